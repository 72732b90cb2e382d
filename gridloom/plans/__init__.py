"""Named queries over the driver's tables, each with the SQL that gives the same rows where SQL can express it."""

from . import files, maps, more, tables, texts

QUERIES = tables.QUERIES | texts.QUERIES | maps.QUERIES | files.QUERIES | more.QUERIES
ORACLE_SQL = tables.ORACLE_SQL | texts.ORACLE_SQL | maps.ORACLE_SQL | files.ORACLE_SQL | more.ORACLE_SQL
