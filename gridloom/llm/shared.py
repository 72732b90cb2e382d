"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.session import discard, scratch

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Longest word (characters or bytes) that a cache keeps, and rows that a worker turns into Python objects at once.
CACHED_WORD, PART_ROWS = 64, 512
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


class Cache(dict):
    """Fills itself. Holds `most` entries at most: when half of them are new, the older ones that nobody asked for go. Keys longer
    than CACHED_WORD are worked out each time, so the size in bytes is bounded too."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.half, self.old = make, most // 2, {}

    def __missing__(self, key):
        if isinstance(key, (str, bytes)) and len(key) > CACHED_WORD:
            return self.make(key)
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in parts of PART_ROWS rows: a worker holds one batch (bounded in bytes by the session) and the objects of one part."""
    for batch in batches:
        for at in range(0, batch.num_rows, PART_ROWS):
            yield batch.slice(at, PART_ROWS)


def cut(df: DataFrame) -> DataFrame:
    """Write df as a Parquet table in the shared folder (spark.checkpoint.dir) and read it back: later steps don't recompute it, and
    it survives the loss of any executor."""
    path = scratch(df.sparkSession, "cut")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def forget(*frames: DataFrame) -> None:
    """Delete tables that cut() wrote, once nothing reads them any more. A frame may be given twice."""
    for df in frames:
        discard(df.sparkSession, df.cut_path)


def fresh(df: DataFrame) -> str:
    """A prefix that no column of df begins with."""
    prefix = "x_"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix = f"x{prefix}"
    return prefix


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
