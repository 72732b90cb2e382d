"""URL filter: longest rule first, then exact membership in a blocklist through a cascade of Bloom filters.

Keys are hosts and the domains above them. Level 1 holds the listed keys; level 2 the keys of the corpus that level 1 takes for
listed though they are not; level 3 the listed keys that level 2 takes for false positives; and so on until a level errs on
no key. As the levels are built over *all* keys that the corpus holds, looking a key up is exact, and a scan needs no join:
each level is one array of 64-bit words that travels with the plan. Its size is known before it is built (BITS per key of the
level) and must be at most MAX_LEVEL_BYTES; a level that needs more raises an error before anything is collected.

Building takes one distinct pass over the keys and a small pass for each level (each level is some hundred times smaller than
the one before the last). All DataFrame functions; no Python on the executors.

Nulls: a null url, or one without ://, has an empty host and path, fits no rule and is allowed. Repeated urls and extra columns
make no difference; of rules of one length that fit, the last by host, path and verdict counts; an empty table or blocklist gives no
rows or no blocks. Urls of any length are read whole; a host is cut at its dots within its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import ascii_lower, cut

#: Bits for each key of a level, and hash functions: about 1 false positive in 120.
BITS, HASHES = 10, 7
MAX_LEVEL_BYTES = 16 << 20
#: A build that did not end after so many levels is an error.
MAX_LEVELS = 64


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def domains_of(host: Column) -> Column:
    """The host and all domains above it, none for an empty host."""
    labels = F.split(host, r"\.", -1)
    n = F.size(labels)
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), ".")))


def match_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct rule, verdict of the longest of (host, path, verdict) that fits; null if none fits."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


class BloomLevel:
    """One filter: `words` 64-bit words of bits."""

    def __init__(self, keys: DataFrame, n: int, level: int):
        self.words, self.level = max(1, -(-n * BITS // 64)), level
        if self.words * 8 > MAX_LEVEL_BYTES:
            raise ValueError(f"level {level} needs {self.words * 8} bytes for {n} keys; the bound is {MAX_LEVEL_BYTES}")
        halves = keys.select(self._halves(F.col("key")).alias("halves"))
        words = halves.select(F.explode(F.array(*(self._bit(F.col("halves"), i) for i in range(HASHES)))).alias("bit")).groupBy(F.shiftright("bit", 6).cast("int").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("word"))
        rows = {r.at: r.word for r in words.collect()}  # at most self.words rows
        self.filled = F.from_json(F.lit(str([rows.get(i, 0) for i in range(self.words)])), "array<bigint>")

    def _halves(self, key: Column) -> Column:
        return F.struct(*(F.shiftrightunsigned(F.xxhash64(key, F.lit(2 * self.level + k)), 8).alias(c) for k, c in enumerate("ab")))  # 56 bits: sums stay in range

    def _bit(self, halves: Column, i: int) -> Column:
        return F.pmod(halves.a + halves.b * F.lit(i), F.lit(self.words * 64).cast("long"))

    def holds(self, key: Column) -> Column:
        """Whether all bits of a key are set. The filter stands in this expression once."""
        bits = lambda halves: F.array(*(self._bit(halves, i) for i in range(HASHES)))
        is_set = lambda bit: F.getbit(F.get(self.filled, F.shiftright(bit, 6).cast("int")), bit.bitwiseAND(63).cast("int")) == 1
        return F.forall(F.array(self._halves(key)), lambda halves: F.forall(bits(halves), is_set))


def build_cascade(universe: DataFrame, listed: DataFrame) -> list[BloomLevel]:
    """Levels that tell the listed keys from the other keys of the universe. Both have a column key."""
    keys = cut(
        universe.select("key", F.lit(False).alias("listed")).unionByName(listed.select("key", F.lit(True).alias("listed"))).where(F.col("key").isNotNull()).groupBy("key").agg(F.max("listed").alias("listed"))
    )
    levels: list[BloomLevel] = []
    inside, others = keys.where("listed"), keys.where("not listed")
    n = inside.count()
    while n:
        if len(levels) == MAX_LEVELS:
            raise ValueError("the cascade does not end")
        levels.append(BloomLevel(inside, n, len(levels)))
        inside, others = others.where(levels[-1].holds(F.col("key"))), inside
        n = inside.count()
    return levels


def in_cascade(key: Column, levels: list[BloomLevel]) -> Column:
    """Whether a key of the universe is listed: it is if the first level that lacks it has an even number (from 1), or if all
    levels have it and there is an odd number of them."""
    out = F.lit(len(levels) % 2 == 1)
    for k in range(len(levels) - 1, -1, -1):
        out = F.when(levels[k].holds(key), out).otherwise(F.lit(k % 2 == 1))
    return out


def read_blocklist(spark: SparkSession, path: str) -> DataFrame:
    """key: one listed host or domain for each line of a text file; blank lines and those that begin with # don't count."""
    line = F.trim(F.col("value"))
    return spark.read.text(path).select(line.alias("key")).where((line != "") & ~line.startswith("#")).distinct()


def filter_urls(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id_col, host, path, rule, verdict for each row. listed: a column key of blocked hosts and domains (with all subdomains)."""
    rows = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    universe = rows.select("host").distinct().select(F.explode(domains_of(F.col("host"))).alias("key"))
    levels = build_cascade(universe, listed.select(ascii_lower(F.col("key")).alias("key")))
    blocked = F.exists(domains_of(F.col("host")), lambda d: in_cascade(d, levels)) if levels else F.lit(False)
    judged = rows.withColumn("fit", match_rule(F.col("host"), F.col("path"), rules))
    return judged.select(
        F.col("id").alias(id_col), "host", "path", F.col("fit.rule").alias("rule"), F.coalesce(F.col("fit.verdict"), F.when(blocked, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict")
    )
