"""Mixing sources to target weights.

Each row gets a hash-random key from its id. The keys of a source are cut into equal ranges; sums of sizes per (source, range)
give distributed prefix sums, so that a source's budget falls into one known range. Ranges before it are taken whole, ranges
after it not at all, and only the rows of that one range are sorted. There are as many ranges as the root of the number of rows, so
that neither the ranges of a source nor the rows of a range are many. Budgets above a source's size repeat it for whole epochs
first. The row in which the budget ends is taken in part, so that each source meets its budget to the word.

Sources sort by code point, null last; weights repeat over them. Targets share the total by weight; a target stops at `cap`
times its source's size, and what is left over is shared again by weight until no target is above its cap.

Targets depend on all sources in one order, so one row for each source goes to one task: sources are to be some thousands, as names
of collections are, not one for each document; more than MAX_SOURCES are an error. Texts of any length are read whole, only their
number of words is kept.

Nulls: a null source is a source, a null id has one key, a null text has size 0. Rows of size 0 take nothing. Rows that are
equal share a key; which of them is cut doesn't show. An empty table gives no rows; other columns pass through.
All DataFrame functions; no Python on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import cut, n_words


#: Sources at most.
MAX_SOURCES = 1_000_000


def share_targets(sizes: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """source, source_size -> source, source_size, target. One row per source."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(order) - 1
    ranked = sizes.withColumn("k", F.when(place < MAX_SOURCES, place).otherwise(F.raise_error(F.lit(f"more than {MAX_SOURCES} sources")).cast("int"))).withColumn("w", F.get(F.array(*map(F.lit, weights)), F.col("k") % len(weights)).cast("long"))
    ranked = ranked.withColumns({"most": F.col("source_size") * cap, "ratio": F.col("source_size") * cap / F.col("w").cast("double")})
    by_ratio, everything = W.orderBy("ratio", "k"), W.partitionBy()
    ranked = ranked.withColumns(
        {
            "total": F.sum("source_size").over(everything),
            "before": F.coalesce(F.sum("most").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
            "left": F.sum("w").over(by_ratio.rowsBetween(0, W.unboundedFollowing)),
        }
    )
    # fills up if, with those of a lower cap for its weight filled up, its share of the rest is still above its cap
    capped = ranked.withColumn("full", (F.col("total") - F.col("before")) / F.col("left").cast("double") > F.col("ratio"))
    rest = (F.col("total") - F.sum(F.when(F.col("full"), F.col("most")).otherwise(0)).over(everything)).cast("double") / F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(everything)
    return capped.select("source", "source_size", F.when(F.col("full"), F.col("most").cast("double")).otherwise(rest * F.col("w")).alias("target"))


def mix(rows: DataFrame, size: Column, id_col: str = "doc_id", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, ranges: int | None = None) -> DataFrame:
    """A struct `row` of each row's columns, with size, source_size, target (its source's) and taken (words the mix takes)."""
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    keyed = rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row"), F.col(source_col).alias("source"), F.coalesce(size, F.lit(0)).cast("long").alias("size"), key.alias("key"))
    ranges = ranges or max(1, int(rows.count() ** 0.5))
    keyed = keyed.withColumn("range", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / 2**32 * ranges).cast("long"))
    sums = cut(keyed.groupBy("source", "range").agg(F.sum("size").alias("size")))
    targets = share_targets(sums.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
    budget = F.floor("target").cast("long")
    targets = targets.withColumn("epochs", F.when(F.col("source_size") == 0, F.lit(0)).otherwise(F.floor(budget / F.greatest("source_size", F.lit(1)))).cast("long"))
    targets = targets.withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
    prefix = sums.withColumn("before", F.sum("size").over(W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
    prefix = prefix.withColumnsRenamed({"source": "s"})
    plan = cut(
        targets.join(prefix, F.col("s").eqNullSafe(F.col("source")) & (F.col("before") <= F.col("rest")) & (F.col("before") + F.col("size") > F.col("rest")), "left").select(
            F.col("source").alias("s"), "source_size", "target", "epochs", "rest", F.coalesce("range", F.lit(0)).alias("last"), F.coalesce("before", F.lit(0)).alias("before")
        )
    )  # one row per source; Spark broadcasts it if its files are below the session's threshold
    planned = keyed.join(plan, F.col("s").eqNullSafe(F.col("source")))
    out = lambda df, last: df.select("row", "size", "source_size", "target", (F.col("epochs") * F.col("size") + last).alias("taken"))
    others = out(planned.where("range != last"), F.when(F.col("range") < F.col("last"), F.col("size")).otherwise(0))
    sorted_in = W.partitionBy("s").orderBy("key", "size").rowsBetween(W.unboundedPreceding, 0)
    cutting = planned.where("range = last").withColumn("upto", F.col("before") + F.sum("size").over(sorted_in))
    cutting = out(cutting, F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("upto") + F.col("size"))))
    return others.unionByName(cutting)


def materialize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", n_chars_col: str | None = None, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """The mix itself: each row of docs as often as the mix takes it whole, and the one text in which a source's budget ends once
    more, up to the last word taken (n_chars_col is then set to its length). Texts without words take no part."""
    mixed = mix(docs, n_words(F.col(text_col)), id_col, source_col, weights, cap).where("taken > 0")
    copies = mixed.withColumn("part", F.explode(F.concat(F.array_repeat(F.lit(0).cast("long"), F.floor(F.col("taken") / F.col("size")).cast("int")), F.when(F.col("taken") % F.col("size") > 0, F.array(F.col("taken") % F.col("size"))).otherwise(F.array().cast("array<bigint>")))))
    text = F.col(f"row.`{text_col}`")
    # a word with the white space before it, so that joining the first of them gives the text's beginning
    begun = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), F.col("part").cast("int")), "")
    columns = {c: F.col(f"row.`{c}`") for c in docs.columns}
    columns[text_col] = F.when(F.col("part") == 0, text).otherwise(begun)
    if n_chars_col is not None:
        columns[n_chars_col] = F.when(F.col("part") == 0, columns[n_chars_col]).otherwise(F.length(begun).cast("long"))
    return copies.select(*(v.alias(k) for k, v in columns.items()))
