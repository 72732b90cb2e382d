"""Deletes runs of lines that repeat earlier ones, by winnowing.

A text is cut at newlines. Lines without a word are passed over. Each line starts a *gram*: itself and as many following lines as
it takes to reach GRAM_WORDS words. For each line at which RUN_WORDS words begin, the gram of least hash among those that lie
within these words is a fingerprint. So two texts that share a run of lines of RUN_WORDS words or more surely share a fingerprint,
and a shared fingerprint is a shared run of GRAM_WORDS words or more.

Places are ordered by id (null last), then by line. A place of a fingerprint that has an earlier place is a match, and is extended
both ways for as long as the lines agree *along that earlier place*: the gram together with the next one, two, ... lines is a key of
its own, and so it is with the lines before, so a join with the first place of each key says how far the longest extension along
any earlier place goes, without pairs of places. What a match and its extensions cover is deleted, blank lines inside included;
first places stay. Extensions end where RUN_WORDS words are reached, as beyond these a fingerprint of the same run matches.

Every repeat of RUN_WORDS words or more is deleted, whatever stands around it; nothing is deleted but lines of a run that stood at
one earlier place as a whole and holds a gram of GRAM_WORDS words or more. A run that overlaps its own repeat (a line over and over)
counts as repeated from its second line on. Lines are compared by 64-bit hashes.

Nulls: a null text stays null. Rows that are equal count as one document and keep the same text. Other columns, whatever their names,
pass through unchanged but `n_chars_col`, if given. An empty table gives no rows. Very long texts: the work grows with the number of
lines, a task holds one text's lines at a time. No step needs all places of a line in one task. All DataFrame functions; no Python
on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import WORD, cut, forget

GRAM_WORDS, RUN_WORDS = 30, 50
_KEYS = "array<struct<key:bigint,lo:int,hi:int>>"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _reach(k: Column) -> Column:
    """gram, run: how many lines from the k-th on it takes to reach so many words (each has one at least); null if they end before."""
    fewer = lambda acc, words: F.when(acc.w < words, 1).otherwise(0)
    return F.aggregate(
        F.slice("lines", k + 1, RUN_WORDS),
        F.struct(F.lit(0).alias("w"), F.lit(0).alias("gram"), F.lit(0).alias("run")),
        lambda acc, x: F.struct((acc.w + x.w).alias("w"), (acc.gram + fewer(acc, GRAM_WORDS)).alias("gram"), (acc.run + fewer(acc, RUN_WORDS)).alias("run")),
        lambda acc: F.struct(F.when(acc.w >= GRAM_WORDS, acc.gram).alias("gram"), F.when(acc.w >= RUN_WORDS, acc.run).alias("run")),
    )


def _extended(lines: Column, start: Column, at: Column, ahead: bool) -> Column:
    """A key for each of the lines: of them up to it, on from the hash `start` and the line number `at`; and the lines that it adds."""
    add = lambda acc, x: F.struct(F.xxhash64(acc.h, x.h).alias("key"), (acc.at if ahead else x.i).alias("lo"), (x.i if ahead else acc.at).alias("hi"))
    return F.aggregate(
        lines,
        F.struct(start.alias("h"), at.alias("at"), F.array().cast(_KEYS).alias("out")),
        lambda acc, x: F.struct(F.xxhash64(acc.h, x.h).alias("h"), x.i.alias("at"), F.concat(acc.out, F.array(add(acc, x))).alias("out")),
        lambda acc: acc.out,
    )


def places(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row for each fingerprint: id, th (hash of the text), k (number of its first line among those with a word), key (its hash), lo
    and hi (its first and last line among all lines), more (structs of the same three for each extension)."""
    text = F.col(text_col).cast("string")
    out = docs.where(text.isNotNull()).select(
        F.col(id_col).alias("id"),
        F.xxhash64(text).alias("th"),
        F.filter(F.transform(_lines(text), lambda x, i: F.struct(i.alias("i"), F.xxhash64(x).alias("h"), F.regexp_count(x, F.lit(WORD)).alias("w"))), lambda x: x.w > 0).alias("lines"),
    )
    numbers = F.when(F.size("lines") > 0, F.sequence(F.lit(0), F.size("lines") - 1)).otherwise(F.array().cast("array<int>"))
    # Every array that a function is called on for each line is used twice at least: else the optimizer would put its expression
    # into that function, and it would be worked out anew for each line.
    out = out.withColumn("reach", F.transform(numbers, _reach))
    gram = lambda r, k: F.struct(F.when(r.gram.isNotNull(), F.xxhash64(F.transform(F.slice("lines", k + 1, r.gram), lambda x: x.h))).alias("g"), k.alias("k"), (k + r.gram).alias("end"))
    out = out.withColumn("grams", F.transform("reach", gram))
    least = lambda r, k: F.array_min(F.filter(F.slice("grams", k + 1, F.coalesce(r.run, F.lit(0))), lambda x: x.end <= k + r.run)).k
    out = out.withColumn("chosen", F.filter(F.array_distinct(F.transform("reach", least)), lambda k: k.isNotNull()))

    def row(k: Column) -> Column:
        g, end = F.get("grams", k).g, F.get("grams", k).end
        lo, hi = F.get("lines", k).i, F.get("lines", end - 1).i
        # ahead: lines before which fewer than RUN_WORDS words stand, from the gram's second line on
        ahead = F.slice("lines", end + 1, F.greatest(F.lit(0), F.coalesce(F.get("reach", k + 1).run, F.lit(RUN_WORDS)) - (end - k) + 1))
        # back: lines after which fewer than RUN_WORDS words stand, up to the gram's last but one line
        since = F.greatest(F.lit(0), k - RUN_WORDS)
        far = F.size(F.filter(F.slice("reach", since + 2, k - since), lambda r, j: F.coalesce(since + 1 + j + r.run <= end - 1, F.lit(False))))
        back = F.reverse(F.slice("lines", since + far + 1, k - since - far))
        more = F.concat(_extended(ahead, F.xxhash64(F.lit(1), g), hi, True), _extended(back, F.xxhash64(F.lit(-1), g), lo, False))
        return F.struct(k.alias("k"), g.alias("key"), lo.alias("lo"), hi.alias("hi"), more.alias("more"))

    return out.select("id", "th", F.inline(F.transform("chosen", row)))


_PLACE = ("id is null", "id", "th", "k")


def _repeated(found: DataFrame) -> DataFrame:
    """The rows whose key has several places, with later: whether theirs is not the first."""
    place = F.struct(*(F.expr(x).alias(f"o{k}") for k, x in enumerate(_PLACE)))
    first = found.groupBy("key").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first != last").select("key", "first")
    return found.join(first, "key").withColumn("later", place > F.col("first")).drop("first")


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, th, runs for each text that repeats earlier lines: array of structs lo, hi, lines (from 0) that repeat. They may overlap."""
    found = cut(places(docs, id_col, text_col))
    matches = cut(_repeated(found))
    forget(found)
    extensions = _repeated(matches.select("id", "th", "k", F.inline("more")))
    runs = matches.where("later").select("id", "th", "lo", "hi").unionByName(extensions.where("later").select("id", "th", "lo", "hi"))
    return runs.groupBy("id", "th").agg(F.collect_set(F.struct("lo", "hi")).alias("runs"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_chars_col: str | None = None, n_deleted_col: str | None = None) -> DataFrame:
    """docs with the repeated runs deleted from text_col; n_chars_col is set to its new length; n_deleted_col, if given, is added:
    the number of deleted lines."""
    names = [f"c{k}" for k in range(len(docs.columns))]  # columns may have any names
    name = dict(zip(docs.columns, names, strict=True))
    text = F.col(name[text_col]).cast("string")
    rows = docs.toDF(*names).select(F.struct(*names).alias("row"), F.col(name[id_col]).alias("id"), text.alias("text"), F.xxhash64(text).alias("hash"))
    runs = repeated_runs(docs.toDF(*names), name[id_col], name[text_col]).withColumnsRenamed({"id": "of"})
    both = rows.join(runs, (F.col("hash") == F.col("th")) & F.col("id").eqNullSafe(F.col("of")) & F.col("text").isNotNull(), "left")
    both = both.withColumn("lines", F.when(F.col("runs").isNotNull(), _lines(F.col("text"))))
    gone = F.flatten(F.transform("runs", lambda r: F.sequence(r.lo, r.hi)))
    both = both.withColumn("left", F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), gone))
    kept = F.when(F.col("runs").isNull(), F.col("text")).otherwise(F.array_join(F.transform("left", lambda i: F.get("lines", i)), "\n"))
    both = both.select("row", kept.alias("kept"), F.coalesce(F.size("lines") - F.size("left"), F.lit(0)).cast("long").alias("deleted"))
    columns = {c: F.col(f"row.{n}") for c, n in name.items()}
    columns[text_col] = F.col("kept")
    if n_chars_col is not None:
        columns[n_chars_col] = F.length("kept").cast("long")
    if n_deleted_col is not None:
        columns[n_deleted_col] = F.col("deleted")
    return both.select(*(v.alias(k) for k, v in columns.items()))
