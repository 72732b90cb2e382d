"""Document fingerprints by one-permutation MinHash.

A text's shingles (five words; with fewer words all of them as one) are hashed once. The upper bits of a hash name its bin, and
each bin keeps the least of the lower bits. An empty bin takes the value of the first filled bin in a pseudo-random order of its
own (optimal densification). The fingerprint packs the BITS lowest bits of each bin as hexadecimal digits. Of two fingerprints
with a share m of equal bins the estimate is (m - c) / (1 - c) with c = 2^-BITS, the chance of equal bits in unequal bins.

A null text counts as empty. A text without words has an empty fingerprint: alike to its like (1), to all others 0. Equal texts, so
repeated rows too, have equal fingerprints. Texts of any length are read whole: a task holds the hashes of one text, and sorts them,
as a fold into bins by array functions would copy all bins for each shingle. Extra columns of any name pass through. An empty table
gives no rows. All DataFrame functions; no Python on the executors.
"""

from __future__ import annotations

import json
import random
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import cut, fresh

BINS, BITS, SHINGLE = 256, 8, 5
_LOW = 64 - (BINS.bit_length() - 1)
_EMPTY = (1 << _LOW) - 1
#: Bins that an empty bin tries before it goes through all.
PROBES = 32
#: Ranges that with_next() cuts a table into, at most (and as many for null ids): 16 bytes for each are broadcast.
MAX_RANGES = 1 << 16


def _literal(value, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), kind)


def _probes() -> list[list[int]]:
    out = []
    for b in range(BINS):
        order = list(range(BINS))
        random.Random(b).shuffle(order)
        out.append(order)
    return out


def with_fingerprint(df: DataFrame, text_col: str, name: str) -> DataFrame:
    """Adds `name`, an array of BINS small integers, or an empty one for a text without words."""
    prefix = fresh(df)
    a, b, c, d, e = (f"{prefix}{x}" for x in "abcde")
    out = df.withColumn(a, F.filter(F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", -1), lambda w: w != ""))
    out = out.withColumn(b, F.transform(a, lambda w: F.xxhash64(w)))
    n = F.size(b)
    out = out.withColumn(c, F.when(n >= SHINGLE, F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(*(F.get(b, i + k) for k in range(SHINGLE))))).when(n > 0, F.array(F.xxhash64(b))).otherwise(F.array().cast("array<bigint>")))
    # one value for each bin that any hash of the bin is below: after sorting, the first of each bin is its least hash, or that
    ends = _literal([(x << _LOW | _EMPTY) - (1 << 64 if x >= BINS // 2 else 0) for x in range(BINS)], "array<bigint>")
    out = out.withColumn(d, F.sort_array(F.concat(F.col(c), ends)))
    bin_of = lambda h: F.shiftrightunsigned(h, _LOW)
    out = out.withColumn(d, F.filter(d, lambda h, i: (i == 0) | (bin_of(h) != bin_of(F.get(d, i - 1)))))
    full = lambda h: h.bitwiseAND(F.lit(_EMPTY)) != F.lit(_EMPTY)
    probes = _literal(_probes(), "array<array<int>>")
    found = lambda order: F.get(F.filter(order, lambda j: full(F.get(d, j))), F.lit(0))
    filled = F.transform(d, lambda h, i: F.when(full(h), h).otherwise(F.get(d, F.coalesce(found(F.slice(F.get(probes, i), 1, PROBES)), found(F.get(probes, i))))))
    out = out.withColumn(e, F.when(F.size(c) == 0, F.array().cast("array<bigint>")).when(F.forall(d, full), F.col(d)).otherwise(filled))
    return out.withColumn(name, F.transform(e, lambda h: h.bitwiseAND(F.lit((1 << BITS) - 1)).cast("smallint"))).drop(a, b, c, d, e)


def pack(fingerprint: Column) -> Column:
    digits = _literal([f"{x:0{BITS // 4}x}" for x in range(1 << BITS)], "array<string>")
    return F.array_join(F.transform(fingerprint, lambda x: F.get(digits, x.cast("int"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets, 0 to 1."""
    by_chance = 2.0**-BITS
    share = F.size(F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.get(a, i) == F.get(b, i))) / F.lit(float(BINS))
    both = F.greatest(F.lit(0.0), (share - by_chance) / (1 - by_chance))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), ((F.size(a) == 0) & (F.size(b) == 0)).cast("double")).otherwise(both)


def with_next(df: DataFrame, id_col: str, columns: list[str], range_rows: int = 250, bounds: int = 64, prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Adds next_<c> for each of the columns: that of the next row in descending order of id_col (integers, null last; of equal
    ids and null ones the order is that of the first column's hash), after the last row that of the first.

    Rows go to ranges of ids of about range_rows rows, MAX_RANGES at most: by `bounds` quantiles, in each of them by `bounds` quantiles
    again, and in these evenly by value; rows with a null id go by their hash. There are many more ranges than partitions, so that
    partitions are alike in size. A row that is the first of its range is also sent to the range before, so no step needs all rows in
    one task, but rows that share an id do go to one range. prepare adds columns to the rows once it is known where they go; `columns`
    may name them, except the first.
    """
    x = fresh(df)
    k, t, r, outer, inner, edge, following = (f"{x}{c}" for c in ("k", "t", "r", "o", "i", "edge", "next"))
    number = F.col(id_col).cast("long")
    keyed = df.withColumns({k: F.coalesce(number, F.lit(-(1 << 63))), t: F.xxhash64(columns[0])})
    rows = df.count()
    n = max(1, min(MAX_RANGES, rows // range_rows))
    n_outer = min(bounds, n)
    n_inner = min(bounds, -(-n // n_outer))
    split = max(1, n // (n_outer * n_inner))
    middle = lambda found: sorted(set(found[1:-1]))
    shares = lambda n: [i / n for i in range(n + 1)]
    found = df.select(F.percentile_approx(number, shares(n_outer), 10 * bounds)).first()[0] or [0, 0]
    above = lambda edges: F.size(F.filter(edges, lambda v: F.col(k) > v))
    keyed = keyed.withColumn(outer, above(_literal(middle(found), "array<bigint>")))
    found = dict(keyed.where(number.isNotNull()).groupBy(outer).agg(F.percentile_approx(k, shares(n_inner), 10 * bounds)).collect())  # a row for each outer range
    found = [found.get(i, [0, 0]) for i in range(n_outer)]
    keyed = keyed.withColumn(inner, above(F.get(_literal([middle(v) for v in found], "array<array<bigint>>"), outer)))
    ends = _literal([[v[0], *middle(v), v[-1]] for v in found], "array<array<bigint>>")
    low, high = (F.get(F.get(ends, outer), F.col(inner) + at).cast("double") for at in (0, 1))
    share = (F.col(k).cast("double") - low) / F.greatest(F.lit(1.0), high - low)
    place = (F.col(outer).cast("long") * (n_inner + 1) + F.col(inner)) * split + F.least(F.lit(split - 1), F.greatest(F.lit(0), F.floor(share * split)))
    by_hash = F.least(F.lit(n - 1), F.floor((F.col(t).cast("double") / 2.0**64 + 0.5) * n)) - n
    keyed = keyed.withColumn(r, F.when(number.isNull(), by_hash).otherwise(place).cast("long")).drop(outer, inner)
    firsts = cut(keyed.groupBy(r).agg(F.max(F.struct(F.col(k).alias("k"), F.col(t).alias("t"))).alias("m")))
    order = W.orderBy(F.desc(r))  # a row for each range
    sends = cut(firsts.select("m.k", "m.t", F.coalesce(F.lag(r).over(order), F.min(r).over(W.partitionBy())).alias("to")).select(*(F.col(c).alias(f"{x}{c}_") for c in ("k", "t", "to"))))
    whole = keyed.withColumn(edge, F.lit(False))
    sent = whole.join(F.broadcast(sends), (F.col(k) == F.col(f"{k}_")) & (F.col(t) == F.col(f"{t}_"))).dropDuplicates([f"{x}to_"])
    sent = prepare(sent.withColumns({r: F.col(f"{x}to_"), edge: F.lit(True)}).drop(f"{k}_", f"{t}_", f"{x}to_"))
    whole = prepare(whole)
    w = W.partitionBy(r).orderBy(edge, F.desc(k), F.desc(t))
    led = whole.unionByName(sent).withColumn(following, F.lead(F.struct(*columns)).over(w)).where(~F.col(edge))
    return led.withColumns({f"next_{c}": F.col(f"{following}.{c}") for c in columns}).drop(k, t, r, edge, following)
