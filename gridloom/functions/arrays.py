"""Arrays, maps and JSON."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_array(value: Column) -> Column:
    return F.array(value)


def recycle(items: Column, n: Column | int) -> Column:
    """items repeated, or cut, to length n; empty if n is 0."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.when(n <= 0, F.slice(items, 1, 0)).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(items, i % F.size(items))))


def columns_to_rows(**columns: Column) -> Column:
    """Arrays of one length as an array of structs; an error where lengths differ."""
    sizes = F.array(*(F.size(c) for c in columns.values()))
    same = F.array_min(sizes) == F.array_max(sizes)
    return F.when(same, F.arrays_zip(*(c.alias(k) for k, c in columns.items()))).otherwise(F.raise_error(F.lit("columns differ in length")))


def transpose(rows: Column) -> Column:
    """Columns of an array of equally long arrays; of no rows, no columns."""
    width = F.when(F.size(rows) > 0, F.size(F.get(rows, 0))).otherwise(0)
    return F.when(width > 0, F.transform(F.sequence(F.lit(0), width - 1), lambda j: F.transform(rows, lambda r: F.get(r, j)))).otherwise(F.slice(rows, 1, 0))


def decode_dictionary(data: Column, index: Column) -> Column:
    """The value of each index (from 0)."""
    return F.transform(index, lambda i: F.get(data, i))


def merge_options(*maps: Column) -> Column:
    """One map; of equal keys the later map's value counts. Null maps are empty."""
    empty = F.from_json(F.lit("{}"), "map<string,string>")
    given = [F.coalesce(m, empty) for m in maps]
    over = lambda a, b: F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)
    return reduce(over, given)


def toggle(items: Column, value: Column) -> Column:
    return F.when(F.array_contains(items, value), F.array_remove(items, value)).otherwise(F.array_append(items, value))


def index_of(items: Column, value: Column) -> Column:
    """Place from 0; -1 if it isn't there."""
    return F.array_position(items, value) - 1


def depth_is_flat(coordinates_json: Column) -> Column:
    """Whether a JSON array of coordinates holds points (not arrays of points)."""
    return ~F.regexp_like(coordinates_json, F.lit(r"^\s*\[\s*\[\s*\["))


def parse_hash(text: Column) -> Column:
    """k=v&k=v as a map; segments that don't split into two parts are left out, of equal keys the last counts."""
    pairs = F.filter(F.transform(F.split(F.regexp_replace(text, "^#", ""), "&", -1), lambda s: F.split(s, "=", -1)), lambda p: F.size(p) == 2)
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.lit(0), F.size(pairs) - i - 1)), lambda q: F.get(q, 0) == F.get(p, 0)))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(F.get(p, 0).alias("key"), F.get(p, 1).alias("value"))))


def write_hash(state: Column) -> Column:
    return F.array_join(F.transform(F.map_entries(state), lambda e: F.concat(e.key, F.lit("="), e.value)), "&")
