"""Continuous colours and legends."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A nine-colour sequential palette, light to dark.
YELLOW_TO_RED = ["#ffffcc", "#ffeda0", "#fed976", "#feb24c", "#fd8d3c", "#fc4e2a", "#e31a1c", "#bd0026", "#800026"]
MISSING = "#808080"


def color_at(value: Column, low: Column, high: Column, colors: list[str] = YELLOW_TO_RED, missing: str = MISSING) -> Column:
    """Colour of a value on the domain low to high, linear in red, green and blue; `missing` for null and outside."""
    steps = len(colors) - 1
    share = F.when(high > low, (value - low) / (high - low)).when(value == low, F.lit(0.0))
    at = F.least(F.floor(share * steps), F.lit(steps - 1)).cast("int")
    part = share * steps - at

    def channel(k: int) -> Column:
        ends = F.array(*(F.lit(int(c[1 + 2 * k : 3 + 2 * k], 16)) for c in colors))
        mixed = F.floor(F.get(ends, at) + (F.get(ends, at + 1) - F.get(ends, at)) * part + 0.5)
        return F.lpad(F.lower(F.hex(mixed.cast("long"))), 2, "0")

    return F.when((share >= 0) & (share <= 1), F.concat(F.lit("#"), channel(0), channel(1), channel(2))).otherwise(F.lit(missing))


def legend_ticks(labels: Column, p_1: Column, p_n: Column, bin_height: float = 20.0) -> Column:
    """Array of structs label, y: where each label stands beside a gradient whose first and last tick lie at shares p_1, p_n."""
    share = (p_n - p_1) / (F.size(labels) - 1)
    offset = bin_height / share * p_1
    return F.transform(labels, lambda label, i: F.struct(label.alias("label"), (offset + i * bin_height + 0.5).alias("y")))


def gradient_height(labels: Column, p_1: Column, p_n: Column, bin_height: float = 20.0) -> Column:
    return bin_height / ((p_n - p_1) / (F.size(labels) - 1)) + 1


def legend_entries(labels: Column, colors: Column, na_label: Column, na_color: Column) -> Column:
    """Array of structs label, color; an entry for missing values unless there is no colour or the label is there already."""
    given = F.arrays_zip(labels.alias("label"), colors.alias("color"))
    added = na_color.isNotNull() & ~F.array_contains(labels, na_label)
    return F.when(added, F.array_append(given, F.struct(na_label.alias("label"), na_color.alias("color")))).otherwise(given)
