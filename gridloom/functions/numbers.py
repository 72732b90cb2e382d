"""Numbers, dates and scales."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_number(text: Column) -> Column:
    """A double, or null where the text is none."""
    return text.try_cast("double")


def round_half_up(x: Column, digits: int = 6) -> Column:
    """Halves go towards plus infinity."""
    return F.floor(x * 10**digits + 0.5) / F.lit(float(10**digits))


def wrap(x: Column, low: float, high: float, include_high: bool = False) -> Column:
    """x moved by whole widths into [low, high), or [low, high]."""
    width = high - low
    moved = F.pmod(x - low, F.lit(float(width))) + low
    return F.when(x == high, F.lit(float(high))).otherwise(moved) if include_high else moved


def date_label(day: Column, long: bool = False) -> Column:
    return F.date_format(day, "MMMM d, yyyy" if long else "MMM d, yyyy")


def local_midnight_ms(day: Column, zone: str) -> Column:
    """Milliseconds since the epoch at the day's midnight in a time zone."""
    return F.unix_millis(F.to_utc_timestamp(day.cast("timestamp"), zone))


def reading_minutes(n_words: Column, per_minute: int = 200) -> Column:
    return F.ceil(n_words / per_minute)


def scale_at(scales: Column, zoom: Column) -> Column:
    """The scale of a zoom level; between levels linear."""
    low = F.floor(zoom).cast("int")
    base, following = F.get(scales, low), F.get(scales, low + 1)
    return F.when(zoom == low, base).otherwise(base + (following - base) * (zoom - low))


def zoom_at(scales: Column, scale: Column) -> Column:
    """The zoom level of a scale: that of the greatest scale that isn't above it, and linear to the next; minus infinity below the
    first, plus infinity above the last."""
    below = F.array_max(F.filter(scales, lambda s: s <= scale))
    level = (F.array_position(scales, below) - 1).cast("double")
    following = F.get(scales, F.array_position(scales, below).cast("int"))
    between = level + (scale - below) / (following - below)
    return F.when(below.isNull(), F.lit(float("-inf"))).when(scale == below, level).when(following.isNull(), F.lit(float("inf"))).otherwise(between)


def tile_x(lng: Column, zoom: Column | int) -> Column:
    """Fractional column of the tile that holds a longitude."""
    return (lng + 180) / 360 * F.pow(F.lit(2.0), zoom if isinstance(zoom, Column) else F.lit(zoom))


def tile_y(lat: Column, zoom: Column | int) -> Column:
    radians = F.radians(lat)
    return (1 - F.ln(F.tan(radians) + 1 / F.cos(radians)) / F.pi()) / 2 * F.pow(F.lit(2.0), zoom if isinstance(zoom, Column) else F.lit(zoom))


def pixel_range(low: Column, high: Column, size: int) -> tuple[Column, Column]:
    """First pixel and the one after the last that a range of fractions of an axis covers."""
    return F.greatest(F.lit(0), F.floor(low * size)), F.least(F.lit(size), F.ceil(high * size))


def nearest_pixel(position: Column, size: int) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(size - 1), F.floor(position * size)))


def overlaps(low: Column, high: Column, x: Column, x1: Column | None = None) -> Column:
    """Whether [x, x1) or the point x meets [low, high)."""
    return (x < high) & ((x if x1 is None else x1) >= low)
