"""Filters, projections, joins, unions and reshaping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.session import scratch


def recode(column: Column, mapping: dict[str, str]) -> Column:
    """Exact matches replaced; all else, null included, stays."""
    if not mapping:
        return column
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.coalesce(F.get(F.map_values(F.map_filter(F.create_map(*pairs), lambda k, _: k == column)), 0), column)


def numeric_only(df: DataFrame, *columns: str) -> DataFrame:
    """Rows whose columns all hold numbers, cast to double; the others go."""
    cast = df.withColumns({c: F.col(c).cast("string").try_cast("double") for c in columns})
    return cast.where(reduce(lambda a, b: a & b, (F.col(c).isNotNull() & ~F.isnan(c) for c in columns)))


def in_category(categories: Column, category: str) -> Column:
    """Whether a row's categories hold the given one; everything fits an empty one; no categories fit none."""
    return F.lit(True) if category == "" else F.coalesce(F.array_contains(categories, category), F.lit(False))


def rename_present(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns renamed from the map's values to its keys, where they are there and differ."""
    for new, old in names.items():
        if old in df.columns and old != new:
            df = df.drop(new).withColumnRenamed(old, new) if new in df.columns else df.withColumnRenamed(old, new)
    return df


def keep_selected(df: DataFrame, key: str, selected: DataFrame | None) -> DataFrame:
    """Rows whose key is selected; all rows if there is no selection."""
    return df if selected is None else df.join(selected.select(F.col(selected.columns[0]).alias(key)).distinct(), key, "left_semi")


def highlight_selected(df: DataFrame, key: str, selected: DataFrame | None, opacity: Column, faint: float = 0.2) -> DataFrame:
    """Adds shown_opacity: the opacity of selected rows, a part of it for the others; unchanged without or with an empty selection."""
    if selected is None:
        return df.withColumn("shown_opacity", opacity.cast("double"))
    keys = selected.select(F.col(selected.columns[0]).alias("__key")).where(F.col("__key").isNotNull()).distinct().withColumn("__hit", F.lit(True))
    some = keys.select(F.lit(True).alias("__some")).limit(1)
    out = df.join(keys, F.col(key) == F.col("__key"), "left").join(some, F.lit(True), "left")
    return out.withColumn("shown_opacity", opacity * F.when(F.col("__some").isNull() | F.col("__hit"), 1.0).otherwise(faint)).drop("__key", "__hit", "__some")


def visible_at(zoom_levels: Column, zoom: int, visible: Column) -> Column:
    """A group's visibility at a zoom level: true for all levels is an empty array; null leaves it as it is."""
    return F.when(zoom_levels.isNull(), visible).when(F.size(zoom_levels) == 0, True).otherwise(F.array_contains(zoom_levels, zoom))


def require_fields(df: DataFrame, *columns: str) -> DataFrame:
    """An error as soon as a row lacks one of the columns' values."""
    for c in columns:
        if c not in df.columns:
            raise ValueError(f"column {c} is missing")
        df = df.withColumn(c, F.when(F.col(c).isNotNull(), F.col(c)).otherwise(F.raise_error(F.lit(f"{c} is missing in a row")).cast(df.schema[c].dataType)))
    return df


def get_cell(df: DataFrame, order: list[str], row: int, *columns: str) -> DataFrame:
    """Values of a row by its number (from 0) and their columns; an error if one isn't there, no row if the number isn't."""
    for column in columns:
        if column not in df.columns:
            raise ValueError(f"column {column} is missing")
    return df.orderBy(*order).offset(row).limit(1).select(*columns)


def present(df: DataFrame, *columns: str) -> DataFrame:
    """Rows in which all of the columns have a value: layers that a row function left empty are passed over."""
    return df.where(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in columns)))


def union_by_name(*frames: DataFrame) -> DataFrame:
    """All rows; columns go by name, missing ones are null; types that don't fit are an error."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def left_join_missing_equal(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """All left rows with the right columns; null keys match each other; the right key goes; other names on both sides get .x, .y."""
    both = [c for c in right.columns if c in left.columns and c != right_key]
    a = left.withColumnsRenamed({c: f"{c}.x" for c in both if c != left_key})
    b = right.withColumnsRenamed({c: f"{c}.y" for c in both}).withColumnRenamed(right_key, "__key")
    return a.join(b, F.col(f"`{left_key}`").eqNullSafe(F.col("__key")), "left").drop("__key")


def pivot_wide(df: DataFrame, id_col: str, name_col: str, value_col: str, names: list, prefix: str = "", strict: bool = True) -> DataFrame:
    """One row for each id, one column for each of the given names. strict: several values for one cell are an error; else the
    greatest counts."""
    value = F.max(value_col)
    if strict:
        value = F.when(F.count(value_col) > 1, F.raise_error(F.lit(f"several values of {value_col} for one cell")).cast(df.schema[value_col].dataType)).otherwise(value)
    out = df.groupBy(id_col).pivot(name_col, names).agg(value)
    return out.withColumnsRenamed({str(n): f"{prefix}{n}" for n in names})


def domain(df: DataFrame, *columns: str) -> DataFrame:
    """low and high over several columns, missing values left out."""
    return df.agg(F.least(*(F.min(c) for c in columns)).alias("low"), F.greatest(*(F.max(c) for c in columns)).alias("high")) if len(columns) > 1 else df.agg(F.min(columns[0]).alias("low"), F.max(columns[0]).alias("high"))


def stacked(df: DataFrame, *columns: str) -> DataFrame:
    """The values of several columns below each other: name, value."""
    return df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in columns))).alias("s")).select("s.name", "s.value")


def facets(df: DataFrame, categories: str) -> DataFrame:
    """category, n: rows of each category, and All for all rows, those without a category included."""
    each = df.select(F.explode(categories).alias("category")).groupBy("category").agg(F.count("*").alias("n"))
    return each.unionByName(df.agg(F.count("*").alias("n")).select(F.lit("All").alias("category"), "n"))


def numbered(df: DataFrame, *order: Column | str, within: list[str] | None = None, name: str = "k") -> DataFrame:
    """Adds a number from 0 in the given order."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*(within or [])).orderBy(*order)) - 1)


def number_all(df: DataFrame, *order: Column | str, name: str = "k") -> DataFrame:
    """Adds a number from 0 in the given order of all rows. The rows are sorted by ranges and written; each range's number of rows
    tells where the next one begins. No task holds more than a range."""
    path = scratch(df.sparkSession, "numbered")
    df.orderBy(*order).select("*", F.monotonically_increasing_id().alias("__m")).write.parquet(path)
    rows = df.sparkSession.read.parquet(path).withColumn("__p", F.shiftright("__m", 33))
    sizes = rows.groupBy("__p").agg(F.count("*").alias("__n"))
    begins = sizes.select("__p", (F.sum("__n").over(W.orderBy("__p")) - F.col("__n")).alias("__b"))  # a row for each range
    return rows.join(begins, "__p").withColumn(name, F.col("__b") + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))).drop("__m", "__p", "__b")


def bind_recycled(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str], right_rows: int) -> DataFrame:
    """Rows side by side; the right table, of right_rows rows, starts anew when it is used up."""
    b = number_all(right, *right_order, name="__b0")
    return number_all(left, *left_order, name="__a0").withColumn("__b0", F.col("__a0") % right_rows).join(b, "__b0").drop("__a0", "__b0")


def newest_by_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def page(df: DataFrame, number: int, size: int, *order: Column | str) -> DataFrame:
    """The rows of a page (from 1)."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def chunk_of(k: Column, size: int = 20) -> Column:
    """Number of the batch that a row number (from 0) falls into."""
    return F.floor(k / size).cast("int")


def newest_first(column: str) -> Column:
    """Undated rows, then the newest."""
    return F.col(column).desc_nulls_first()


def first_visible_only(df: DataFrame, order: str, visible: str) -> DataFrame:
    """Of the visible rows only the first stays so."""
    first = df.where(visible).agg(F.min(order).alias("__first"))
    return df.join(F.broadcast(first), F.lit(True), "left").withColumn(visible, F.coalesce(F.col(visible) & (F.col(order) == F.col("__first")), F.lit(False))).drop("__first")
