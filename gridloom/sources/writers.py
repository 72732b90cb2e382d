"""Writers: GeoJSON, map payloads, listings, search indexes, cell outputs."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import geometry as G
from gridloom.functions import palette
from gridloom.functions import text as X
from gridloom.functions.numbers import round_half_up
from gridloom.operators import relational as R


def polygon_geometry(rings: Column, precision: int = 6) -> Column:
    """GeoJSON text of a polygon: rings closed, coordinates rounded."""
    position = lambda p: F.array(round_half_up(p.x, precision), round_half_up(p.y, precision))
    return F.to_json(F.struct(F.lit("Polygon").alias("type"), F.transform(rings, lambda r: F.transform(G.closed_ring(r), position)).alias("coordinates")))


def points_geometry(points: Column, precision: int = 6) -> Column:
    """GeoJSON text of points: a Point if there is one, else a MultiPoint."""
    position = lambda p: F.array(round_half_up(p.x, precision), round_half_up(p.y, precision))
    one = F.to_json(F.struct(F.lit("Point").alias("type"), position(F.get(points, 0)).alias("coordinates")))
    many = F.to_json(F.struct(F.lit("MultiPoint").alias("type"), F.transform(points, position).alias("coordinates")))
    return F.when(F.size(points) == 1, one).otherwise(many)


def line_geometry(points: Column, precision: int = 6) -> Column:
    """GeoJSON text of a line."""
    position = lambda p: F.array(round_half_up(p.x, precision), round_half_up(p.y, precision))
    return F.to_json(F.struct(F.lit("LineString").alias("type"), F.transform(points, position).alias("coordinates")))


def multi_polygon_geometry(polygons: Column, precision: int = 6) -> Column:
    """GeoJSON text of several polygons, each an array of rings."""
    position = lambda p: F.array(round_half_up(p.x, precision), round_half_up(p.y, precision))
    rings = lambda polygon: F.transform(polygon, lambda r: F.transform(G.closed_ring(r), position))
    return F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), F.transform(polygons, rings).alias("coordinates")))


def feature_collection(features: Column) -> Column:
    """GeoJSON text of a collection of features given as texts."""
    return F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(features, ","), F.lit("]}"))


def choropleth_controls(values: list[str], low: Column, high: Column, colors: list[str] = palette.YELLOW_TO_RED) -> Column:
    """The rows that go with a choropleth, as array of structs category, grp, title, content (JSON): a legend for each value column, of
    which only the first's is shown, and one control that switches between them."""
    legend = F.to_json(F.struct(F.array(*map(F.lit, colors)).alias("colors"), low.alias("low"), high.alias("high"), F.lit(palette.MISSING).alias("missing")))
    row = lambda category, grp, title, content: F.struct(F.lit(category).alias("category"), F.lit(grp).cast("string").alias("grp"), F.lit(title).cast("string").alias("title"), content.alias("content"))
    control = F.to_json(F.struct(F.array(*map(F.lit, values)).alias("baseGroups"), F.lit(False).alias("collapsed")))
    return F.array(*(row("control", v, v, legend) for v in values), row("layers_control", None, None, control))


def geometry_collection(geometries: Column) -> Column:
    """GeoJSON text of a collection of geometries given as texts."""
    return F.concat(F.lit('{"type":"GeometryCollection","geometries":['), F.array_join(geometries, ","), F.lit("]}"))


def feature(geometry: Column, properties: Column) -> Column:
    """GeoJSON text of a feature; properties: a struct or map."""
    return F.concat(F.lit('{"type":"Feature","properties":'), F.to_json(properties), F.lit(',"geometry":'), geometry, F.lit("}"))


def write_features(df: DataFrame, path: str, geometry: str, properties: list[str]) -> None:
    """One feature to a line, in as many files as there are partitions."""
    df.select(feature(F.col(geometry), F.struct(*properties)).alias("value")).write.mode("overwrite").text(path)


def choropleth(df: DataFrame, label: str, values: list[str], id_cols: list[str]) -> DataFrame:
    """One row for each row and value column: grp (the column), value, color on the domain of all columns, popup. Rows of the first
    group are visible."""
    bounds = R.domain(df, *values)
    each = df.select(*id_cols, F.col(label).alias("label"), F.posexplode(F.array(*(F.struct(F.lit(v).alias("grp"), F.col(v).alias("value")) for v in values))).alias("ordinal", "s"))
    rows = each.select(*id_cols, "label", "ordinal", "s.grp", "s.value").join(F.broadcast(bounds), F.lit(True), "left")  # bounds is one row
    return rows.select(*id_cols, "grp", "value", palette.color_at(F.col("value"), F.col("low"), F.col("high")).alias("color"), X.popup(F.col("label"), F.round("value", 3)).alias("popup"), (F.col("ordinal") == 0).alias("visible"))


def listing_rows(posts: DataFrame) -> DataFrame:
    """Posts as a listing page orders and marks them."""
    date_ms = F.unix_millis(F.col("date").cast("timestamp"))
    return R.number_all(posts.withColumns({"date_ms": date_ms, "categories_code": X.encode_list(F.coalesce("categories", F.array().cast("array<string>")))}), R.newest_first("date"), "title", name="idx")


def write_search_index(docs: DataFrame, path: str) -> None:
    """Documents with a text; pages without any are left out."""
    docs.where(F.length(F.trim("text")) > 0).write.mode("overwrite").json(path)


def cell_output(value: Column) -> Column:
    """A value as a cell prints it."""
    return F.concat(F.lit("[1] "), value.cast("string"))


class ResultCache:
    """Results kept as tables by the hash of what made them. One writer wins; readers only see whole tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def get(self, code: str, make) -> DataFrame:
        key = self.spark.range(1).select(F.sha2(F.lit(code), 256)).first()[0]
        path = f"{self.folder}/{key}"
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = fs_path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")):
            parts = f"{path}.{uuid.uuid4().hex}"
            make().write.parquet(parts)
            if not fs.rename(self.spark._jvm.org.apache.hadoop.fs.Path(parts), fs_path):
                fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(parts), True)
        return self.spark.read.parquet(path)
