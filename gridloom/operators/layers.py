"""A map's layers as a table.

Calls (seq, method, category, layer_id, grp, lat, lng, popup, ...) are applied in order: an add with an id replaces the row of the
same category and id; removals and clearings take rows away. METHODS lists every call and its effect on the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Calls by effect, with the category that they act on.
ADDS = {
    "addPopups": "popup", "addTiles": "tile", "addWMSTiles": "tile", "addProviderTiles": "tile", "addMarkers": "marker", "addAwesomeMarkers": "marker",
    "addCircleMarkers": "marker", "addCircles": "shape", "addPolylines": "shape", "addRectangles": "shape", "addPolygons": "shape", "addGeoJSON": "geojson",
    "addTopoJSON": "topojson", "addControl": "control", "addCustomControl": "control", "addLegend": "control", "addRasterImage": "image", "addSelect": "select",
    "addLayersControl": "layers_control", "addScaleBar": "scale_bar", "addMeasure": "measure", "addMarkerCluster": "cluster",
}
REMOVES = {
    "removePopup": "popup", "removeTiles": "tile", "removeMarker": "marker", "removeShape": "shape", "removeGeoJSON": "geojson", "removeTopoJSON": "topojson",
    "removeControl": "control", "removeImage": "image", "removeMarkerCluster": "cluster", "removeMarkerFromCluster": "marker",
}
CLEARS = {
    "clearPopups": "popup", "clearTiles": "tile", "clearMarkers": "marker", "clearShapes": "shape", "clearGeoJSON": "geojson", "clearTopoJSON": "topojson",
    "clearControls": "control", "clearImages": "image", "clearMarkerClusters": "cluster", "removeLayersControl": "layers_control", "removeScaleBar": "scale_bar",
    "removeMeasure": "measure", "removeSelect": "select",
}
CLEAR_GROUP = "clearGroup"
VISIBILITY = {"hideGroup": False, "showGroup": True}
VIEWS = ("setView", "fitBounds", "flyTo", "flyToBounds", "setMaxBounds")
#: Of these only one exists at a time.
SINGLES = ("layers_control", "scale_bar", "measure", "select")
METHODS = {**dict.fromkeys(ADDS, "upsert"), **dict.fromkeys(REMOVES, "delete by id"), **dict.fromkeys(CLEARS, "delete by category"), CLEAR_GROUP: "delete by group", **dict.fromkeys(VISIBILITY, "show or hide group"), **dict.fromkeys(VIEWS, "set view"), "setGroupOptions": "zoom levels of group", "getControl": "lookup", "createMapPane": "none"}


def _categories(calls: DataFrame, table: dict[str, str]):
    return F.get(F.map_values(F.map_filter(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), lambda k, _: k == F.col("method"))), 0)


def apply_calls(calls: DataFrame) -> DataFrame:
    """The layers that stand after all calls: the columns of their adding call, and category. Unknown methods change nothing."""
    added = calls.withColumn("category", _categories(calls, ADDS)).where("category is not null")
    single = F.col("category").isin(*SINGLES)
    key = F.when(F.col("layer_id").isNotNull(), F.concat(F.lit("id:"), "layer_id")).when(single, F.lit("one")).otherwise(F.concat(F.lit("seq:"), F.col("seq").cast("string")))
    last = W.partitionBy("category", "key").orderBy(F.desc("seq"))
    live = added.withColumn("key", key).withColumn("n", F.row_number().over(last)).where("n = 1").drop("n", "key")
    gone = lambda df, *on: df.groupBy(*on).agg(F.max("seq").alias("gone"))
    by_id = gone(calls.withColumn("category", _categories(calls, REMOVES)).where("category is not null and layer_id is not null"), "category", "layer_id")
    by_category = gone(calls.withColumn("category", _categories(calls, CLEARS)).where("category is not null"), "category")
    by_group = gone(calls.where((F.col("method") == CLEAR_GROUP) & F.col("grp").isNotNull()), "grp")
    for taken, on in ((by_id, ["category", "layer_id"]), (by_category, ["category"]), (by_group, ["grp"])):
        live = live.join(taken, on, "left").where("gone is null or gone < seq").drop("gone")
    return live.select(*calls.columns, "category")


def group_visibility(calls: DataFrame) -> DataFrame:
    """grp, visible: by the last call that hides or shows a group."""
    shown = calls.where(F.col("method").isin(*VISIBILITY))
    return shown.groupBy("grp").agg(F.max_by(F.col("method") == "showGroup", "seq").alias("visible"))


def view(calls: DataFrame) -> DataFrame:
    """The last call that sets the view."""
    return calls.where(F.col("method").isin(*VIEWS)).orderBy(F.desc("seq")).limit(1)


def unknown_calls(calls: DataFrame) -> DataFrame:
    """seq, message for each call of a method that METHODS doesn't have."""
    return calls.where(~F.coalesce(F.col("method").isin(*METHODS), F.lit(False))).select("seq", F.concat(F.lit("Unknown method "), F.coalesce("method", F.lit("null"))).alias("message"))


def group_options(calls: DataFrame) -> DataFrame:
    """grp, zoom_levels: by the last call that sets a group's options; no levels mean all."""
    return calls.where("method = 'setGroupOptions'").groupBy("grp").agg(F.max_by("zoom_levels", "seq").alias("zoom_levels"))


def control(layers: DataFrame, layer_id: str) -> DataFrame:
    """The control of an id; no row if there is none."""
    return layers.where((F.col("category") == "control") & (F.col("layer_id") == layer_id))


def panes(calls: DataFrame) -> DataFrame:
    """name, z_index of the panes that were made, the last call for each name."""
    return calls.where("method = 'createMapPane'").groupBy("name").agg(F.max_by("z_index", "seq").alias("z_index"))


#: Sides of grid cells in degrees: the smallest, and how many times it is doubled.
CELL, CELL_LEVELS = 360 / 1024, 10


def brush(layers: DataFrame, boxes: DataFrame) -> DataFrame:
    """box_id, ct_group, ct_key for each layer with a point inside a box (south, west, north, east), once for each matching layer.

    A box goes to the cells, four at most, of the grid whose cells are as wide as it is; a point goes to its cell on each grid that
    boxes use. So an equi-join on cells replaces a comparison of all points with all boxes. Boxes wider than the world are met on
    the widest grid."""
    wide = F.greatest(F.col("east") - F.col("west"), F.col("north") - F.col("south"), F.lit(CELL))
    level = F.least(F.lit(CELL_LEVELS), F.ceil(F.log2(wide / CELL))).cast("int")
    at = lambda x, level: F.floor(x / (CELL * F.pow(F.lit(2.0), level))).cast("long")
    cells = lambda low, high: F.explode(F.sequence(at(F.col(low), F.col("level")), at(F.col(high), F.col("level"))))
    whole = boxes.where("south <= north and west <= east").withColumn("level", level)
    dealt = whole.withColumn("cx", cells("west", "east")).withColumn("cy", cells("south", "north"))
    used = sorted(r.level for r in whole.select("level").distinct().collect())  # CELL_LEVELS + 1 at most
    points = layers.where("ct_group is not null and lat is not null and lng is not null").select("ct_group", "ct_key", "lat", "lng", F.explode(F.array(*map(F.lit, used)).cast("array<int>")).alias("level"))
    points = points.withColumns({"cx": at(F.col("lng"), F.col("level")), "cy": at(F.col("lat"), F.col("level"))})
    inside = (F.col("lat") >= F.col("south")) & (F.col("lat") <= F.col("north")) & (F.col("lng") >= F.col("west")) & (F.col("lng") <= F.col("east"))
    return points.join(dealt, ["level", "cx", "cy"]).where(inside).select("box_id", "ct_group", "ct_key")


def view_limits(points: DataFrame, pad: float = 0.006) -> DataFrame:
    """south, north, west, east around all points; a side without extent is padded."""
    b = points.agg(F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lng").alias("w"), F.max("lng").alias("e"))
    padded = lambda low, high, k: F.col(low if k < 0 else high) + F.when(F.col(low) == F.col(high), k * pad).otherwise(0.0)
    return b.select(padded("s", "n", -1).alias("south"), padded("s", "n", 1).alias("north"), padded("w", "e", -1).alias("west"), padded("w", "e", 1).alias("east"))


def mip_levels(pixels: DataFrame, width: int, height: int, wanted: int) -> list[DataFrame]:
    """A raster (row, col, r, g, b, a) and its halvings, by means of 2 x 2 pixels, until both sides are at most `wanted`."""
    out = [pixels]
    while max(width, height) > wanted and (width > 1 or height > 1):
        width, height = -(-width // 2), -(-height // 2)
        half = lambda c: F.floor(F.col(c) / 2).cast("int").alias(c)
        out.append(out[-1].groupBy(half("row"), half("col")).agg(*(F.avg(c).alias(c) for c in "rgba")))
    return out
