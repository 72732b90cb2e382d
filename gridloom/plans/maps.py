"""Queries on places, shapes and map layers. Places come from the first elements of the embeddings, rings from pairs of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import geometry as G
from gridloom.functions import numbers as N
from gridloom.operators import layers as L
from gridloom.sources import readers, writers

from .registry import Registry, table

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.sql


def places(spark, sf_dir):
    e = lambda k: F.get("embedding", k).cast("double")
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", (e(0) * 85).alias("lat"), (e(1) * 180).alias("lng"), (e(2) * 85).alias("lat2"), (e(3) * 180).alias("lng2"))


_PLACES = "places as (select vec_id, label, embedding[1]::double * 85 as lat, embedding[2]::double * 180 as lng, embedding[3]::double * 85 as lat2, embedding[4]::double * 180 as lng2 from embeddings)"
RING = 6


def rings(spark, sf_dir):
    """A ring of RING points (from 1, x then y) for each vector."""
    points = F.transform(F.sequence(F.lit(0), F.lit(RING - 1)), lambda i: G.point(F.get("embedding", i * 2).cast("double"), F.get("embedding", i * 2 + 1).cast("double")))
    return table(spark, sf_dir, "embeddings").select("vec_id", points.alias("ring"), F.get("embedding", 20).cast("double").alias("x"), F.get("embedding", 21).cast("double").alias("y"))


_EDGES = f"""e as (select vec_id, i, embedding[2 * i + 1]::double as ax, embedding[2 * i + 2]::double as ay, embedding[2 * ((i + {RING - 1}) % {RING}) + 1]::double as cx, embedding[2 * ((i + {RING - 1}) % {RING}) + 2]::double as cy,
  embedding[21]::double as x, embedding[22]::double as y from (select *, unnest(range({RING})) as i from embeddings))"""
r3 = lambda c: F.round(c, 3)
z = lambda c, n: F.round(c, n) + F.lit(0.0)  # noqa: E731  no negative zero


@query(f"with {_PLACES} select vec_id, round(6371000 * 2 * atan2(sqrt(a), sqrt(1 - a)), 3) as meters from (select *, power(sin(radians(lat2 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(lat2)) * power(sin(radians(lng2 - lng) / 2), 2) as a from places)")
def haversine(spark, sf_dir):
    return places(spark, sf_dir).select("vec_id", r3(G.distance(F.col("lat"), F.col("lng"), F.col("lat2"), F.col("lng2"))).alias("meters"))


@query(f"with {_PLACES} select vec_id, round(6378137 * radians(lng), 3) as x, round(6378137 * ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / 2, 3) as y, round(lat, 6) as lat, round(lng, 6) as lng from places")
def mercator(spark, sf_dir):
    df = places(spark, sf_dir).withColumn("m", G.mercator(F.col("lat"), F.col("lng"))).withColumn("b", G.mercator_inverse(F.col("m.x"), F.col("m.y")))
    return df.select("vec_id", r3("m.x").alias("x"), r3("m.y").alias("y"), F.round("b.y", 6).alias("lat"), F.round("b.x", 6).alias("lng"))


_E = G._ECCENTRICITY


@query(f"with {_PLACES} select vec_id, round(-6378137 * ln(tan(pi() / 4 - radians(lat) / 2) / power((1 - {_E!r} * sin(radians(lat))) / (1 + {_E!r} * sin(radians(lat))), {_E / 2!r})), 3) as y, round(lat, 6) as lat from places")
def ellipsoidal_mercator(spark, sf_dir):
    df = places(spark, sf_dir).withColumn("m", G.ellipsoidal_mercator(F.col("lat"), F.col("lng"))).withColumn("b", G.ellipsoidal_mercator_inverse(F.col("m.x"), F.col("m.y")))
    return df.select("vec_id", r3("m.y").alias("y"), F.round("b.y", 6).alias("lat"))


@query(f"with {_PLACES} select vec_id, floor((lng + 180) / 360 * 32)::bigint as x, floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 32)::bigint as y, floor(((lng + 180) / 360 - floor((lng + 180) / 360 * 32) / 32) * 32 * 256)::bigint as px from places")
def tile_numbers(spark, sf_dir):
    x, y = N.tile_x(F.col("lng"), 5), N.tile_y(F.col("lat"), 5)
    return places(spark, sf_dir).select("vec_id", F.floor(x).alias("x"), F.floor(y).alias("y"), N.nearest_pixel(x - F.floor(x), 256).cast("long").alias("px"))


@query(f"with {_PLACES} select label, round(min(lng), 6) as west, round(min(lat), 6) as south, round(max(lng), 6) as east, round(max(lat), 6) as north from places group by 1")
def bbox_agg(spark, sf_dir):
    lng, lat = F.round("lng", 6), F.round("lat", 6)
    return places(spark, sf_dir).groupBy("label").agg(F.min(lng).alias("west"), F.min(lat).alias("south"), F.max(lng).alias("east"), F.max(lat).alias("north"))


@query(f"with {_PLACES}, p as (select * from places where vec_id = (select min(vec_id) from places)) select round(min(lat) - 0.006, 6) as south, round(max(lat) + 0.006, 6) as north, round(min(lng) - 0.006, 6) as west, round(max(lng) + 0.006, 6) as east from p")
def bbox_pad_degenerate(spark, sf_dir):
    df = places(spark, sf_dir)
    one = df.join(F.broadcast(df.agg(F.min("vec_id").alias("vec_id"))), "vec_id", "left_semi")
    return L.view_limits(one).select(*(F.round(c, 6).alias(c) for c in ("south", "north", "west", "east")))


BOXES = [(0, -10.0, -20.0, 10.0, 20.0), (1, 0.0, 0.0, 30.0, 90.0), (2, -30.0, -90.0, 0.0, 0.0)]


@query(f"with {_PLACES}, b(box_id, south, west, north, east) as (values {', '.join(map(str, BOXES))}) select box_id, vec_id as ct_key from places join b on lat between south and north and lng between west and east")
def brush_range_join(spark, sf_dir):
    boxes = spark.createDataFrame(BOXES, "box_id int, south double, west double, north double, east double")
    layer = places(spark, sf_dir).select(F.lit("g").alias("ct_group"), F.col("vec_id").alias("ct_key"), "lat", "lng")
    return L.brush(layer, boxes).select("box_id", "ct_key")


@query(f"with {_EDGES} select vec_id, count(*) filter ((ay > y) <> (cy > y) and x < (cx - ax) * (y - ay) / (cy - ay) + ax) % 2 = 1 as inside from e group by 1")
def point_in_polygon(spark, sf_dir):
    return rings(spark, sf_dir).select("vec_id", G.in_polygon(F.array("ring"), F.col("x"), F.col("y")).alias("inside"))


@query(f"with {_EDGES}, f as (select *, ay * cx - cy * ax as f from e), s as (select vec_id, sum(f) * 3 as area, sum((ax + cx) * f) as sx, sum((ay + cy) * f) as sy from f group by 1) select vec_id, round(sx / area, 5) + 0.0 as x, round(sy / area, 5) + 0.0 as y from s where abs(area) > 0.001")
def ring_centroid(spark, sf_dir):
    ring = F.col("ring")
    area = F.aggregate(G._edges(ring), F.lit(0.0), lambda s, e: s + e.a.y * e.b.x - e.b.y * e.a.x) * 3
    df = rings(spark, sf_dir).where(F.abs(area) > 0.001).withColumn("c", G.ring_centroid(ring))
    return df.select("vec_id", z(F.col("c.x"), 5).alias("x"), z(F.col("c.y"), 5).alias("y"))


@query(f"""with p as (select vec_id, i, embedding[2 * i + 1]::double as ax, embedding[2 * i + 2]::double as ay, embedding[2 * i + 3]::double as cx, embedding[2 * i + 4]::double as cy from (select *, unnest(range({RING - 1})) as i from embeddings)),
d as (select *, sqrt((cx - ax) * (cx - ax) + (cy - ay) * (cy - ay)) as len from p),
c as (select *, sum(len) over (partition by vec_id order by i) as after, sum(len) over (partition by vec_id) / 2 as half from d),
f as (select *, row_number() over (partition by vec_id order by i) as n from c where after >= half and len > 0)
select vec_id, round(cx - (after - half) / len * (cx - ax), 5) + 0.0 as x, round(cy - (after - half) / len * (cy - ay), 5) + 0.0 as y from f where n = 1""")
def line_midpoint(spark, sf_dir):
    df = rings(spark, sf_dir).withColumn("m", G.line_midpoint(F.col("ring")))
    return df.select("vec_id", z(F.col("m.x"), 5).alias("x"), z(F.col("m.y"), 5).alias("y"))


@query(f"with {_PLACES} select vec_id, round((((lng * 9 + 180) % 360) + 360) % 360 - 180, 6) as lng, floor(lat * 1e6 + 0.5) / 1e6 as lat6 from places")
def wrap_and_round(spark, sf_dir):
    return places(spark, sf_dir).select("vec_id", F.round(N.wrap(F.col("lng") * 9, -180, 180), 6).alias("lng"), N.round_half_up(F.col("lat")).alias("lat6"))


@query(f"""with {_PLACES}, b as (select vec_id, least(lng, lng2) as w, least(lat, lat2) as s, greatest(lng, lng2) as e, greatest(lat, lat2) as n from places)
select vec_id, 1 between s and n and 2 between w and e as holds_point, w <= -1 and e >= 1 and s <= -1 and n >= 1 as holds_box, e >= -9 and w <= 9 and n >= -9 and s <= 9 as meets, e > -9 and w < 9 and n > -9 and s < 9 as shares_area,
round(w - abs(e - w) * 0.5, 6) as padded_west, round((s + n) / 2, 6) as center_lat, sqrt((e - w) * (e - w) + (n - s) * (n - s)) < 50 as is_small from b""")
def box_relations(spark, sf_dir):
    b = G.box(F.least("lng", "lng2"), F.least("lat", "lat2"), F.greatest("lng", "lng2"), F.greatest("lat", "lat2"))
    box = lambda *x: G.box(*(F.lit(float(v)) for v in x))
    return places(spark, sf_dir).select("vec_id", b.alias("b")).select(
        "vec_id", G.box_contains_point(F.col("b"), F.lit(2), F.lit(1)).alias("holds_point"), G.box_contains(F.col("b"), box(-1, -1, 1, 1)).alias("holds_box"), G.box_intersects(F.col("b"), box(-9, -9, 9, 9)).alias("meets"),
        G.box_overlaps(F.col("b"), box(-9, -9, 9, 9)).alias("shares_area"), F.round(G.box_pad(F.col("b"), 0.5).west, 6).alias("padded_west"), F.round(G.box_center(F.col("b")).y, 6).alias("center_lat"),
        (G.planar_distance(F.col("b.west"), F.col("b.south"), F.col("b.east"), F.col("b.north")) < 50).alias("is_small"),
    )


@query(f"with {_PLACES} select vec_id, round(lat - 180 * 5000 / 40075017.0, 6) as south, round(lng + 180 * 5000 / 40075017.0 / cos(radians(lat)), 6) as east, greatest(abs(lat - lat2), abs(lng - lng2)) <= 1e-9 as same from places")
def box_around(spark, sf_dir):
    b = G.box_around(F.col("lat"), F.col("lng"), F.lit(5000.0))
    return places(spark, sf_dir).select("vec_id", F.round(b.south, 6).alias("south"), F.round(b.east, 6).alias("east"), G.same_place(F.col("lat"), F.col("lng"), F.col("lat2"), F.col("lng2")).alias("same"))


@query(f"""with {_PLACES}, t as (select vec_id, case when (lng2 - lng) * (lng2 - lng) + (lat2 - lat) * (lat2 - lat) > 0 then greatest(0, least(1, ((3 - lng) * (lng2 - lng) + (4 - lat) * (lat2 - lat)) / ((lng2 - lng) * (lng2 - lng) + (lat2 - lat) * (lat2 - lat)))) else 0 end as t, lng, lat, lng2, lat2 from places)
select vec_id, round(sqrt(power(lng + (lng2 - lng) * t - 3, 2) + power(lat + (lat2 - lat) * t - 4, 2)), 6) as d from t""")
def segment_distance(spark, sf_dir):
    d = G.segment_distance(F.lit(3.0), F.lit(4.0), F.col("lng"), F.col("lat"), F.col("lng2"), F.col("lat2"))
    return places(spark, sf_dir).select("vec_id", F.round(d, 6).alias("d"))


@query(f"""with {_PLACES}, t as (select *, greatest(0, least((-20 - lng) / (lng2 - lng), (20 - lng) / (lng2 - lng)), least((-10 - lat) / (lat2 - lat), (10 - lat) / (lat2 - lat))) as t0,
 least(1, greatest((-20 - lng) / (lng2 - lng), (20 - lng) / (lng2 - lng)), greatest((-10 - lat) / (lat2 - lat), (10 - lat) / (lat2 - lat))) as t1 from places)
select vec_id, round(lng + (lng2 - lng) * t0, 5) + 0.0 as x0, round(lat + (lat2 - lat) * t1, 5) + 0.0 as y1 from t where t0 <= t1""")
def clip_segments(spark, sf_dir):
    c = G.clip_segment(F.col("lng"), F.col("lat"), F.col("lng2"), F.col("lat2"), G.box(F.lit(-20.0), F.lit(-10.0), F.lit(20.0), F.lit(10.0)))
    df = places(spark, sf_dir).select("vec_id", c.alias("c")).where("c is not null")
    return df.select("vec_id", z(F.col("c.a.x"), 5).alias("x0"), z(F.col("c.b.y"), 5).alias("y1"))


@query(f"with {_PLACES} select vec_id, round(256 * 8 * (0.5 / (pi() * 6378137) * (6378137 * radians(lng)) + 0.5), 3) as x, round(256 * 8 * (0.5 - 0.5 / (pi() * 6378137) * (6378137 * ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / 2)), 3) as y, round(256 * 8 * (lng / 180 + 1), 3) as flat_x, 3.0::double as zoom from places")
def pixels(spark, sf_dir):
    p, q = (G.pixel(F.col("lat"), F.col("lng"), F.lit(3), crs) for crs in ("EPSG3857", "urn:ogc:def:crs:EPSG::4326"))
    return places(spark, sf_dir).select("vec_id", r3(p.x).alias("x"), r3(p.y).alias("y"), r3(q.x).alias("flat_x"), F.round(G.zoom_of(G.scale_of(F.lit(3))), 9).alias("zoom"))


@query()
def simplify_line(spark, sf_dir):
    line = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: G.point(i.cast("double"), F.get("embedding", i).cast("double")))
    df = table(spark, sf_dir, "embeddings").select("vec_id", G.simplify_line(line, F.lit(0.1)).alias("line"))
    return df.select("vec_id", F.size("line").alias("n"), F.round(F.aggregate("line", F.lit(0.0), lambda s, p: s + p.x), 6).alias("sum_x"))


@query()
def clip_polygon(spark, sf_dir):
    edges = (F.lit(v) for v in (-0.1, -0.1, 0.1, 0.1))
    df = rings(spark, sf_dir).select("vec_id", G.clip_polygon(F.col("ring"), *edges).alias("ring"))
    b = G.box_of(F.col("ring"))
    return df.select("vec_id", F.size("ring").alias("n"), F.round(b.west, 6).alias("west"), F.round(b.north, 6).alias("north"))


@query("select vec_id, 'v' || vec_id as name, 6::int as n, 'red' as color, floor(embedding[1]::double * 1e6 + 0.5) / 1e6 as x from embeddings")
def geojson_roundtrip(spark, sf_dir):
    text = writers.feature(writers.polygon_geometry(F.array("ring")), F.struct(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("name"), F.lit('{"color":"red"}').alias("style"), F.col("vec_id").cast("string").alias("vec_id")))
    written = rings(spark, sf_dir).select(text.alias("value"))
    style = F.create_map(F.lit("color"), F.lit("blue"))
    back = readers.single_geometries(readers.features(written, style=style)).withColumn("ring", F.get(F.get(readers.polygons(F.col("geometry")), 0), 0))
    return back.select(F.col("properties")["vec_id"].cast("long").alias("vec_id"), F.col("properties")["name"].alias("name"), F.size("ring").alias("n"), F.col("style")["color"].alias("color"), F.get("ring", 0).x.alias("x"))


@query("select vec_id, round(embedding[1]::double, 6) as lng, round(embedding[2]::double, 6) as lat from embeddings")
def unprojected_geojson(spark, sf_dir):
    ring = F.transform("ring", lambda p: G.mercator(p.y, p.x))
    crs = '"crs":{"type":"name","properties":{"name":"urn:ogc:def:crs:EPSG::3857"}},'
    text = F.concat(F.lit('{"type":"FeatureCollection",' + crs + '"features":['), writers.feature(writers.polygon_geometry(F.array(ring), 9), F.struct(F.col("vec_id").cast("string").alias("vec_id"))), F.lit("]}"))
    back = readers.features(rings(spark, sf_dir).select(text.alias("value")))
    ring = F.get(F.get(readers.unprojected(readers.polygons(F.col("geometry")), F.col("crs")), 0), 0)
    return back.select(F.col("properties")["vec_id"].cast("long").alias("vec_id"), F.round(F.get(ring, 0).x, 6).alias("lng"), F.round(F.get(ring, 0).y, 6).alias("lat"))


@query("select s_suppkey, 2.0 * (s_nationkey + 3) + 10 as x, 5 * 3.0 + 20 as y from supplier")
def topojson_arcs(spark, sf_dir):
    text = F.concat(F.lit('{"arcs":[[['), F.col("s_nationkey").cast("string"), F.lit(',2],[3,1]]],"transform":{"scale":[2,5],"translate":[10,20]}}'))
    last = F.get(F.get(readers.topology_arcs(text), 0), 1)
    return table(spark, sf_dir, "supplier").select("s_suppkey", last.x.alias("x"), last.y.alias("y"))


_CALLS = """calls as (select event_id as seq, case event_type when 'view' then 'addMarkers' when 'click' then 'addCircles' when 'purchase' then 'removeMarker' when 'signup' then 'clearShapes' else 'unknown' end as method,
 case when user_id % 5 = 0 then null else user_id::varchar end as layer_id from events)"""


@query(f"""with {_CALLS}, a as (select *, case method when 'addMarkers' then 'marker' when 'addCircles' then 'shape' end as category from calls),
l as (select *, row_number() over (partition by category, coalesce('id:' || layer_id, 'seq:' || seq) order by seq desc) as n from a where category is not null),
gone as (select layer_id, max(seq) as seq from calls where method = 'removeMarker' group by layer_id), cleared as (select coalesce(max(seq), -1) as seq from calls where method = 'clearShapes')
select l.seq, category, l.layer_id from l left join gone on gone.layer_id = l.layer_id and category = 'marker', cleared
 where n = 1 and coalesce(gone.seq, -1) < l.seq and (category <> 'shape' or cleared.seq < l.seq)""")
def layer_calls(spark, sf_dir):
    method = F.when(F.col("event_type") == "view", "addMarkers").when(F.col("event_type") == "click", "addCircles").when(F.col("event_type") == "purchase", "removeMarker").when(F.col("event_type") == "signup", "clearShapes").otherwise("unknown")
    calls = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), method.alias("method"), F.when(F.col("user_id") % 5 != 0, F.col("user_id").cast("string")).alias("layer_id"), F.lit(None).cast("string").alias("grp"))
    return L.apply_calls(calls).select("seq", "category", "layer_id")


@query("select (vec_id // 40)::int as row, ((vec_id % 20) // 2)::int as col, round(avg(label), 6) as r from embeddings group by 1, 2")
def raster_mips(spark, sf_dir):
    c = F.col("label").cast("double")
    pixels_ = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 20).cast("int").alias("row"), (F.col("vec_id") % 20).cast("int").alias("col"), c.alias("r"), c.alias("g"), c.alias("b"), c.alias("a"))
    return L.mip_levels(pixels_, 20, 20, 10)[1].select("row", "col", F.round("r", 6).alias("r"))
