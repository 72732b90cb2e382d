"""Queries on event records, calls on maps, geometry files and rasters."""

from __future__ import annotations

import base64

from pyspark.sql import functions as F

from gridloom import streaming
from gridloom.functions import arrays as A
from gridloom.functions import geometry as G
from gridloom.functions import numbers as N
from gridloom.operators import layers as L
from gridloom.operators import relational as R
from gridloom.session import scratch
from gridloom.sources import readers, writers

from .maps import _PLACES, places
from .registry import Registry, table
from .tables import YEARS, enp_wide

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.sql


@query("select event_id from events where event_type <> 'error' and user_id % 3 <> 0")
def null_layer_guard(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("layer", F.when(F.col("event_type") != "error", F.struct("event_type"))).withColumn("grp", F.nullif(F.col("user_id") % 3, F.lit(0)))
    return R.present(events, "layer", "grp").select("event_id")


@query("""select event_id, 'm_' || case when event_id % 2 = 0 then 'marker' else 'shape' end || '_click' as input, user_id::varchar as id, case when user_id % 4 = 0 then null else event_type end as grp,
 round(value, 3) as lat, 2.5::double as lng from events""")
def event_records(spark, sf_dir):
    """Records read back from their JSON text; the nonces of all events differ."""
    category = F.when(F.col("event_id") % 2 == 0, "marker").otherwise("shape")
    events = table(spark, sf_dir, "events").select("event_id", category.alias("category"), F.col("user_id").cast("string").alias("layer_id"), F.when(F.col("user_id") % 4 != 0, F.col("event_type")).alias("grp"), F.col("value").alias("lat"), F.lit(2.5).alias("lng"))
    records = streaming.event_records(events, "m", "click", seq="event_id")
    back = records.select("event_id", "input", F.from_json("record", "id string, `.nonce` bigint, group string, lat double, lng double").alias("r"))
    return back.where("r.`.nonce` is not null").select("event_id", "input", "r.id", F.col("r.group").alias("grp"), F.round("r.lat", 3).alias("lat"), "r.lng")


_CALLS = "calls as (select event_id as seq, case event_type when 'view' then 'hideGroup' when 'click' then 'showGroup' when 'purchase' then 'setGroupOptions' when 'signup' then 'createMapPane' else 'add' || event_type end as method, 'g' || (user_id % 40) as grp, event_id % 7 as k from events)"


def calls(spark, sf_dir):
    kinds = {"view": "hideGroup", "click": "showGroup", "purchase": "setGroupOptions", "signup": "createMapPane"}
    method = F.coalesce(R.recode(F.nullif("event_type", F.lit("error")), kinds), F.lit("adderror"))
    grp = F.concat(F.lit("g"), (F.col("user_id") % 40).cast("string"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), method.alias("method"), grp.alias("grp"), (F.col("event_id") % 7).alias("k"))


@query(f"with {_CALLS} select seq, 'Unknown method adderror' as message from calls where method = 'adderror'")
def unknown_calls(spark, sf_dir):
    return L.unknown_calls(calls(spark, sf_dir))


@query(f"with {_CALLS} select grp, arg_max(method = 'showGroup', seq) as visible from calls where method in ('hideGroup', 'showGroup') group by grp")
def group_visibility(spark, sf_dir):
    return L.group_visibility(calls(spark, sf_dir))


@query(f"with {_CALLS} select grp, arg_max(k, seq)::bigint as first_level, 2::int as levels from calls where method = 'setGroupOptions' group by grp")
def group_options(spark, sf_dir):
    asked = calls(spark, sf_dir).withColumn("zoom_levels", F.array(F.col("k"), F.col("k") + 1))
    return L.group_options(asked).select("grp", F.get("zoom_levels", 0).alias("first_level"), F.size("zoom_levels").alias("levels"))


@query(f"with {_CALLS} select grp as name, arg_max(k, seq)::bigint as z_index from calls where method = 'createMapPane' group by grp")
def map_panes(spark, sf_dir):
    return L.panes(calls(spark, sf_dir).withColumns({"name": F.col("grp"), "z_index": F.col("k")}))


@query("select max(event_id)::bigint as seq from events where event_type = 'view' and user_id = 7")
def map_control(spark, sf_dir):
    asked = table(spark, sf_dir, "events").where("event_type = 'view'").select(F.col("event_id").alias("seq"), F.lit("addControl").alias("method"), F.col("user_id").cast("string").alias("layer_id"), F.lit(None).cast("string").alias("grp"))
    return L.control(L.apply_calls(asked), "7").select("seq")


@query("select vec_id, 3::int as n, floor(embedding[1]::double * 1e6 + 0.5) / 1e6 as x, floor(embedding[4]::double * 1e6 + 0.5) / 1e6 as lat, 2::int as polygons, 'MultiPolygon' as other from embeddings")
def geojson_lines(spark, sf_dir):
    """Lines and sets of polygons written into one collection and read back."""
    e = lambda k: F.get("embedding", k).cast("double")
    line = F.array(*(G.point(e(k), e(k + 1)) for k in (0, 2, 4)))
    squares = F.array(*(F.array(F.array(*(G.point(F.lit(x + s), F.lit(y)) for x, y in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0))))) for s in (0.0, 5.0)))
    own = F.struct(F.col("vec_id").cast("string").alias("vec_id"))
    text = writers.feature_collection(F.array(writers.feature(writers.line_geometry(line), own), writers.feature(writers.multi_polygon_geometry(squares), own)))
    back = readers.features(table(spark, sf_dir, "embeddings").select(text.alias("value")))
    back = back.select(F.col("properties")["vec_id"].cast("long").alias("vec_id"), F.col("geometry.type").alias("type"), readers.lat_lngs(F.col("geometry")).alias("line"), readers.polygons(F.col("geometry")).alias("polygons"))
    lines, others = back.where("type = 'LineString'"), back.where("type != 'LineString'").select("vec_id", F.size("polygons").alias("polygons"), F.col("type").alias("other"))
    return lines.select("vec_id", F.size("line").alias("n"), F.get("line", 0).lng.alias("x"), F.get("line", 1).lat.alias("lat")).join(others, "vec_id")


@query("select n_nationkey, 10.0 + n_nationkey as lat, 0.5 as lng from nation where n_regionkey = 2")
def geojson_callbacks(spark, sf_dir):
    """Features by a predicate, with positions in an order of their own."""
    text = F.concat(F.lit('{"type":"Feature","properties":{"region":"'), F.col("n_regionkey").cast("string"), F.lit('","key":"'), F.col("n_nationkey").cast("string"), F.lit('"},"geometry":{"type":"Point","coordinates":['), F.col("n_nationkey").cast("string"), F.lit(",0.5]}}"))
    found = readers.features(table(spark, sf_dir, "nation").select(text.alias("value")), where=F.col("properties")["region"] == "2")
    place = F.get(readers.lat_lngs(F.col("geometry"), lambda p: F.struct((F.get(p, 0) + 10).alias("lat"), F.get(p, 1).alias("lng"), F.lit(None).cast("double").alias("alt"))), 0)
    return found.select(F.col("properties")["key"].cast("int").alias("n_nationkey"), place.lat.alias("lat"), place.lng.alias("lng"))


@query("""select s_suppkey, 'l' as id, 'LineString' as type, 1::int as lines, 5::int as points, 2.0 * s_nationkey as x, 4.0 as last_y from supplier
union all select s_suppkey, 'p', 'Polygon', 1, 7, 8.0, 4.0 from supplier union all select s_suppkey, 'o', 'Point', 1, 1, 14.0, 18.0 from supplier""")
def topojson_features(spark, sf_dir):
    """A line of two arcs, a ring of an arc forwards and backwards, a point."""
    own = F.concat(F.lit(',"properties":{"s":"'), F.col("s_suppkey").cast("string"), F.lit('"}'))
    text = F.concat(
        F.lit('{"type":"Topology","transform":{"scale":[2,2],"translate":[0,0]},"arcs":[[['), F.col("s_nationkey").cast("string"), F.lit(",0],[1,1]],[[4,2],[-3,0],[-1,-1],[4,1]]],"),
        F.lit('"objects":{"all":{"type":"GeometryCollection","geometries":[{"type":"LineString","id":"l","arcs":[0,1]'), own, F.lit('},{"type":"Polygon","id":"p","arcs":[[1,-2]]'), own,
        F.lit('}]},"one":{"type":"Point","id":"o","coordinates":[7,9]'), own, F.lit("}}}"),
    )
    parts = readers.topology_features(table(spark, sf_dir, "supplier").select(text.alias("value")))
    line = F.get("lines", 0)
    return parts.select(F.col("properties")["s"].cast("long").alias("s_suppkey"), "id", "type", F.size("lines").alias("lines"), F.size(line).alias("points"), F.get(line, 0).x.alias("x"), F.get(line, F.size(line) - 1).y.alias("last_y"))


@query("select r, c, (r * 40 + c * 10 + k)::int as value, k::int as channel from (select unnest([0, 1, 2]) as r) a, (select unnest([0, 1]) as c) b, (select unnest([0, 1, 2, 3]) as k) d")
def raster_ingest(spark, sf_dir):
    """An image of 3 rows and 2 columns, given as a data URI."""
    rgba = bytes(r * 40 + c * 10 + k for r in range(3) for c in range(2) for k in range(4))
    uri = "data:image/png;base64," + base64.b64encode(readers.encode_png(2, 3, rgba)).decode()
    pixels = readers.raster_pixels(spark.createDataFrame([(1, uri)], "id int, uri string"))
    return pixels.select(F.col("row").cast("long").alias("r"), F.col("col").cast("long").alias("c"), F.posexplode(F.array(*"rgba")).alias("channel", "value")).select(F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), "value", "channel")


@query("""select s_suppkey, 'https://wms/x?service=WMS&request=GetMap&layers=a%2Cb&styles=&format=image%2Fpng&transparent=false&version=1.1.1&width=256&height=256&srs=EPSG%3A3857&bbox=' || s_nationkey || '.0,0.0,10.0,20.0' as older,
 'https://wms/?k=1&service=WMS&request=GetMap&layers=a&styles=&format=image%2Fjpeg&transparent=false&version=1.3.0&width=256&height=256&crs=EPSG%3A4326&bbox=0.0,' || s_nationkey || '.0,20.0,10.0' as newer from supplier""")
def wms_tiles(spark, sf_dir):
    box = (F.col("s_nationkey").cast("double"), F.lit(0.0), F.lit(10.0), F.lit(20.0))
    older = readers.wms_address(F.lit("https://wms/x"), "a,b", *box, format="image/png")
    newer = readers.wms_address(F.lit("https://wms/?k=1"), "a", *box, version="1.3.0", crs="EPSG:4326")
    return table(spark, sf_dir, "supplier").select("s_suppkey", older.alias("older"), newer.alias("newer"))


@query(f"with {_PLACES} select vec_id, round(lng, 6) + 0.0 as lng, round(lat, 6) + 0.0 as lat, round(lng, 6) + 0.0 as plain_lng from places")
def pixel_inverse(spark, sf_dir):
    p = G.pixel(F.col("lat"), F.col("lng"), F.lit(5))
    q = G.pixel(F.col("lat"), F.col("lng"), F.lit(5), "EPSG4326")
    df = places(spark, sf_dir).select("vec_id", p.alias("p"), q.alias("q"))
    back, plain = G.place_of_pixel(F.col("p.x"), F.col("p.y"), F.lit(5)), G.place_of_pixel(F.col("q.x"), F.col("q.y"), F.lit(5), "EPSG4326")
    z = lambda c: F.round(c, 6) + 0.0
    return df.select("vec_id", z(back.x).alias("lng"), z(back.y).alias("lat"), z(plain.x).alias("plain_lng"))


@query("""with t as (select s_suppkey, (s_nationkey % 8) / 8.0::double as low, (s_nationkey % 8 + 1) / 8.0::double as high from supplier)
select s_suppkey, greatest(0, floor(low * 100))::bigint as first, least(100, ceil(high * 100))::bigint as until, least(99, floor((low + high) / 2 * 100))::bigint as middle from t where 0.75 >= low and 0.25 < high""")
def grid_alignment(spark, sf_dir):
    """Pixels of an image that a tile covers, for the tiles that meet a part of it."""
    k = F.col("s_nationkey") % 8
    t = table(spark, sf_dir, "supplier").select("s_suppkey", (k / 8).alias("low"), ((k + 1) / 8).alias("high"))
    t = t.where(N.overlaps(F.col("low"), F.col("high"), F.lit(0.25), F.lit(0.75)))
    first, until = N.pixel_range(F.col("low"), F.col("high"), 100)
    return t.select("s_suppkey", first.cast("long").alias("first"), until.cast("long").alias("until"), N.nearest_pixel((F.col("low") + F.col("high")) / 2, 100).cast("long").alias("middle"))


@query("select n_regionkey, count(*)::bigint as n from nation group by 1")
def result_cache(spark, sf_dir):
    """Made once, then read twice; a second maker for the same code isn't asked."""
    cache = writers.ResultCache(spark, scratch(spark, "results"))
    cache.get("count nations", lambda: table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.count("*").alias("n")))
    return cache.get("count nations", lambda: spark.range(0).select(F.lit(0).alias("n_regionkey"), F.col("id").alias("n")))


_CONTROLS = ", ".join(f"'enp_{y}'" for y in YEARS)


@query(f"select 'control' as category, unnest([{_CONTROLS}]) as grp, 9::int as colors, true as bounded union all select 'layers_control', null, {len(YEARS)}, null")
def choropleth_controls(spark, sf_dir):
    """The legends and the control of a choropleth; legends span the domain of all columns."""
    values = [f"enp_{y}" for y in YEARS]
    bounds = R.domain(enp_wide(spark, sf_dir), *values)
    rows = bounds.select("low", "high", F.inline(writers.choropleth_controls(values, F.col("low"), F.col("high"))))
    read = F.from_json("content", "colors array<string>, low double, high double, baseGroups array<string>")
    rows = rows.withColumn("c", read)
    return rows.select("category", "grp", F.size(F.coalesce("c.colors", "c.baseGroups")).alias("colors"), ((F.abs(F.col("c.low") - F.col("low")) < 1e-9) & (F.abs(F.col("c.high") - F.col("high")) < 1e-9)).alias("bounded"))


@query("select c_custkey, c_name as only, 1::int as n from customer")
def as_array(spark, sf_dir):
    one = A.as_array(F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.get(one, 0).alias("only"), F.size(one).alias("n"))
