"""Queries that go through files and payloads: what is written is read back by the readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import arrays as A
from gridloom.functions import geometry as G
from gridloom.functions import text as X
from gridloom.operators import layers as L
from gridloom.operators import relational as R
from gridloom.operators import search as S
from gridloom.session import scratch
from gridloom.sources import readers, writers

from .registry import Registry, table
from .texts import search_documents

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.sql


@query("select c_custkey, c_name, case when c_custkey % 5 = 0 then null when c_custkey % 7 = 0 then '' else c_mktsegment end as segment, c_acctbal from customer")
def csv_scan(spark, sf_dir):
    """Missing values are written and read as NA, empty texts stay empty."""
    segment = F.when(F.col("c_custkey") % 5 == 0, F.lit(None)).when(F.col("c_custkey") % 7 == 0, "").otherwise(F.col("c_mktsegment"))
    path = scratch(spark, "csv")
    table(spark, sf_dir, "customer").select("c_custkey", "c_name", segment.alias("segment"), "c_acctbal").write.option("header", True).option("nullValue", "NA").option("emptyValue", "").csv(path)
    return readers.read_csv(spark, path, "c_custkey long, c_name string, segment string, c_acctbal double")


@query("select n_nationkey::varchar as id, n_name as name, 2.5::double as x from nation")
def geojson_scan(spark, sf_dir):
    """Several files in one scan."""
    path = scratch(spark, "geojson")
    rows = table(spark, sf_dir, "nation").select(F.concat(F.lit('{"type":"Feature","id":"'), F.col("n_nationkey").cast("string"), F.lit('","properties":'), F.to_json(F.struct(F.col("n_name").alias("name"))), F.lit(',"geometry":{"type":"Point","coordinates":[2.5,1]}}')).alias("value"), "n_regionkey")
    collected = rows.groupBy("n_regionkey").agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.collect_list("value"), ","), F.lit("]}")).alias("value"))
    collected.write.partitionBy("n_regionkey").text(path)  # a file for each region
    found = readers.read_geojson(spark, path)
    return found.select("id", F.col("properties")["name"].alias("name"), F.get(readers.lat_lngs(F.col("geometry")), 0).lng.alias("x"))


@query("select 'p' || (doc_id // 5) || '.html' || case when doc_id % 5 > 0 then '#s' || (doc_id % 5) else '' end as \"objectID\", md5(text) as text_md5 from documents where length(trim(text)) > 0")
def search_index_scan(spark, sf_dir):
    """Whole texts, by their hash as read back. Pages without a text are not written."""
    path = scratch(spark, "search")
    docs = search_documents(spark, sf_dir).withColumn("objectID", F.col("href"))
    writers.write_search_index(docs.select("objectID", "href", "title", "section", "text"), path)
    return readers.read_search_index(spark, path, lines=True).select("objectID", F.md5("text").alias("text_md5"))


@query("select '/' || r_name || '/index.html' as listing, n_name as page from nation join region on n_regionkey = r_regionkey")
def listing_scan(spark, sf_dir):
    path = scratch(spark, "listings")
    both = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    each = both.groupBy(F.concat(F.lit("/"), "r_name", F.lit("/index.html")).alias("listing")).agg(F.collect_list("n_name").alias("items"))
    each.agg(F.to_json(F.collect_list(F.struct("listing", "items"))).alias("value")).write.text(path)
    listings = readers.read_listings(spark, path)
    pages = table(spark, sf_dir, "nation").select(F.col("n_name").alias("page"))
    return S.listings_of(pages, listings).select("listing", "page")


@query("select event_id, json_extract_string(props, '$.k')::bigint as k from events")
def payload_parse(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", F.col("props").alias("payload"))
    return readers.payloads(events, "k bigint").select("event_id", "x.k")


@query("select c_custkey as id, c_mktsegment as title from customer")
def rename_present(spark, sf_dir):
    return R.rename_present(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), {"id": "c_custkey", "title": "c_mktsegment", "text": "c_missing"})


@query("select c_mktsegment as grp, count(*)::bigint as n, max(length(c_name))::bigint as widest, string_agg(c_custkey::varchar, ',' order by c_custkey) as members from customer group by 1")
def group_lists(spark, sf_dir):
    """Distinct groups with their members and widest label."""
    each = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("grp"))
    return each.agg(F.count("*").alias("n"), F.max(F.length("c_name")).cast("long").alias("widest"), F.array_join(F.sort_array(F.collect_list("c_custkey")).cast("array<string>"), ",").alias("members"))


@query("select s_suppkey, 'LatLng(' || s_nationkey || '.0, ' || s_suppkey || '.0)' as place, s_nationkey || '.0,1.0,2.0,3.0' as box, '../' || 'a/' || s_suppkey as url from supplier")
def place_texts(spark, sf_dir):
    n, k = F.col("s_nationkey").cast("double"), F.col("s_suppkey").cast("double")
    return table(spark, sf_dir, "supplier").select("s_suppkey", X.lat_lng_text(n, k).alias("place"), X.box_text(n, F.lit(1.0), F.lit(2.0), F.lit(3.0)).alias("box"), X.offset_url(F.lit("../"), F.concat(F.lit("/a/"), F.col("s_suppkey").cast("string"))).alias("url"))


@query("select n_nationkey, 3::int as opened, 4::int as closed, n_nationkey % 2 = 0 as flat from nation")
def ring_shapes(spark, sf_dir):
    n = F.col("n_nationkey").cast("double")
    ring = F.array(G.point(n, n), G.point(n + 1, n), G.point(n, n + 1), G.point(n, n))
    text = F.when(F.col("n_nationkey") % 2 == 0, "[[1,2],[3,4]]").otherwise("[[[1,2],[3,4]]]")
    return table(spark, sf_dir, "nation").select("n_nationkey", F.size(G.open_ring(ring)).alias("opened"), F.size(G.closed_ring(G.open_ring(ring))).alias("closed"), A.depth_is_flat(text).alias("flat"))


#: Fixed values, written by hand for the SQL: the calls by their effect.
_EFFECTS = {
    "upsert": "addPopups addTiles addWMSTiles addProviderTiles addMarkers addAwesomeMarkers addCircleMarkers addCircles addPolylines addRectangles addPolygons addGeoJSON addTopoJSON addControl addCustomControl addLegend addRasterImage addSelect addLayersControl addScaleBar addMeasure addMarkerCluster",
    "delete by id": "removePopup removeTiles removeMarker removeShape removeGeoJSON removeTopoJSON removeControl removeImage removeMarkerCluster removeMarkerFromCluster",
    "delete by category": "clearPopups clearTiles clearMarkers clearShapes clearGeoJSON clearTopoJSON clearControls clearImages clearMarkerClusters removeLayersControl removeScaleBar removeMeasure removeSelect",
    "delete by group": "clearGroup", "show or hide group": "hideGroup showGroup", "set view": "setView fitBounds flyTo flyToBounds setMaxBounds",
    "zoom levels of group": "setGroupOptions", "lookup": "getControl", "none": "createMapPane",
}


@query(" union all ".join(f"select unnest(string_split('{v}', ' ')) as method, '{k}' as effect" for k, v in _EFFECTS.items()))
def method_registry(spark, sf_dir):
    return spark.createDataFrame(sorted(L.METHODS.items()), "method string, effect string")
