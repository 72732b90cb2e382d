"""Queries over all rows of their tables, against results worked out here row by row."""

import datetime
import hashlib

import pytest

from gridloom import plans
from gridloom.sources import readers

QUERIES = plans.QUERIES


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)


def test_listing_order_numbers_every_customer(spark, folder):
    rows = [(k, k * 7 % 25, f"segment {k % 5}") for k in range(1, 1301)]
    spark.createDataFrame(rows, "c_custkey long, c_nationkey int, c_mktsegment string").repartition(7).write.parquet(f"{folder}/customer.parquet")
    day = {k: None if k % 3 == 0 else datetime.date(2000 + n, 1, 1) for k, n, _ in rows}
    order = sorted(day, key=lambda k: (day[k] is not None, -day[k].toordinal() if day[k] else 0, k))
    got = {r.c_custkey: r.idx for r in QUERIES["listing_order"](spark, folder).collect()}
    assert got == {k: idx for idx, k in enumerate(order)}


def test_layer_calls_applies_every_event(spark, sf_dir):
    events = sorted(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", "user_id").collect())
    assert events[-1].event_id >= 400
    layers = {}
    for seq, kind, user in events:
        layer_id = None if user % 5 == 0 else str(user)
        if kind in ("view", "click"):
            category = "marker" if kind == "view" else "shape"
            layers[category, layer_id or f"call {seq}"] = (seq, category, layer_id)
        elif kind == "purchase" and layer_id:
            layers.pop(("marker", layer_id), None)
        elif kind == "signup":
            layers = {k: v for k, v in layers.items() if k[0] != "shape"}
    got = [tuple(r) for r in QUERIES["layer_calls"](spark, sf_dir).select("seq", "category", "layer_id").collect()]
    assert sorted(got) == sorted(layers.values())


def md5_by_page(rows):
    return {f"p{k // 5}.html" + (f"#s{k % 5}" if k % 5 else ""): hashlib.md5(text.encode()).hexdigest() for k, text in rows}


def test_search_index_scan_keeps_whole_texts(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert max(len(text) for _, text in docs) > 10_000
    got = QUERIES["search_index_scan"](spark, sf_dir).collect()
    assert len(got) == len(docs)
    assert {r.objectID: r.text_md5 for r in got} == md5_by_page(docs)


def test_search_index_scan_leaves_out_empty_pages_only(spark, folder):
    docs = [(0, "zero"), (1, ""), (2, None), (3, "   "), (4, " " * 150 + "late"), (6, 'six\n"quoted" \\ \u2028 é'), (9, "x" * 50_000)]
    spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'s' as source", "'en' as lang").write.parquet(f"{folder}/documents.parquet")
    got = {r.objectID: r.text_md5 for r in QUERIES["search_index_scan"](spark, folder).collect()}
    assert got == md5_by_page((k, text) for k, text in docs if text and text.strip(" "))


@pytest.mark.parametrize("name,url,attribution", [
    ("CartoDB.PositronNoLabels", "https://{s}.basemaps.cartocdn.com/light_nolabels/{z}/{x}/{y}{r}.png", "&copy; OpenStreetMap contributors &copy; CARTO"),
    ("OpenStreetMap.Mapnik", "https://tile.openstreetmap.org/{z}/{x}/{y}.png", "&copy; OpenStreetMap contributors"),
    ("HikeBike", "https://tiles.wmflabs.org/hikebike/{z}/{x}/{y}.png", "&copy; OpenStreetMap contributors"),
    ("MapTilesAPI.OSMFrancais", "https://maptiles.p.rapidapi.com/fr/map/v1/{z}/{x}/{y}.png?rapidapi-key={apikey}", '&copy; <a href="http://www.maptilesapi.com/">MapTiles API</a>, &copy; OpenStreetMap contributors'),
])
def test_names_of_the_whole_provider_catalog(spark, name, url, attribution):
    got = readers.provider(readers.providers(spark), name).first()
    assert (got.url, got.attribution) == (url, attribution)


def test_provider_catalog(spark):
    rows = readers.providers(spark).collect()
    bases = {r.provider: r for r in rows if r.variant is None}
    assert len(bases) == 36 and len(rows) == 233 == len({(r.provider, r.variant) for r in rows})
    assert all(r.provider in bases for r in rows) and all(r.url and r.attribution for r in bases.values())
    assert sum(r.provider == "CartoDB" for r in rows) == 11
