"""Hand-made rows for single functions and operators, edge cases first."""

import base64
import datetime
import json
import math
import random
import struct
import time
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F

from gridloom import plans, streaming
from gridloom.functions import arrays as A
from gridloom.functions import geometry as G
from gridloom.functions import numbers as N
from gridloom.functions import palette as P
from gridloom.functions import text as X
from gridloom.operators import layers as L
from gridloom.operators import relational as R
from gridloom.operators import search as S
from gridloom.sources import readers, writers


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_transliterate(spark):
    assert one(spark, X.transliterate(F.lit("Ñuñoa Aysén straße Ærø Łódź"))) == "Nunoa Aysen strasse AEro Lodz"
    assert one(spark, X.transliterate(F.lit(None).cast("string"))) is None


def test_paste_and_popup_show_missing_and_escape(spark):
    assert one(spark, X.paste(F.lit("a"), F.lit(None).cast("int"))) == "aNA"
    assert one(spark, X.popup(F.lit("<i>"), F.lit(None).cast("double"))) == "<b>&lt;i&gt;</b><br>NA"


def brute_snippet(text, query):
    start = text.lower().find(query.lower())
    if start < 0:
        return text
    marked = text[:start] + X.MARK + text[start : start + len(query)] + X.MARK_END + text[start + len(query) :]
    begin = 0
    if start >= 50:
        places = [k for k in range(start) if marked[k] in " ,:"]
        begin = places[-1] + 1 if places else 0
    clip = begin + len(X.MARK) + len(X.MARK_END) + 200
    if clip > len(marked):
        return marked[begin:]
    places = [k for k in range(clip, len(marked)) if marked[k] in " ,:"]
    return marked[begin : places[0]] + "…" if places else marked[begin : len(marked) - 1]


def test_snippet(spark):
    texts = ["", "none", "Find me", "x" * 60 + "find" + "y" * 300, "a b, " * 20 + "FIND " + "word " * 60, "a " * 40 + "find" + "z" * 150, "find" + "q" * 234]
    got = [r.x for r in spark.createDataFrame([(t,) for t in texts], "t string").select(X.snippet(F.col("t"), "find").alias("x")).collect()]
    assert got == [brute_snippet(t, "find") for t in texts]


def test_highlight_quotes_the_term(spark):
    assert one(spark, X.highlight_all(F.lit("a+b A+B aab"), "a+b")) == "<mark>a+b</mark> <mark>A+B</mark> aab"
    assert one(spark, X.unhighlight(F.lit("<mark>a</mark>b"))) == "ab"


def test_categories_code(spark):
    code = one(spark, X.encode_list(F.array(F.lit("news"), F.lit("a b"))))
    assert base64.b64decode(code) == b"news%2Ca%20b"
    assert one(spark, X.decode_list(F.lit(code))) == ["news", "a b"]


def test_add_param(spark):
    rows = [("a", "a?q=1"), ("a?b=2", "a?b=2&q=1"), ("a#f", "a?q=1#f"), ("a?b#f#g", "a?b&q=1#f#g")]
    assert [one(spark, X.add_param(F.lit(u), "q", F.lit("1"))) for u, _ in rows] == [w for _, w in rows]


def test_split_escaped(spark):
    assert one(spark, X.split_escaped(F.lit("a\\.b..c\\\\."), ".")) == ["a.b", "", "c\\"]
    assert one(spark, X.split_escaped(F.lit(""), ".")) == []


def test_breadcrumb_needs_two(spark):
    assert one(spark, X.breadcrumb(F.array(F.lit("a")), "path")) is None
    assert one(spark, X.breadcrumb(F.array(F.lit("a"), F.lit("b"), F.lit("c")), "parent")) == "b"


def test_arrays(spark):
    abc = F.array(*map(F.lit, "abc"))
    assert one(spark, A.recycle(abc, 5)) == list("abcab")
    assert one(spark, A.recycle(abc, 0)) == []
    assert one(spark, A.recycle(abc, 2)) == ["a", "b"]
    assert one(spark, A.decode_dictionary(abc, F.array(*map(F.lit, (0, 1, 0, 2))))) == list("abac")
    assert one(spark, A.toggle(abc, F.lit("b"))) == ["a", "c"]
    assert one(spark, A.as_array(F.lit(1))) == [1]
    assert one(spark, A.depth_is_flat(F.lit("[[1,2],[3,4]]"))) is True
    assert one(spark, A.depth_is_flat(F.lit("[[[1,2]]]"))) is False
    assert one(spark, A.write_hash(A.parse_hash(F.lit("#a=1&b&c=2&a=3&x=y=z")))) == "c=2&a=3"


def test_columns_of_unequal_length_fail(spark):
    with pytest.raises(Exception, match="differ in length"):
        one(spark, A.columns_to_rows(a=F.array(F.lit(1)), b=F.array(F.lit(1), F.lit(2))))


def test_numbers(spark):
    assert one(spark, N.round_half_up(F.lit(-2.5), 0)) == -2.0
    assert one(spark, N.wrap(F.lit(190.0), -180, 180)) == -170.0
    assert one(spark, N.wrap(F.lit(180.0), -180, 180, include_high=True)) == 180.0
    assert one(spark, N.to_number(F.lit("abc"))) is None
    assert one(spark, N.local_midnight_ms(F.lit(datetime.date(2025, 9, 25)), "-05:00")) == 1758776400000
    assert [one(spark, N.reading_minutes(F.lit(n))) for n in (455, 1, 9, 32)] == [3, 1, 1, 1]
    scales = F.array(*(F.lit(float(x)) for x in (4, 8, 16)))
    assert [one(spark, N.zoom_at(scales, F.lit(x))) for x in (2.0, 4.0, 12.0, 17.0)] == [float("-inf"), 0.0, 1.5, float("inf")]
    assert one(spark, N.date_label(F.lit(datetime.date(2025, 9, 25)))) == "Sep 25, 2025"


def test_palette(spark):
    at = lambda v: one(spark, P.color_at(F.lit(v).cast("double"), F.lit(0.0), F.lit(1.0)))
    assert [at(0.0), at(1.0), at(None), at(2.0)] == [P.YELLOW_TO_RED[0], P.YELLOW_TO_RED[-1], P.MISSING, P.MISSING]


def test_recode_keeps_the_rest(spark):
    df = spark.createDataFrame([("AISEN",), ("X",), (None,)], "k string")
    assert [r.k for r in df.select(R.recode(F.col("k"), {"AISEN": "AYSEN"}).alias("k")).collect()] == ["AYSEN", "X", None]


def test_pivot_duplicates(spark):
    df = spark.createDataFrame([("a", 2013, 1.0), ("a", 2013, 2.0), ("b", 2017, 3.0)], "u string, y int, v double")
    with pytest.raises(Exception, match="several values"):
        R.pivot_wide(df, "u", "y", "v", [2013, 2017]).collect()
    rows = R.pivot_wide(df, "u", "y", "v", [2013, 2017, 2021], prefix="v_", strict=False).orderBy("u").collect()
    assert rows == [Row(u="a", v_2013=2.0, v_2017=None, v_2021=None), Row(u="b", v_2013=None, v_2017=3.0, v_2021=None)]


def test_join_matches_missing_keys_and_renames(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2)], "k string, v int")
    b = spark.createDataFrame([(None, 10), ("x", 20), ("x", 21)], "id string, v int")
    got = sorted(tuple(r) for r in R.left_join_missing_equal(a, b, "k", "id").select("`v.x`", "`v.y`").collect())
    assert got == [(1, 10), (2, 20), (2, 21)]


def test_selection(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    none, some = df.limit(0), df.where("k = 'a'")
    assert R.keep_selected(df, "k", None).count() == 3
    assert [r.k for r in R.keep_selected(df, "k", some).collect()] == ["a"]
    assert {r.shown_opacity for r in R.highlight_selected(df, "k", none, F.lit(0.5)).collect()} == {0.5}
    assert sorted(r.shown_opacity for r in R.highlight_selected(df, "k", some, F.lit(0.5)).collect()) == [0.1, 0.1, 0.5]


def test_categories(spark):
    df = spark.createDataFrame([(["news", "code"],), (["news"],), (None,), (None,)], "c array<string>")
    assert {r.category: r.n for r in R.facets(df, "c").collect()} == {"All": 4, "news": 2, "code": 1}
    assert df.where(R.in_category(F.col("c"), "code")).count() == 1
    assert df.where(R.in_category(F.col("c"), "")).count() == 4


def test_fields_and_cells(spark):
    df = spark.createDataFrame([("a", None)], "href string, title string")
    with pytest.raises(Exception, match="title is missing"):
        R.require_fields(df, "title").collect()
    with pytest.raises(ValueError, match="column z"):
        R.get_cell(df, ["href"], 0, "z")
    assert R.get_cell(df, ["href"], 0, "href").first().href == "a"
    assert R.rename_present(df, {"url": "href", "x": "nothing"}).columns == ["url", "title"]


def test_fuzzy_search_in_long_texts(spark):
    """The words of a text are taken apart once, not once for each word (which took more than a minute)."""
    text = " ".join(f"word{k:06d}" for k in range(30_000))
    df = spark.createDataFrame([(text + " mistypedterm",), (text + " two misplaced  words",), ("misplaced",), (" ",), (None,)], "text string").coalesce(1)
    began = time.perf_counter()
    one, two = S.field_distance(F.col("text"), "mistypedtern"), S.field_distance(F.col("text"), "misplaced wards")
    assert [tuple(r) for r in df.select(one, two).collect()] == [(1 / 12, None), (None, 1 / 15), (None, None), (None, None), (None, None)]
    assert time.perf_counter() - began < 30


def test_search_and_groups(spark):
    docs = spark.createDataFrame([("p.html#a", "one", "", "Garnet news"), ("p.html", "Garnet", "", ""), ("q.html", "x", "", "garent blog"), ("r.html", "y", "", "none")], "href string, title string, section string, text string")
    hits = S.search(docs, "garnet").collect()
    assert [h.href for h in hits] == ["p.html", "p.html#a"]
    assert S.search(docs, "q").count() == 0 and S.search(docs, None).count() == 0
    ranked = spark.createDataFrame([(f"p.html#{k}", "t", k) for k in range(5)] + [("p.html", "doc", 9), ("q.html#z", "other", 3)], "href string, title string, rank int")
    rows = sorted(S.grouped(ranked).collect(), key=lambda r: (r.doc_rank, r.k))
    assert [(r.type, r.href) for r in rows] == [("document", "p.html"), ("item", "p.html#0"), ("item", "p.html#1"), ("more", None), ("document", "q.html#z")]
    assert rows[3].title == "3 more matches in this document"
    assert S.matching_documents(ranked).first().n == 2


def test_nearest_listing(spark):
    pages = spark.createDataFrame([("/a/b/p.html", None), ("/x/p.html", "/z/"), ("/y/p.html", None)], "page string, referrer string")
    listings = spark.createDataFrame([("/index.html", ["/x/p.html", "/y/p.html"], 0), ("/z/index.html", ["/x/p.html"], 1), ("/a/index.html", ["/a/b/p.html"], 2)], "listing string, items array<string>, k int")
    got = {r.page: r.listing for r in S.nearest_listing(pages, S.listings_of(pages, listings)).collect()}
    assert got == {"/a/b/p.html": "/a/index.html", "/x/p.html": "/z/index.html", "/y/p.html": "/index.html"}


def test_layers(spark):
    rows = [(1, "addMarkers", "a", "g"), (2, "addMarkers", "a", "g"), (3, "addMarkers", None, "g"), (4, "addMarkers", None, "h"), (5, "clearGroup", None, "h"), (6, "addCircles", "a", None), (7, "removeShape", "a", None), (8, "addScaleBar", None, None), (9, "addScaleBar", None, None), (10, "nonsense", None, None), (11, "hideGroup", None, "g")]
    calls = spark.createDataFrame(rows, "seq int, method string, layer_id string, grp string")
    assert sorted(r.seq for r in L.apply_calls(calls).collect()) == [2, 3, 9]
    assert L.group_visibility(calls).collect() == [Row(grp="g", visible=False)]
    assert "addMarkers" in L.METHODS and L.view(calls).count() == 0


def png(width, height, rows, color):
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, color, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(rows))) + chunk(b"IEND", b"")


def test_raster(spark):
    image = png(2, 2, [b"\x01" + bytes([10, 20, 30, 5, 5, 5]), b"\x02" + bytes([1, 1, 1, 2, 2, 2])], 2)
    df = spark.createDataFrame([(7, "data:image/png;base64," + base64.b64encode(image).decode()), (8, None)], "id int, uri string")
    got = sorted(tuple(r) for r in readers.raster_pixels(df).collect())
    assert got == [(7, 0, 0, 10, 20, 30, 255), (7, 0, 1, 15, 25, 35, 255), (7, 1, 0, 11, 21, 31, 255), (7, 1, 1, 17, 27, 37, 255)]


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Unit,ENP\nMunicipality,1.5\n,NA\n")
    rows = readers.read_csv(spark, str(tmp_path / "a.csv"), "Unit string, ENP double").collect()
    assert rows == [Row(Unit="Municipality", ENP=1.5), Row(Unit="", ENP=None)]
    for k in (1, 2):
        feature = {"type": "Feature", "id": k, "properties": {"Comuna": f"c{k}", "popup": "p"}, "style": {"color": "red"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}}
        (tmp_path / f"{k}.geojson").write_text(json.dumps({"type": "FeatureCollection", "style": {"color": "blue", "weight": "1"}, "features": [feature]}))
    found = readers.read_geojson(spark, readers.numbered_paths(f"{tmp_path}/", range(1, 3), ".geojson")).withColumn("rings", readers.polygons(F.col("geometry"))).orderBy("id").collect()
    assert [r.properties["Comuna"] for r in found] == ["c1", "c2"]
    assert found[0].style == {"color": "red", "weight": "1"} and len(found[0].rings[0][0]) == 3
    (tmp_path / "search.json").write_text(json.dumps([{"objectID": "a", "href": "a.html", "title": "t", "section": "", "text": "x"}, {"objectID": "b", "href": "b.html", "title": "t", "section": "", "text": " "}]))
    docs = readers.read_search_index(spark, str(tmp_path / "search.json"))
    writers.write_search_index(docs, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1
    (tmp_path / "listings.json").write_text(json.dumps([{"listing": "/index.html", "items": ["/a.html"]}]))
    assert readers.read_listings(spark, str(tmp_path / "listings.json")).first()["items"] == ["/a.html"]
    (tmp_path / "post.md").write_text('---\ntitle: "Welcome"\ndate: "2025-09-22"\ncategories:\n  - news\n  - code\n---\ntext')
    post = readers.read_posts(spark, str(tmp_path / "post.md")).first()
    assert (post.title, post.date, post.categories, post.image) == ("Welcome", datetime.date(2025, 9, 22), ["news", "code"], None)


def test_geometry_texts(spark):
    p = F.array(G.point(F.lit(1.23456789), F.lit(2)))
    assert json.loads(one(spark, writers.points_geometry(p)))["coordinates"] == [1.234568, 2.0]
    both = one(spark, writers.geometry_collection(F.array(writers.points_geometry(p), writers.points_geometry(p))))
    df = spark.createDataFrame([(both,)], "value string")
    parts = readers.single_geometries(readers.features(df)).select(readers.lat_lngs(F.col("geometry")).alias("x")).collect()
    assert [(r.x[0].lat, r.x[0].lng) for r in parts] == [(2.0, 1.234568)] * 2


def test_results_are_made_once(spark, tmp_path):
    made = []
    cache = writers.ResultCache(spark, str(tmp_path))
    make = lambda: made.append(1) or spark.range(3)
    assert cache.get("1 + 1", make).count() == cache.get("1 + 1", make).count() == 3
    assert made == [1]


def test_providers(spark):
    catalog = readers.providers(spark)
    assert readers.provider(catalog, "OpenTopoMap").first().attribution == "Map data: &copy; OpenStreetMap contributors, SRTM"
    with pytest.raises(ValueError, match="no tile provider"):
        readers.provider(catalog, "CartoDB.Nothing")


def test_streams(spark, tmp_path):
    spark.createDataFrame([(1, datetime.datetime(2024, 1, 1, 0, 0, k), k) for k in (0, 1, 2, 30, 31)], "key int, ts timestamp, v int").write.parquet(str(tmp_path / "in"))
    batch = streaming.debounce(spark.read.parquet(str(tmp_path / "in")), "key", "ts", "5 seconds", "v")
    assert sorted((r.n, r.v) for r in batch.collect()) == [(2, 31), (3, 2)]
    stream = streaming.throttle(spark.readStream.schema("key int, ts timestamp, v int").parquet(str(tmp_path / "in")), "key", "ts", "10 seconds", "v", watermark="1 minute")
    q = stream.writeStream.format("memory").queryName("throttled").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    batch = streaming.throttle(spark.read.parquet(str(tmp_path / "in")), "key", "ts", "10 seconds", "v").collect()
    assert sorted(r.v for r in spark.table("throttled").collect()) == sorted(r.v for r in batch) == [0, 30]


def test_throttle_waits_from_the_last_event_that_passed(spark):
    rows = [(1, s, s) for s in (59, 61, 62, 150, 209, 210)] + [(2, 0, 1), (2, 0, 0), (None, 5, 5), (2, None, 9)]
    df = spark.createDataFrame(rows, "key int, s int, v int").withColumn("ts", F.timestamp_seconds("s"))
    got = streaming.throttle(df, "key", "ts", "60 seconds", "v").select("key", F.unix_seconds("first_ts"), "v").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(1, 59, 59), (1, 150, 150), (1, 210, 210), (2, 0, 0), (None, 5, 5)]))
    assert streaming.throttle(df.limit(0), "key", "ts", "60 seconds", "v").count() == 0


def brute_simplify(points, tolerance):
    """Radial distance, then the recursive form of Douglas and Peucker."""
    kept = [points[0]]
    for p in points[1:]:
        if math.dist(p, kept[-1]) > tolerance:
            kept.append(p)
    if kept[-1] != points[-1]:
        kept.append(points[-1])

    def off(p, a, b):
        dot = (b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2
        t = max(0.0, min(1.0, ((p[0] - a[0]) * (b[0] - a[0]) + (p[1] - a[1]) * (b[1] - a[1])) / dot)) if dot else 0.0
        return math.dist(p, (a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))

    def walk(line):
        if len(line) < 3:
            return line
        far = max(range(1, len(line) - 1), key=lambda k: off(line[k], line[0], line[-1]))
        if off(line[far], line[0], line[-1]) <= tolerance:
            return [line[0], line[-1]]
        return walk(line[: far + 1])[:-1] + walk(line[far:])

    return walk(kept)


def test_simplified_lines_of_the_query(spark, sf_dir):
    lines_ = {r.vec_id: [(float(k), x) for k, x in enumerate(r.embedding[:32])] for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    want = {i: brute_simplify(p, 0.1) for i, p in lines_.items()}
    got = plans.QUERIES["simplify_line"](spark, sf_dir).collect()
    assert {r.vec_id: (r.n, r.sum_x) for r in got} == {i: (len(p), round(sum(x for x, _ in p), 6)) for i, p in want.items()}
    assert brute_simplify([(0, 0), (1, 0.05), (2, 0), (3, 4)], 0.1) == [(0, 0), (2, 0), (3, 4)]


@pytest.mark.parametrize("ring,want", [
    ([(0, 0), (4, 0), (4, 4), (0, 4)], {(1, 1), (3, 1), (3, 2), (1, 2)}), ([(2, 1.5), (2.5, 1.5), (2.5, 1.75)], {(2, 1.5), (2.5, 1.5), (2.5, 1.75)}),
    ([(0, 1.5), (2, 1.5), (2, 9)], {(1, 1.5), (2, 1.5), (2, 2), (1, 2)}), ([(7, 7), (8, 7), (8, 8)], set()), ([(2, 0), (4, 2), (2, 2)], {(3, 1), (3, 2), (2, 2), (2, 1)}),
])
def test_clipped_polygons_by_hand(spark, ring, want):
    """Rings and the box from (1, 1) to (3, 2)."""
    df = spark.createDataFrame([([{"x": float(x), "y": float(y)} for x, y in ring],)], "ring array<struct<x:double,y:double>>")
    got = df.select(G.clip_polygon("ring", *map(F.lit, (1.0, 1.0, 3.0, 2.0))).alias("c")).first().c
    assert {(p.x, p.y) for p in got} == want


def test_brush_equals_all_comparisons(spark):
    rnd = random.Random(8)
    layers = [(f"g{k % 3}", str(k), rnd.uniform(-90, 90), rnd.uniform(-200, 200)) for k in range(400)] + [("g", "n", None, 1.0), (None, "x", 0.0, 0.0), ("g", "edge", 10.0, 20.0)]
    boxes = [(k, s, w, s + rnd.choice([0.0, 0.01, 3.0, 80.0]), w + rnd.choice([0.0, 0.2, 40.0, 500.0])) for k in range(60) for s, w in [(rnd.uniform(-90, 60), rnd.uniform(-220, 120))]] + [(99, 10.0, 20.0, 10.0, 20.0), (98, 5.0, 5.0, 4.0, 9.0)]
    got = L.brush(spark.createDataFrame(layers, "ct_group string, ct_key string, lat double, lng double"), spark.createDataFrame(boxes, "box_id int, south double, west double, north double, east double"))
    want = [(b, g, k) for b, s, w, n, e in boxes for g, k, lat, lng in layers if g and lat is not None and s <= lat <= n and w <= lng <= e]
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 100


def test_png_filters(spark):
    """An image whose lines use each filter in turn, undone pixel by pixel."""
    rnd, width, height = random.Random(2), 7, 10
    for color, channels in ((0, 1), (2, 3), (4, 2), (6, 4)):
        image = [[[rnd.randrange(256) for _ in range(channels)] for _ in range(width)] for _ in range(height)]
        lines = b""
        for r, row in enumerate(image):
            kind, line = r % 5, []
            for c, pixel in enumerate(row):
                for k, v in enumerate(pixel):
                    left, up, corner = (row[c - 1][k] if c else 0), (image[r - 1][c][k] if r else 0), (image[r - 1][c - 1][k] if r and c else 0)
                    p = left + up - corner
                    paeth = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
                    line.append((v - (0, left, up, (left + up) // 2, paeth)[kind]) % 256)
            lines += bytes([kind, *line])
        chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + b"\0\0\0\0"
        data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, color, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
        flat = [x for row in image for p in row for x in ((p[:3] if channels > 2 else [p[0]] * 3) + ([p[-1]] if channels in (2, 4) else [255]))]
        assert readers.decode_png(data) == (width, height, bytes(flat))
    with pytest.raises(ValueError, match="not a PNG"):
        readers.decode_png(b"GIF")


def test_search_index_errors(spark, tmp_path):
    (tmp_path / "bad.json").write_text('{"objectID": "a", "href": ', encoding="utf-8")
    with pytest.raises(Exception, match="MALFORMED|Malformed|malformed"):
        readers.read_search_index(spark, str(tmp_path / "bad.json")).collect()


numbers = st.floats(-50, 50, allow_nan=False).map(lambda x: round(x, 3))
lines = st.lists(st.tuples(numbers, numbers), min_size=2, max_size=30)


@settings(max_examples=200, deadline=None)
@given(lines, st.floats(0.01, 20))
def test_simplified_points_are_a_subset(points, tolerance):
    kept = G.thin_points(points, tolerance)
    assert kept[0] == points[0] and kept[-1] == points[-1] and set(kept) <= set(points)


@settings(max_examples=200, deadline=None)
@given(lines)
def test_clipped_points_lie_inside(points):
    assert all(-10 <= x <= 10 and -10 <= y <= 10 for x, y in G.clip_points(points, (-10, -10, 10, 10)))


def test_geometry(spark):
    square = F.array(*(G.point(F.lit(x), F.lit(y)) for x, y in ((0, 0), (2, 0), (2, 2), (0, 2))))
    hole = F.array(*(G.point(F.lit(x), F.lit(y)) for x, y in ((0.5, 0.5), (1.5, 0.5), (1.5, 1.5), (0.5, 1.5))))
    assert one(spark, G.in_polygon(F.array(square, hole), F.lit(1.0), F.lit(1.0))) is False
    assert one(spark, G.in_polygon(F.array(square), F.lit(1.0), F.lit(1.0))) is True
    assert tuple(one(spark, G.ring_centroid(square))) == (1.0, 1.0)
    assert tuple(one(spark, G.line_midpoint(F.slice(square, 1, 2)))) == (1.0, 0.0)
    assert one(spark, G.near_line(square, F.lit(1.0), F.lit(0.1), F.lit(0.2))) is True
    assert len(one(spark, G.open_ring(G.closed_ring(square)))) == 4
    assert one(spark, G.clip_segment(F.lit(5.0), F.lit(5.0), F.lit(6.0), F.lit(6.0), G.box(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0)))) is None
    back = one(spark, G.mercator_inverse(F.lit(1e6), F.lit(2e6)))
    forth = one(spark, G.mercator(F.lit(back.y), F.lit(back.x)))
    assert abs(forth.x - 1e6) < 1e-3 and abs(forth.y - 2e6) < 1e-3
    assert G.crs_code(None) == "EPSG3857" and G.crs_code("urn:ogc:def:crs:EPSG::3857") == "EPSG:3857" and G.crs_code("L.CRS.Simple") == "Simple"
    assert tuple(one(spark, G.box_extend(G.box_of(square), G.box(F.lit(-1.0), F.lit(None).cast("double"), F.lit(1.0), F.lit(9.0))))) == (-1.0, 0.0, 2.0, 9.0)
