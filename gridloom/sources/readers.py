"""Readers: CSV, GeoJSON, TopoJSON, front matter, site indexes, JSON payloads, rasters, tile providers."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions import geometry as G
from gridloom.functions import text as X
from gridloom.functions.arrays import merge_options

from .tile_catalog import PROVIDERS


def read_csv(spark: SparkSession, path: str, schema: str | None = None, missing: str = "NA") -> DataFrame:
    """A CSV file with a header. `missing` reads as null, an empty text field as an empty text. Types are inferred only without a
    schema."""
    # the parser turns unquoted empty fields into its null value, so that has to be one that no file holds
    reader = spark.read.option("header", True).option("nullValue", "\u0001").option("emptyValue", "")
    if schema is None:
        found = spark.read.option("header", True).option("nullValue", missing).option("inferSchema", True).csv(path)
        schema = found.schema
    rows = reader.csv(path, schema=schema)
    texts = [f.name for f in rows.schema if isinstance(f.dataType, T.StringType)]
    return rows.withColumns({c: F.nullif(F.coalesce(F.col(f"`{c}`"), F.lit("")), F.lit(missing)) for c in texts})


def numbered_paths(base: str, numbers: range, extension: str) -> list[str]:
    return [f"{base}{n}{extension}" for n in numbers]


STYLE = "map<string,string>"
_FEATURE = f"type string, id string, style {STYLE}, properties map<string,string>, geometry struct<type:string,coordinates:string,geometries:string>"
_COLLECTION = f"type string, style {STYLE}, crs struct<type:string,properties:map<string,string>>, features array<struct<{', '.join(x.replace(' ', ':', 1) for x in _FEATURE.split(', '))}>>"


def features(documents: DataFrame, text: str = "value", style: Column | None = None, where: Column | None = None) -> DataFrame:
    """One row for each feature of GeoJSON texts (a FeatureCollection, a Feature or a bare geometry): id, properties, geometry
    (type, coordinates as JSON text, geometries), style (given, data's, feature's and its properties', later ones win), crs, popup.
    Features that `where` does not take are left out."""
    doc = documents.select(F.col(text).alias("t"))
    doc = doc.select("t", F.get_json_object("t", "$.type").alias("kind"), F.from_json("t", _COLLECTION).alias("c"), F.from_json("t", _FEATURE).alias("f"), F.from_json("t", "type string, coordinates string, geometries string").alias("g"))
    bare = F.struct(F.lit("Feature").alias("type"), F.lit(None).cast("string").alias("id"), F.lit(None).cast(STYLE).alias("style"), F.lit(None).cast("map<string,string>").alias("properties"), F.col("g").alias("geometry"))
    one = F.when(F.col("kind") == "FeatureCollection", F.col("c.features")).when(F.col("kind") == "Feature", F.array("f")).otherwise(F.array(bare))
    rows = doc.select(F.col("c.style").alias("outer"), F.col("c.crs").alias("crs"), F.explode(one).alias("f")).where("f.geometry is not null")
    given = style if style is not None else F.lit(None).cast(STYLE)
    inner = F.from_json(F.col("f.properties").getItem("style"), STYLE)
    out = rows.select(
        F.col("f.id").alias("id"), F.col("f.properties").alias("properties"), F.col("f.geometry").alias("geometry"), merge_options(given, F.col("outer"), F.col("f.style"), inner).alias("style"),
        F.when(F.col("crs.type") == "name", F.col("crs.properties").getItem("name")).when(F.col("crs.type").isNotNull(), F.concat("crs.type", F.lit(":"), F.col("crs.properties").getItem("code"))).alias("crs"),
        F.col("f.properties").getItem("popup").alias("popup"),
    )
    return out if where is None else out.where(where)


def read_geojson(spark: SparkSession, paths: list[str] | str, **options) -> DataFrame:
    """Features of all files, in one scan."""
    return features(spark.read.text(paths, wholetext=True), **options)


def single_geometries(df: DataFrame) -> DataFrame:
    """Members of geometry collections as rows of their own."""
    member = "array<struct<type:string,coordinates:string,geometries:string>>"
    parts = F.when(F.col("geometry.type") == "GeometryCollection", F.from_json("geometry.geometries", member)).otherwise(F.array("geometry"))
    return df.withColumn("geometry", F.explode(parts))


#: Nesting of coordinates: arrays around a position.
LEVELS = {"Point": 0, "MultiPoint": 1, "LineString": 1, "MultiLineString": 2, "Polygon": 2, "MultiPolygon": 3}


def polygons(geometry: Column) -> Column:
    """Polygons of a geometry as array of arrays of rings of points (x, y); repeated last points are left out; null for others."""
    one, many = (F.from_json(geometry.coordinates, k) for k in ("array<array<array<double>>>", "array<array<array<array<double>>>>"))
    all_of = F.when(geometry.type == "Polygon", F.array(one)).when(geometry.type == "MultiPolygon", many)
    return F.transform(all_of, lambda poly: F.transform(poly, lambda ring: G.open_ring(F.transform(ring, lambda p: G.point(F.get(p, 0), F.get(p, 1))))))


def lat_lngs(geometry: Column, to_lat_lng: Callable[[Column], Column] | None = None) -> Column:
    """Positions of a point, line or set of points as array of structs lat, lng, alt: the order of the first two is swapped, unless a
    function of a position (an array of numbers) says otherwise."""
    swapped = lambda p: F.struct(F.get(p, 1).alias("lat"), F.get(p, 0).alias("lng"), F.get(p, 2).alias("alt"))
    one, many = F.from_json(geometry.coordinates, "array<double>"), F.from_json(geometry.coordinates, "array<array<double>>")
    points = F.when(geometry.type == "Point", F.array(one)).when(geometry.type.isin("LineString", "MultiPoint"), many)
    return F.transform(points, to_lat_lng or swapped)


def unprojected(polygon_rings: Column, crs: Column) -> Column:
    """Rings in a named coordinate system (spherical or ellipsoidal Mercator by its code) as longitudes and latitudes."""
    code = F.regexp_extract(F.coalesce(crs, F.lit("")), r"(\d+)$", 1)
    turn = lambda f: F.transform(polygon_rings, lambda poly: F.transform(poly, lambda ring: F.transform(ring, lambda p: f(p.x, p.y))))
    return F.when(code.isin("3857", "900913"), turn(G.mercator_inverse)).when(code == "3395", turn(G.ellipsoidal_mercator_inverse)).otherwise(polygon_rings)


def topology_arcs(text: Column) -> Column:
    """Arcs of a TopoJSON text as arrays of points: positions are sums of differences, scaled and moved by the transform."""
    t = F.from_json(text, "arcs array<array<array<double>>>, transform struct<scale:array<double>,translate:array<double>>")

    def walk(arc: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.array().cast("array<struct<x:double,y:double>>").alias("out"))

        def step(acc: Column, p: Column) -> Column:
            x, y = acc.x + F.get(p, 0), acc.y + F.get(p, 1)
            sx, sy = F.coalesce(F.get(t["transform"]["scale"], 0), F.lit(1.0)), F.coalesce(F.get(t["transform"]["scale"], 1), F.lit(1.0))
            tx, ty = F.coalesce(F.get(t["transform"]["translate"], 0), F.lit(0.0)), F.coalesce(F.get(t["transform"]["translate"], 1), F.lit(0.0))
            return F.struct(x.alias("x"), y.alias("y"), F.array_append(acc.out, G.point(x * sx + tx, y * sy + ty)).alias("out"))

        return F.when(t["transform"].isNotNull(), F.aggregate(arc, start, step, lambda acc: acc.out)).otherwise(F.transform(arc, lambda p: G.point(F.get(p, 0), F.get(p, 1))))

    return F.transform(t["arcs"], walk)


_MEMBER = "type:string,id:string,properties:map<string,string>,arcs:string,coordinates:array<double>"


def topology_features(documents: DataFrame, text: str = "value") -> DataFrame:
    """object, id, properties, type, lines (arrays of points x, y) for each geometry of TopoJSON texts: members of collections come one
    by one; a line or ring is its arcs one after the other, without the point that two share; arc ~k is arc k backwards."""
    objects = f"struct<objects:map<string,struct<{_MEMBER},geometries:array<struct<{_MEMBER}>>>>>"
    transform = F.from_json(F.col(text), "transform struct<scale:array<double>,translate:array<double>>")["transform"]
    rows = documents.select(topology_arcs(F.col(text)).alias("all"), transform.alias("t"), F.from_json(F.col(text), objects)["objects"].alias("objects"))
    rows = rows.select("all", "t", F.explode("objects").alias("object", "o"))
    own = F.struct(*(F.col(f"o.{x.split(':')[0]}") for x in ("type", "id", "properties", "arcs", "coordinates")))
    rows = rows.select("object", "all", "t.scale", "t.translate", F.explode(F.when(F.col("o.type") == "GeometryCollection", F.col("o.geometries")).otherwise(F.array(own))).alias("g"))
    arcs = lambda kind: F.from_json("g.arcs", kind)
    chains = (
        F.when(F.col("g.type") == "LineString", F.array(arcs("array<int>")))
        .when(F.col("g.type").isin("MultiLineString", "Polygon"), arcs("array<array<int>>"))
        .when(F.col("g.type") == "MultiPolygon", F.flatten(arcs("array<array<array<int>>>")))
    )
    arc = lambda k: F.when(k >= 0, F.get("all", k)).otherwise(F.reverse(F.get("all", -k - 1)))
    stitched = lambda chain: F.flatten(F.transform(chain, lambda k, n: F.when(n == 0, arc(k)).otherwise(F.slice(arc(k), 2, 1 << 30))))
    moved = lambda k: F.get("g.coordinates", k) * F.coalesce(F.get("scale", k), F.lit(1.0)) + F.coalesce(F.get("translate", k), F.lit(0.0))
    place = F.when(F.col("g.type") == "Point", F.array(F.array(G.point(moved(0), moved(1)))))
    return rows.withColumn("chains", chains).select("object", "g.id", "g.properties", "g.type", F.coalesce(F.transform("chains", stitched), place).alias("lines"))


def with_front_matter(documents: DataFrame, text: str = "value") -> DataFrame:
    """Adds title, author, date, categories, image: the fields with which a document begins, between two lines of three dashes."""
    head = F.regexp_extract(F.col(text), r"(?s)^---\r?\n(.*?)\r?\n---", 1)
    field = lambda name: F.nullif(F.regexp_replace(F.trim(F.regexp_extract(head, rf"(?m)^{name}:[ \t]*(.*)$", 1)), "^[\"']|[\"']$", ""), F.lit(""))
    inline = F.regexp_extract(field("categories"), r"^\[(.*)\]$", 1)
    block = F.regexp_extract_all(F.regexp_extract(head, r"(?m)^categories:[ \t]*\n((?:[ \t]*-[ \t]*.*\n?)+)", 1), F.lit(r"(?m)^[ \t]*-[ \t]*(.*?)[ \t]*$"), F.lit(1))
    items = F.when(F.length(inline) > 0, F.transform(F.split(inline, ","), F.trim)).when(F.size(block) > 0, block)
    day = F.try_to_timestamp(field("date"), F.lit("yyyy-MM-dd")).cast("date")
    return documents.withColumns({"title": field("title"), "author": field("author"), "date": day, "categories": items, "image": field("image")})


def read_posts(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """path and front matter of documents."""
    files = spark.read.text(paths, wholetext=True).withColumn("path", F.input_file_name())
    return with_front_matter(files).drop("value")


SEARCH_DOCUMENT = "objectID string, href string, title string, section string, text string"


def read_search_index(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """The documents of a search index, an array in one file or (lines) one to a line; a file that can't be read is an error."""
    return spark.read.option("mode", "FAILFAST").schema(SEARCH_DOCUMENT).json(path, multiLine=not lines)


def read_listings(spark: SparkSession, path: str) -> DataFrame:
    """listing, items, k (the listing's number), from a JSON array of objects."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<struct<listing:string,items:array<string>>>")).alias("k", "l"))
    return rows.select("l.listing", "l.items", "k")


def payloads(elements: DataFrame, schema: str, text: str = "payload") -> DataFrame:
    """JSON payloads kept by element id, as structs in column x."""
    return elements.withColumn("x", F.from_json(text, schema)).drop(text)


def decode_png(data: bytes) -> tuple[int, int, bytes]:
    """Width, height and red-green-blue-alpha bytes of an 8-bit PNG image without interlacing or palette."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG image")
    at, packed, width, height, channels = 8, b"", 0, 0, 0
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            width, height, depth, color, *rest = struct.unpack(">IIBBBBB", body)
            channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(color, 0)
            if depth != 8 or rest[2] or not channels:
                raise ValueError("unsupported kind of PNG image")
        elif kind == b"IDAT":
            packed += body
        at += size + 12
    if not width or not height:
        raise ValueError("a PNG image without a size")
    stride = width * channels
    raw = np.frombuffer(zlib.decompress(packed), dtype=np.uint8).reshape(height, stride + 1)
    out = np.zeros((height + 1, width + 1, channels), dtype=np.uint8)  # with an empty row above and an empty column before
    for r in range(height):
        kind, line, above = raw[r, 0], raw[r, 1:].reshape(width, channels), out[r]
        row = out[r + 1]
        if kind == 0:
            row[1:] = line
        elif kind == 1:
            row[1:] = np.cumsum(line, axis=0, dtype=np.uint8)
        elif kind == 2:
            row[1:] = line + above[1:]
        elif kind in (3, 4):
            up = above.astype(np.int16)
            for c in range(1, width + 1):  # each pixel needs the one before it
                left = row[c - 1].astype(np.int16)
                if kind == 3:
                    guess = (left + up[c]) // 2
                else:
                    apart = np.abs(np.stack([up[c] - up[c - 1], left - up[c - 1], left + up[c] - 2 * up[c - 1]]))
                    guess = np.choose(apart.argmin(axis=0), [left, up[c], up[c - 1]])  # of equal ones the first
                row[c] = (line[c - 1] + guess).astype(np.uint8)
        else:
            raise ValueError("unknown filter in a PNG image")
    flat = out[1:, 1:]
    rgba = np.full((height, width, 4), 255, dtype=np.uint8)
    rgba[..., :3] = flat[..., :3] if channels > 2 else flat[..., :1]
    if channels in (2, 4):
        rgba[..., 3] = flat[..., -1]
    return width, height, rgba.tobytes()


def encode_png(width: int, height: int, rgba: bytes) -> bytes:
    """An 8-bit PNG image of red-green-blue-alpha bytes."""
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    lines = b"".join(b"\0" + rgba[r * width * 4 : (r + 1) * width * 4] for r in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


#: Pixels in a batch of raster_pixels().
PIXELS = 1 << 18


def raster_pixels(images: DataFrame, id_col: str = "id", uri: str = "uri") -> DataFrame:
    """row, col, r, g, b, a of images given as data URIs of PNG files (base64)."""
    source = images.select(F.col(id_col).alias("id"), F.unbase64(F.regexp_extract(F.col(uri), r"^data:image/png;base64,(.*)$", 1)).alias("png"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, png in enumerate(batch.column("png").to_pylist()):
                if not png:
                    continue
                width, height, flat = decode_png(png)
                pixels = np.frombuffer(flat, dtype=np.uint8).reshape(-1, 4).astype(np.int32)
                for at in range(0, width * height, PIXELS):
                    part = pixels[at : at + PIXELS]
                    n = np.arange(at, at + len(part), dtype=np.int32)
                    ids = batch.column("id").take(pa.array(np.full(len(part), k)))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(n // width), pa.array(n % width), *(pa.array(part[:, c]) for c in range(4))], names=["id", "row", "col", "r", "g", "b", "a"])

    schema = T.StructType([source.schema["id"], *(T.StructField(c, T.IntegerType()) for c in ("row", "col", "r", "g", "b", "a"))])
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def providers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROVIDERS, "provider string, variant string, url string, attribution string, max_zoom int, options map<string,string>")


def provider(catalog: DataFrame, name: str) -> DataFrame:
    """url, attribution, max_zoom of "Provider" or "Provider.Variant": the variant's own values, else the provider's; attributions
    of other providers and options put in, but for keys of an account, which stay in braces. An unknown name is an error."""
    base, _, variant = name.partition(".")
    own = catalog.where((F.col("provider") == base) & F.col("variant").isNull())
    out = own.select("url", "attribution", "max_zoom", "options")
    if variant:
        over = catalog.where((F.col("provider") == base) & (F.col("variant") == variant)).select(*(F.col(c).alias(f"v_{c}") for c in ("url", "attribution", "max_zoom", "options")))
        out = out.join(over, F.lit(True), "inner").select(*(F.coalesce(f"v_{c}", c).alias(c) for c in ("url", "attribution", "max_zoom")), merge_options(F.col("options"), F.col("v_options")).alias("options"))
    if out.isEmpty():
        raise ValueError(f"no tile provider {name}")
    others = catalog.where("variant is null").select(F.col("provider").alias("__p"), F.col("attribution").alias("__a"))
    # names in names, as far as they go: a chain without a circle is no longer than the catalog
    while not out.where(F.col("attribution").rlike(r"\{attribution\.\w+\}")).isEmpty():
        named = F.nullif(F.regexp_extract("attribution", r"\{attribution\.(\w+)\}", 1), F.lit(""))
        out = out.withColumn("__n", named).join(others, F.col("__n") == F.col("__p"), "left")
        out = out.withColumn("attribution", F.replace("attribution", F.concat(F.lit("{attribution."), "__n", F.lit("}")), F.coalesce("__a", F.raise_error(F.concat(F.lit("no attribution of "), "__n")).cast("string")))).drop("__n", "__p", "__a")
    known = F.filter(F.map_entries("options"), lambda e: ~e.value.startswith("<insert "))
    url = F.aggregate(known, F.col("url"), lambda u, e: F.replace(u, F.concat(F.lit("{"), e.key, F.lit("}")), e.value))
    year = X.fill_template(F.col("attribution"), {"year": F.year(F.current_date())})
    return out.select(X.fill_template(url, {"maxZoom": F.col("max_zoom")}).alias("url"), year.alias("attribution"), "max_zoom")


def tile_address(template: Column, x: Column, y: Column, z: Column, subdomains: str = "abc") -> Column:
    """The address of a tile."""
    s = F.get(F.array(*map(F.lit, subdomains)), F.abs(x + y) % len(subdomains))
    return X.fill_template(template, {"x": x, "y": y, "z": z, "s": s, "r": F.lit("")})


def wms_address(base: Column, layers: str, west: Column, south: Column, east: Column, north: Column, size: int = 256, version: str = "1.1.1", crs: str = "EPSG:3857", **params: str) -> Column:
    """The address of a map image of a WMS server; from version 1.3.0 on the system is crs, and EPSG:4326 puts latitudes first."""
    newer = tuple(map(int, version.split("."))) >= (1, 3)
    known = {"service": "WMS", "request": "GetMap", "layers": layers, "styles": "", "format": "image/jpeg", "transparent": "false", "version": version} | params
    known |= {"width": str(size), "height": str(size), "crs" if newer else "srs": crs}
    sides = (south, west, north, east) if newer and crs == "EPSG:4326" else (west, south, east, north)
    query = "&".join(f"{k}={quote(v, safe=chr(39) + '!()*~')}" for k, v in known.items())
    joint = F.when(F.instr(base, "?") > 0, "&").otherwise("?")
    return F.concat(base, joint, F.lit(f"{query}&bbox="), F.concat_ws(",", *(x.cast("string") for x in sides)))
