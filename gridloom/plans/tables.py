"""Queries on tables: filters, joins, pivots, listings, layers, events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom import streaming
from gridloom.functions import arrays as A
from gridloom.functions import numbers as N
from gridloom.functions import palette as P
from gridloom.functions import text as X
from gridloom.operators import relational as R
from gridloom.sources import readers, writers

from .registry import Registry, table

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.sql

YEARS = [1996, 1997, 1998]
SEGMENTS = {"BUILDING": "CONSTRUCTION", "AUTOMOBILE": "CARS", "HOUSEHOLD": "HOME"}


def effective_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """unit, year, enp: effective number of market segments, 1 / sum of squared shares (Laakso and Taagepera), by nation and year."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("year"), "o_totalprice")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    sums = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey", "year", "c_mktsegment").agg(F.sum("o_totalprice").alias("v"))
    total = F.sum("v")
    enp = sums.groupBy("c_nationkey", "year").agg((total * total / F.sum(F.col("v") * F.col("v"))).alias("enp"))
    return enp.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("unit"), "year", "enp")


def enp_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations with their values by year: filter, normalise the key, recode, pivot, join, cast."""
    data = effective_number(spark, sf_dir).where(F.col("unit").isNotNull())
    data = data.withColumn("unit_id", X.transliterate(F.col("unit"))).withColumn("unit_id", R.recode(F.col("unit_id"), {"UNITED STATES": "USA"}))
    wide = R.pivot_wide(data, "unit_id", "year", "enp", YEARS, prefix="enp_")
    shapes = table(spark, sf_dir, "nation").select("n_nationkey", R.recode(F.upper(X.transliterate(F.col("n_name"))), {"UNITED STATES": "USA"}).alias("name"))
    joined = R.left_join_missing_equal(shapes, wide, "name", "unit_id")
    return joined.withColumns({f"enp_{y}": N.to_number(F.col(f"enp_{y}").cast("string")) for y in YEARS})


_ENP_SQL = """
sums as (select c_nationkey, year(o_orderdate) as yr, c_mktsegment, sum(o_totalprice) as v from orders join customer on o_custkey = c_custkey group by 1, 2, 3),
enp as (select c_nationkey, yr, sum(v) * sum(v) / sum(v * v) as enp from sums group by 1, 2),
wide as (select n_nationkey, case when upper(n_name) = 'UNITED STATES' then 'USA' else upper(n_name) end as name,
  max(case when yr = 1996 then enp end) as enp_1996, max(case when yr = 1997 then enp end) as enp_1997, max(case when yr = 1998 then enp end) as enp_1998
  from nation left join enp on c_nationkey = n_nationkey group by 1, 2)"""


@query(f"with {_ENP_SQL} select n_nationkey, name, round(enp_1996, 6) as enp_1996, round(enp_1997, 6) as enp_1997, round(enp_1998, 6) as enp_1998 from wide")
def enp_by_nation_wide(spark, sf_dir):
    return enp_wide(spark, sf_dir).select("n_nationkey", "name", *(F.round(f"enp_{y}", 6).alias(f"enp_{y}") for y in YEARS))


@query(f"""with {_ENP_SQL},
long as (select n_nationkey, name, 'enp_1996' as grp, enp_1996 as v, 0 as k from wide union all select n_nationkey, name, 'enp_1997', enp_1997, 1 from wide union all select n_nationkey, name, 'enp_1998', enp_1998, 2 from wide)
select n_nationkey, grp, round(v, 6) as value, '<b>' || name || '</b><br>' || case when v is null then 'NA' else 'value' end as popup_kind, k = 0 as visible from long""")
def choropleth_rows(spark, sf_dir):
    rows = writers.choropleth(enp_wide(spark, sf_dir), "name", [f"enp_{y}" for y in YEARS], ["n_nationkey"])
    kind = F.concat(F.regexp_extract("popup", "^(<b>.*</b><br>)", 1), F.when(F.col("value").isNull(), F.regexp_extract("popup", "<br>(NA)$", 1)).otherwise("value"))
    return rows.select("n_nationkey", "grp", F.round("value", 6).alias("value"), kind.alias("popup_kind"), "visible")


@query("select c_custkey, c_name from customer where c_mktsegment = 'BUILDING'")
def filter_eq(spark, sf_dir):
    return table(spark, sf_dir, "customer").where(F.col("c_mktsegment") == "BUILDING").select("c_custkey", "c_name")


@query("select c_custkey, case nullif(c_mktsegment, 'MACHINERY') when 'BUILDING' then 'CONSTRUCTION' when 'AUTOMOBILE' then 'CARS' when 'HOUSEHOLD' then 'HOME' else nullif(c_mktsegment, 'MACHINERY') end as segment from customer")
def recode_dict(spark, sf_dir):
    df = table(spark, sf_dir, "customer").withColumn("segment", F.nullif("c_mktsegment", F.lit("MACHINERY")))
    return df.select("c_custkey", R.recode(F.col("segment"), SEGMENTS).alias("segment"))


@query("select c_custkey, upper(c_mktsegment) || '!' as segment from customer")
def sequential_mutate(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.upper("c_mktsegment").alias("segment")).withColumn("segment", F.concat("segment", F.lit("!")))


@query("select o_custkey, " + ", ".join(f"round(sum(case when year(o_orderdate) = {y} then o_totalprice end), 2) as total_{y}" for y in YEARS) + " from orders group by 1")
def pivot_wide_sum(spark, sf_dir):
    df = table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate"))
    out = df.groupBy("o_custkey").pivot("year", YEARS).agg(F.sum("o_totalprice"))
    return out.select("o_custkey", *(F.round(str(y), 2).alias(f"total_{y}") for y in YEARS))


@query("with d as (select o_custkey, year(o_orderdate) as y, max(o_totalprice) as v from orders group by 1, 2) select o_custkey, " + ", ".join(f"max(case when y = {y} then v end) as best_{y}" for y in YEARS) + " from d group by 1")
def pivot_wide_first(spark, sf_dir):
    one = table(spark, sf_dir, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(F.max("o_totalprice").alias("v"))
    return R.pivot_wide(one, "o_custkey", "year", "v", YEARS, prefix="best_")


@query("select c_name as name, c_nationkey as nationkey, c_mktsegment as segment, null::double as balance from customer union all select s_name, s_nationkey, null, s_acctbal from supplier")
def union_by_name(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nationkey"), F.col("c_mktsegment").alias("segment"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nationkey"))
    return R.union_by_name(a, b)


@query("""select n.n_nationkey, n.n_name as "name.x", r.r_name as "name.y" from nation n left join region r on n.n_regionkey = r.r_regionkey""")
def left_join_rename(spark, sf_dir):
    a = table(spark, sf_dir, "nation").withColumnRenamed("n_name", "name")
    b = table(spark, sf_dir, "region").withColumnRenamed("r_name", "name")
    return R.left_join_missing_equal(a, b, "n_regionkey", "r_regionkey").select("n_nationkey", "`name.x`", "`name.y`")


@query("""with a as (select c_custkey, nullif(c_nationkey, 3) as k from customer), b as (select nullif(n_nationkey, 3) as k, n_name from nation)
select c_custkey, n_name from a left join b on a.k is not distinct from b.k""")
def left_join_null_safe(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select("c_custkey", F.nullif("c_nationkey", F.lit(3)).alias("k"))
    b = table(spark, sf_dir, "nation").select(F.nullif("n_nationkey", F.lit(3)).alias("k2"), "n_name")
    return R.left_join_missing_equal(a, b, "k", "k2").select("c_custkey", "n_name")


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders)")
def left_anti_unmatched(spark, sf_dir):
    keys = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(keys, "c_custkey", "left_anti").select("c_custkey")


@query("select o_orderkey, o_custkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def semi_selected_keys(spark, sf_dir):
    chosen = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    return R.keep_selected(table(spark, sf_dir, "orders"), "o_custkey", chosen).select("o_orderkey", "o_custkey")


@query("select p_partkey, case p_size % 4 when 0 then 'a' when 1 then 'b' when 2 then 'c' end as size_class from part")
def dictionary_decode(spark, sf_dir):
    data = F.array(*map(F.lit, "abc"))
    return table(spark, sf_dir, "part").select("p_partkey", F.get(A.decode_dictionary(data, F.array(F.col("p_size") % 4)), 0).alias("size_class"))


@query("""with a as (select s_suppkey, row_number() over (order by s_suppkey) - 1 as k from supplier), b as (select r_name, row_number() over (order by r_regionkey) - 1 as k from region)
select s_suppkey, r_name from a join b on a.k % 5 = b.k""")
def positional_bind(spark, sf_dir):
    regions = table(spark, sf_dir, "region")
    out = R.bind_recycled(table(spark, sf_dir, "supplier").select("s_suppkey"), regions.select("r_regionkey", "r_name"), ["s_suppkey"], ["r_regionkey"], regions.count())
    return out.select("s_suppkey", "r_name")


@query("select o_orderkey, d, row_number() over (order by d desc nulls first, o_orderkey) - 1 as idx from (select o_orderkey, case when o_orderkey % 7 = 0 then null else o_orderdate::date end as d from orders) order by d desc nulls first, o_orderkey limit 100")
def listing_nulls_first(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.to_date("o_orderdate")).alias("d"))
    top = R.page(df, 1, 100, R.newest_first("d"), "o_orderkey")
    return R.numbered(top, R.newest_first("d"), "o_orderkey", name="idx").select("o_orderkey", "d", F.col("idx").cast("long").alias("idx"))


@query("select category, n::bigint as n from (select lang as category, count(*) as n from documents group by 1 union all select 'src:' || source, count(*) from documents group by 1 union all select 'All', count(*) from documents)")
def facet_counts(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select(F.array("lang", F.concat(F.lit("src:"), "source")).alias("categories"))
    return R.facets(df, "categories")


@query("select doc_id from documents where lang = 'fr'")
def category_filter(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", F.array("lang", "source").alias("categories"))
    return df.where(R.in_category(F.col("categories"), "fr")).select("doc_id")


@query("select c_custkey, c_name from customer order by c_name, c_custkey limit 25 offset 50")
def page_n(spark, sf_dir):
    return R.page(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), 3, 25, "c_name", "c_custkey")


@query("select o_orderkey, strftime(o_orderdate, '%b %-d, %Y') as short, strftime(o_orderdate, '%B %-d, %Y') as long, epoch_ms(o_orderdate::date) + 18000000 as midnight_ms from orders")
def date_labels(spark, sf_dir):
    d = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", N.date_label(d).alias("short"), N.date_label(d, long=True).alias("long"), N.local_midnight_ms(d, "-05:00").alias("midnight_ms"))


@query("select least(min(p_retailprice), min(p_size)) as low, greatest(max(p_retailprice), max(p_size)) as high from part")
def domain_minmax(spark, sf_dir):
    return R.domain(table(spark, sf_dir, "part").select("p_retailprice", F.col("p_size").cast("double").alias("p_size")), "p_retailprice", "p_size")


def _color_sql(value: str, low: str, high: str) -> str:
    cases = []
    share = f"(({value} - {low}) / ({high} - {low}))"
    at = f"least(floor({share} * 8), 7)::int"
    for k in range(3):
        ends = "[" + ", ".join(str(int(c[1 + 2 * k : 3 + 2 * k], 16)) for c in P.YELLOW_TO_RED) + "]"
        cases.append(f"lpad(lower(to_hex(floor({ends}[{at} + 1] + ({ends}[{at} + 2] - {ends}[{at} + 1]) * ({share} * 8 - {at}) + 0.5)::bigint)), 2, '0')")
    return f"case when {share} between 0 and 1 then '#' || {' || '.join(cases)} else '{P.MISSING}' end"


@query(f"with b as (select min(p_retailprice) as low, max(p_retailprice) as high from part) select p_partkey, {_color_sql('v', 'low', 'high')} as color from (select p_partkey, case when p_partkey % 10 = 0 then null else p_retailprice end as v from part), b")
def color_scale(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    bounds = R.domain(parts, "p_retailprice")
    v = F.when(F.col("p_partkey") % 10 != 0, F.col("p_retailprice"))
    return parts.join(F.broadcast(bounds), F.lit(True), "left").select("p_partkey", P.color_at(v, F.col("low"), F.col("high")).alias("color"))


@query("""with l as (select p_brand, list(s order by s) as labels from (select distinct p_brand, p_size::varchar as s from part) group by 1 having count(*) > 1)
select p_brand, label, round(20 / (0.9 / (n - 1)) * 0.05 + (i - 1) * 20 + 0.5, 6) as y, round(20 / (0.9 / (n - 1)) + 1, 6) as height
from (select p_brand, unnest(labels) as label, generate_subscripts(labels, 1) as i, len(labels) as n from l)""")
def legend_ticks(spark, sf_dir):
    labels = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.sort_array(F.collect_set(F.col("p_size").cast("string"))).alias("labels")).where(F.size("labels") > 1)
    ticks = labels.select("p_brand", P.gradient_height(F.col("labels"), F.lit(0.05), F.lit(0.95)).alias("height"), F.explode(P.legend_ticks(F.col("labels"), F.lit(0.05), F.lit(0.95))).alias("t"))
    return ticks.select("p_brand", "t.label", F.round("t.y", 6).alias("y"), F.round("height", 6).alias("height"))


@query("select r_regionkey, unnest(case when r_regionkey % 2 = 0 then ['low', 'high', 'NA'] else ['low', 'NA'] end) as label, unnest(case when r_regionkey % 2 = 0 then ['#fff', '#000', '#808080'] else ['#fff', '#123'] end) as color from region")
def legend_entries(spark, sf_dir):
    even = F.col("r_regionkey") % 2 == 0
    labels = F.when(even, F.array(F.lit("low"), F.lit("high"))).otherwise(F.array(F.lit("low"), F.lit("NA")))
    colors = F.when(even, F.array(F.lit("#fff"), F.lit("#000"))).otherwise(F.array(F.lit("#fff"), F.lit("#123")))
    return table(spark, sf_dir, "region").select("r_regionkey", F.inline(P.legend_entries(labels, colors, F.lit("NA"), F.lit("#808080"))))


@query("select event_id, user_id, event_type, value from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as n from events) where n = 1")
def last_wins_upsert(spark, sf_dir):
    return R.newest_by_key(table(spark, sf_dir, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("event_id", "user_id", "event_type", "value")


@query("select c_custkey, 0.5::double * case when c_custkey in (select o_custkey from orders where o_totalprice > 100000) then 1.0::double else 0.2::double end as shown_opacity from customer")
def cross_highlight(spark, sf_dir):
    chosen = table(spark, sf_dir, "orders").where("o_totalprice > 100000").select("o_custkey")
    return R.highlight_selected(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", chosen, F.lit(0.5)).select("c_custkey", "shown_opacity")


@query("select n_nationkey, case n_nationkey % 3 when 0 then true when 1 then n_regionkey in (2, 3) else false end as visible from nation")
def zoom_visible(spark, sf_dir):
    levels = F.when(F.col("n_nationkey") % 3 == 0, F.array().cast("array<int>")).when(F.col("n_nationkey") % 3 == 1, F.array(F.col("n_regionkey"), F.col("n_regionkey") + 1))
    return table(spark, sf_dir, "nation").select("n_nationkey", R.visible_at(levels, 3, F.lit(False)).alias("visible"))


@query("select p_partkey, array_to_string(list_transform(range(p_size % 7), lambda i: ['a', 'b', 'c'][(i % 3)::int + 1]), ',') as items from part")
def recycle_array(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(A.recycle(F.array(*map(F.lit, "abc")), F.col("p_size") % 7), ",").alias("items"))


@query("select c_custkey, unnest([c_name, c_mktsegment]) as a, unnest([1, 2])::int as b from customer")
def cols_to_rows(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.inline(A.columns_to_rows(a=F.array("c_name", "c_mktsegment"), b=F.array(F.lit(1), F.lit(2)))))


@query("select s_suppkey, s_suppkey || ',' || s_nationkey as first, s_name || ',x' as second from supplier")
def transpose2d(spark, sf_dir):
    rows = F.array(F.array(F.col("s_suppkey").cast("string"), F.col("s_name")), F.array(F.col("s_nationkey").cast("string"), F.lit("x")))
    t = A.transpose(rows)
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(F.get(t, 0), ",").alias("first"), F.array_join(F.get(t, 1), ",").alias("second"))


@query("select c_custkey, c_mktsegment as seg, (c_nationkey + 1)::varchar as n, 2::int as size from customer")
def hash_parse(spark, sf_dir):
    h = F.concat(F.lit("#seg="), "c_mktsegment", F.lit("&n="), F.col("c_nationkey").cast("string"), F.lit("&broken&a=b=c&n="), (F.col("c_nationkey") + 1).cast("string"))
    m = A.parse_hash(h)
    return table(spark, sf_dir, "customer").select("c_custkey", m["seg"].alias("seg"), m["n"].alias("n"), F.size(m).alias("size"))


@query("select s_suppkey, 'red' as color, s_nationkey::varchar as weight, case when s_nationkey > 10 then '5' else '1' end as radius from supplier")
def merge_options(spark, sf_dir):
    m = lambda *kv: F.create_map(*kv)
    base = m(F.lit("color"), F.lit("blue"), F.lit("radius"), F.lit("1"))
    own = m(F.lit("color"), F.lit("red"), F.lit("weight"), F.col("s_nationkey").cast("string"))
    late = F.when(F.col("s_nationkey") > 10, m(F.lit("radius"), F.lit("5")))
    o = A.merge_options(base, own, late)
    return table(spark, sf_dir, "supplier").select("s_suppkey", o["color"].alias("color"), o["weight"].alias("weight"), o["radius"].alias("radius"))


@query("select n_nationkey, case when n_regionkey in (1, 2) then case when n_regionkey = 1 then '2' else '1' end else '1,2,' || n_regionkey end as items, case when n_regionkey in (1, 2) then n_regionkey - 1 else -1 end::bigint as place from nation")
def toggle_member(spark, sf_dir):
    items = F.array(F.lit(1), F.lit(2))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.array_join(A.toggle(items, F.col("n_regionkey")), ",").alias("items"), A.index_of(items, F.col("n_regionkey")).cast("long").alias("place"))


@query("select event_id, json_extract_string(props, '$.k') as k from events")
def json_member(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", X.json_member(F.col("props"), "k").alias("k"))


@query("select event_id, value * 2 as doubled from (select event_id, try_cast(case when event_id % 3 = 0 then 'n/a' else value::varchar end as double) as value from events) where value is not null")
def numeric_guard(spark, sf_dir):
    raw = F.when(F.col("event_id") % 3 == 0, "n/a").otherwise(F.col("value").cast("string"))
    return R.numeric_only(table(spark, sf_dir, "events").select("event_id", raw.alias("value")), "value").select("event_id", (F.col("value") * 2).alias("doubled"))


@query("select a.n_nationkey as a, b.n_nationkey as b from nation a join nation b on a.n_nationkey < b.n_nationkey + 3 and a.n_nationkey + 1 >= b.n_nationkey")
def interval_overlap(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("a"))
    m = n.withColumnRenamed("a", "b")
    return n.join(m, N.overlaps(F.col("b"), F.col("b") + 3, F.col("a"), F.col("a") + 1))


@query("select 'p_retailprice' as name, p_retailprice as value from part union all select 'p_size', p_size::double from part")
def stack_columns(spark, sf_dir):
    return R.stacked(table(spark, sf_dir, "part").select("p_retailprice", F.col("p_size").cast("double").alias("p_size")), "p_retailprice", "p_size")


@query("select c_custkey, floor((row_number() over (order by c_custkey) - 1) / 20)::int as batch from customer")
def chunk_batches(spark, sf_dir):
    return streaming.chunks(table(spark, sf_dir, "customer").select("c_custkey"), ["c_custkey"], 20)


@query("select r_regionkey, r_regionkey = (select min(r_regionkey) from region where r_regionkey >= 2) as visible from region")
def first_visible_only(spark, sf_dir):
    return R.first_visible_only(table(spark, sf_dir, "region").select("r_regionkey", (F.col("r_regionkey") >= 2).alias("visible")), "r_regionkey", "visible")


@query("select n_nationkey, n_name from nation order by n_nationkey limit 1 offset 4")
def cell_by_position(spark, sf_dir):
    nations = R.require_fields(table(spark, sf_dir, "nation"), "n_name")
    return R.get_cell(nations, ["n_nationkey"], 4, "n_nationkey", "n_name")


@query("select 1 + 1 as value, '[1] 2' as printed")
def cell_output(spark, sf_dir):
    return spark.range(1).select(F.expr("1 + 1").alias("value")).select("value", writers.cell_output(F.col("value")).alias("printed"))


@query("""with s as (select user_id, ts, event_id, value, case when epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts, event_id)) < 3600000000 then 0 else 1 end as new from events),
g as (select *, sum(new) over (partition by user_id order by ts, event_id) as grp from s)
select user_id, min(ts) as started, count(*)::bigint as n, arg_max(value, ts) as value from g group by user_id, grp""")
def debounce_events(spark, sf_dir):
    return streaming.debounce(table(spark, sf_dir, "events"), "user_id", "ts", "1 hour", "value").select("user_id", "started", "n", "value")


@query("""with recursive p as (select user_id, min(ts) as first_ts from events group by user_id
 union all select p.user_id, min(e.ts) from p join events e on e.user_id = p.user_id and e.ts >= p.first_ts + interval 6 hour group by p.user_id)
select p.user_id, p.first_ts, e.value from p join events e on e.user_id = p.user_id and e.ts = p.first_ts""")
def throttle_events(spark, sf_dir):
    return streaming.throttle(table(spark, sf_dir, "events"), "user_id", "ts", "6 hours", "value")


@query("select user_id, max(ts) as ts from events group by 1")
def latest_event(spark, sf_dir):
    return streaming.latest(table(spark, sf_dir, "events").withColumn("at", F.col("ts")), "user_id", "ts", ["at"]).select("user_id", F.col("at").alias("ts"))


@query("select user_id, string_agg(event_type, ',' order by event_id) as calls from events group by 1")
def pending_calls(spark, sf_dir):
    return streaming.pending_calls(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type").select("user_id", F.array_join("calls", ",").alias("calls"))


@query("select event_id from events e join (select user_id, min(ts) as ready from events where event_type = 'signup' group by 1) r on e.user_id = r.user_id and e.ts >= r.ready")
def after_ready(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return streaming.after_ready(events, events.where("event_type = 'signup'"), "user_id", "ts").select("event_id")


@query("select p_partkey, round(8 + (16 - 8) * (p_size % 10) / 10.0, 6) as scale, round((8 + p_size % 10 * 2 - case when p_size % 10 < 4 then 8 else 16 end) / case when p_size % 10 < 4 then 8.0 else 16.0 end + case when p_size % 10 < 4 then 1 else 2 end, 6) as zoom from part")
def scale_zoom(spark, sf_dir):
    scales = F.array(*(F.lit(float(s)) for s in (4, 8, 16, 32)))
    k = F.col("p_size") % 10
    return table(spark, sf_dir, "part").select("p_partkey", F.round(N.scale_at(scales, 1 + k / 10), 6).alias("scale"), F.round(N.zoom_at(scales, 8.0 + k * 2), 6).alias("zoom"))


@query("select 'CartoDB.Positron' as name, 'https://{s}.basemaps.cartocdn.com/light_all/{z}/{x}/{y}{r}.png' as url, '&copy; OpenStreetMap contributors &copy; CARTO' as attribution, 'https://c.basemaps.cartocdn.com/light_all/3/2/5.png' as tile")
def provider_lookup(spark, sf_dir):
    name = "CartoDB.Positron"
    tile = readers.tile_address(F.col("url"), F.lit(2), F.lit(5), F.lit(3), "acb")
    return readers.provider(readers.providers(spark), name).select(F.lit(name).alias("name"), "url", "attribution", tile.alias("tile"))
