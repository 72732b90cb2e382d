"""Queries on texts, addresses and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import numbers as N
from gridloom.functions import text as X
from gridloom.operators import relational as R
from gridloom.operators import search as S
from gridloom.sources import readers, writers

from .registry import Registry, table

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.sql

#: Fixed values, written by hand for the SQL: letters of the texts and what they become; a sample of other blocks, and its result.
_FROM = "ÄÇÈÉÊÍÑÓÖÜäçèéêíñóöü"
_TO = "ACEEEINOOUaceeeinoou"
_SAMPLE = " Đặng Thị Ngọc Ánh, Łódź Ærø Þór Œuvre ĳs Ẁẽẞ — “quoted” ‘so’ ‹a› «b» „c‟ … 3−2×½ ﬁn ﬄ ＡＢｃ！ ©é"
_SAMPLE_PLAIN = " Dang Thi Ngoc Anh, Lodz AEro THor OEuvre ijs WeSS - \"quoted\" ''so'' <a> <<b>> ,,c\" ... 3-2* 1/2 fin ffl ABc! (C)e"


def _latin_sql(column: str) -> str:
    return f"replace(translate({column}, '{_FROM}', '{_TO}'), 'ß', 'ss')"


@query(f"select doc_id, md5({_latin_sql('text')}) as plain_md5, left({_latin_sql('text')}, 40) as begins, source || '{_SAMPLE_PLAIN}' as other from documents")
def transliterate_docs(spark, sf_dir):
    plain = X.transliterate(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(plain).alias("plain_md5"), F.substring(plain, 1, 40).alias("begins"), X.transliterate(F.concat("source", F.lit(_SAMPLE))).alias("other"))


TERM = "the and"


@query(f"""with d as (select doc_id, text, instr(lower(text), '{TERM}') - 1 as s from documents),
m as (select *, case when s >= 0 then substr(text, 1, s) || '{X.MARK.replace("'", "''")}' || substr(text, s + 1, {len(TERM)}) || '{X.MARK_END}' || substr(text, s + 1 + {len(TERM)}) end as marked from d),
b as (select *, reverse(substr(marked, 1, s)) as back from m),
c as (select *, case when s < 50 then 0 when length(regexp_extract(back, '^[^ ,:]*')) < length(back) then s - length(regexp_extract(back, '^[^ ,:]*')) else 0 end as beg from b),
e as (select *, beg + 234 as clip, substr(marked, beg + 235) as tail from c),
f as (select *, length(regexp_extract(tail, '^[^ ,:]*')) as t from e)
select doc_id, case when s < 0 then text else substr(marked, beg + 1, case when clip > length(marked) then length(marked) when t < length(tail) then clip + t else length(marked) - 1 end - beg)
  || case when clip <= length(marked) and t < length(tail) then '…' else '' end end as snippet from f""")
def snippet(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.snippet(F.col("text"), TERM).alias("snippet"))


@query("select doc_id, md5(regexp_replace(text, '(the)', '<mark>\\1</mark>', 'gi')) as marked_md5 from documents")
def highlight_all(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.highlight_all(F.col("text"), "the")).alias("marked_md5"))


@query("select doc_id, md5(text) as text_md5 from documents")
def highlight_undone(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.unhighlight(X.highlight_all(F.col("text"), "the"))).alias("text_md5"))


@query("select page_id, split_part(url, '#', 1) || case when contains(split_part(url, '#', 1), '?') then '&' else '?' end || 'q=x' || substr(url, length(split_part(url, '#', 1)) + 1) as url from pages")
def url_add_param(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.add_param(F.col("url"), "q", F.lit("x")).alias("url"))


@query("select split_part(url, '#', 1) as base, count(*)::bigint as n, min(page_id) as first from pages group by 1")
def url_fragment_group(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(X.base_href(F.col("url")).alias("base")).agg(F.count("*").alias("n"), F.min("page_id").alias("first"))


@query("select doc_id, to_base64(encode(lang || '%2C' || source)) as code, lang || '|' || source as back from documents")
def base64_categories(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", X.encode_list(F.array("lang", "source")).alias("code"))
    return df.select("doc_id", "code", F.array_join(X.decode_list(F.col("code")), "|").alias("back"))


@query("select doc_id, n::bigint as n_words, ceil(n / 200.0)::bigint as minutes from (select doc_id, len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) as n from documents)")
def reading_time(spark, sf_dir):
    n = F.size(X.words(F.col("text"))).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", n.alias("n_words")).select("doc_id", "n_words", N.reading_minutes(F.col("n_words")).cast("long").alias("minutes"))


def search_documents(spark, sf_dir):
    """Documents as a search index: five to a page, the first of them the page itself."""
    page, section = F.floor(F.col("doc_id") / 5), F.col("doc_id") % 5
    href = F.concat(F.lit("p"), page.cast("string"), F.lit(".html"), F.when(section > 0, F.concat(F.lit("#s"), section.cast("string"))).otherwise(""))
    return table(spark, sf_dir, "documents").select("doc_id", href.alias("href"), F.concat("source", F.lit(" "), "lang").alias("title"), F.lit("").alias("section"), "text")


_HITS_SQL = """docs as (select doc_id, 'p' || (doc_id // 5) || '.html' || case when doc_id % 5 > 0 then '#s' || (doc_id % 5) else '' end as href, source || ' ' || lang as title, text from documents),
hits as (select doc_id, href, title, text, power(case when contains(lower(title), 'src3') then 0.001 else 1.0 end, 0.4) * power(case when contains(lower(text), 'src3') then 0.001 else 1.0 end, 0.2) as score from docs where contains(lower(title), 'src3') or contains(lower(text), 'src3'))"""


@query(f"with {_HITS_SQL} select doc_id, round(score, 9) as score from hits")
def search_weighted(spark, sf_dir):
    return S.search(search_documents(spark, sf_dir), "src3", limit=None).select("doc_id", F.round("score", 9).alias("score"))


@query(f"with {_HITS_SQL} select doc_id, split_part(href, '#', 1) || '?q=src3' || substr(href, length(split_part(href, '#', 1)) + 1) as href from hits order by score, doc_id limit 50")
def search_top50(spark, sf_dir):
    return S.with_snippets(S.search(search_documents(spark, sf_dir), "src3", order="doc_id"), "src3").select("doc_id", "href")


#: A word of the texts with one letter wrong.
MISTYPED = "thisonwhxleon"
_FUZZY = """docs as (select doc_id, source || ' ' || lang as title, lower(text) as text, list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '') as words from documents),
near as (select doc_id, contains(text, '{q}') as exact, list_min(list_transform(words, lambda w: levenshtein(w, '{q}'))) as d from docs)""".format(q=MISTYPED)


@query(f"with {_FUZZY} select doc_id, round(power(case when exact then 0.001 else d / {len(MISTYPED)}.0 end, 0.2), 9) as score from near where exact or d <= 1")
def search_fuzzy(spark, sf_dir):
    return S.search(search_documents(spark, sf_dir), MISTYPED, limit=None).select("doc_id", F.round("score", 9).alias("score"))


@query("select doc_id from documents where false")
def search_empty_query(spark, sf_dir):
    return S.search(search_documents(spark, sf_dir), "").select("doc_id")


_GROUP_SQL = """docs as (select doc_id, 'p' || (doc_id // 5) || '.html' || case when doc_id % 5 > 0 then '#s' || (doc_id % 5) else '' end as href, source || ' ' || lang as title, doc_id as rank from documents),
g as (select *, split_part(href, '#', 1) as base, not contains(href, '#') as whole from docs),
k as (select *, min(rank) over (partition by base) as doc_rank, count(*) over (partition by base) as n, row_number() over (partition by base order by case when whole then 0 else 1 end, rank) - 1 as k from g)"""


@query(f"""with {_GROUP_SQL} select base, doc_rank, k::int as k, case when k = 0 then 'document' else 'item' end as type, href, title, null::int as n_more from k where k < 3
union all select base, doc_rank, 3, 'more', null, case when n = 4 then '1 more match in this document' else (n - 3) || ' more matches in this document' end, (n - 3)::int from k where k = 0 and n > 3""")
def group_collapse_3(spark, sf_dir):
    return S.grouped(search_documents(spark, sf_dir).withColumn("rank", F.col("doc_id")))


@query(f"""with {_GROUP_SQL} select base, doc_rank, k::int as k, case when k = 0 then 'document' else 'item' end as type, href, title, null::int as n_more from k where k < 3 or base in ('p1.html', 'p7.html')
union all select base, doc_rank, 3, 'more', null, case when base in ('p1.html', 'p7.html') then 'Hide additional matches' when n = 4 then '1 more match in this document' else (n - 3) || ' more matches in this document' end, (n - 3)::int from k where k = 0 and n > 3""")
def group_expanded(spark, sf_dir):
    return S.grouped(search_documents(spark, sf_dir).withColumn("rank", F.col("doc_id")), expanded=["p1.html", "p7.html"])


@query(f"with {_HITS_SQL} select count(distinct split_part(href, '#', 1))::bigint as n from hits")
def hit_doc_count(spark, sf_dir):
    return S.matching_documents(S.search(search_documents(spark, sf_dir), "src3", limit=None))


@query("select c_custkey, 'a.b' as first, c_mktsegment as second, 2::int as n from customer")
def split_escaped(spark, sf_dir):
    parts = X.split_escaped(F.concat(F.lit("a\\.b."), "c_mktsegment", F.lit(".")), ".")
    return table(spark, sf_dir, "customer").select("c_custkey", F.get(parts, 0).alias("first"), F.get(parts, 1).alias("second"), F.size(parts).alias("n"))


@query("select s_suppkey, 'https://b/' || s_nationkey || '/' || s_suppkey || '/{keep}' as url from supplier")
def fill_template(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", X.fill_template(F.lit("https://b/{n}/{s}/{keep}"), {"n": F.col("s_nationkey"), "s": F.col("s_suppkey")}).alias("url"))


@query("select n_nationkey, r_name as root, r_name as parent, r_name || ' > ' || n_name as path from nation join region on n_regionkey = r_regionkey")
def breadcrumbs(spark, sf_dir):
    joined = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.array("r_name", "n_name").alias("c"))
    return joined.select("n_nationkey", *(X.breadcrumb(F.col("c"), k).alias(k) for k in ("root", "parent", "path")))


@query("select c_custkey, '<b>' || c_name || '</b><br>' || coalesce(nullif(c_nationkey, 3)::varchar, 'NA') as popup, c_name || ': ' || coalesce(nullif(c_nationkey, 3)::varchar, 'NA') as pasted from customer")
def paste_missing(spark, sf_dir):
    n = F.nullif("c_nationkey", F.lit(3))
    return table(spark, sf_dir, "customer").select("c_custkey", X.popup(F.col("c_name"), n).alias("popup"), X.paste(F.col("c_name"), ": ", n).alias("pasted"))


@query("""with p as (select page_id, '/' || (page_id % 3) || '/' || page_id || '.html' as page from pages)
select page, '/' || (page_id % 3) || '/index.html' as listing from p""")
def nearest_listing(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("/"), (F.col("page_id") % 3).cast("string"), F.lit("/"), F.col("page_id").cast("string"), F.lit(".html")).alias("page"), F.lit(None).cast("string").alias("referrer"))
    listings = pages.select(F.explode(F.array(*(F.lit(f"/{k}/index.html") for k in range(3)))).alias("listing"), "page").groupBy("listing").agg(F.collect_list("page").alias("items"))
    listings = R.numbered(listings, "listing")
    return S.nearest_listing(pages, S.listings_of(pages, listings))


@query("select doc_id, source as title, lang as category, 2020 + doc_id % 5 as year from documents")
def front_matter(spark, sf_dir):
    text = F.concat(F.lit('---\ntitle: "'), "source", F.lit('"\nauthor: "x"\ndate: "'), (2020 + F.col("doc_id") % 5).cast("string"), F.lit('-09-25"\ncategories: ['), "lang", F.lit(", news]\n---\n"), "text")
    docs = table(spark, sf_dir, "documents").select("doc_id", text.alias("value"))
    return readers.with_front_matter(docs).select("doc_id", "title", F.get("categories", 0).alias("category"), F.year("date").cast("long").alias("year"))


@query("select c_custkey, row_number() over (order by d desc nulls first, c_custkey) - 1 as idx from (select c_custkey, case when c_custkey % 3 = 0 then null else make_date(2000 + c_nationkey::int, 1, 1) end as d from customer)")
def listing_order(spark, sf_dir):
    day = F.when(F.col("c_custkey") % 3 != 0, F.make_date(2000 + F.col("c_nationkey"), F.lit(1), F.lit(1)))
    posts = table(spark, sf_dir, "customer").select("c_custkey", F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("title"), day.alias("date"), F.array("c_mktsegment").alias("categories"))
    return writers.listing_rows(posts).select("c_custkey", F.col("idx").cast("long").alias("idx"))
