"""Weighted text search over documents with the columns href, title, section, text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions import text as T

WEIGHTS = {"title": 20, "section": 20, "text": 10}
LIMIT, COLLAPSE_AFTER, MIN_MATCH, THRESHOLD = 50, 3, 2, 0.1


def field_distance(field: Column, query: str) -> Column:
    """0 for a field that holds the query, whatever the case; else the least share of letters to change in a run of as many words;
    null beyond THRESHOLD. An approximation of a browser's fuzzy matcher, whose scoring isn't public here."""
    q = query.lower()
    most = int(THRESHOLD * len(q))
    exact = F.instr(F.lower(field), q) > 0
    if most == 0:
        return F.when(exact, F.lit(0.0))
    n = len(q.split())
    words = F.filter(F.split(F.lower(field), r"\s+", -1), lambda x: x != "")
    # a lambda works out for each element whatever isn't its own argument, so the words are bound once and the runs taken from these
    runs = words if n == 1 else F.transform(F.array(words), lambda w: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))))[0]
    changes = F.array_min(F.filter(F.transform(runs, lambda r: F.levenshtein(r, F.lit(q), most)), lambda d: d >= 0))
    return F.when(exact, F.lit(0.0)).otherwise(changes / len(q))


def search(docs: DataFrame, query: str | None, limit: int | None = LIMIT, order: str = "href") -> DataFrame:
    """Documents that match, best first: score (0 is best), with href, title, section, text. No rows for a query shorter than
    MIN_MATCH. The limit counts hits before any grouping."""
    if not query or len(query) < MIN_MATCH:
        return docs.withColumn("score", F.lit(0.0)).limit(0)
    total = sum(WEIGHTS.values())
    score = F.lit(1.0)
    hit = F.lit(False)
    for c, weight in WEIGHTS.items():
        d = field_distance(F.coalesce(F.col(c), F.lit("")), query)
        hit = hit | d.isNotNull()
        score = score * F.when(d.isNull(), F.lit(1.0)).otherwise(F.pow(F.greatest(d, F.lit(0.001)), F.lit(weight / total)))
    found = docs.withColumn("score", score).where(hit)
    return found if limit is None else found.orderBy("score", order).limit(limit)


def with_snippets(hits: DataFrame, query: str) -> DataFrame:
    """Hits as a page shows them: the query in the address, the text clipped around the first match."""
    return hits.withColumns({"href": T.add_param(F.col("href"), "q", F.lit(query)), "text": T.snippet(F.col("text"), query)})


def grouped(hits: DataFrame, rank: str = "rank", collapse_after: int = COLLAPSE_AFTER, expanded: list[str] | None = None) -> DataFrame:
    """Hits by document, in the order of first hits. type: document for the first row of each, item for the others, more for a row
    that stands for those from number collapse_after on. A hit without a fragment comes first in its group (of several, the last).
    Columns: base, doc_rank, k (place in the group), type, href, title, n_more."""
    base = T.base_href(F.col("href"))
    own = hits.withColumn("base", base).withColumn("whole", F.instr("href", "#") == 0)
    group = W.partitionBy("base")
    own = own.withColumn("doc_rank", F.min(rank).over(group)).withColumn("n", F.count("*").over(group))
    # a first hit stays where it is until a whole document is put before it
    in_order = W.partitionBy("base").orderBy(F.when(F.col("whole"), 0).otherwise(1), F.when(F.col("whole"), -F.col(rank)).otherwise(F.col(rank)))
    own = own.withColumn("k", F.row_number().over(in_order) - 1)
    is_open = F.col("base").isin(expanded) if expanded else F.lit(False)
    rows = own.where(is_open | (F.col("k") < collapse_after)).select("base", "doc_rank", "k", F.when(F.col("k") == 0, "document").otherwise("item").alias("type"), "href", "title", F.lit(None).cast("int").alias("n_more"))
    left = (F.col("n") - collapse_after).cast("int")
    more = own.where((F.col("k") == 0) & (F.col("n") > collapse_after)).select(
        "base", "doc_rank", F.lit(collapse_after).alias("k"), F.lit("more").alias("type"), F.lit(None).cast("string").alias("href"),
        F.when(is_open, "Hide additional matches").when(left == 1, "1 more match in this document").otherwise(F.concat(left.cast("string"), F.lit(" more matches in this document"))).alias("title"), left.alias("n_more"),
    )
    return rows.unionByName(more)


def matching_documents(hits: DataFrame) -> DataFrame:
    """n: documents with a hit."""
    return hits.agg(F.count_distinct(T.base_href(F.col("href"))).alias("n"))


def listings_of(pages: DataFrame, listings: DataFrame) -> DataFrame:
    """page, listing, k: the listings (from 0 in their order) that hold a page, by its path or that of its index.html."""
    items = listings.select("listing", "k", F.explode("items").alias("item"))
    asked = pages.select("page", F.explode(F.array_distinct(F.array("page", F.concat("page", F.lit("index.html"))))).alias("item"))
    return asked.join(items, "item").select("page", "listing", "k").distinct()


def nearest_listing(pages: DataFrame, found: DataFrame) -> DataFrame:
    """page, listing: the listing with the longest leading path in common with the page's folders; then the page that led here
    (column referrer); then the first listing. pages: page, referrer. found: page, listing, k."""
    folders = F.split(F.regexp_replace("page", "^/", ""), "/", -1)
    shared = F.aggregate(
        F.sequence(F.lit(0), F.size(folders)),
        F.lit(0),
        lambda best, n: F.when((n > 0) & F.startswith(F.regexp_replace("listing", "^/", ""), F.array_join(F.slice(folders, 1, n), "/")) & (F.array_join(F.slice(folders, 1, n), "/") != ""), n).otherwise(best),
    )
    led = (F.col("listing") == F.col("referrer")) | (F.col("listing") == F.concat("referrer", F.lit("index.html")))
    ranked = found.join(pages, "page").withColumns({"shared": shared, "led": F.coalesce(led, F.lit(False))})
    w = W.partitionBy("page").orderBy(F.desc("shared"), F.desc("led"), "k")
    return ranked.withColumn("n", F.row_number().over(w)).where("n = 1").select("page", "listing")
