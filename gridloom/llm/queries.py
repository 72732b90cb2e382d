"""The queries opN_... of this subpackage, with production parameters, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, fertility, fingerprint, licenses, linededup, mixing, neardup, quality, urls
from .shared import cut, n_words, table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    out = chat.format_chat(turns.unionByName(own))
    read = out.withColumns({"read": chat.read_turns(F.col("formatted")), "loss": chat.read_trained(F.col("formatted"), F.col("mask"))})
    return read.select(
        "conv_id",
        F.size("read").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("read", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _escaped_sql(text: str) -> str:
    return rf"regexp_replace({text}, '([<\[])(\\*)({chat.CONTROL})', '\1\\\2\3', 'g')"


_HEAD, _SEP, _END = len(chat.START) + 1, len(chat.SEP), len(chat.END)
_ROLE = "replace(replace(" + _escaped_sql("role") + r", '\', '\b'), chr(10), '\n')"
OP2_SQL = f"""
with t as (
  select conv_id, case when conv_id is null then row_number() over () end as own, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, null, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, null, 1, 'assistant', '</s>[INST] ok [/INST]'),
o as (select *, lag(role) over (partition by conv_id, own order by turn nulls first, role, text) as before from t),
p as (select *, length({_escaped_sql("text")}) + case when before = role then {_SEP} else {_HEAD + _END} + length({_ROLE}) end as chars from o),
g as (select conv_id, count(*)::bigint as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text) as turns,
        coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '') as loss, sum(chars)::bigint as formatted_chars from p group by conv_id, own)
select conv_id, n_turns, sha256(turns) as turns_sha256, length(loss)::bigint as loss_chars, sha256(loss) as loss_sha256, formatted_chars from g
"""


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, model).select("doc_id", F.coalesce(quality.fold(F.col("doc_id")) == quality.HELD_OUT, F.lit(False)).alias("held_out"), "score", "predicted")


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = linededup.dedup_lines(docs.withColumn("n_chars", F.length("text").cast("long")), n_chars_col="n_chars", n_deleted_col="n_deleted_lines")
    return out.select("doc_id", "n_deleted_lines", "n_chars", F.sha2("text", 256).alias("text_sha256"))


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = cut(table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size")))
    return mixing.mix(sized, F.col("size")).select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", "taken")


OP5_SQL = """
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size, md5(doc_id::varchar) as key from documents),
s as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as k from d group by source),
r as (select *, case k % 3 when 0 then 1 when 1 then 2 else 3 end as w, 3 * source_size as most from s),
o as (select *, most / w::double as ratio, sum(source_size) over () as total,
        coalesce(sum(most) over (order by most / w::double, k rows between unbounded preceding and 1 preceding), 0) as before,
        sum(w) over (order by most / w::double, k rows between current row and unbounded following) as weights_left from r),
f as (select *, (total - before)::double / weights_left::double > ratio as full_up from o),
t as (select source, source_size,
        case when full_up then most::double
             else (total - sum(case when full_up then most else 0 end) over ())::double / sum(case when full_up then 0 else w end) over () * w end as target from f),
e as (select *, case when source_size = 0 then 0 else floor(floor(target) / source_size)::bigint end as epochs from t),
p as (select d.*, e.source_size, e.target, e.epochs, floor(e.target)::bigint - e.epochs * e.source_size as rest,
        sum(size) over (partition by d.source order by key, size rows between unbounded preceding and current row) - size as upto
      from d join e on d.source is not distinct from e.source)
select doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - upto)))::bigint as taken from p
"""


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op7_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.fertility_rules(table(spark, sf_dir, "documents"), [tokenizer_file("piece_bpe_32k.model"), tokenizer_file("byte_bpe_multi_50k.tiktoken")])


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    pairs = fingerprint.with_next(docs, "doc_id", ["text", "own"], prepare=lambda df: fingerprint.with_fingerprint(df, "text", "own"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    both = fingerprint.with_fingerprint(pairs.withColumns({"n_chars": n.cast("long"), "edited": edited}), "edited", "other")
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint.pack(F.col("own")).alias("fingerprint"),
        fingerprint.pack(F.col("other")).alias("edited_fingerprint"),
        fingerprint.likeness(F.col("own"), F.col("other")).alias("near_edited"),
        fingerprint.likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )


#: Rules of op9: (host, path, verdict).
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Blocklist of op9: names of unwanted sites, under each of the registries that the pages come from.
BLOCKED_NAMES = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]
BLOCKED_UNDER = ["example.com", "example.net", "example.org"]


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame([(f"{a}.{b}",) for a in BLOCKED_NAMES for b in BLOCKED_UNDER], "key string")
    return urls.filter_urls(table(spark, sf_dir, "pages"), listed, URL_RULES)


OP9_SQL = f"""
with p as (
  select page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path
  from pages),
rules(rule_host, rule_path, rule_verdict) as (values {", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in URL_RULES)}),
listed(key) as (values {", ".join(f"('{a}.{b}')" for a in BLOCKED_NAMES for b in BLOCKED_UNDER)}),
fits as (
  select page_id, rule_host || rule_path as rule, rule_verdict,
         row_number() over (partition by page_id order by length(rule_host || rule_path) desc) as k
  from p join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path))
select p.page_id, p.host, p.path, f.rule,
       coalesce(f.rule_verdict, case when exists (select 1 from listed where p.host = key or ends_with(p.host, '.' || key)) then 'block' else 'allow' end) as verdict
from p left join fits f on p.page_id = f.page_id and f.k = 1
"""


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


QUERIES = {"op1_neardup": op1_neardup, "op2_chat": op2_chat, "op3_quality": op3_quality, "op4_lines": op4_lines, "op5_mix": op5_mix, "op6_licenses": op6_licenses, "op7_fertility": op7_fertility, "op8_fingerprints": op8_fingerprints, "op9_urls": op9_urls, "op10_bpe": op10_bpe}
ORACLE_SQL = {"op2_chat": OP2_SQL, "op5_mix": OP5_SQL, "op9_urls": OP9_SQL}
