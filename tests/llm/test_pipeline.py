import numpy as np
import pytest

import corpus_pipeline
from gridloom.llm import bpe, quality
from gridloom.llm.queries import tokenizer_file

from .test_linededup import brute as brute_lines
from .test_mixing import fill
from .test_neardup import brute as brute_classes

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def staged(spark, sf_dir, tmp_path_factory):
    """Input and output of every stage, written and read again."""
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        out.append((docs.collect(), spark.read.parquet(f"{folder}/{k}").collect()))
        docs = spark.read.parquet(f"{folder}/{k}")
    return out


def test_columns(staged):
    for given, _ in staged:
        assert sorted(given[0].asDict()) == sorted(COLUMNS)


def test_quality_stage(spark, sf_dir, staged):
    given, out = staged[0]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    good = {r.doc_id for r in quality.score_quality(docs, model).where("predicted = 1").collect()}
    assert {r.doc_id for r in out} == good and 0 < len(good) < len(given)
    by_id = {r.doc_id: r for r in given}
    assert all(r == by_id[r.doc_id] for r in out)


def test_line_stage(staged):
    given, out = staged[1]
    want = brute_lines([(r.doc_id, r.text) for r in given])
    kept = {r.doc_id: t for r in given if (t := want[r.doc_id, r.text]).strip(" ") or t == r.text}
    assert {r.doc_id: r.text for r in out} == kept and all(r.n_chars == len(r.text) for r in out)


def test_near_duplicate_stage(staged):
    given, out = staged[2]
    want = {i for i, (_, _, kept) in brute_classes([(r.doc_id, r.text) for r in given], 80).items() if kept}
    assert {r.doc_id for r in out} == want and len(out) == len(want)


def test_mixing_stage(staged):
    given, out = staged[3]
    n = lambda rows: sum(len(r.text.encode().split()) for r in rows)
    sizes = {}
    for r in given:
        sizes[r.source] = sizes.get(r.source, 0) + n([r])
    for s, target in fill(sizes).items():
        assert n([r for r in out if r.source == s]) == int(target + 1e-6)
    texts = {r.doc_id: r.text for r in given}
    assert all(texts[r.doc_id].startswith(r.text) for r in out)
    assert len({r.doc_id for r in out if r.text != texts[r.doc_id]}) <= len(sizes)


def test_token_stage(staged):
    given, out = staged[4]
    own = bpe.BpeTokenizer(tokenizer_file("word_bpe_49k.json"))
    want = sorted((r.doc_id, own.encode(r.text)) for r in given)
    assert sorted((r.doc_id, bytes(r.token_ids)) for r in out) == want
    assert all(r.n_tokens == len(np.frombuffer(bytes(r.token_ids), "<u4")) for r in out)


def test_run(spark, sf_dir, staged):
    assert corpus_pipeline.run(spark, sf_dir).count() == len(staged[-1][1])


def test_extra_columns_and_nulls(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40).selectExpr("*", "'x' as id", "1 as size", "2 as node")
    odd = spark.createDataFrame([(None, None, None, None, None, "x", 1, 2), (10**6, "", "en", None, 0, "x", 1, 2), (10**6, "", "en", None, 0, "x", 1, 2)], docs.schema)
    for rows in (docs.unionByName(odd), docs.limit(0)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, rows, sf_dir)
            assert out.count() >= 0 and (k == 4 or sorted(out.columns) == sorted(docs.columns))
