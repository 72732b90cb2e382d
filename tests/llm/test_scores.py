"""Quality classifier, fertility rules, fingerprints, license scans."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from gridloom.llm import fertility, fingerprint, licenses, quality
from gridloom.llm.queries import QUERIES, tokenizer_file

from .test_linededup import hash_longs, hash_text

SCHEMA = "doc_id long, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, sf_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def test_quality_on_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    got = QUERIES["op3_quality"](spark, sf_dir).collect()
    assert len(got) == 1000
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    held = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert len(held) > 50 and np.mean([a == b for a, b in held]) > 0.95


def test_held_out_labels_are_not_learnt_from(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(quality.fold(F.col("doc_id")) == quality.HELD_OUT, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.fit_quality(docs, labels) == quality.fit_quality(docs, turned)


def sizes_by(dictionary, text):
    """Compressed size of all blocks of a text, one compressor for each block."""
    total = 0
    for at in range(0, len(text), 512):
        d = zstandard.ZstdCompressionDict(dictionary)
        total += len(zstandard.ZstdCompressor(level=3, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress(text[at : at + 512]))
    return total


def test_quality_step_by_step(spark):
    """The learnt rows, differences, the calibration and the scores of op3, worked out plainly."""
    sf_dir = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit_quality(docs, labels)
    texts = documents(spark, sf_dir)
    known = sorted((r.doc_id, r.quality) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2)
    learnt, rest = ([x for x in known if (zlib.crc32(str(x[0]).encode()) % 4 == 3) == c] for c in (False, True))
    for label, dictionary in ((1, model.good), (0, model.bad)):  # every block of every learnt text, in one fixed order
        own = [b[at : at + 512] for i, q in learnt if q == label for b in [texts[i].encode()] for at in range(0, len(b), 512)]
        random.Random(0).shuffle(own)
        assert dictionary == zstandard.train_dictionary(65536, own).as_bytes()
    difference = {i: (sizes_by(model.bad, t.encode()) - sizes_by(model.good, t.encode())) / max(1, len(t.encode())) for i, t in texts.items()}
    # the curve is where the gradient of the likelihood (with its slight pull) is nil
    x, y = np.array([difference[i] for i, _ in rest]), np.array([q for _, q in rest])
    p = 1 / (1 + np.exp(-(model.offset + model.slope * x)))
    scale = np.abs(x).mean()
    assert abs((y - p).sum() - 0.01 * model.offset) < 1e-6 and abs(((y - p) * x / scale).sum() - 0.01 * model.slope * scale) < 1e-6
    for r in QUERIES["op3_quality"](spark, sf_dir).collect():
        want = 1 / (1 + np.exp(-(model.offset + model.slope * difference[r.doc_id])))
        assert abs(r.score - want) < 1e-9 and r.predicted == (want >= 0.7)


def test_quality_sample_is_bounded_and_whole(spark, monkeypatch):
    """Rows are taken whole or not at all, up to a number of bytes; texts above a bound are not learnt from."""
    rows = [(k, f"good text number {k} " * 40 if k % 2 else f"### {k} *** " * 60) for k in range(200)] + [(1000, "x" * 50_000), (1001, "y" * 50_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    whole = quality.fit_quality(df, labels)
    monkeypatch.setattr(quality, "FIT_TEXT_BYTES", 10_000)
    assert quality.fit_quality(df, labels) == quality.fit_quality(df.where("doc_id < 1000"), labels) != whole
    monkeypatch.setattr(quality, "FIT_BYTES", 20_000)
    few = quality.fit_quality(df, labels)
    assert len(few.good) + len(few.bad) <= 20_000 and few.good and few.bad
    twice = df.unionByName(df)
    assert quality.fit_quality(twice, labels) == few


def test_quality_edge_cases(spark):
    rows = [(1, None), (2, ""), (None, "good text"), (3, "### *** " * 20_000), (3, "x"), (3, "x")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'a' as id", "0.5 as difference", "1 as label")
    none = spark.createDataFrame([], "doc_id long, quality int")
    empty = quality.fit_quality(df, none)
    assert {r.score for r in quality.score_quality(df, empty).collect()} == {0.5}
    one_kind = quality.fit_quality(df, spark.createDataFrame([(1, 1), (3, 1), (None, 0), (2, None)], "doc_id long, quality int"))
    assert all(r.score > 0.99 for r in quality.score_quality(df, one_kind).collect())
    both = quality.fit_quality(df, spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int"))
    assert quality.score_quality(df, both).count() == len(rows)
    kept = quality.keep_good(df, one_kind)
    assert kept.columns == df.columns and kept.count() == len(rows)
    assert quality.score_quality(df.limit(0), both).count() == 0 and quality.keep_good(df.limit(0), both).count() == 0


def brute_base(text):
    words = WORD.findall(text or "")
    grams = collections.Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {k + j for k in range(len(words) - 2) for j in range(3) if grams[words[k], words[k + 1], words[k + 2]] > 1}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_fertility(spark, sf_dir):
    docs = documents(spark, sf_dir)
    got = {r.doc_id: r for r in QUERIES["op7_fertility"](spark, sf_dir).collect()}
    assert got.keys() == docs.keys()
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    for i, text in docs.items():
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_base(text)
        assert not (r.kept and r.base_failed)
        ids = [t for w in WORD.findall(text) for t in model.encode(w)]
        share = np.array(list(collections.Counter(ids).values())) / max(1, len(ids))
        assert r.n_tokens == len(ids) and abs(r.entropy + float((share * np.log2(share)).sum())) < 1e-6
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    clean = [r.kept for i, r in got.items() if labels.get(i) == 1 and not r.base_failed]
    assert np.mean(clean) > 0.95


def middle(values):
    """The lower median on the grid."""
    at = sorted(int(np.floor(v * fertility.GRID + 0.5)) for v in values)
    return at[(len(at) - 1) // 2] / fertility.GRID


def test_fertility_verdicts(spark):
    """kept, from the measures of all rows by numpy; and how it agrees with the labels."""
    sf_dir = "/root/testdata/sf0.01"
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").collect()}
    rows = QUERIES["op7_fertility"](spark, sf_dir).collect()
    groups = collections.defaultdict(list)

    def values(r):
        for k, s in enumerate(("", "_2")):
            yield (langs[r.doc_id], 2 * k, 0), r["chars_per_token" + s]
            yield (langs[r.doc_id], 2 * k + 1, int(np.log2(max(1, r["n_tokens" + s])))), r["entropy" + s]

    for r in rows:
        for key, v in values(r) if r.n_words >= 50 else ():
            groups[key].append((v, r.n_words**0.5))
    bands = {}
    for key, own in groups.items():
        m = middle([v for v, _ in own])
        least = m * (0.005, 0.014)[key[1] % 2]
        bands[key] = m, max(least, middle([abs(v - m) for v, _ in own])), middle([abs(v - m) * root for v, root in own])
    near = 0
    for r in rows:
        inside, edge = not r.base_failed, False
        least, most, fallback, entropy = fertility.BANDS[r.script]
        for s in ("", "_2"):
            inside = inside and least <= r["chars_per_token" + s] <= most and r["byte_share" + s] <= fallback and r["entropy" + s] >= entropy * np.log2(max(1, min(r["n_tokens" + s], 90)))
        for key, v in values(r):
            if key in bands:
                m, wide, by_root = bands[key]
                bound = 5 * max(wide, by_root / max(1, r.n_words) ** 0.5) + 1 / fertility.GRID
                edge = edge or abs(abs(v - m) - bound) < 0.02  # a value on the border of two grid points may round either way
                inside = inside and abs(v - m) <= bound
        near += edge
        assert edge or r.kept == inside, r
    assert near < 0.1 * len(rows)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = {q: [r.kept for r in rows if labels.get(r.doc_id) == q and not r.base_failed] for q in (0, 1)}
    assert np.mean(kept[1]) > 0.98 and np.mean(kept[0]) < 0.2


def test_scripts_and_byte_shares(spark):
    """A text of each script; byte shares by both vocabularies, recounted."""
    import base64

    import sentencepiece
    import tiktoken

    texts = {"latin": "An easy text of words", "greek": "Ένα απλό κείμενο", "cyrillic": "Простой текст слов", "semitic": "نص بسيط שלום", "indic": "सरल पाठ", "east_asian": "简单的 文字 テキスト 한국어", "none": "123 456 !!!"}
    df = spark.createDataFrame(list(enumerate(texts.values())), SCHEMA)
    paths = [tokenizer_file("piece_bpe_32k.model"), tokenizer_file("byte_bpe_multi_50k.tiktoken")]
    got = {r.doc_id: r for r in fertility.fertility_rules(df, paths, lang_col=None).collect()}
    model = sentencepiece.SentencePieceProcessor(model_file=paths[0])
    with open(paths[1], "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    names = {v: k for k, v in ranks.items()}
    encoding = tiktoken.Encoding("own", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})

    def whole(token):
        try:
            return bool(names[token].decode()) or True
        except UnicodeDecodeError:
            return False

    for k, (script, text) in enumerate(texts.items()):
        pieces = [t for w in text.split() for t in model.encode(w)]
        tokens = [t for w in text.split() for t in encoding.encode_ordinary(" " + w)]
        assert got[k].script == script and not got[k].kept  # too short
        assert (got[k].n_tokens, got[k].n_tokens_2) == (len(pieces), len(tokens))
        assert abs(got[k].byte_share - np.mean([model.is_byte(t) for t in pieces])) < 1e-9
        assert abs(got[k].byte_share_2 - np.mean([not whole(t) for t in tokens])) < 1e-9
        assert abs(got[k].chars_per_token_2 - len(text.replace(" ", "")) / len(tokens)) < 1e-9
    assert got[4].byte_share > 0


def test_fertility_edge_cases(spark):
    same = "word word word word " * 30
    rows = [(1, None, "en"), (2, "", None), (None, same, "en"), (3, "a\x1cb  c\r\x0bd\n\x85e", "xx"), (4, "汉字 тест αβγ हिन्दी 𓀀𒀀𓁹 " * 30, None), (5, "\n\n a \n a \n", "en"), (6, "lorem ipsum " * 40_000, "en"), (7, "x" * 300_000 + " é" * 9, "en")]
    df = spark.createDataFrame(rows, SCHEMA + ", lang string").selectExpr("*", "'a' as id", "1 as n_words", "2 as kept")
    got = {r.doc_id: r for r in fertility.fertility_rules(df, tokenizer_file("piece_bpe_32k.model")).collect()}
    for i, text, _ in rows:
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words, got[i].base_failed) == brute_base(text)
    assert got[1].script == "none" and got[4].byte_share > 0.1
    assert fertility.fertility_rules(df.drop("lang"), tokenizer_file("piece_bpe_32k.model"), lang_col=None).count() == len(rows)
    assert fertility.fertility_rules(df.limit(0), tokenizer_file("piece_bpe_32k.model")).count() == 0


def shingles(text):
    w = WORD.findall(text)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints(spark, sf_dir):
    docs = documents(spark, sf_dir)
    order = sorted(docs, reverse=True)
    got = {r.doc_id: r for r in QUERIES["op8_fingerprints"](spark, sf_dir).collect()}
    errors = []
    for k, i in enumerate(order):
        text, following = docs[i], docs[order[(k + 1) % len(order)]]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        errors += [r.near_edited - jaccard(shingles(text), shingles(edited)), r.near_next - jaccard(shingles(text), shingles(following))]
    assert np.abs(errors).max() < 0.2 and np.abs(errors).mean() < 0.03 and abs(np.mean(errors)) < 0.01


def test_next_rows_over_many_ranges(spark):
    ids = [7, 3, 3, 10**15, -5, None, 12, 13, 14, 15, 16, 99, 100]
    df = spark.createDataFrame([(i, f"t{k}") for k, i in enumerate(ids)], SCHEMA)
    for range_rows, bounds in ((1, 4), (2, 256), (1000, 256)):
        got = fingerprint.with_next(df, "doc_id", ["text"], range_rows, bounds).collect()
        follow = {r.text: r.next_text for r in got}
        assert len(got) == len(ids)
        walk, at = [], "t3"
        for _ in ids:
            walk.append(ids[int(at[1:])])
            at = follow[at]
        assert at == "t3" and walk == sorted(ids, key=lambda i: (i is None, -(i or 0)))
    names = ["k", "t", "to", "__k", "x_k", "xx_r", "X_o", "next_text", "m", "edge", "r"]
    more = df.selectExpr("*", *(f"doc_id as `{c}`" for c in names))
    assert {r.text: r.next_text for r in fingerprint.with_next(more, "doc_id", ["text"], 2).collect()} == follow
    assert set(fingerprint.with_next(more, "doc_id", ["text"]).columns) == {*more.columns, "next_text"}
    assert fingerprint.with_next(df.limit(0), "doc_id", ["text"]).count() == 0
    assert fingerprint.with_next(df.limit(1), "doc_id", ["text"]).first().next_text == "t0"


def test_next_ranges_are_even(spark):
    """Clumped ids, null ones too: no range holds many rows."""
    ids = [*range(3000), *range(10**12, 10**12 + 3000), *(7**k for k in range(5, 22)), *[None] * 3000]
    df = spark.createDataFrame([(i, f"t{k}") for k, i in enumerate(ids)], SCHEMA)
    sizes = []

    def sized(d):
        sizes.append(int(d.groupBy("x_r").count().agg(F.max("count")).first()[0]))
        return d

    got = fingerprint.with_next(df, "doc_id", ["text"], 50, 8, prepare=sized).collect()
    assert len({r.next_text for r in got}) == len(ids) and max(sizes) <= 250


def brute_fingerprint(text):
    """Bins of least hashes, densified and packed, step by step."""
    words = [hash_text(w) for w in WORD.findall(text)]
    if not words:
        return ""
    hashes = [hash_longs(words[k : k + 5]) & (1 << 64) - 1 for k in range(max(1, len(words) - 4))]
    bins, low = [None] * fingerprint.BINS, 64 - (fingerprint.BINS.bit_length() - 1)
    for h in hashes:
        b, rest = ((h >> low) + fingerprint.BINS // 2) % fingerprint.BINS, h & (1 << low) - 1  # bins in the order of signed hashes
        bins[b] = rest if bins[b] is None else min(bins[b], rest)
    full = [next(j for j in [b, *order] if bins[j] is not None) for b, order in enumerate(fingerprint._probes())]
    return "".join(f"{bins[j] & 255:02x}" for j in full)


def test_fingerprints_bit_by_bit(spark):
    texts = ["", " \n", "one", "a b c d", "a b c d e", "a b c d e f", "é  ß\tx " * 9, " ".join(f"w{k % 700}" for k in range(3000)), " ".join(f"u{k}" for k in range(300))]
    df = fingerprint.with_fingerprint(spark.createDataFrame(list(enumerate(texts)), SCHEMA), "text", "f").select("doc_id", fingerprint.pack(F.col("f")).alias("p"))
    assert {r.doc_id: r.p for r in df.collect()} == {k: brute_fingerprint(t) for k, t in enumerate(texts)}


@pytest.mark.parametrize("rows", [[], [(1, "a b c d e f")], [(3, None), (1, ""), (2, "x y")], [(None, "a"), (None, "b"), (1, "c"), (1, "c")]])
def test_fingerprint_query_on_small_tables(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(QUERIES["op8_fingerprints"](spark, str(tmp_path)).collect(), key=str)
    texts = sorted([(i is not None, i or 0, hash_text(t or ""), t or "") for i, t in rows], reverse=True)
    want = []
    for k, (_, i, _, text) in enumerate(texts):
        following = texts[(k + 1) % len(texts)][3]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        want.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), brute_fingerprint(text), brute_fingerprint(edited)))
    assert sorted((r.doc_id or 0, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) for r in got) == sorted(want)


def test_fingerprint_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "a b c"), (4, "a  b c "), (5, "a b d"), (6, "w " * 50_000), (7, " ".join(f"u{k}" for k in range(40_000)))]
    df = fingerprint.with_fingerprint(spark.createDataFrame(rows, SCHEMA), "text", "f").select("doc_id", "f", fingerprint.pack(F.col("f")).alias("p"))
    got = {r.doc_id: r for r in df.collect()}
    assert got[1].p == got[2].p == "" and got[3].p == got[4].p != got[5].p
    assert all(len(got[i].p) == fingerprint.BINS * fingerprint.BITS // 4 for i in range(3, 8))
    pairs = df.alias("a").join(df.alias("b"), F.col("a.doc_id") <= F.col("b.doc_id")).select(F.col("a.doc_id").alias("i"), F.col("b.doc_id").alias("j"), fingerprint.likeness(F.col("a.f"), F.col("b.f")).alias("x"))
    near = {(r.i, r.j): r.x for r in pairs.collect()}
    assert near[1, 2] == near[3, 4] == near[7, 7] == 1.0 and near[1, 3] == 0.0 and near[3, 5] < 0.1


def brute_scan(text, template):
    """Matched words of the best local alignment of the whole text with a template."""
    a, b = licenses.words_of(template), licenses.words_of(text)
    best, row = (0, 0), [(0, 0)] * (len(b) + 1)
    for x in a:
        new = [(0, 0)]
        for j, y in enumerate(b, 1):
            cell = (row[j - 1][0] + (2 if x == y else -1), row[j - 1][1] + (x == y))
            for other in (row[j], new[-1]):
                if other[0] - 1 > cell[0]:
                    cell = (other[0] - 1, other[1])
            new.append(cell if cell[0] > 0 else (0, 0))
            best = max(best, new[-1], key=lambda c: c[0])
        row = new
    return best[1]


def test_licenses(spark, sf_dir):
    docs = documents(spark, sf_dir)
    got = {}
    for r in QUERIES["op6_licenses"](spark, sf_dir).collect():
        got.setdefault(r.doc_id, []).append(r)
        assert licenses.words_of(docs[r.doc_id][r.begin : r.end]) and 0.8 <= r.coverage <= 1
    notices = {k: v for k, v in licenses.TEMPLATES.items() if len(v) < 100}
    for i, text in docs.items():
        if len(text) > 3000:
            continue
        want = {k for k, v in notices.items() if v in text}
        assert want <= {r.license for r in got.get(i, [])}
        if not want:
            for name, v in notices.items():  # the notices that only an alignment finds
                if brute_scan(text, v) >= 0.8 * len(licenses.words_of(v)):
                    assert name in {r.license for r in got.get(i, [])}, (i, name)


def test_altered_licenses():
    index = licenses.LicenseIndex(licenses.TEMPLATES)
    words = licenses.TEMPLATES["mit"].split()
    for gone in (6, 30, 90):
        text = "Some head. " + " ".join(w for k, w in enumerate(words) if k % gone) + " a tail"
        match = index.scan(text)
        assert [m[0] for m in match] == ["mit"] and match[0][2] == brute_scan(text, licenses.TEMPLATES["mit"])
        assert match[0][3] >= len("Some head.")
    twice = "É " + licenses.TEMPLATES["isc"] + " between " * 30 + licenses.TEMPLATES["isc"]
    assert [m[0] for m in index.scan(twice)] == ["isc", "isc"] and twice[index.scan(twice)[0][3] :].startswith("Permission")
    assert index.scan("the rights of the copyright") == []


def test_license_edge_cases(spark):
    rows = [(1, None), (2, ""), (None, "ALL RIGHTS RESERVED"), (3, "all rights\n reserved. " * 2), (3, "all rights\n reserved. " * 2), (4, "x " * 100_000 + "All rights reserved.")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'a' as id", "1 as license", "2 as begin")
    got = collections.Counter(r.doc_id for r in licenses.scan_licenses(df).collect())
    assert got == {None: 1, 3: 4, 4: 1}
    assert licenses.scan_licenses(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="fewer than 3 words"):
        licenses.LicenseIndex({"short": "two words"})
