import random
import re
import struct
import time

import xxhash

from gridloom.llm import linededup as ld
from gridloom.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string"


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def hash_text(x):
    return signed(xxhash.xxh64_intdigest(x.encode(), 42))


def hash_longs(values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", v), seed)
    return signed(seed)


def brute(rows):
    """What stays of each (id, text): each place of a fingerprint is held against every earlier one, line by line both ways."""
    docs, seen = [], {}
    for i, text in sorted({(i, t) for i, t in rows if t is not None}, key=lambda r: (r[0] is None, r[0] or 0, hash_text(r[1]))):
        lines = [(n, x, len(WORD.findall(x))) for n, x in enumerate(text.split("\n"))]
        lines = [x for x in lines if x[2]]

        def reach(k, words, lines=lines):
            total = 0
            for j in range(k, len(lines)):
                total += lines[j][2]
                if total >= words:
                    return j - k + 1
            return None

        grams = {k: (n, hash_longs([hash_text(x[1]) for x in lines[k : k + n]])) for k in range(len(lines)) if (n := reach(k, ld.GRAM_WORDS))}
        chosen = set()
        for k in range(len(lines)):
            n = reach(k, ld.RUN_WORDS)
            inside = [(grams[j][1], j) for j in range(k, k + (n or 0)) if j in grams and j + grams[j][0] <= k + n]
            if inside:
                chosen.add(min(inside)[1])
        docs.append(((i, text), lines, grams, sorted(chosen)))
    out = {}
    for doc, lines, grams, chosen in docs:
        mine, gone = [x[1] for x in lines], set()
        for k in chosen:
            n, g = grams[k]
            for theirs, at in seen.get(g, ()):
                low, high = 0, n - 1
                while k - low > 0 and at - low > 0 and mine[k - low - 1] == theirs[at - low - 1]:
                    low += 1
                while k + high + 1 < len(mine) and at + high + 1 < len(theirs) and mine[k + high + 1] == theirs[at + high + 1]:
                    high += 1
                gone |= set(range(lines[k - low][0], lines[k + high][0] + 1))
            seen.setdefault(g, []).append((mine, k))
        out[doc] = "\n".join(x for n, x in enumerate(doc[1].split("\n")) if n not in gone)
    return out


def deduped(df):
    before = {(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()}
    by_id = {}
    for i, t in before:
        by_id.setdefault(i, t)
    return by_id, [(r.doc_id, r.text) for r in ld.dedup_lines(df).select("doc_id", "text").collect()]


def random_docs(seed, n=60):
    rnd = random.Random(seed)
    line = lambda words: " ".join(f"w{rnd.randrange(3000)}" for _ in range(words))
    passages = [[line(rnd.choice([3, 8, 20, 60])) for _ in range(rnd.randrange(1, 8))] for _ in range(8)]
    common = [line(4) for _ in range(3)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rnd.randrange(1, 6)):
            parts += rnd.choice([[line(rnd.randrange(1, 40))], rnd.choice(passages), [rnd.choice(common)], ["", "  "]])
        rows.append((i, "\n".join(parts)))
    return rows, passages


def test_against_brute_force(spark):
    for seed in (1, 2):
        rows, passages = random_docs(seed)
        want = brute(rows)
        got = dict(deduped(spark.createDataFrame(rows, SCHEMA))[1])
        assert got == {i: want[i, t] for i, t in rows}
        assert any(got[i] != t for i, t in rows)
        for p in passages:  # a passage of RUN_WORDS words or more is left once, whole
            if sum(len(x.split()) for x in p) >= ld.RUN_WORDS:
                assert sum("\n".join(p) in t for t in got.values()) <= 1


def test_first_places_stay_and_short_repeats_too(spark):
    passage = "\n".join(" ".join(f"p{k}{j}" for k in range(12)) for j in range(5))
    rows = [(5, f"own five\n{passage}\ntail of five"), (2, f"start of two\n{passage}"), (9, passage), (7, "short repeat\nclean seven"), (8, "short repeat\nclean eight")]
    got = dict(deduped(spark.createDataFrame(rows, SCHEMA))[1])
    assert got == {2: rows[1][1], 5: "own five\ntail of five", 9: "", 7: rows[3][1], 8: rows[4][1]}


def test_matches_extend_along_one_place(spark):
    """The passage and X stood together, X and Y, Y and Z too; but not the passage, X and Y."""
    passage = "\n".join(" ".join(f"p{k}{j}" for k in range(12)) for j in range(5))
    rows = [(1, f"{passage}\nx is here"), (2, "x is here\ny as well"), (3, "y as well\nand z too"), (4, f"own line\n{passage}\nx is here\ny as well\nand z too\ntail")]
    assert dict(deduped(spark.createDataFrame(rows, SCHEMA))[1]) == dict(rows[:3]) | {4: "own line\ny as well\nand z too\ntail"}


def test_passages_of_single_lines_and_blanks(spark):
    """Lines that are longer than a run, with blanks between; a run that ends within the words of its last fingerprint."""
    long = [" ".join(f"l{n}w{k}" for k in range(60)) for n in range(4)]
    short = [f"s{n} a b" for n in range(30)]
    rows = [(1, "\n\n".join(long)), (2, "own\n" + "\n \n".join(long) + "\nown too"), (3, "\n".join(short)), (4, "x\n" + "\n".join(short[2:29]) + "\ny"), (5, "\n".join(short[9:24])), (6, "same line here, and it has ten words in it\n" * 40)]
    want = brute(rows)
    got = dict(deduped(spark.createDataFrame(rows, SCHEMA))[1])
    assert got == {i: want[i, t] for i, t in rows}
    assert got[2] == "own\nown too" and got[4] == "x\ny" and got[5] == rows[4][1]  # 45 words stay


def test_very_long_texts(spark):
    """The work grows with the number of lines: 60,000 of them, all repeated, in some ten seconds."""
    text = "\n".join(f"line {k} of a text that goes on and on for long" for k in range(60_000))
    began = time.monotonic()
    got = ld.dedup_lines(spark.createDataFrame([(1, text), (2, "new\n" + text)], SCHEMA), n_deleted_col="deleted").collect()
    assert {r.doc_id: (r.deleted, len(r.text)) for r in got} == {1: (0, len(text)), 2: (60_000, 3)}
    assert time.monotonic() - began < 90


def test_edge_cases(spark):
    long = "\n".join(" ".join(f"w{k}x{j}" for j in range(9)) for k in range(3000))
    rows = [(1, None, 4), (2, "", 0), (3, "\n \n\t\n", 4), (4, long, 1), (4, long, 1), (None, long, 2), (6, long + "\nnew", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, k int").selectExpr("*", "'a' as id", "'b' as lines", "1 as th", "0 as __runs", "0 as __hash", "0 as __text", "0 as `a.b`", "0 as row", "0 as c0")
    out = ld.dedup_lines(df, n_deleted_col="deleted")
    assert out.columns == [*df.columns, "deleted"]
    got = sorted(((r.doc_id or 0, r.text, r.deleted, r.lines) for r in out.collect()), key=str)
    assert got == sorted([(1, None, 0, "b"), (2, "", 0, "b"), (3, "\n \n\t\n", 0, "b"), (4, long, 0, "b"), (4, long, 0, "b"), (0, "", 3000, "b"), (6, "new", 3000, "b")], key=str)
    assert ld.dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = brute(rows)
    got = {r.doc_id: r.n_chars for r in QUERIES["op4_lines"](spark, sf_dir).collect()}
    assert got == {i: len(want[i, t]) for i, t in rows}
