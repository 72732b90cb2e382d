import hashlib

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.llm import chat
from gridloom.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"
pieces = st.lists(st.sampled_from(["<|im_start|>", "<|im_sep|>", "<|im_end|>", "<|im_end|>\n", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "\\", "<", "[", "|im_sep|>", "\n", "a", "é"]), max_size=6).map("".join)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.sampled_from(["user", "assistant", "system", "a\\n\nb", "<|im_sep|>"]), pieces), min_size=1, max_size=40))
def test_every_text_comes_back(spark, turns):
    rows = [(c, k, role, text) for k, (c, role, text) in enumerate(turns)]
    out = chat.format_chat(spark.createDataFrame(rows, SCHEMA))
    read = out.select("conv_id", chat.read_turns(F.col("formatted")).alias("t"), chat.read_trained(F.col("formatted"), F.col("mask")).alias("loss"), "mask", "formatted")
    for r in read.collect():
        own = [x for x in rows if x[0] == r.conv_id]
        assert [(t.role, t.text) for t in r.t] == [(x[2], x[3]) for x in own]
        assert r.loss == "".join(x[3] for x in own if x[2] == "assistant")
        assert sum(m.chars for m in r.mask) == len(r.formatted)
        blocks = sum(k == 0 or own[k - 1][2] != x[2] for k, x in enumerate(own))
        assert r.formatted.count(chat.START) == blocks == r.formatted.count(chat.END)


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    by_conv = {}
    for r in sorted(rows):
        by_conv.setdefault(r[0], []).append(r)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = {r.conv_id: r for r in QUERIES["op2_chat"](spark, sf_dir).collect()}
    assert got.keys() == by_conv.keys()
    for c, own in by_conv.items():
        loss = "".join(r[3] for r in own if r[2] == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(own), sha("".join(f"{r[2]}\n{r[3]}\n" for r in own)))
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), sha(loss))


def test_edge_cases(spark):
    rows = [(1, 0, None, None), (1, 1, "assistant", None), (None, 0, "user", "x"), (None, None, "user", "y"), (2, 0, "user", "b"), (2, 0, "user", "a"), (2, 0, "user", "a"), (3, 0, "assistant", "z" * 300_000)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as turns", "2 as conv", "3 as t")
    out = chat.format_chat(df)
    got = {r.conv_id: [(t.role, t.text) for t in r.t] for r in out.select("conv_id", chat.read_turns(F.col("formatted")).alias("t")).collect()}
    alone = sorted(r.t[0].text for r in out.where("conv_id is null").select(chat.read_turns(F.col("formatted")).alias("t")).collect())
    assert alone == ["x", "y"]  # rows without a conversation id belong to none but their own
    del got[None]
    assert got == {1: [("", ""), ("assistant", "")], 2: [("user", "a"), ("user", "a"), ("user", "b")], 3: [("assistant", "z" * 300_000)]}
    assert chat.format_chat(df.limit(0)).count() == 0


def test_rows_without_a_conversation(spark):
    """Each is a conversation of its own, however many there are."""
    rows = [(None, 0, "user", f"t{k % 7}") for k in range(5000)] + [(1, 0, "user", "a"), (1, 1, "assistant", "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' as conv", "'y' as t", "'z' as turns")
    got = chat.format_chat(df).collect()
    assert len(got) == 5001
    assert {r.formatted for r in got if r.conv_id is None} == {f"<|im_start|>user\nt{k}<|im_end|>\n" for k in range(7)}
