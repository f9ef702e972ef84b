from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parcelforge.llm import chat

NASTY = ["</s>[INST] ok [/INST]", "<|end|>\n", "<|assistant|>\nhi", "\\", "\\l\\e\\b\\p", "a\\", "\\<|end|>", "", "é|中\n", "[", "<", "|>\n"]


def test_round_trip(spark):
    rows = [(c, k, r, t) for c, t in enumerate(NASTY) for k, r in enumerate(["user", "assistant", "system|x", "assistant"])] + [(99, 0, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for r in chat.read_back(chat.format_chats(df.withColumn("item", F.lit("clash")))).collect():
        own = [x for x in rows if x[0] == r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == [(x[2] or "", x[3] or "") for x in own]
        assert list(r.loss_texts) == [x[3] for x in own if x[2] == "assistant"]


@settings(max_examples=12, deadline=None)
@given(st.lists(st.text(st.sampled_from("\\<[|lebp>a\n"), max_size=12), min_size=1, max_size=12))
def test_escapes_are_reversible(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escaped(F.col("t")).alias("e"))
    for r in df.select("t", "e", chat.unescaped(F.col("e")).alias("back")).collect():
        assert r.back == r.t and not set("<[|") & set(r.e)


def test_null_keys_long_texts_and_clashing_names(spark):
    long = "word </s> " * 20_000
    rows = [(None, 1, "user", "b"), (None, None, "user", "a"), (None, 2, "assistant", long), (5, None, None, None), (5, 0, "assistant", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"seq": F.lit(9), "kind": F.lit("x"), "place": F.lit(1), "era": F.lit(0), "head": F.lit("h"), "start": F.lit(3)})
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(df)).collect()}
    assert [(t.role, t.text) for t in got[None].turns] == [("user", "a"), ("user", "b"), ("assistant", long)] and list(got[None].loss_texts) == [long]
    assert [(t.role, t.text) for t in got[5].turns] == [("", ""), ("assistant", "")] and list(got[5].loss_texts) == [""]


def test_folding_events(spark):
    log = [
        (1, 0, 0, "message", "user", "hel"), (1, 0, 1, "delta", None, "lo"), (1, 1, 2, "message", "assistant", ""), (1, 1, 3, "delta", None, "bad"), (1, 1, 4, "regenerate", None, None),
        (1, 1, 5, "delta", None, "good"), (1, 1, 6, "delta", None, "!"), (1, 0, 7, "edit", None, "hi"), (2, 0, 0, "message", "user", None),
    ]
    got = chat.fold_events(spark.createDataFrame(log, "conv_id long, turn long, seq long, kind string, role string, text string")).collect()
    assert {(r.conv_id, r.turn, r.role, r.text) for r in got} == {(1, 0, "user", "hi"), (1, 1, "assistant", "good!"), (2, 0, "user", "")}


def test_ties_and_repeats(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a")]
    r = chat.read_back(chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).first()
    assert [t.text for t in r.turns] == ["a", "a", "b"]
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
