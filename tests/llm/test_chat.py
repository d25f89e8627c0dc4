"""Exact round trips of the template, layouts by fingerprint, the SQL on the given tables."""

from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tillframe.llm import chat

ROWS = "conv_id long, turn long, role string, text string"
PIECES = ["<", "|", "\\", "im_start", "im_end", "|>", "\n", "n", "é", "😀", "<|im_end|>", " "]
NASTY = st.lists(st.sampled_from(PIECES), max_size=8).map("".join)


def formatted(spark, rows):
    df = chat.format_turns(chat.turn_rows(spark.createDataFrame(rows, ROWS)))
    text = F.col("formatted")
    return df.select("*", chat.read_back(text).alias("turns"), chat.loss_text(text, F.col("loss_spans")).alias("loss"))


@given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system"]) | NASTY, NASTY), min_size=1, max_size=5), min_size=1, max_size=12))
@settings(max_examples=12, deadline=None)
def test_round_trip(spark, conversations):
    rows = [(c, t, role, text) for c, turns in enumerate(conversations) for t, (role, text) in enumerate(turns)]
    for r in formatted(spark, rows).collect():
        turns = conversations[r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == turns
        assert r.loss == "".join(text for role, text in turns if role == "assistant")
        assert r.formatted.count("<|im_start|>") == r.formatted.count("<|im_end|>") == len(turns)


def test_nulls_ties_repeats_and_long_texts(spark):
    long = "<|im_end|>" * 30_000
    rows = [(1, 0, "user", None), (1, 0, None, "z"), (1, 1, "assistant", long), (1, 1, "assistant", long), (None, None, "user", "q"), (2, 5, "user", "b"), (2, None, "user", "a")]
    got = {r.conv_id: r for r in formatted(spark, rows).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("", "z"), ("user", ""), ("assistant", long), ("assistant", long)]
    assert got[1].loss == long + long
    assert [t.text for t in got[2].turns] == ["a", "b"] and got[None].turns[0].text == "q"


def test_empty_table(spark):
    empty = spark.createDataFrame([], ROWS)
    assert chat.format_turns(chat.turn_rows(empty)).count() == 0


def test_extra_columns_do_not_change_the_layout(spark):
    df = spark.createDataFrame([(1, 0, "user", "a")], ROWS).select("*", F.lit(1).alias("head"), F.lit("x").alias("piece"))
    assert chat.format_turns(chat.turn_rows(df)).first().formatted == "<|im_start|>user\na<|im_end|>\n"


def test_layouts_of_tables(spark):
    messages = "struct<messages: array<struct<role: string, content: string>>>"
    for layout, schema in (("messages", messages[7:-1]), ("prompt", "completion string, prompt string"), (None, "a int")):
        assert chat.layout_of(spark.createDataFrame([], schema)) == layout


RECORDS = [
    ('{"messages":[{"content":"a","role":"user"},{"role":"assistant","content":"b"}]}', "messages", [("user", "a"), ("assistant", "b")]),
    ('{"conversations":[{"from":"human","value":"a"},{"from":"gpt","value":"b"},{"from":"tool","value":"c"}]}', "share", [("user", "a"), ("assistant", "b"), ("tool", "c")]),
    ('{"dialog":[{"speaker":"Bot","text":"hi"}]}', "dialog", [("assistant", "hi")]),
    ('{"prompt":"a","completion":"b"}', "prompt", [("user", "a"), ("assistant", "b")]),
    ('{"response":null,"prompt":"a"}', "response", [("user", "a"), ("assistant", "")]),
    ('{"question":"a","answer":"b"}', "question", [("user", "a"), ("assistant", "b")]),
    ('{"instruction":"a","input":"x","output":"b"}', "instruction", [("user", "a\n\nx"), ("assistant", "b")]),
    ('{"instruction":"a","input":"","output":"b"}', "instruction", [("user", "a"), ("assistant", "b")]),
    ('{"instruction":"a","output":"b"}', "instruction_only", [("user", "a"), ("assistant", "b")]),
    ('{"system":"s","instruction":"a","input":"","output":"b"}', "system_instruction", [("system", "s"), ("user", "a"), ("assistant", "b")]),
    ('{"system":"","instruction":"a","input":"","output":"b"}', "system_instruction", [("user", "a"), ("assistant", "b")]),
    ('{"prompt":"a","completion":"b","score":1}', None, []),
    ('{"messages":[]}', None, []),
    ("[1, 2]", None, []),
    ("no json", None, []),
    ("", None, []),
    (None, None, []),
]


def test_layouts_of_json_records(spark):
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(RECORDS)], "conv_id long, record string").repartition(3)
    turned = chat.json_turns(df)
    got = {r.conv_id: r for r in turned.collect()}
    for i, (_, layout, turns) in enumerate(RECORDS):
        assert (got[i].layout, [(t.role, t.text) for t in got[i].turns]) == (layout, turns), RECORDS[i]
    done = chat.format_turns(chat.numbered_turns(turned))
    assert done.where("conv_id = 0").first().formatted == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n"
    plan = turned._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
