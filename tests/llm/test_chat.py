"""Chat formatting: round trips, loss masks and layouts."""

import hashlib
import json
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from factorloom.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
TEXTS = [
    None, "", "hi", r"\### Assistant: </turn> ok", "<turn>user<turn/>x</turn>", r"<\turn> <\\/turn> \ \\ <", "<turn", "</turn>" * 3,
    "a\nb\n", "é😀<turn/>日本", "$1 \\1 \\n %s", "x" * 5000, "<turn-text> <turns>", " ",
]


def formatted(spark, rows, **clashing):
    df = spark.createDataFrame(rows, SCHEMA)
    for name, value in clashing.items():
        df = df.withColumn(name, F.lit(value))
    return chat.formatted(chat.table_turns(df))


def test_texts_read_back(spark):
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "<turn>odd\n", None]), rng.choice(TEXTS)) for c in range(40) for t in range(rng.randrange(1, 7))]
    rows += [(100, 0, "assistant", t) for t in TEXTS] + [(None, 0, "user", "q"), (None, None, "assistant", "a"), (101, 0, "user", "same")]
    rows += [(101, 0, "user", "same")]
    out = formatted(spark, rows, formatted="x", turns=1, loss="y")
    got = {r.conv_id: r for r in chat.digests(out).collect()}
    texts = {r.conv_id: r for r in out.collect()}
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn is not None, turn or 0, role is not None, role or "", text is not None, text or ""))
    assert set(got) == set(groups)
    for conv, turns in groups.items():
        turns = [(role, text, r) for _, _, r, role, _, text in sorted(turns)]
        loss = "".join(text for role, text, _ in turns if role == "assistant")
        said = "".join(f"{role}\n{text}\n" for role, text, _ in turns)
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == len(texts[conv].formatted)
        spans = [(s.start, s.start + s.length) for s in texts[conv].loss_mask]
        assert len(spans) == sum(role == "assistant" for role, _, _ in turns)
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_plain_texts_stay_as_they_are(spark):
    r = formatted(spark, [(1, 0, "user", "a < b \\ c"), (1, 1, "assistant", "ok")]).first()
    assert r.formatted == "<turn>user<turn/>a < b \\ c</turn><turn>assistant<turn/>ok</turn>"
    assert [r.formatted[s.start : s.start + s.length] for s in r.loss_mask] == ["ok"]


def test_empty_tables(spark):
    assert chat.digests(formatted(spark, [])).count() == 0
    records = spark.createDataFrame([], "id long, json string")
    assert chat.record_turns(records, "id", "json").count() == 0


def test_layouts_of_records(spark):
    turns = [("user", "q"), ("assistant", "a")]
    records = {
        1: {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        2: {"conversations": [{"from": "human", "value": "q"}, {"value": "a", "from": "gpt"}]},
        3: {"prompt": "q", "response": "a"},
        4: {"output": "a", "instruction": "q", "input": ""},
        5: {"instruction": "q", "output": "a"},
        6: {"instruction": "q", "input": "ctx", "output": "a"},
        7: {"something": ["else"]},
        9: {"messages": [{"role": "user", "content": None}]},
    }
    rows = [(i, json.dumps(r)) for i, r in records.items()] + [(8, "no json"), (10, None)]
    df = spark.createDataFrame(rows, "id long, json string").withColumn("v", F.lit(1)).withColumn("layout", F.lit("x"))
    out = chat.record_turns(df, "id", "json")
    got = {r.conv_id: r.turns and [tuple(t) for t in r.turns] for r in out.collect()}
    assert all(got[i] == turns for i in (1, 2, 3, 4, 5))
    assert got[6] == [("user", "q\n\nctx"), ("assistant", "a")]
    assert got[7] is None and got[8] is None and got[10] is None and got[9] == [("user", None)]
    assert chat.digests(chat.formatted(out)).where("n_turns = 0").count() == 3


def test_layouts_of_tables(spark):
    wide = spark.createDataFrame([(1, [("user", "q"), ("assistant", "a")], 5)], "conv_id long, messages array<struct<role string, content string>>, extra int")
    pair = spark.createDataFrame([(1, "q", "a", "z")], "conv_id long, prompt string, response string, extra string")
    rows = spark.createDataFrame([(1, 1, "assistant", "a"), (1, 0, "user", "q")], SCHEMA)
    got = [chat.formatted(chat.table_turns(df)).first() for df in (wide, pair, rows)]
    assert got[0] == got[1] == got[2]
    with pytest.raises(ValueError):
        chat.table_turns(spark.createDataFrame([(1,)], "other long"))
