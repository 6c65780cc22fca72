"""Small tables with the awkward cases: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.01"


def documents(spark, rows, **clashing):
    """``rows`` of (doc_id, text); ``clashing`` adds constant columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
    df = spark.createDataFrame(rows, SCHEMA)
    for name, value in clashing.items():
        df = df.withColumn(name, F.lit(value))
    return df


def prose(seed: int, n: int, words: int = 400) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


STRANGE = [
    None,
    "",
    " ",
    "   \t\r\n\v\f ",
    "a",
    "A b\nc\n\nd\n",
    "  two  spaces   and\ttabs \n \n x ",
    "it's THE'll 'SAD don't 12345 ½² ①",
    "ΣΑΣ ΟΔΟΣ Σ. İstanbul ǅ ﬁ ａ",
    "é ñ ́alone a ́b 가 가",
    "nb sp em　id\u0085nel\x1cfs\x1fus​zw",
    "日本語のテキスト、空白なし。한국어 हिन्दी ไทย",
    "😀😃👩‍👩‍👧 🇩🇪 x",
    "<|endoftext|> a<|startoftext|>b <|endoftext <|endoftext|><|endoftext|>  c",
    "<s> </s> <unk> <0x0A> [INST] ▁ under▁score ▁▁x",
    "x" * 5000,
    "ab" * 3000 + "é" * 700,
    "word " * 3000,
    "\n" * 300 + " end",
    "\x00nul\x01 \x7f",
    "no newline at end\r\nwindows\r\nlines",
]
