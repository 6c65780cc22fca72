"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per document. The ledger keeps the measurements and one bit per failed rule; policies are versioned
sets of bits, applied and compared later by bitwise arithmetic on the ledger alone, without reading a text again.

Defined cases: a null text has no words, so it fails ``few_words``; counts are over whole texts of any length; repeated rows are
judged one by one; an empty table gives an empty ledger; other columns are ignored by the ledger and kept by ``passing``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from factorloom.llm.shared import content_key, map_rows

# Fixed values of the base rules.
WINDOW = 8
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]

#: Bit number = place in this table. A rule states when a document fails; integer arithmetic keeps it exact.
RULES: dict[str, Callable[[], Column]] = {
    "few_words": lambda: F.col("n_words") < MIN_WORDS,
    "repeated_windows": lambda: 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"),
    "many_symbols": lambda: 10 * F.col("n_symbols") > F.col("n_words"),
    "short_words": lambda: F.col("word_chars") < 2 * F.col("n_words"),
    "long_words": lambda: F.col("word_chars") > 20 * F.col("n_words"),
    "duplicate_lines": lambda: 2 * F.col("n_dup_lines") > F.col("n_lines"),
}

#: A policy is a version of the set of rules that reject.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": tuple(RULES),
}


def mask(policy: str | tuple[str, ...]) -> int:
    names = POLICIES[policy] if isinstance(policy, str) else policy
    order = list(RULES)
    return sum(1 << order.index(name) for name in set(names))


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Number of positions covered by windows that occur twice or more; ``window`` is a power of two."""
    if len(ids) <= window:
        return 0
    names, span = ids, 1
    while span < window:
        pairs = names[:-span] * (int(names.max()) + 1) + names[span:]
        names, span = np.unique(pairs, return_inverse=True)[1], 2 * span
    starts = np.flatnonzero(np.bincount(names)[names] > 1)
    edges = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int(np.count_nonzero(np.cumsum(edges)[:-1]))


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one whole text; bytes are split because that uses exactly the ASCII blanks."""
    text = text or ""
    words = text.encode().split()
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    lines = [line for line in text.split("\n") if line.strip(" \t\n\v\f\r")]
    return (
        len(words),
        len(text) - sum(text.count(blank) for blank in " \t\n\v\f\r"),
        sum(text.count(symbol) for symbol in SYMBOLS),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(ids),
    )


def ledger(docs: DataFrame) -> DataFrame:
    """``doc_id, content_key``, the measurements and ``failures``, one bit per failed rule."""
    source = docs.select("doc_id", content_key(), "text")

    def rows() -> Callable[..., Iterator[tuple]]:
        def one(doc_id, key, text):
            yield (doc_id, key, *measure(text))

        return one

    fields = [source.schema["doc_id"], source.schema["content_key"], *(StructField(m, LongType()) for m in MEASURES)]
    measured = map_rows(source, rows, StructType(fields))
    bits = [F.when(rule(), F.lit(1 << i)).otherwise(F.lit(0)) for i, rule in enumerate(RULES.values())]
    failures = bits[0]
    for bit in bits[1:]:
        failures = failures.bitwiseOR(bit)
    return measured.withColumn("failures", failures.cast("long"))


def kept(policy: str | tuple[str, ...]) -> Column:
    return F.col("failures").bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def ablation(rows: DataFrame, policy: str | tuple[str, ...]) -> DataFrame:
    """Per rule of the policy: documents that fail it, that only it rejects, and that stay rejected without it.

    The ledger is first counted per bit pattern: at most ``2 ** len(RULES)`` rows go on, whatever the number of documents.
    """
    whole = mask(policy)
    patterns = rows.groupBy(F.col("failures").bitwiseAND(F.lit(whole).cast("long")).alias("bits")).agg(
        F.count(F.lit(1)).alias("n")
    )
    names = [n for i, n in enumerate(RULES) if whole >> i & 1]
    table = F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(mask((n,))).cast("long").alias("bit")) for n in names)))
    each = patterns.select("bits", "n", table.alias("r")).select("bits", "n", "r.*")
    rest = F.col("bits").bitwiseAND(F.lit(whole).cast("long").bitwiseXOR(F.col("bit")))
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0)).cast("long")
    return each.groupBy("rule").agg(
        total(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        total(F.col("bits") == F.col("bit")).alias("n_only"),
        total(rest != 0).alias("n_rejected_without"),
    )


def quality(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The ledger with the verdicts of the base rules and of ``policy``."""
    return ledger(docs).select(
        "doc_id", *MEASURES, "failures", (~kept("base")).alias("base_failed"), (kept("base") & kept(policy)).alias("kept")
    )


def passing(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The rows of ``docs`` that the base rules and ``policy`` keep, with all their columns.

    Texts stay in the same task: their rows are judged where they are read, without a join.
    """
    row = docs.select(F.struct("*").alias("row"), F.col("text").alias("text"))
    fields = [row.schema["row"], *(StructField(m, LongType()) for m in MEASURES)]

    def rows() -> Callable[..., Iterator[tuple]]:
        def one(whole, text):
            yield (whole, *measure(text))

        return one

    measured = map_rows(row, rows, StructType(fields))
    rejected = F.lit(False)
    for name in POLICIES["base"] + POLICIES[policy]:
        rejected = rejected | RULES[name]()
    return measured.where(~rejected).select("row.*")
