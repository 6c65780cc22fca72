"""Token counts by a map-side lookup of pre-tokens in two tiers.

No merge of a sentencepiece model crosses from another character into a space, nor touches a line break that no piece holds. So a
text falls into pre-tokens whose lengths add up. Tier one is a table of the lengths of frequent pre-tokens, broadcast; its size is
bounded by ``frequent``. Tier two is a bounded cache in each Python worker, which encodes what it misses. Pre-tokens are never
shuffled. Which ones are frequent is judged from whole texts of a random sample of about ``SAMPLED`` documents, whatever the
size of the table: that choice saves time and has no part in the counts, which are exact for every pre-token of every text. For
a ``.json`` file whole texts go through its own library.

Defined cases: a null text counts as empty and has no tokens; texts are counted whole, of any length; rows are independent, so
repeated rows give repeated results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from factorloom.llm.shared import map_rows

SPACE = "▁"
CACHED_TOKENS = 300_000
CACHED_LENGTH = 40
#: Documents that the choice of the frequent pre-tokens looks at, and the tasks that do.
SAMPLED = 2_000
SAMPLE_TASKS = 8
SEGMENTS = re.compile(f"{SPACE}+[^{SPACE}]*")


def pre_tokens(text: str) -> list[str]:
    """Pre-tokens of a text, without the space before each; line breaks may still stand in them."""
    if not text:
        return []
    if "  " in text or SPACE in text or text[0] == " " or text[-1] == " ":
        return [s[1:] for s in SEGMENTS.findall(SPACE + text.replace(" ", SPACE))]
    return text.split(" ")


@lru_cache(maxsize=2)
def _processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def checked(path: str) -> str:
    """The path, if the model's pieces keep the two rules that counts add up by."""
    processor = _processor(path)
    pieces = [processor.id_to_piece(i) for i in range(processor.get_piece_size())]
    if any("\n" in p or re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces):
        raise ValueError(f"{path}: pieces cross spaces or line breaks")
    return path


def encoded_length(path: str, token: str) -> int:
    """Length of a pre-token; one that begins with a line break stands without the space before."""
    encode = _processor(path).encode
    return len(encode(token, num_threads=1)) - 2 if token[:1] == "\n" else len(encode(token + "\n", num_threads=1)) - 1


def counter(path: str, table: dict[str, int]) -> Callable[[str], int]:
    """Counts the tokens of a text."""
    cache: dict[str, int] = {}

    def length(token: str) -> int:
        n = cache.get(token)
        if n is None:
            n = encoded_length(path, token)
            if len(token) <= CACHED_LENGTH:
                if len(cache) >= CACHED_TOKENS:
                    cache.clear()
                cache[token] = n
        return n

    def count(text: str) -> int:
        total, get = 0, table.get
        for token in pre_tokens(text):
            n = get(token)
            if n is None:
                if "\n" in token:
                    first, *rest = token.split("\n")
                    n = length(first) + len(rest) + sum(length("\n" + t) for t in rest if t)
                else:
                    n = length(token)
            total += n
        return total

    return count


def frequent_lengths(docs: DataFrame, path: str, frequent: int) -> dict[str, int]:
    """Lengths of at most ``frequent`` common pre-tokens of a sample of documents.

    Each of a fixed number of tasks keeps at most eight times as many candidates and hands its most common ones to the driver, so
    what they hold and what the driver adds up is bounded.
    """

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0):
                seen.update(t for t in pre_tokens(text.as_py() or "") if len(t) <= CACHED_LENGTH and "\n" not in t)
                if len(seen) > 8 * frequent:
                    seen = Counter(dict(seen.most_common(4 * frequent)))
        common = seen.most_common(frequent)
        yield pa.RecordBatch.from_arrays(
            [pa.array([t for t, _ in common], pa.string()), pa.array([n for _, n in common], pa.int64())], ["token", "n"]
        )

    share = min(1.0, SAMPLED / max(docs.count(), 1))
    sampled = docs.select("text").sample(share, seed=7).repartition(SAMPLE_TASKS)
    counts: Counter[str] = Counter()
    for r in sampled.mapInArrow(top, "token string, n long").toLocalIterator():
        counts[r.token] += r.n
    chosen = sorted(counts, key=lambda t: (-counts[t], t))[:frequent]
    return {token: encoded_length(path, token) for token in chosen}


def token_counts(docs: DataFrame, path: str, limit: int = 4096, frequent: int = 20_000) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every whole text, for the tokenizer file at ``path``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    source = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    if path.endswith(".json"):
        rows = _whole_texts(path)
    else:
        table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, checked(path), frequent))

        def rows() -> Callable[..., Iterator[tuple]]:
            count = counter(path, table.value)

            def one(doc_id, n_bytes, text):
                yield doc_id, n_bytes, count(text)

            return one

    fields = [source.schema["doc_id"], StructField("n_bytes", LongType()), StructField("n_tokens", LongType())]
    counted = map_rows(source, rows, StructType(fields))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def _whole_texts(path: str) -> Callable[[], Callable[..., Iterator[tuple]]]:
    def rows() -> Callable[..., Iterator[tuple]]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()

        def one(doc_id, n_bytes, text):
            yield doc_id, n_bytes, len(tokenizer.encode(text, add_special_tokens=False).ids)

        return one

    return rows
