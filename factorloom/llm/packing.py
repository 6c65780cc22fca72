"""Best-fit packing of tokenised documents into sequences of fixed capacity.

Which sequence a piece may join depends on its length only, so packing is decided on the histogram of lengths, at most
``capacity`` numbers whatever the corpus. Lengths above a third of the capacity stand at most twice in a sequence: the
longest is matched with the longest that still fits beside it, until none is left. Shorter lengths, longest first, go into the
smallest gap that holds them, and open new sequences only when no gap does. Equal sequences are handled as one group with
a range of numbers, so the plan has a few rows per length. Each piece then finds its place by its rank among the pieces of its
length; ranks are taken within salted parts of a length, so a frequent length is spread over tasks.

Defined cases: a null text counts as empty, and an empty document is the one closing id; documents longer than the capacity are cut
into full pieces, the first of which may be shorter; equal rows take different places, so every row is packed; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from factorloom.llm.bpe import byte_letters
from factorloom.llm.shared import map_rows, stored

CAPACITY = 2048
END = 0
CACHED_SEGMENTS = 300_000
CACHED_LENGTH = 40
# Fixed value: the splitting pattern of byte-level files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A word that follows one space starts a new token together with that space, so texts can be encoded in between.
SEGMENTS = re.compile(r" (?=\S)")

Placement = tuple[int, int, int, int, int, int]  # length, first rank, end rank, first sequence, pieces per sequence, offset


class ByteEncoder:
    """Ids of texts for a byte-level BPE file, as little-endian bytes, with a bounded cache of segments."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        bytes_of = {letter: b for b, letter in enumerate(byte_letters())}
        model = spec["model"]
        if spec["normalizer"] is not None or spec["pre_tokenizer"] != {
            "type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True
        }:
            raise ValueError(f"{path}: another kind of tokenizer")
        vocab, special = model["vocab"], {t["content"]: t["id"] for t in spec["added_tokens"]}
        merges = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
        if any(vocab[m.replace(" ", "")] != 256 + rank for rank, m in enumerate(merges)):
            raise ValueError(f"{path}: ids do not follow the merges")
        ranks = {bytes(map(bytes_of.__getitem__, token)): i for token, i in vocab.items() if token not in special}
        self.encoding = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = {token: np.array([i], "<u4").tobytes() for token, i in special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.cache: dict[str, bytes] = {}

    def fresh(self, segment: str) -> bytes:
        return np.array(self.encoding.encode_ordinary(segment), "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        out: list[bytes] = []
        cache = self.cache
        for piece in self.cut.split(text) if self.cut and "<|" in text else (text,):
            if piece in self.special:
                out.append(self.special[piece])
                continue
            first, *rest = SEGMENTS.split(piece)
            out.append(self.fresh(first))
            for segment in rest:
                got = cache.get(segment)
                if got is None:
                    got = self.fresh(" " + segment)
                    if len(segment) <= CACHED_LENGTH:
                        if len(cache) >= CACHED_SEGMENTS:
                            cache.clear()
                        cache[segment] = got
                out.append(got)
        return b"".join(out)


@lru_cache(maxsize=2)
def encoder(path: str) -> ByteEncoder:
    return ByteEncoder(path)


def cuts(n: int, capacity: int) -> Iterator[tuple[int, int]]:
    """Start and end of the pieces of a document of ``n`` ids."""
    start = 0
    end = n if n <= capacity else n % capacity or capacity
    while start < n:
        yield start, end
        start, end = end, end + capacity


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every piece, and on demand its ``ids`` as little-endian bytes."""
    source = docs.select("doc_id", "text")

    def rows() -> Callable[..., Iterator[tuple]]:
        own = encoder(path)
        end = np.array([END], "<u4").tobytes()

        def one(doc_id, text):
            ids = own.encode(text or "") + end
            for piece, (start, stop) in enumerate(cuts(len(ids) // 4, capacity)):
                data = ids[4 * start : 4 * stop]
                out = (doc_id, piece, start, stop - start, crc32(data))
                yield (*out, data) if with_ids else out

        return one

    fields = [source.schema["doc_id"], StructField("piece", IntegerType())]
    fields += [StructField(n, LongType()) for n in ("start", "length", "ids_crc32")]
    schema = StructType(fields).add("ids", "binary") if with_ids else StructType(fields)
    return map_rows(source, rows, schema)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Placement]:
    """Where the pieces of each length go; ranks of a length are given out from 0 in the order of its placements."""
    out: list[Placement] = []
    given = dict.fromkeys(counts, 0)
    groups: dict[int, list[tuple[int, int]]] = {}  # gap -> (first sequence, number of sequences)
    gaps: list[int] = []
    opened = 0

    def place(length: int, n: int, first: int, per: int, offset: int) -> None:
        out.append((length, given[length], given[length] + n, first, per, offset))
        given[length] += n

    def leave(gap: int, first: int, n: int) -> None:
        if n and gap:
            if gap not in groups:
                groups[gap] = []
                insort(gaps, gap)
            groups[gap].append((first, n))

    large = sorted(length for length in counts if 3 * length > capacity and counts[length])
    left = {length: counts[length] for length in large}
    while large:
        a = large[-1]
        if left[a] == 1:
            large.pop()
            at = bisect_right(large, capacity - a) - 1
        else:
            at = bisect_right(large, capacity - a) - 1
        if at < 0:
            n = left[a]
            place(a, n, opened, 1, 0)
            leave(capacity - a, opened, n)
            used = 0
        else:
            b = large[at]
            n = left[a] // 2 if a == b else min(left[a], left[b])
            if a == b:
                place(a, 2 * n, opened, 2, 0)
            else:
                place(a, n, opened, 1, 0)
                place(b, n, opened, 1, a)
                left[b] -= n
                if not left[b]:
                    large.pop(at)
            leave(capacity - a - b, opened, n)
            used = n * (1 + (a == b))
        opened += n
        left[a] -= used or n
        if not left[a] and large and large[-1] == a:
            large.pop()

    for s in sorted((length for length in counts if 3 * length <= capacity), reverse=True):
        c = counts[s]
        while c:
            at = bisect_left(gaps, s)
            if at == len(gaps):
                gap, first, n = capacity, opened, -(-c // (capacity // s))
                opened += n
            else:
                gap = gaps[at]
                first, n = groups[gap].pop()
                if not groups[gap]:
                    del groups[gap]
                    gaps.pop(at)
            per = gap // s
            full = min(n, c // per)
            if full:
                place(s, full * per, first, per, capacity - gap)
                leave(gap - per * s, first, full)
                c -= full * per
                first, n = first + full, n - full
            if c and n:
                place(s, c, first, c, capacity - gap)
                leave(gap - c * s, first, 1)
                first, n, c = first + 1, n - 1, 0
            leave(gap, first, n)
    return out


def packed(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces, which must be a stored table: they are read three times.

    The plan has a few rows per length, so at most some thousand are broadcast.
    """
    spark = rows.sparkSession
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    parts = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    counts = {r.length: r.n for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    schema = "length long, first_rank long, end_rank long, first_sequence long, per_sequence long, first_offset long"
    places = F.broadcast(spark.createDataFrame(plan(counts, capacity), schema))

    by_salt = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select("length", "salt", F.coalesce(F.sum("n").over(by_salt), F.lit(0)).alias("before"))
    in_part = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("in_part", F.row_number().over(in_part) - 1).join(before, ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("in_part"))
    inside = (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("end_rank"))
    found = ranked.join(places, (ranked["length"] == places["length"]) & inside).drop(places["length"])
    nth = F.col("rank") - F.col("first_rank")
    return found.select(
        *(c for c in rows.columns),
        (F.col("first_sequence") + F.floor(nth / F.col("per_sequence"))).alias("sequence_id"),
        (F.col("first_offset") + nth % F.col("per_sequence") * F.col("length")).alias("offset"),
    )


def best_fit(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Cut, store and pack all documents; the id at the end of each document is ``END``."""
    return packed(stored(pieces(docs, path, capacity, with_ids), "pieces"), capacity)
