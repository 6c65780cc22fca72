"""Repeated passages: words of windows that also stand in a document with a smaller id are removed.

Recompression names the inside of equal passages equally, and one fixed symbol stands for each window. A symbol in two different
texts reveals that they may share its windows: these are candidates, and so are windows without a symbol (long runs of a word).
Candidates are verified by 128-bit fingerprints of their words: each fingerprint's smallest document keeps it, in the others its
words go. Only symbols, fewer than one in ten words, and candidate windows are shuffled, the text once.

Texts with equal words are one class: all but the document with the smallest id lose every window, without comparing them. Classes
of at least a thousandth of all documents, at most a thousand, are known to every task, so their copies are not even parsed.

Defined cases: a null text has no words; documents shorter than a window lose nothing; a null ``doc_id`` is neither smaller nor larger
than others, so such a row loses nothing and removes nothing; rows with equal ``doc_id`` do not remove each other's words, and repeated
rows get the same result each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from factorloom.llm.recompression import window_symbols
from factorloom.llm.shared import map_rows, map_slices, stored
from factorloom.llm.word_hashes import WordHashes, mix, windows

HOT_SHARE = 0.001
_SECOND = np.uint64(0x5851F42D4C957F2D)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def digest_of(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def fingerprints(names: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit names for each window."""
    return windows(names, window), windows(mix(names, _SECOND), window)


def whole_name(joined: bytes) -> int:
    """Name of a document's whole word sequence, as a signed number."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(joined)).astype(np.int64))


def summaries(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, digest, whole, first_id``: digest and name of a document's words, and the smallest id that has them."""
    source = docs.select("doc_id", "text")

    def rows() -> Callable[..., Iterator[tuple]]:
        def one(doc_id, text):
            words = words_of(text)
            joined = b" ".join(words)
            yield doc_id, len(words), hashlib.sha256(joined).hexdigest(), whole_name(joined)

        return one

    fields = [source.schema["doc_id"], StructField("n_words", LongType()), StructField("digest", StringType()), StructField("whole", LongType())]
    table = stored(map_rows(source, rows, StructType(fields)), "summaries")
    classes = table.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n_class"))
    # Stored, so that the join is between two plain exchanges and a large class can be split.
    copied = stored(classes.where("n_class > 1"), "classes")
    joined = table.join(copied, "digest", "left").withColumn("first_id", F.coalesce("least", "doc_id")).drop("least")
    return stored(joined.withColumn("n_class", F.coalesce("n_class", F.lit(1))), "summaries")


def hot_classes(table: DataFrame) -> dict[int, int]:
    """First ids of the classes with at least ``HOT_SHARE`` of all documents: at most ``1 / HOT_SHARE`` of them."""
    least = max(2, math.ceil(table.count() * HOT_SHARE))
    rows = table.where((F.col("n_class") >= least) & (F.col("doc_id") == F.col("first_id"))).select("whole", "first_id").distinct()
    return {r.whole: r.first_id for r in rows.collect()}


def symbols(docs: DataFrame, window: int, hot: dict[int, int]) -> DataFrame:
    """``name, doc_id, whole, first, end``: runs of windows and the symbol that stands for them, null where there is none."""
    known = docs.sparkSession.sparkContext.broadcast(hot)

    def rows() -> Callable[..., tuple | None]:
        hashes, hot = WordHashes(), known.value

        def several(ids, texts):
            kept, wholes, names = [], [], []
            for doc_id, text in zip(ids, texts):
                words = words_of(text)
                if len(words) >= window:
                    whole = whole_name(b" ".join(words))
                    if hot.get(whole, doc_id) == doc_id:
                        kept.append(doc_id)
                        wholes.append(whole)
                        names.append(hashes.of(words))
            if not kept:
                return None
            document, first, end, name, fixed = window_symbols(names, window)
            name = pa.array(name.view(np.int64), pa.int64(), mask=~fixed)
            return name, np.array(kept, np.int64)[document], np.array(wholes, np.int64)[document], first, end

        return several

    schema = StructType().add("name", "long").add("doc_id", "long").add("whole", "long").add("first", "integer").add("end", "integer")
    return map_slices(docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rows, schema)


def candidates(docs: DataFrame, table: DataFrame, window: int) -> DataFrame:
    """``doc_id, text, runs``: documents with their runs of candidate windows."""
    found = stored(symbols(docs, window, hot_classes(table)), "symbols")
    named = found.where("name is not null")
    shared = named.groupBy("name").agg(F.min("whole").alias("low"), F.max("whole").alias("high")).where("low < high").select("name")
    shared = stored(shared, "shared")
    runs = named.select("name", "doc_id", "first", "end").join(shared, "name").drop("name")
    runs = runs.unionByName(found.where("name is null").select("doc_id", "first", "end"))
    # Only the first document of a class can be a smallest one, and only it needs its windows compared.
    firsts = table.where((F.col("doc_id") == F.col("first_id")) & (F.col("n_words") >= window)).select("doc_id").distinct()
    grouped = runs.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("first", "end"))).alias("runs"))
    wanted = grouped.join(firsts, "doc_id")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartition(parts, "doc_id")
    return texts.join(wanted.repartition(parts, "doc_id"), "doc_id")


def _segments(words: list[bytes], runs: list[dict], window: int) -> tuple[list[bytes], list[int]]:
    """The words that candidate windows cover, and where in them these windows start; overlapping runs share their words.

    A repeated ``doc_id`` may bring runs of another text: those beyond the text are left out.
    """
    out: list[bytes] = []
    starts: list[int] = []
    at = shift = 0
    for run in runs:
        first, end = run["first"], min(run["end"], len(words) - window + 1)
        if first >= end:
            continue
        if first >= at:
            at, shift = first, len(out) - first
        out += words[at : end + window - 1]
        at = max(at, end + window - 1)
        starts += range(first + shift, end + shift)
    return out, starts


def candidate_windows(rows: DataFrame, window: int) -> DataFrame:
    """``w1, w2, doc_id`` of the distinct candidate windows of each document."""

    def per_task() -> Callable[..., tuple | None]:
        hashes = WordHashes()

        def several(ids, texts, runs):
            words: list[bytes] = []
            starts, owners = [], []
            for doc_id, text, own in zip(ids, texts, runs):
                part, at = _segments(words_of(text), own, window)
                starts.append(np.array(at, np.int64) + len(words))
                owners.append(np.full(len(at), doc_id, np.int64))
                words += part
            starts, owners = np.concatenate(starts), np.concatenate(owners)
            w1, w2 = (w[starts] for w in fingerprints(hashes.of(words), window))
            order = np.lexsort((w1, owners))
            w1, w2, owners = w1[order], w2[order], owners[order]
            once = np.r_[True, (w1[1:] != w1[:-1]) | (owners[1:] != owners[:-1])][: len(w1)]
            return w1[once].view(np.int64), w2[once].view(np.int64), owners[once]

        return several

    schema = StructType().add("w1", "long").add("w2", "long").add("doc_id", "long")
    return map_slices(rows.select("doc_id", "text", "runs"), per_task, schema)


def repeated(found: DataFrame) -> DataFrame:
    """``doc_id, removed``: first fingerprints of the windows that also stand in a document with a smaller id."""
    least = found.groupBy("w1", "w2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    later = found.join(stored(least.drop("most"), "repeated"), ["w1", "w2"]).where("doc_id > least")
    return later.groupBy("doc_id").agg(F.collect_list("w1").alias("removed"))


def kept_words(words: list[bytes], runs: list[dict], removed: list[int], window: int, hashes: WordHashes) -> list[bytes]:
    """The words outside the removed windows, which are among the candidates."""
    part, starts = _segments(words, runs, window)
    w1 = fingerprints(hashes.of(part), window)[0][np.array(starts, np.int64)]
    gone = np.isin(w1, np.array(removed, np.int64).view(np.uint64))
    places = np.concatenate([np.arange(r["first"], max(r["first"], min(r["end"], len(words) - window + 1))) for r in runs])[gone]
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, places, 1)
    np.add.at(edges, places + window, -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(edges)[:-1] == 0)]


def cleaned(rows: DataFrame, gone: DataFrame, window: int) -> DataFrame:
    """``doc_id, digest, kept, n_removed`` of the documents that lose words."""

    def per_task() -> Callable[..., Iterator[tuple]]:
        hashes = WordHashes()

        def one(doc_id, text, runs, removed):
            words = words_of(text)
            kept = kept_words(words, runs, removed, window, hashes)
            yield doc_id, digest_of(words), b" ".join(kept).decode(), len(words) - len(kept)

        return one

    schema = StructType().add("doc_id", "long").add("digest", "string").add("kept", "string").add("n_removed", "long")
    return map_rows(rows.select("doc_id", "text", "runs").join(gone, "doc_id"), per_task, schema)


def substring_dedup(spark: SparkSession, docs: DataFrame, window: int = 50) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every row.

    The candidates' texts are kept in a table bucketed by ``doc_id`` while windows are compared, so they are shuffled once; the
    result is stored, and the table dropped.
    """
    table = summaries(docs)
    name = f"substring_dedup_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chosen = candidates(docs, table, window)
    chosen.write.option("compression", "zstd").bucketBy(parts, "doc_id").sortBy("doc_id").saveAsTable(name)
    texts = spark.table(name)
    gone = repeated(candidate_windows(texts, window))
    changed = cleaned(texts, gone, window).select(
        F.col("doc_id").alias("changed_id"), F.col("digest").alias("changed_digest"), "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )
    changed = changed.dropDuplicates(["changed_id", "changed_digest"])
    same = (F.col("doc_id") == F.col("changed_id")) & (F.col("digest") == F.col("changed_digest"))
    copy = (F.col("doc_id") > F.col("first_id")) & (F.col("n_words") >= window)
    nothing = F.sha2(F.lit(""), 256)
    out = table.join(changed, same, "left").select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, nothing).otherwise(F.coalesce("kept_sha256", "digest")).alias("kept_sha256"),
    )
    out = stored(out, "substring-dedup")
    spark.sql(f"DROP TABLE {name}")
    return out
