"""Merkle manifest of a dataset: a ternary hash tree per source, a tree over the sources' roots, and a witness for every document.

Leaves of a source ascend by ``doc_id``. They are dealt to aligned blocks of ``3 ** LEVELS`` leaves, and each block is a stream of
appends: an arriving leaf opens a subtree, takes the siblings before it as its partial witness, and every sibling that is completed later
extends the witnesses of the subtrees open at its level. Three siblings close into their parent, which is appended one level up.
The roots of the blocks are appends of a further round in the same way, until each source has one root; then the sources' roots are the
appends. So no task holds more than a block, a source of any size is spread over its blocks, and the number of rounds is the logarithm of
the largest source in base ``3 ** LEVELS``. A document's witness is its block's part, followed by those of the blocks above.

Digests are lowercase hexadecimal text. A leaf hashes ``doc_id, source, lang, n_chars, text``, each ``-`` if null and otherwise its number of
UTF-8 bytes, ``:`` and the value.

Defined cases: null values have their own mark, so null and empty differ; rows without a source form a source of their own, which comes
first; a null ``doc_id`` comes first in its source; rows that share a ``doc_id`` ascend by their leaf digest, and equal rows are leaves
each; a source with one row has its leaf as root, a single source has its root as the root of all, and its witness there is empty; an
empty table has no rows and no root; texts of any length are hashed whole where they are read; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from factorloom.llm.shared import stored

# Fixed values of the tree and of a leaf.
ARITY = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

#: Levels that one block spans; a block is the most that a task has to keep.
LEVELS = 6
BLOCK = ARITY**LEVELS

WITNESS = ArrayType(StructType([StructField("before", StringType()), StructField("after", StringType())]))
#: Rows of one result batch.
OUT_ROWS = 4096


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(docs: DataFrame, text: Column | None = None) -> Column:
    parts = [field(text if name == "text" and text is not None else docs[name]) for name in FIELDS]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def tree_key(source: Column) -> Column:
    """Text that orders sources bytewise with null first, and that is never null."""
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source.cast("string")))


def leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """``tree, doc_id, leaf`` and the leaf of the tampered text, ``tampered``, where that text is not null."""
    changed = F.lit(None).cast("string") if tampered is None else F.when(tampered.isNotNull(), leaf_digest(docs, tampered))
    return docs.select(
        tree_key(docs["source"]).alias("tree"), "doc_id", leaf_digest(docs).alias("leaf"), changed.alias("tampered")
    )


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add ``place``, from 0, and the number of rows ``size`` of every tree, without a tree in one task.

    Ranges of (tree, order) are written with a running number; a small table of rows per (tree, range) turns it into places.
    """
    # The stored number makes all keys distinct, so that repeated rows do not share a range.
    numbered = stored(rows.withColumn("_row", F.monotonically_increasing_id()), "merkle-leaves")
    keys = ["tree", *order, "_row"]
    # Evaluated above the sort: the upper bits are the range, the lower 33 count its rows in order.
    ranged = numbered.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged = stored(ranged.drop("_row").withColumn("_at", F.monotonically_increasing_id()), "merkle-ranges")
    ranged = ranged.withColumn("_range", F.shiftright("_at", 33))
    counts = ranged.groupBy("tree", "_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    whole = Window.partitionBy("tree")
    starts = counts.select(
        "tree",
        "_range",
        (F.sum("_n").over(whole.orderBy("_range")) - F.col("_n") - F.col("_first")).alias("_shift"),
        F.sum("_n").over(whole).alias("size"),
    )
    return ranged.join(starts, ["tree", "_range"]).withColumn("place", F.col("_at") + F.col("_shift")).drop("_at", "_range", "_shift")


class OpenSubtree:
    """A completed node whose parent is still open, with the part of its witness at its own level known so far."""

    __slots__ = ("digest", "first", "end", "left", "right")

    def __init__(self, digest: str, first: int, end: int) -> None:
        self.digest, self.first, self.end, self.left, self.right = digest, first, end, "", ""


class Stream:
    """Appends to one block: open subtrees per level, and the witnesses of its leaves up to ``height``."""

    def __init__(self, height: int) -> None:
        self.height = height
        self.open: list[list[OpenSubtree]] = [[] for _ in range(height)]
        self.left: list[list[str]] = [[] for _ in range(height)]
        self.right: list[list[str]] = [[] for _ in range(height)]
        self.length = 0
        self.root = ""

    def append(self, digest: str) -> None:
        for level in range(self.height):
            self.left[level].append("")
            self.right[level].append("")
        self.length += 1
        self._complete(0, OpenSubtree(digest, self.length - 1, self.length))

    def _complete(self, level: int, node: OpenSubtree) -> None:
        if level == self.height:
            self.root = node.digest
            return
        run = self.open[level]
        for earlier in run:
            earlier.right += node.digest
            node.left += earlier.digest
        run.append(node)
        if len(run) == ARITY:
            self._close(level)

    def _close(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        for node in run:
            width = node.end - node.first
            self.left[level][node.first : node.end] = [node.left] * width
            self.right[level][node.first : node.end] = [node.right] * width
        parent = sha256("".join(node.digest for node in run).encode()).hexdigest()
        self._complete(level + 1, OpenSubtree(parent, run[0].first, run[-1].end))

    def finish(self) -> None:
        """Close what is open: a last run of fewer siblings, even of one, has a parent too."""
        for level in range(self.height):
            if self.open[level]:
                self._close(level)


def height(size: int, levels: int = LEVELS) -> int:
    """Levels of a tree of ``size`` leaves, as far as one block spans them."""
    h = 0
    while size > 1 and h < levels:
        size, h = -(-size // ARITY), h + 1
    return h


def _witnesses(streams: list[Stream]) -> pa.Array:
    left, right, sizes = [], [], []
    for s in streams:
        for i in range(s.length):
            for level in range(s.height):
                left.append(s.left[level][i])
                right.append(s.right[level][i])
        sizes += [s.height] * s.length
    pairs = pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], ["before", "after"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pairs)


def appended(nodes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """One round of appends: all columns of ``tree, place, digest, size, ...`` and ``block``, ``root`` of the block, ``witness`` inside it.

    Blocks are dealt by hash and arrive in order, so a task streams through them and keeps one block at a time.
    """
    rows = nodes.withColumn("block", F.floor(F.col("place") / ARITY**levels).cast("long"))
    rows = rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "place")
    schema = StructType([*rows.schema, StructField("root", StringType()), StructField("witness", WITNESS)])
    arrow = to_arrow_schema(schema)
    tree_at, digest_at, size_at, block_at = (rows.columns.index(c) for c in ("tree", "digest", "size", "block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        streams: list[Stream] = []
        key, stream = None, None

        def ready() -> pa.RecordBatch:
            """The rows of all finished blocks."""
            roots = [s.root for s in streams for _ in range(s.length)]
            columns = [*zip(*waiting[: len(roots)]), roots]
            out = [pa.array(c, f.type) for c, f in zip(columns, arrow)]
            out.append(_witnesses(streams).cast(arrow.field("witness").type))
            del waiting[: len(roots)]
            streams.clear()
            return pa.RecordBatch.from_arrays(out, schema=arrow)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if (row[tree_at], row[block_at]) != key:
                    if stream is not None:
                        stream.finish()
                        streams.append(stream)
                        if len(waiting) >= OUT_ROWS:
                            yield ready()
                    key, stream = (row[tree_at], row[block_at]), Stream(height(row[size_at], levels))
                stream.append(row[digest_at])
                waiting.append(row)
        if stream is not None:
            stream.finish()
            streams.append(stream)
            yield ready()

    return rows.mapInArrow(run, schema)


def rounds_of(nodes: DataFrame, name: str, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """Rounds of appends until every tree has one node, each stored, and ``tree, root``."""
    largest = nodes.agg(F.max("size")).first()[0] or 0
    rounds = []
    while True:
        rounds.append(stored(appended(nodes, levels), f"merkle-{name}"))
        roots = rounds[-1].where(F.col("place") % ARITY**levels == 0)
        largest = -(-largest // ARITY**levels)
        if largest <= 1:
            return rounds, roots.select("tree", "root")
        size = F.ceil(F.col("size") / ARITY**levels).cast("long")
        nodes = roots.select("tree", F.col("block").alias("place"), F.col("root").alias("digest"), size.alias("size"))


def descended(rounds: list[DataFrame], top: DataFrame) -> DataFrame:
    """The first round's rows with whole witnesses: each round's part, then those of its block, up to ``above`` of ``top``.

    ``top`` has a row per tree. It meets the last round, of at most one block per tree; a block's rows meet one row of the round above.
    """
    carried = [c for c in top.columns if c not in ("tree", "above")]
    found = rounds[-1].join(top, "tree").withColumn("witness", F.concat("witness", "above")).drop("above")
    for below in reversed(rounds[:-1]):
        up = found.select("tree", F.col("place").alias("block"), F.col("witness").alias("above"), *carried)
        found = below.join(up, ["tree", "block"]).withColumn("witness", F.concat("witness", "above")).drop("above")
    return found


def folded(leaf: Column, witness: Column) -> Column:
    """The root that a leaf digest and its witness lead to."""
    return F.aggregate(witness, leaf, lambda digest, at: F.sha2(F.concat(at["before"], digest, at["after"]).cast("binary"), 256))


def proof_digest(witness: Column) -> Column:
    """Digest of all siblings, level by level and left to right."""
    levels = F.transform(witness, lambda at: F.concat(at["before"], at["after"]))
    return F.sha2(F.array_join(levels, "").cast("binary"), 256)


def manifest(docs: DataFrame, tampered: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """``doc_id, leaf, tampered, subroot, root, witness`` of every document."""
    rows = placed(leaves(docs, tampered), ["doc_id", "leaf"]).withColumnRenamed("leaf", "digest")
    rounds, subroots = rounds_of(stored(rows, "merkle-placed"), "blocks", levels)
    # The sources' roots form one tree, in the order of the sources.
    forest = placed(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("of"), F.col("root").alias("digest")), ["of"])
    forest_rounds, top = rounds_of(stored(forest, "merkle-forest"), "forest", levels)
    root = top.first()
    empty = F.array().cast(WITNESS)
    upper = descended(forest_rounds, top.select("tree", empty.alias("above")))
    upper = upper.select(F.col("of").alias("tree"), F.col("witness").alias("above"), F.col("digest").alias("subroot"))
    found = descended(rounds, upper)
    top_root = F.lit(root["root"] if root else None).cast("string")
    return found.select("doc_id", F.col("digest").alias("leaf"), "tampered", "subroot", top_root.alias("root"), "witness")


def verified(rows: DataFrame) -> DataFrame:
    """The manifest with each leaf, or its tampered one, folded along its witness and compared with the root."""
    found = folded(F.coalesce("tampered", "leaf"), F.col("witness"))
    out = rows.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("witness")).alias("proof_sha256"), found.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
