"""Near duplicates by one-permutation hashing, banded buckets and star-shaped candidate edges.

A document's set of word shingles is hashed once; the hash range is cut into bins, each bin's minimum is one value of the
signature, and an empty bin takes the value of the first filled bin in a fixed random order of its own (optimal densification). Bands
of the signature name buckets. With 64 bands of 7 values, a pair at similarity 0.8 shares no bucket in one of three million cases.

Documents with equal sets are one node. In each bucket the node whose buckets are largest is the centre of a star, and every other
node is compared with it: as many pairs as members, never all pairs.

Then only nodes of one star that still lie in different components can add a link. Each is written as its differences from the centre,
the shingles that one of the two has and the other lacks. What two nodes differ in is what they differ in from the centre, less twice
what these differences share; so a similarity demands a number of shared differences, and none only where both link with the
centre, which connects them. Edited copies of one text that are just too far apart have few differences in common, though they
share nearly all else. A node's differences are ordered, those that fewest nodes of the star share first: two nodes meet at a
shared difference only if behind it both have as many left as they must share. The first one that linked nodes share passes this, so
nothing is lost: every pair of a bucket was compared, is connected, or cannot link. Nothing is capped.

A comparison first counts the bins in which two sketches of four bits per bin agree. Pairs more than six standard deviations below what
the similarity leads to expect are none, which is wrong in one of a billion cases; the others are decided on the full sets.

Defined cases: a null or empty text has an empty set and links with nothing; a text with fewer words than a shingle is one
shingle; rows with equal sets are linked; a null ``doc_id`` is never the smallest of a component unless all are null, and such a row
is kept only then; rows with equal ``doc_id`` and different texts are different documents; an empty table gives an empty
result; other columns are ignored by ``near_duplicates`` and kept by ``representatives``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType
from pyspark.sql.window import Window

from factorloom.llm.components import components
from factorloom.llm.shared import content_key, map_rows, stored
from factorloom.llm.word_hashes import WordHashes, mix, windows

BINS, BANDS, BAND_ROWS = 512, 64, 7
PLANES, PLANE_WORDS = 4, BINS // 64


def shingles(names: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a document's word names."""
    if not len(names):
        return names
    return np.unique(windows(names, size) if len(names) >= size else mix(windows(names, len(names)), np.uint64(len(names))))


@lru_cache(maxsize=4)
def _donors(bins: int) -> np.ndarray:
    """For each bin, all bins in a fixed random order: column ``t`` holds every bin's choice number ``t``."""
    numbers = np.arange(bins * bins, dtype=np.uint64).reshape(bins, bins)
    return np.ascontiguousarray(np.argsort(mix(numbers, np.uint64(bins)), axis=1, kind="stable").T)


def signature(hashes: np.ndarray, bins: int) -> np.ndarray:
    """One-permutation minima of sorted hashes, empty bins filled by optimal densification."""
    edges = np.arange(bins, dtype=np.uint64) * np.uint64((1 << 64) // bins)
    first = np.searchsorted(hashes, edges)
    last = np.append(first[1:], len(hashes))
    filled = first < last
    out = hashes[np.minimum(first, len(hashes) - 1)]
    empty, choices, turn = np.flatnonzero(~filled), _donors(bins), 0
    while len(empty):
        donor = choices[turn][empty]
        found = filled[donor]
        out[empty[found]] = out[donor[found]]
        empty, turn = empty[~found], turn + 1
    return out


def sketch(values: np.ndarray) -> bytes:
    """Bits of a hash of each bin's value and number: one plane after the other, each with a bit of every bin."""
    mixed = mix(values, np.arange(len(values), dtype=np.uint64))
    planes = [(mixed >> np.uint64(p)) & np.uint64(1) for p in range(PLANES)]
    return np.packbits(np.array(planes, np.uint8), axis=1).tobytes()


def band_names(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    table = values.reshape(bands, rows)
    out = np.arange(bands, dtype=np.uint64)
    for column in table.T:
        out = mix(out, column)
    return out


def lower_words(text: str | None) -> list[bytes]:
    """Words at ASCII blanks; on bytes only A-Z change case."""
    return (text or "").encode().lower().split()


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, content_key, n_shingles, digest, bands``; the last two are null for an empty set."""
    source = docs.select("doc_id", content_key(), "text")

    def per_task() -> Callable[..., Iterator[tuple]]:
        hashes = WordHashes()

        def one(doc_id, key, text):
            found = shingles(hashes.of(lower_words(text)), size)
            if not len(found):
                yield doc_id, key, 0, None, None
                return
            values = signature(found, BINS)
            names = band_names(values[: BANDS * BAND_ROWS], BANDS, BAND_ROWS)
            digest = hashlib.blake2b(found.astype("<u8").tobytes(), digest_size=16).digest()
            yield doc_id, key, len(found), digest, names.astype("<i8").tobytes()

        return one

    fields = [source.schema["doc_id"], source.schema["content_key"], StructField("n_shingles", LongType())]
    fields += [StructField(n, BinaryType()) for n in ("digest", "bands")]
    return map_rows(source, per_task, StructType(fields))


def _numbers(column: str) -> Column:
    """The 64-bit numbers in a binary column."""
    return F.expr(f"transform(sequence(0, length({column}) div 8 - 1), i -> cast(conv(hex(substring({column}, i * 8 + 1, 8)), 16, -10) as bigint))")


def _buckets(nodes: DataFrame) -> DataFrame:
    """``bucket, node, n_shingles``, one row per band, without Python."""
    return nodes.select("node", "n_shingles", F.explode(_numbers("bands")).alias("bucket"))


def _likely(pairs: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sketches agree as far as the similarity demands.

    Two bins agree with the similarity's probability, and else by chance in one of ``2 ** PLANES`` cases.
    """
    share = percent / 100 + (1 - percent / 100) / 2**PLANES
    least = math.floor(BINS * share - 6 * math.sqrt(BINS * share * (1 - share)))
    left, right = (bits.select(F.col("node").alias(n), F.col("words").alias(f"words_{n}")) for n in ("a", "b"))
    both = pairs.join(right, "b").join(left, "a")

    def unequal(word: int) -> Column:
        places = range(word, PLANES * PLANE_WORDS, PLANE_WORDS)
        return reduce(Column.bitwiseOR, [F.col("words_a")[i].bitwiseXOR(F.col("words_b")[i]) for i in places])

    differ = [F.bit_count(unequal(word)) for word in range(PLANE_WORDS)]
    return both.where(BINS - reduce(add, differ) >= least).select("a", "b")


def _candidate_sets(docs: DataFrame, members: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """``node, hashes, bits`` of nodes that share a bucket, from the text of one document each."""
    wanted = nodes.join(members.select("node").distinct(), "node", "left_semi").select(
        "node", F.col("first_doc.doc_id").alias("first_id"), F.col("first_doc.content_key").alias("first_key")
    )
    texts = docs.select("doc_id", content_key(), "text").join(
        wanted, F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("content_key") == F.col("first_key"))
    )

    def per_task() -> Callable[..., Iterator[tuple]]:
        hashes = WordHashes()

        def one(node, text):
            found = shingles(hashes.of(lower_words(text)), size)
            yield node, found.astype("<u8").tobytes(), sketch(signature(found, BINS))

        return one

    schema = StructType().add("node", "long").add("hashes", "binary").add("bits", "binary")
    # Repeated rows of the first document would give their node twice; the join has dealt the rows by their key already.
    once = texts.dropDuplicates(["content_key", "node"]).select("node", "text")
    return map_rows(once, per_task, schema)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a, b, linked`` for each pair, on the full sets."""
    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("set_a"))
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("set_b"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "set_a", "set_b")

    def per_task() -> Callable[..., Iterator[tuple]]:
        def one(a, b, set_a, set_b):
            x, y = np.frombuffer(set_a, "<u8"), np.frombuffer(set_b, "<u8")
            place = np.minimum(np.searchsorted(x, y), len(x) - 1)
            common = int(np.count_nonzero(x[place] == y))
            yield a, b, 100 * common >= percent * (len(x) + len(y) - common)

        return one

    return map_rows(both, per_task, StructType().add("a", "long").add("b", "long").add("linked", "boolean"))


def _stars(members: DataFrame) -> DataFrame:
    """``centre, n_centre, node, n_shingles``, each bucket's members with its centre: the node whose buckets are largest."""
    top = F.max_by(F.struct("node", "n_shingles"), F.struct("score", "node")).alias("top")
    centres = members.groupBy("bucket").agg(top).select("bucket", F.col("top.node").alias("centre"), F.col("top.n_shingles").alias("n_centre"))
    rows = members.join(stored(centres, "centres"), "bucket").where("node <> centre")
    return rows.select("centre", "n_centre", "node", "n_shingles").distinct()


def _open(stars: DataFrame, labels: DataFrame) -> DataFrame:
    """``centre, node, component, inside`` of stars whose nodes lie in several components; inside is that of the centre.

    The centre itself was compared with all of them.
    """
    of_centre = labels.select(F.col("node").alias("centre"), F.col("component").alias("component_c"))
    rows = stars.select("centre", "node").join(labels, "node").join(of_centre, "centre")
    rows = stored(rows.select("centre", "node", "component", (F.col("component") == F.col("component_c")).alias("inside")), "waiting")
    several = rows.groupBy("centre").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("centre")
    return rows.join(stored(several, "several"), "centre", "left_semi")


def _differences(waiting: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``weight, differences`` added to nodes: the shingles that either the node or its centre has.

    Two nodes link where ``2 * (100 + percent)`` times the differences they share reach the sum of their weights.
    """
    own = sets.select("node", F.col("hashes").alias("set_node"))
    of_centre = sets.select(F.col("node").alias("centre"), F.col("hashes").alias("set_centre"))
    both = waiting.join(own, "node").join(of_centre, "centre").select(*waiting.columns, "set_node", "set_centre")

    def per_task() -> Callable[..., Iterator[tuple]]:
        def one(*values):
            *row, set_node, set_centre = values
            x, y = np.frombuffer(set_node, "<u8"), np.frombuffer(set_centre, "<u8")
            found = np.setxor1d(x, y, assume_unique=True)
            yield *row, (100 + percent) * len(found) - (100 - percent) * len(x), found.tobytes()

        return one

    schema = StructType([*waiting.schema, StructField("weight", LongType()), StructField("differences", BinaryType())])
    return map_rows(both, per_task, schema)


def _across(stars: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a, b``, the pairs within stars that lie in different components and share a difference early enough to link."""
    rows = stored(_differences(_open(stars, labels), sets, percent), "differences")
    each = rows.select("centre", "node", "component", "inside", "weight", F.explode(_numbers("differences")).alias("hash"))
    # Differences are counted before they are joined, so a frequent one shrinks before the shuffle.
    shared = each.groupBy("centre", "hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    of_node = Window.partitionBy("centre", "node")
    rarest_last = of_node.orderBy(F.desc("n"), F.desc("hash"))
    ranked = each.join(stored(shared, "shared"), ["centre", "hash"]).withColumn("left", F.row_number().over(rarest_last).cast("long"))
    share = 2 * (100 + percent)
    ranked = ranked.withColumn("spare", share * F.count(F.lit(1)).over(of_node) - F.col("weight")).drop("n")
    ranked = stored(ranked, "ranked")
    # Nodes inside the centre's component only wait for those outside it, the others for any.
    outside = ~F.col("inside")
    bounds = ranked.groupBy("centre").agg(
        F.min("weight").alias("least"),
        F.max("spare").alias("most"),
        F.min(F.when(outside, F.col("weight"))).alias("least_outside"),
        F.max(F.when(outside, F.col("spare"))).alias("most_outside"),
    )
    least = F.when(outside, F.col("least")).otherwise(F.col("least_outside"))
    most = F.when(outside, F.col("most")).otherwise(F.col("most_outside"))
    # What is joined with a frequent key is stored, so that its rows can be split.
    early = ranked.join(stored(bounds, "bounds"), "centre").where((share * F.col("left") >= F.col("weight") + least) & (F.col("weight") <= most))
    early = stored(early.select("centre", "hash", "node", "component", "weight", "left"), "early")
    other = early.select("centre", "hash", *(F.col(c).alias(f"{c}_o") for c in ("node", "component", "weight", "left")))
    fits = share * F.least("left", "left_o") >= F.col("weight") + F.col("weight_o")
    met = early.join(other, ["centre", "hash"]).where("node < node_o and component <> component_o").where(fits)
    return met.select(F.col("node").alias("a"), F.col("node_o").alias("b")).distinct()


def _merged(labels: DataFrame, compared: DataFrame) -> DataFrame:
    """The components ``labels`` after the links among the compared pairs."""
    links = stored(compared, "compared").where("linked")
    if links.isEmpty():
        return labels
    merged = components(
        links.join(labels.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a")
        .join(labels.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b")
        .select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    ).select(F.col("node").alias("component"), F.col("component").alias("now"))
    out = labels.join(merged, "component", "left").withColumn("component", F.coalesce("now", "component"))
    return stored(out.drop("now").select("node", "component"), "labels")


def node_components(nodes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """``node, component`` of the nodes that link with another."""
    buckets = _buckets(nodes)
    # What is joined by bucket is stored first: between two plain exchanges a large bucket can be split.
    shared = stored(buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    members = stored(buckets.join(shared, "bucket"), "members")
    scores = members.groupBy("node").agg(F.sum("n").alias("score"))
    members = stored(members.join(scores, "node").select("bucket", "node", "n_shingles", "score"), "members")
    sets = stored(_candidate_sets(docs, members, nodes, size), "sets")

    bits = stored(sets.select("node", _numbers("bits").alias("words")), "bits")
    labels = members.select("node").distinct().select("node", F.col("node").alias("component"))
    stars = stored(_stars(members), "stars")
    fits = 100 * F.least("n_shingles", "n_centre") >= percent * F.greatest("n_shingles", "n_centre")
    pairs = stars.where(fits).select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
    labels = _merged(labels, _verified(_likely(pairs, bits, percent), sets, percent))
    return _merged(labels, _verified(_across(stars, labels, sets, percent), sets, percent))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, content_key, n_shingles, component_id, kept`` for every row.

    Documents link where their sets of ``size``-word shingles have a Jaccard similarity of ``percent`` / 100 or more.
    """
    rows = stored(sketches(docs, size), "sketches")
    classes = rows.where("digest is not null").groupBy("digest").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "content_key")).alias("first_doc"),
        F.first("n_shingles").alias("n_shingles"),
        F.first("bands").alias("bands"),
    )
    nodes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    labels = node_components(nodes, docs, size, percent)
    labelled = nodes.select("digest", "node", F.col("first_doc.doc_id").alias("first_id")).join(labels, "node", "left")
    labelled = labelled.withColumn("component", F.coalesce("component", "node"))
    least = labelled.groupBy("component").agg(F.min("first_id").alias("component_id"))
    by_digest = stored(labelled.join(least, "component").select("digest", "component_id"), "components")
    linked = rows.where("digest is not null").drop("bands").join(by_digest, "digest").drop("digest")
    alone = rows.where("digest is null").drop("bands", "digest").withColumn("component_id", F.col("doc_id"))
    out = linked.unionByName(alone.select(*linked.columns))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def representatives(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row of ``docs`` for each component, with all its columns: that of the smallest ``doc_id``.

    Of repeated rows, equal in ``doc_id`` and text, one stays. The join deals the texts by their key, which serves this too.
    """
    kept = near_duplicates(docs, size, percent).where("kept").select(
        F.col("doc_id").alias("kept_id"), F.col("content_key").alias("kept_key")
    )
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("row_id"), content_key().alias("row_key"))
    same = F.col("row_id").eqNullSafe(F.col("kept_id")) & (F.col("row_key") == F.col("kept_key"))
    return rows.join(kept.distinct(), same, "left_semi").dropDuplicates(["row_key", "row_id"]).select("row.*")
