"""Lines that many documents share, dropped everywhere.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z in lower case. The 128-bit hashes of all lines are
range-partitioned by hash, document and position, so a hash with very many lines is spread over several partitions, and sorted in
the same order; the first line of each key in each document streams out of that order and is counted. What travels back to a
document is a bitmap of 64-line words; words whose lines are all kept are left out. Texts are never grouped by line.

Defined cases: a null or empty text is one empty line; keys below ``min_points`` code points are always kept; rows with equal
``doc_id`` and equal text are one document and get the same result each, rows with equal ``doc_id`` and different texts are
different documents; a null ``doc_id`` is a value like others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factorloom.llm.shared import content_key

WORD = 64


def line_key(line: Column) -> Column:
    """Equal for lines that agree but for the blanks at their ends and the case of A-Z.

    ``lower`` would change other letters too, and ``translate`` is slow, so lines with other letters are lowered as Latin-1
    bytes. That also moves the lead bytes C0 to DE up by 20, but their one continuation byte still tells them from the lead
    bytes of longer sequences, so keys of different lines stay different.
    """
    bare = bare_line(line)
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.lower(F.when(ascii_only, bare).otherwise(F.decode(bare.cast("binary"), "ISO-8859-1")))


def bare_line(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\n\v\f\r"))


def line_hashes(docs: DataFrame, min_points: int = 1) -> DataFrame:
    """``doc_id, content_key, pos, h1, h2`` of every line with a key of ``min_points`` or more."""
    lines = docs.select("doc_id", content_key(), F.posexplode(F.split(F.col("text"), "\n", -1)).alias("pos", "line"))
    keys = lines.where(F.char_length(bare_line(F.col("line"))) >= max(1, min_points)).select(
        "doc_id", "content_key", "pos", line_key(F.col("line")).alias("key")
    )
    return keys.select(
        "doc_id", "content_key", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")
    )


def drop_bitmaps(docs: DataFrame, min_documents: int = 10, min_points: int = 1) -> DataFrame:
    """``doc_id, content_key, drops``: a map from word number to the bits of its lines to drop; documents that keep all have none."""
    order = ["h1", "h2", "doc_id", "content_key"]
    rows = line_hashes(docs, min_points).repartitionByRange(*order).sortWithinPartitions(*order, "pos")
    first = F.row_number().over(Window.partitionBy(*order).orderBy("pos")) == 1
    firsts = rows.withColumn("first", first).where("first")
    shared = firsts.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_documents)
    drops = rows.join(shared.select("h1", "h2"), ["h1", "h2"])
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("pos") % WORD)
    words = drops.groupBy("doc_id", "content_key", F.floor(F.col("pos") / WORD).cast("int").alias("word")).agg(
        F.bit_or(bit).alias("bits")
    )
    return words.groupBy("doc_id", "content_key").agg(
        F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("drops")
    )


def kept_lines(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """All columns of ``docs`` in a struct ``row``, with ``n_lines``, ``n_dropped`` and the ``kept`` text."""
    right = bitmaps.select(F.col("doc_id").alias("bitmap_id"), F.col("content_key").alias("bitmap_key"), "drops")
    left = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("left_id"), content_key().alias("left_key"))
    same = F.col("left_id").eqNullSafe(F.col("bitmap_id")) & (F.col("left_key") == F.col("bitmap_key"))
    joined = left.join(right, same, "left").select(
        "row", "drops", F.split(F.coalesce(F.col("row.text"), F.lit("")), "\n", -1).alias("lines")
    )

    def stays(_, pos: Column) -> Column:
        bits = F.coalesce(F.try_element_at("drops", F.floor(pos / WORD).cast("int")), F.lit(0).cast("long"))
        return F.getbit(bits, pos % WORD) == 0

    kept = F.when(F.col("drops").isNull(), F.col("lines")).otherwise(F.filter("lines", stays))
    return joined.withColumn("left", kept).select(
        "row",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("left")).cast("long").alias("n_dropped"),
        F.array_join("left", "\n").alias("kept"),
    )


def without_shared_lines(docs: DataFrame, min_documents: int = 10, min_points: int = 1) -> DataFrame:
    """All rows and columns of ``docs``, the text without its shared lines; ``n_chars``, where there is one, follows it.

    Texts that lose no line stay as they are, null included.
    """
    out = kept_lines(docs, drop_bitmaps(docs, min_documents, min_points))
    changed = F.col("n_dropped") > 0
    new = {"text": F.when(changed, F.col("kept")).otherwise(F.col("row.text"))}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(changed, F.length("kept").cast(kind)).otherwise(F.col("row.n_chars"))
    return out.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def line_dedup(docs: DataFrame, min_documents: int = 10, min_points: int = 1) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256`` of every document."""
    docs = docs.select("doc_id", "text")
    out = kept_lines(docs, drop_bitmaps(docs, min_documents, min_points))
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
