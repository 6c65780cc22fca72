"""Exact duplicates by a persistent index of text digests.

Texts are equal when they agree after every character of ``[\\x20\\x09-\\x0D]`` is deleted. The index is a table with one row per
SHA-256 digest, bucketed and sorted by it; each batch of new data meets it in a sort-merge anti-join, and only unknown digests are
appended. What a batch adds to digests that are known, more rows or a better document, is appended to a second table of the same
buckets, so neither table is ever rewritten; reading the index merges the two bucket by bucket.

Defined cases: a null text counts as empty, and empty texts are equal to one another; of equal texts the longest original stays,
then the smallest ``doc_id`` (null counts as smallest); repeated rows are members of their group one by one; an empty table gives
an empty result; other columns are ignored. A batch that is added again under its name, because a job failed half-way, changes nothing.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.llm.shared import stored

BLANKS = " \t\n\v\f\r"


def normalised(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for blank in BLANKS:
        out = F.replace(out, F.lit(blank), F.lit(""))
    return out


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id, digest, n_points``: what later steps need of a document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.unhex(F.sha2(normalised(text), 256)).alias("digest"), F.length(text).alias("n_points"))


def representatives(rows: DataFrame) -> DataFrame:
    """One row per digest, aggregated before the shuffle, so a large group sends one row per task."""
    best = F.min(F.struct((-F.col("n_points")).alias("order"), "doc_id"))
    return (
        rows.groupBy("digest")
        .agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
        .select("digest", F.col("best.doc_id").alias("keep_id"), (-F.col("best.order")).alias("n_points"), "group_size")
    )


def changes_table(table: str) -> str:
    return f"{table}_changes"


def append_new(rows: DataFrame, table: str, batch: str, buckets: int | None = None) -> None:
    """Add a batch of digests to the index ``table``, which is created on first use.

    Unknown digests enter the index. For known ones the batch's rows and best document are appended to ``changes_table``. That
    comes first: a batch found in the index is complete, and one found only among the changes has its index rows still to come.
    ``buckets`` follows the shuffle partitions, and must be the same in every call for a table.
    """
    spark = rows.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = representatives(rows).withColumn("batch", F.lit(batch))

    def holds(name: str) -> bool:
        return spark.catalog.tableExists(name) and not spark.table(name).where(F.col("batch") == batch).isEmpty()

    def append(part: DataFrame, name: str) -> None:
        by_bucket = part.repartition(buckets, "digest")
        by_bucket.write.mode("append").bucketBy(buckets, "digest").sortBy("digest").saveAsTable(name)

    if holds(table):
        return
    if not spark.catalog.tableExists(table):
        append(found, table)
        return
    known = spark.table(table).select("digest").hint("merge")
    if not holds(changes_table(table)):
        append(found.join(known, "digest", "left_semi"), changes_table(table))
    append(found.join(known, "digest", "left_anti"), table)


def current(spark: SparkSession, table: str) -> DataFrame:
    """``digest, keep_id, n_points, group_size`` of everything added so far. Both tables share their buckets, so nothing is shuffled."""
    index = spark.table(table)
    if not spark.catalog.tableExists(changes_table(table)):
        return index.drop("batch")
    best = F.struct((-F.col("n_points")).alias("order"), F.col("keep_id").alias("doc_id"))
    changes = spark.table(changes_table(table)).groupBy("digest").agg(F.min(best).alias("_best"), F.sum("group_size").alias("_more"))
    merged = index.withColumn("_first", best).join(changes.hint("merge"), "digest", "left").withColumn("_best", F.least("_first", "_best"))
    return merged.select(
        "digest",
        F.col("_best.doc_id").alias("keep_id"),
        (-F.col("_best.order")).alias("n_points"),
        (F.col("group_size") + F.coalesce("_more", F.lit(0))).alias("group_size"),
    )


def drop_index(spark: SparkSession, table: str) -> None:
    for name in (table, changes_table(table)):
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def resolve(rows: DataFrame, index: DataFrame, hot_share: float = 0.001) -> DataFrame:
    """Each document with the one that stays for it.

    Digests with at least ``hot_share`` of all rows, at most ``1 / hot_share`` of them, are broadcast: their many documents
    need no shuffle. The others meet the bucketed index in a sort-merge join that shuffles the documents' digests only.
    """
    total = index.agg(F.sum("group_size")).first()[0] or 0
    least = max(2, math.ceil(total * hot_share))
    columns = index.select("digest", "keep_id", "group_size")
    hot = F.broadcast(columns.where(F.col("group_size") >= least))
    cold = columns.where(F.col("group_size") < least).hint("merge")
    many = rows.join(hot, "digest")
    few = rows.join(hot.select("digest"), "digest", "left_anti").join(cold, "digest")
    return many.unionByName(few)


def duplicates(spark: SparkSession, batches: Sequence[DataFrame], table: str) -> DataFrame:
    """Add one batch of documents after the other and return ``doc_id, keep_id, group_size, kept, text_sha256`` for each of their rows."""
    parts = [stored(digests(docs), "digests") for docs in batches]
    for i, part in enumerate(parts):
        append_new(part, table, f"batch {i}")
    return resolve(reduce(DataFrame.unionByName, parts), current(spark, table)).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
