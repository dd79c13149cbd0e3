"""Exact dedup by content sort, in DataFrame operations only.

Sampled splitters range-partition the normalised texts, the external sort of each range puts equal texts
next to each other, and the window over them compares neighbours in full.  The driver sees of a sampled
text only its first ``HEAD`` characters and, so that texts with one head can be parted, a 64-bit hash;
inside a range the order is that of the whole texts.

A text that the sample shows to be hot (more than half a partition's share of the rows or of the bytes)
is salted into as many runs as it is partitions large.  The runs of one hot text meet afterwards: one
representative row each, compared by the whole text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import WHITESPACE, Scratch, partitions, read_table, text_or_empty

HEAD = 64
#: Rows drawn for each partition to find hot texts.
DRAWN = 200


def hot_texts(docs: DataFrame, norm: Column, many: int, scratch: Scratch) -> DataFrame:
    """(hash, salts) of texts that outgrow half a partition, by a sample: at most 4 * ``many`` rows."""
    total = docs.count()
    drawn = docs.sample(min(1.0, DRAWN * many / max(total, 1)), 7).select(norm.alias("norm"))
    texts = drawn.groupBy(F.xxhash64("norm").alias("hash")).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("norm") + 16).alias("bytes"))
    texts = scratch.write(texts)
    rows, size = texts.agg(F.sum("rows"), F.sum("bytes")).first()
    share = F.greatest(F.col("rows") / F.lit(rows or 1), F.col("bytes") / F.lit(size or 1))
    hot = texts.where("rows > 1").where(share > 0.5 / many)
    return hot.select("hash", F.ceil(share * 2 * many).cast("int").alias("salts"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of ASCII white space became one space; a null text
    counts as empty.  Of equal texts the row with the smallest id stays; of rows that repeat the same id
    and text, one.  Null ids rank after all others (keep_id is null only if all ids of the group are).
    Texts may be of any length.  An empty table gives an empty result; other columns are ignored, whatever
    their names.
    """
    spark = docs.sparkSession
    scratch, many = Scratch(spark, "exact-dedup"), partitions(spark)
    norm = F.regexp_replace(text_or_empty(docs[text_col]), WHITESPACE, " ")
    hot = scratch.write(hot_texts(docs, norm, many, scratch))
    # Null ids of a hot text go by input partition, which a retried task shares.
    spread = F.when(F.col("doc_id").isNull(), F.spark_partition_id()).otherwise(F.xxhash64("doc_id"))
    rows = (
        docs.select(docs[id_col].cast("long").alias("doc_id"), norm.alias("norm"))
        .withColumn("head", F.substring("norm", 1, HEAD))
        .withColumn("hash", F.xxhash64("norm"))
        .join(F.broadcast(hot), "hash", "left")  # at most 4 rows a partition
        .withColumn("salt", F.coalesce(F.pmod(spread, F.col("salts")), F.lit(0)).cast("int"))
    )
    run = Window.partitionBy("norm", "head", "hash", "salt").orderBy(F.col("doc_id").asc_nulls_last())
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nth = F.row_number().over(run)
    runs = scratch.write(
        rows.repartitionByRange("head", "hash", "salt").select(
            "doc_id", "norm", "salt", F.col("salts").isNotNull().alias("hot"),
            F.min("doc_id").over(whole).alias("run_min"), F.count(F.lit(1)).over(whole).alias("run_rows"), nth.alias("nth"),
        )
        .withColumn("text_sha256", F.sha2(F.col("norm").cast("binary"), 256))
        .withColumn("norm", F.when(F.col("hot") & (F.col("nth") == 1), F.col("norm")))  # only representatives of salted runs carry their text on
    )
    first = F.min(F.struct(F.col("run_min").isNull().alias("no_id"), "run_min", "salt"))
    merged = (
        runs.where("norm is not null").groupBy("norm")
        .agg(first.alias("first"), F.sum("run_rows").alias("group_size"), F.first("text_sha256").alias("text_sha256"))
        .select("text_sha256", F.col("first.run_min").alias("keep_id"), F.col("first.salt").alias("keep_salt"), "group_size")
    )
    merged = F.broadcast(scratch.write(merged))  # hot texts only: at most 4 rows a partition
    out = runs.drop("norm").join(merged, "text_sha256", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("run_min")).otherwise(F.col("keep_id"))
    return out.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", "run_rows").alias("group_size"),
        (F.col("doc_id").eqNullSafe(keep) & (F.col("nth") == 1) & F.coalesce(F.col("salt") == F.col("keep_salt"), F.lit(True))).alias("kept"),
        "text_sha256",
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"))


SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM n JOIN g USING (norm)
"""
