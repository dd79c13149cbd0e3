"""A corpus pipeline of the training-data operators: language ID, near-dedup, decontamination, mixing, sharding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet in the
shared folder and reads it again as the next stage's docs.  All but the last return the columns of docs,
whatever else they are called: columns that a stage makes for itself get names that docs doesn't use.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from metricloom.llm import decontaminate, language_id, mixing, near_dedup, sharding
from metricloom.llm.shared import Scratch, opened_scratch, read_table


def own_name(what: str) -> str:
    """A column name that no table has."""
    return f"{what}_{uuid.uuid4().hex}"


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, in no language, go.

    So do rows with a null, empty or blank text, and all rows where no label is there to learn from.  Texts of
    any length are read whole; repeated rows stay or go together; an empty table stays empty.
    """
    profiles = language_id.learn_profiles(docs.where(~language_id.held_out("doc_id", 4, 2)))
    found = own_name("language")
    spoken = docs.withColumn(found, language_id.predicted(F.col("text"), profiles))
    return spoken.where(F.col(found)["lang"] != language_id.UNKNOWN).drop(found)


#: Documents are near copies when their sets of five-word shingles have this similarity.
SHINGLE, PERCENT = 5, 80


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id.

    Rows that repeat an id are one document, of which the row with the least text hash stays (of rows equal in
    that, any one).  Rows with a null id are linked with nothing and all stay, and so do documents without
    words.  Texts of any length are compared whole; an empty table stays empty.
    """
    kept = near_dedup.near_dedup(docs, SHINGLE, PERCENT).where("kept and doc_id is not null").select("doc_id").distinct()
    nth = own_name("nth")
    same_id = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    first = docs.join(kept, "doc_id", "left_semi").withColumn(nth, F.row_number().over(same_id)).where(F.col(nth) == 1)
    return first.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item within its edit budget go.

    Null and empty texts hold none and stay; repeated rows stay or go together; texts of any length are
    searched whole; an empty table stays empty.
    """
    return decontaminate.without_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def mixed_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the curriculum takes; documents not taken go.

    Rows that share id and source share the largest number of copies; a null id or source is a value of its
    own.  Null and empty texts have size 0: they add nothing and follow their place in the stream.  Texts of
    any length count all their words; an empty table stays empty.
    """
    copies, copy, same_id, same_source = map(own_name, ("copies", "copy", "id", "source"))
    mix = mixing.curriculum_mix(docs).groupBy(F.col("doc_id").alias(same_id), F.col("source").alias(same_source)).agg(F.max("copies").alias(copies))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(same_id)) & F.col("source").cast("string").eqNullSafe(F.col(same_source))
    taken = docs.join(mix.where(F.col(copies) > 0), same)
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*docs.columns)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and slot.

    Columns of docs that are called shard or slot come out as shard_ and slot_ (with more underscores if those
    are taken too).  Null and empty texts are one group of equal texts; rows that repeat an id, or have none,
    are documents of their own; texts of any length stay whole; an empty table stays empty.
    """
    placed = sharding.minimax_shards(docs, carry=True)
    shown, taken = [], {c.lower() for c in docs.columns}
    for c in docs.columns:
        name = c
        while name.lower() in ("shard", "slot") or (name != c and name.lower() in taken):
            name += "_"
        taken.add(name.lower())
        shown.append(F.col("row")[c].alias(name))
    return placed.select(*shown, "shard", "slot")


STAGES = [
    ("language_id", known_language),
    ("near_dedup", one_of_near_copies),
    ("decontamination", without_benchmark),
    ("mixing", mixed_to_weights),
    ("sharding", sharded),
]
#: Edit distances, sketches and profiles are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows.  Once a stage is written, its scratch tables and its input, if a stage wrote it, are deleted."""
    scratch, docs, before = Scratch(spark, "pipeline"), read_table(spark, sf_dir, "documents"), []
    for _, stage in STAGES:
        with opened_scratch() as made:
            docs = scratch.write(stage(spark, docs, sf_dir))
        for used in made:
            used.close()
        scratch.drop(*before)
        before = [docs]
    return docs
