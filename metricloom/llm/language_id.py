"""Language ID by rank-order profiles.

A profile lists the most frequent letter n-grams (n = 1 to 3, words padded) by rank.  The distance of a
document to a language is how far its n-grams are out of place in that language's profile; an n-gram that
the profile lacks counts as far as its length.  Profiles are learned from a bounded sample of labelled
rows; every whole text is scored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import read_table

#: N-grams in a profile; labelled rows that a language's profile is learned from (on average, drawn by a hash of the id).
PROFILE, SAMPLE = 400, 2_000
UNKNOWN = "und"


class Ngrams:
    """Most frequent n-grams of a text, as integers of 21 bits a character; character 1 is a word boundary."""

    def __init__(self):
        self.letter = np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)])

    def all(self, text: str) -> np.ndarray:
        chars = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
        letter = np.append(self.letter[chars], False)
        if not letter.any():
            return np.zeros(0, np.int64)
        keep = letter.copy()
        keep[1:] |= letter[:-1]  # the first of each run of other characters stays as the boundary
        c = np.where(letter, np.append(chars, 0).astype(np.int64) + 1, 1)[keep]
        c = np.append(1, c) if c[0] != 1 else c
        pairs = c[:-1] << 21 | c[1:]
        triples = (pairs[:-1] << 21 | c[2:])[c[1:-1] != 1]
        return np.concatenate([c[c != 1], pairs, triples])

    def counted(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        grams = np.sort(self.all(text))
        heads = np.flatnonzero(np.append(True, grams[1:] != grams[:-1])) if len(grams) else np.zeros(0, np.int64)
        return grams[heads], np.diff(np.append(heads, len(grams)))

    def top(self, text: str, size: int) -> np.ndarray:
        grams, counts = self.counted(text)
        return grams[np.argsort(-counts, kind="stable")[:size]]


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ngrams, found = Ngrams(), {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            held = found.setdefault(lang, [])
            held.append(ngrams.counted(text))
            if len(held) >= 256:
                found[lang] = [_merged(held)]
    for lang, held in found.items():
        grams, counts = _merged(held)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(counts)], ["lang", "gram", "n"])


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    grams, at = np.unique(np.concatenate([g for g, _ in held]), return_inverse=True)
    return grams, np.bincount(at, np.concatenate([n for _, n in held]), len(grams)).astype(np.int64)


def learn_profiles(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, size: int = PROFILE) -> dict[str, list[int]]:
    """Language -> n-grams by rank, from about ``sample`` rows of each language.

    Every language that any row names is learned.  Rows with a null label or text teach nothing; repeated
    rows count each.  Equally frequent n-grams rank by their characters.  An empty table gives no profile.
    The driver holds ``size`` numbers for each language, as does every task that predicts.
    """
    spark = labelled.sparkSession
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counts = rows.groupBy("lang").count().collect()  # one row for each language
    if not counts:
        return {}
    shares = F.broadcast(spark.createDataFrame([(r["lang"], min(1.0, sample / r["count"])) for r in counts], "lang string, share double"))  # less than the profiles
    drawn = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("language")), F.lit(1 << 30)) / float(1 << 30)
    grams = rows.join(shares, "lang").where(drawn < F.col("share")).select("lang", "text").mapInArrow(_gram_counts, "lang string, gram long, n long")
    ranked = grams.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= size)
    profiles: dict[str, list[int]] = {}
    for row in ranked.orderBy("lang", "rank").select("lang", "gram").collect():  # languages * size rows
        profiles.setdefault(row["lang"], []).append(row["gram"])
    return profiles


def predicted(text: Column, profiles: dict[str, list[int]], size: int = PROFILE) -> Column:
    """A struct of lang and score for whole texts; ``und`` and 0 where there is no letter.

    The score is 1 less the distance as a part of the greatest possible one.  Equal distances go to the
    language first in order.
    """
    names = sorted(profiles)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        ngrams, tables = Ngrams(), []
        for name in names:
            grams = np.array(profiles[name], np.int64)
            order = np.argsort(grams)
            tables.append((grams[order], order))
        for texts in batches:
            langs, scores = [], []
            for text in texts:
                top = ngrams.top(text, size) if text else ()
                if not len(top) or not names:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                ranks, distances = np.arange(len(top)), []
                for grams, order in tables:
                    at = np.minimum(np.searchsorted(grams, top), len(grams) - 1)
                    distances.append(int(np.where(grams[at] == top, np.abs(order[at] - ranks), size).sum()))
                best = int(np.argmin(distances))
                langs.append(names[best])
                scores.append(1 - distances[best] / (size * len(top)))
            yield pd.DataFrame({"lang": langs, "score": scores})

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, "lang string, score double")(text)


def held_out(id_col: str, modulus: int, remainder: int) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def identify(docs: DataFrame, profiles: dict[str, list[int]], text_col: str = "text", out_col: str = "language") -> DataFrame:
    """The documents with one more column, a struct of lang and score; all rows and columns stay.

    The column is named ``out_col``, with as many underscores added as it takes to differ from the columns
    that are there (names differ in more than case).  Null, empty and letterless texts are ``und``; so are
    all texts when no profile was learned.  Texts of any length are read whole, repeated rows get equal
    results, an empty table stays empty.
    """
    taken = {c.lower() for c in docs.columns}
    while out_col.lower() in taken:
        out_col += "_"
    return docs.withColumn(out_col, predicted(docs[text_col], profiles))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out("doc_id", 4, 2).alias("held_out"))
    profiles = learn_profiles(docs.where(~F.col("held_out")))
    return identify(docs, profiles).select("doc_id", "held_out", F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))
