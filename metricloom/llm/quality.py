"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network in NumPy.

Tokens are a word's letters and its shape (case and punctuation), both hashed to ``VOCABULARY`` rows.
Every token has a sparse random index vector; a token's word vector is the sum of the index vectors around
it in the training texts.  A document is the mean and spread of its tokens' vectors.  A network with one
hidden layer scores it, and a temperature fitted on rows left out of training calibrates the probability.

Texts stay on the executors: the driver collects sums of index vectors (one row of ``DIMENSIONS`` whole
numbers for each of at most ``VOCABULARY`` tokens) and one row of features for each training document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .language_id import held_out
from .shared import Scratch, read_table

#: Labelled rows that the classifier is fitted on (on average, drawn by a hash of the id).
SAMPLE = 3_000
VOCABULARY, DIMENSIONS, NONZERO, REACH = 1 << 14, 48, 6, 2
HIDDEN, EPOCHS, RATE, DECAY = 24, 300, 0.01, 1e-3
#: A text is pooled so many words at a time.
POOLED = 200_000


class Tokens(dict):
    """word -> letters' row << 32 | shape's row."""

    def __missing__(self, word: str) -> int:
        core = "".join(c for c in word if c.isalpha())
        shape = "A" if core.isupper() and len(core) > 1 else "Aa" if core[:1].isupper() else "a" if core else ""
        shape += "9" if any(c.isdigit() for c in word) else ""
        shape += "".join(c for c in word if not c.isalnum())
        rows = [xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) % VOCABULARY for x in ("w" + core.lower(), "s" + shape)]
        if len(self) > 300_000:
            self.clear()
        value = self[word] = rows[0] << 32 | rows[1]
        return value

    def rows(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        words = text.split()
        packed = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return packed >> 32, packed & 0xFFFFFFFF


def index_vectors() -> np.ndarray:
    """Whole numbers: NONZERO random places of each row are raised or lowered by one."""
    order = np.random.Generator(np.random.PCG64(11))
    out = np.zeros((VOCABULARY, DIMENSIONS), np.int64)
    for i in range(NONZERO):
        out[np.arange(VOCABULARY), order.integers(0, DIMENSIONS, VOCABULARY)] += 1 - 2 * (i % 2)
    return out


class Neighbours:
    """Sums of the index vectors of all tokens within REACH places of each token."""

    def __init__(self):
        self.tokens, self.index = Tokens(), index_vectors()
        self.sums = np.zeros((VOCABULARY, DIMENSIONS), np.int64)

    def _add(self, centres: np.ndarray, others: np.ndarray) -> None:
        pairs, counts = np.unique(centres * VOCABULARY + others, return_counts=True)
        for i in range(0, len(pairs), POOLED):
            rows, near = np.divmod(pairs[i : i + POOLED], VOCABULARY)
            heads = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
            self.sums[rows[heads]] += np.add.reduceat(self.index[near] * counts[i : i + POOLED, None], heads)

    def add(self, texts: list[str]) -> None:
        cores, shapes = zip(*[self.tokens.rows(t) for t in texts])
        for step in range(1, REACH + 1):
            for kinds in (cores, shapes):
                left = np.concatenate([r[:-step] for r in kinds if len(r) > step] or [np.zeros(0, np.int64)])
                right = np.concatenate([r[step:] for r in kinds if len(r) > step] or [np.zeros(0, np.int64)])
                if len(left):
                    self._add(left, right)
                    self._add(right, left)


def _neighbour_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = Neighbours()
    for batch in batches:
        for i in range(0, batch.num_rows, 100):
            found.add(batch.column(0).slice(i, 100).to_pylist())
    used = np.flatnonzero(found.sums.any(axis=1))
    sums = pa.FixedSizeListArray.from_arrays(pa.array(found.sums[used].ravel()), DIMENSIONS).cast(pa.list_(pa.int64()))
    yield pa.RecordBatch.from_arrays([pa.array(used), sums], ["token", "sums"])


def word_vectors(texts: DataFrame) -> np.ndarray:
    """Unit vectors of all tokens from a table with one column of texts; the sums are whole numbers, so their order changes nothing."""
    partial = texts.mapInArrow(_neighbour_sums, "token long, sums array<long>")
    total = partial.groupBy("token").agg(F.array(*[F.sum(F.col("sums")[i]) for i in range(DIMENSIONS)]).alias("sums"))
    vectors = index_vectors().astype(np.float64)
    for row in total.collect():  # at most VOCABULARY rows
        vectors[row["token"]] += row["sums"]
    return (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def features(text: str | None, tokens: Tokens, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the vectors of a whole text's tokens, and its length; zeros for no words."""
    out = []
    kinds = tokens.rows(text or "")
    for rows in kinds:
        total = np.zeros((2, DIMENSIONS))
        for i in range(0, len(rows), POOLED):
            used, counts = np.unique(rows[i : i + POOLED], return_counts=True)
            v = vectors[used].astype(np.float64)
            total += counts @ v, counts @ (v * v)
        n = max(len(rows), 1)
        mean = total[0] / n
        out += [mean, np.sqrt(np.maximum(total[1] / n - mean * mean, 0))]
        out.append([len(np.unique(rows)) / n])
    return np.concatenate([*out, [np.log1p(len(kinds[0]))]])


class Network:
    """tanh hidden layer and a logit; ``fit`` is Adam on the log loss, then the temperature."""

    def __init__(self):
        self.mean = self.scale = None
        self.temperature = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -50, 50)))

    def fit(self, x: np.ndarray, y: np.ndarray) -> Network:
        order = np.random.Generator(np.random.PCG64(13))
        shuffled = order.permutation(len(x))
        calibration, train = np.split(shuffled, [len(x) // 5])
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        self.w1 = order.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN))
        self.b1, self.w2, self.b2 = np.zeros(HIDDEN), order.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)
        names = ("w1", "b1", "w2", "b2")
        first, second = ({k: np.zeros_like(getattr(self, k)) for k in names} for _ in range(2))
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        step = 0
        for _ in range(EPOCHS):
            order.shuffle(train)
            for part in np.array_split(train, max(1, len(train) // 256)):
                hidden = np.tanh(z[part] @ self.w1 + self.b1)
                error = (1 / (1 + np.exp(-np.clip(hidden @ self.w2 + self.b2, -50, 50))) - y[part]) / max(len(part), 1)
                inner = np.outer(error, self.w2) * (1 - hidden**2)
                slopes = {"w1": z[part].T @ inner + DECAY * self.w1, "b1": inner.sum(axis=0), "w2": hidden.T @ error + DECAY * self.w2, "b2": error.sum(keepdims=True)}
                step += 1
                for k in names:
                    first[k] = 0.9 * first[k] + 0.1 * slopes[k]
                    second[k] = 0.999 * second[k] + 0.001 * slopes[k] ** 2
                    setattr(self, k, getattr(self, k) - RATE / (1 + step / 500) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8))
        if len(calibration):
            logits, sign = self.logits(x[calibration]), 1 - 2 * y[calibration]
            losses = [(np.logaddexp(0, sign * logits / t).mean(), t) for t in np.geomspace(0.25, 16, 61)]
            self.temperature = float(min(losses)[1])
        return self


class Constant:
    """Stands in where there is nothing to learn from: the labels' mean, or one half without labels."""

    def __init__(self, value: float):
        self.value = value

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.value)


def _features(vectors: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for batch in batches:
            x = [features(t, tokens, vectors).tolist() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.list_(pa.float64()))], ["id", "label", "x"])

    return run


def learn_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE):
    """(word vectors, network) fitted on about ``sample`` labelled documents, drawn by a hash of the id.

    Null labels and ids are left out, null texts count as empty.  Of rows that share an id the greatest label
    and the least text count, so repeated rows change nothing.  Texts may be of any length.  Empty tables, or
    labels of one value, give a constant score.  Other columns are ignored, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    labels = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label")).dropna().groupBy("id").agg(F.max("label").alias("label"))
    n = labels.count()
    drawn = labels.where(F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("quality")), F.lit(max(n, 1))) < sample) if n > sample else labels
    drawn = F.broadcast(scratch.write(drawn))  # about ``sample`` rows
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).join(drawn, "id")
    rows = scratch.write(rows.groupBy("id", "label").agg(F.coalesce(F.min("text"), F.lit("")).alias("text")))
    vectors = word_vectors(rows.select("text"))
    found = sorted(rows.mapInArrow(_features(vectors), rows.drop("text").schema.simpleString()[7:-1].replace(":", " ") + ", x array<double>").collect())  # about ``sample`` rows of fixed size
    scratch.close()
    if not found:
        return vectors, Constant(0.5)
    y = np.array([float(r["label"] >= 1) for r in found])
    if len(set(y)) < 2:
        return vectors, Constant(float(y.mean()))
    return vectors, Network().fit(np.array([r["x"] for r in found]), y)


def scored(text: Column, model) -> Column:
    """The probability of label 1 for every whole text; null and empty texts are scored as texts of no words.

    Equal texts get equal scores; texts of any length are pooled whole, ``POOLED`` words at a time; an empty
    table gives no scores, and other columns play no part.
    """
    vectors, network = model

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokens = Tokens()
        for texts in batches:
            yield pd.Series(network.scores(np.array([features(t, tokens, vectors) for t in texts]).reshape(len(texts), -1)) if len(texts) else [], dtype=float)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "double")(text)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", held_out("doc_id", 3, 1).alias("held_out"))
    labels = read_table(spark, sf_dir, "labels").where(~held_out("doc_id", 3, 1))
    out = docs.select("doc_id", "held_out", scored(F.col("text"), learn_quality(docs.drop("held_out"), labels)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
