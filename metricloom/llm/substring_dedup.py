"""Substring dedup: Rabin-Karp hashes of every window of words, counted in Spark.

Two windows that are equal also have the same least hash among the shorter grams inside them.  So a first
pass counts in Spark only these grams, about one in six words: places whose gram occurs once cannot repeat.
Windows in the places that are left, the suspects, are counted in a second pass by 128 bits of Rabin-Karp
hashes (two polynomials over the halves of 128-bit word hashes): among n windows about n**2 / 2**129 pairs
are taken for equal by chance.

Each map task counts its own documents first: of windows equal within the task it sends on only the
earliest, and the others are known repeats at once, so a passage that a third of all documents share costs
one row a task and document.  Spark shuffles and sorts the rest by (hash, document, start); in each run of
equal hashes all but the first are repeats.  Repeats go back by document and merge into maximal intervals,
which are cut from the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, partitions, read_table, text_or_empty
from .words import Windows, WordHashes, WordPairs, mixed

WINDOW = 20
#: A map task compares so many words at a time.
CHUNK_WORDS, ROWS = 4_000_000, 200_000
#: Low bits of a known run's hash column, which hold its length.
LENGTH = (1 << 31) - 1
#: Bits of a gram's hash that the first pass compares.
GRAM_BITS = np.uint64(0xFFFFFFFFFFFFFFFF)


@dataclass(frozen=True)
class Layout:
    """How (hash, doc, start) travels: start and id share one number where both fit, since each byte counts a hundred times the documents.

    Rows with a negative place are runs of known repeats; their length is in the low bits of the hash.
    """

    least: int
    bits: int | None

    def columns(self, hashes: int) -> list[str]:
        return [*[f"h{i}" for i in range(hashes)], "place", *([] if self.bits else ["doc"])]

    def order(self, hashes: int) -> list[str]:
        return [*[f"h{i}" for i in range(hashes)], *([] if self.bits else ["doc"]), "place"]

    def schema(self, hashes: int) -> str:
        return ", ".join(f"{c} long" for c in self.columns(hashes))

    def arrays(self, hashes: list[np.ndarray], d: np.ndarray, p: np.ndarray) -> list[np.ndarray]:
        return [*hashes, (d - self.least) << self.bits | p] if self.bits else [*hashes, p, d]

    def read(self, batch: pa.RecordBatch, hashes: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """Hashes, doc, start and whether a row is a known run."""
        h, place = [batch.column(i).to_numpy() for i in range(hashes)], batch.column(hashes).to_numpy()
        known = place < 0
        place = np.where(known, ~place, place)
        if self.bits:
            return h, (place >> self.bits) + self.least, place & ((1 << self.bits) - 1), known
        return h, batch.column(hashes + 1).to_numpy(), place, known

    def batches(self, hashes: list[np.ndarray], fresh: np.ndarray, runs: tuple[np.ndarray, ...], d: np.ndarray, p: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Rows of the places ``fresh``, and runs (doc, start, length) of known repeats, which go anywhere."""
        doc, start, length = runs
        anywhere = mixed(doc.astype(np.uint64)).view(np.int64) & ~LENGTH | length
        known = self.arrays([anywhere, *[np.zeros(len(doc), np.int64)] * (len(hashes) - 1)], doc, start)
        known[len(hashes)] = ~known[len(hashes)]
        for columns in (self.arrays([h[fresh].view(np.int64) for h in hashes], d[fresh], p[fresh]), known):
            for i in range(0, len(columns[0]), ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + ROWS]) for c in columns], self.columns(len(hashes)))


def layout_for(rows: DataFrame) -> Layout:
    """A text has fewer than 2**30 words; only where that and the ids don't fit one number is the longest text sought."""
    least, most = (x or 0 for x in rows.agg(F.min("doc_id"), F.max("doc_id")).first())
    wide = (most - least).bit_length()
    if wide <= 32:
        return Layout(least, 32 if wide <= 30 else 30)
    bits = ((rows.agg(F.max(F.octet_length("text"))).first()[0] or 0) // 2 + 1).bit_length()  # a word takes two bytes at least
    return Layout(least, bits if wide + bits <= 62 else None)


def gram_size(size: int) -> int:
    return (size + 1) // 2


def least_grams(grams: np.ndarray, reach: int) -> np.ndarray:
    """The places of the first least one among every ``reach`` + 1 neighbouring grams."""
    if len(grams) <= reach:
        return np.zeros(0, np.int64)
    at = np.lib.stride_tricks.sliding_window_view(grams, reach + 1).argmin(axis=1) + np.arange(len(grams) - reach)
    return at[np.append(True, at[1:] != at[:-1])]


def joined_runs(d: np.ndarray, p: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """(doc, start, length) of the maximal runs of [p, end) that touch within a document; rows in order of document and place."""
    if not len(d):
        return d, p, end
    reach = np.maximum.accumulate(end + (np.cumsum(np.append(False, d[1:] != d[:-1])) << 40)) - (np.cumsum(np.append(False, d[1:] != d[:-1])) << 40)
    opens = np.append(True, (d[1:] != d[:-1]) | (p[1:] > reach[:-1]))
    at = np.flatnonzero(opens)
    return d[at], p[at], reach[np.append(at[1:], len(d)) - 1] - p[at]


def in_chunks(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[list[tuple]]:
    """Documents of at least so many words as (id, words, further columns), CHUNK_WORDS or so at a time, by id."""
    docs, held = [], 0
    for batch in batches:
        further = [batch.column(i).to_pylist() for i in range(2, batch.num_columns)]
        for row, (doc, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1))):
            words = text.as_py().split()
            if len(words) >= least:
                docs.append((doc, words, *[f[row] for f in further]))
                held += len(words)
            if held >= CHUNK_WORDS:
                yield sorted(docs, key=lambda x: x[0])
                docs, held = [], 0
    if docs:
        yield sorted(docs, key=lambda x: x[0])


def _map_grams(size: int, layout: Layout):
    """(id, text) -> rows of the layout: least grams seen first in this task, and runs of words around those seen again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = gram_size(size)
        known, windows, reach = WordHashes(), Windows(gram), size - gram
        for docs in in_chunks(batches, size):
            hashes, places = [], []
            for _, words in docs:
                grams = windows.of(known.of(words)) & GRAM_BITS
                places.append(least_grams(grams, reach))
                hashes.append(grams[places[-1]])
            h, p = np.concatenate(hashes), np.concatenate(places)
            d = np.repeat(np.array([x[0] for x in docs], np.int64), [len(x) for x in hashes])
            n = np.repeat(np.array([len(x[1]) for x in docs], np.int64), [len(x) for x in hashes])
            order = np.argsort(h, kind="stable")
            same = h[order[1:]] == h[order[:-1]]
            first, shared = np.zeros(len(h), bool), np.zeros(len(h), bool)
            first[order] = np.append(True, ~same)
            shared[order] = np.append(False, same) | np.append(same, False)
            around = joined_runs(d[shared], np.maximum(p[shared] - reach, 0), np.minimum(p[shared] + size, n[shared]))
            yield from layout.batches([h], first, around, d, p)

    return run


def _shared_places(size: int, layout: Layout):
    """Rows sorted by hash -> (doc, start, length) of the words around every gram that occurs twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach, last, told = size - gram_size(size), None, False  # the last row may go on in the next batch
        for batch in batches:
            (h,), d, p, known = layout.read(batch, 1)
            runs = [(d[known], p[known], h[known] & LENGTH)]
            h, d, p = h[~known], d[~known], p[~known]
            if len(h):
                if last is not None:
                    h, d, p = (np.append(x, y) for x, y in zip(last, (h, d, p)))
                same = h[1:] == h[:-1]
                shared = np.append(False, same) | np.append(same, False)
                last = h[-1], d[-1], p[-1]
                told, was = bool(shared[-1]), told
                if was:
                    shared[0] = False
                start = np.maximum(p[shared] - reach, 0)
                runs.append((d[shared], start, p[shared] + size - start))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(t)) for x, t in zip(zip(*runs), (np.int64, np.int32, np.int32))], ["doc", "start", "length"])

    return run


def _map_windows(size: int, layout: Layout):
    """(id, text, starts, ends) of suspects -> rows of the layout: windows seen first in this task, and runs of words of known repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, windows = WordPairs(), Windows(size)
        for docs in in_chunks(batches, size):
            hashes, ids, places = [[], []], [], []
            for doc, words, starts, ends in docs:
                for a, b in zip(starts, ends):
                    if min(b, len(words)) - a >= size:
                        halves = known.of(words[a:b])
                        for out, half in zip(hashes, halves):
                            out.append(windows.of(np.ascontiguousarray(half)))
                        ids.append(doc)
                        places.append(np.arange(a, a + len(hashes[0][-1]), dtype=np.int64))
            if not ids:
                continue
            h, g, p = (np.concatenate(x) for x in (*hashes, places))
            d = np.repeat(np.array(ids, np.int64), [len(x) for x in places])
            order = np.lexsort((g, h))
            opens = np.append(True, (h[order[1:]] != h[order[:-1]]) | (g[order[1:]] != g[order[:-1]]))
            leader = order[opens][np.cumsum(opens) - 1]
            first, again = np.zeros(len(h), bool), np.zeros(len(h), bool)
            first[order[opens]] = True
            again[order] = ~opens & ((d[order] != d[leader]) | (p[order] != p[leader]))
            yield from layout.batches([h, g], first, joined_runs(d[again], p[again], p[again] + size), d, p)

    return run


def _repeats(size: int, layout: Layout):
    """Rows sorted by (hash, doc, start) -> (doc, start, length) of the words of all windows that are not the first of their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # hash of the run that is open, doc and start of its first window
        for batch in batches:
            (h, g), d, p, known = layout.read(batch, 2)
            runs = [(d[known], p[known], h[known] & LENGTH)]
            h, g, d, p = h[~known], g[~known], d[~known], p[~known]
            if len(h):
                if last is not None:
                    h, g, d, p = (np.append(x, y) for x, y in zip(last, (h, g, d, p)))
                opens = np.append(True, (h[1:] != h[:-1]) | (g[1:] != g[:-1]))
                first = np.flatnonzero(opens)[np.cumsum(opens) - 1]
                again = (d != d[first]) | (p != p[first])
                runs.append((d[again], p[again], np.full(int(again.sum()), size)))
                last = h[-1], g[-1], d[first[-1]], p[first[-1]]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(t)) for x, t in zip(zip(*runs), (np.int64, np.int32, np.int32))], ["doc", "start", "length"])

    return run


def _intervals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (doc, start) -> one row per document with its maximal intervals of words."""

    def merged(d: np.ndarray, p: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        doc, start, length = joined_runs(d, p, p + n)
        fresh = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        offsets = pa.array(np.append(fresh, len(doc)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (start, start + length)]
        return pa.RecordBatch.from_arrays([pa.array(doc[fresh]), *lists], ["doc", "starts", "ends"])

    held: list[tuple[np.ndarray, ...]] = []  # rows of the document that may go on
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(tuple(batch.column(i).to_numpy().astype(np.int64) for i in range(3)))
        if held[-1][0][-1] == held[0][0][0]:
            continue
        d, p, n = (np.concatenate(x) for x in zip(*held))
        cut = int(np.searchsorted(d, d[-1]))
        yield merged(d[:cut], p[:cut], n[:cut])
        held = [(d[cut:], p[cut:], n[cut:])]
    if held:
        yield merged(*(np.concatenate(x) for x in zip(*held)))


def by_document(runs: DataFrame, many: int) -> DataFrame:
    """(doc, start, length) -> one row per document with its maximal intervals."""
    return runs.repartition(many, "doc").sortWithinPartitions("doc", "start").mapInArrow(_intervals, "doc long, starts array<int>, ends array<int>")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts, counts, removed = batch.column(0), [], [], []
        for text, starts, ends in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            words = text.split()
            kept, at = [], 0
            for a, b in zip(starts or (), ends or ()):
                kept += words[at:a]
                at = b
            kept += words[at:]
            texts.append(b" ".join(kept))
            counts.append(len(words))
            removed.append(len(words) - len(kept))
        yield pa.RecordBatch.from_arrays([ids, pa.array(texts, pa.binary()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64())], ["doc_id", "text", "n_words", "n_removed"])


def substring_dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, text (the words kept, one space apart), n_words, n_removed.

    A word goes when a window of ``window`` words covers it whose words also start earlier: in a document
    of smaller id, or earlier in its own.  Words are runs of bytes between ASCII white space.  A null text
    has no words, texts shorter than a window lose none.  Rows with a null id lose nothing and are no
    evidence against others.  Rows that repeat id and text are one document and share its result; if such
    rows differ in text, each loses the places found in any of them.  Texts may be of any length, an empty
    table gives an empty result, and other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    scratch, many = Scratch(spark, "substring-dedup"), partitions(spark)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text_or_empty(docs[text_col]).cast("binary").alias("text"))
    rated = rows.where("doc_id is not null")
    layout = layout_for(rated)
    place = "long, start int, length int"
    grams = rated.mapInArrow(_map_grams(window, layout), layout.schema(1)).repartition(many, "h0").sortWithinPartitions(*layout.order(1))
    suspects = scratch.write(by_document(grams.mapInArrow(_shared_places(window, layout), f"doc {place}"), many))
    suspected = rated.join(suspects, rated["doc_id"] == suspects["doc"]).select("doc_id", "text", "starts", "ends")
    windows = suspected.mapInArrow(_map_windows(window, layout), layout.schema(2)).repartition(many, "h0").sortWithinPartitions(*layout.order(2))
    cuts = scratch.write(by_document(windows.mapInArrow(_repeats(window, layout), f"doc {place}"), many))
    joined = rows.join(cuts, rows["doc_id"] == cuts["doc"], "left").select("doc_id", "text", "starts", "ends")
    return joined.mapInArrow(_cut, "doc_id long, text binary, n_words long, n_removed long").withColumn("text", F.col("text").cast("string"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup(read_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, unnest(range(1, len(words) + 1)) AS p, unnest(words) AS word, words FROM d),
k AS (SELECT doc_id, p, word, CASE WHEN p + 19 <= len(words) THEN array_to_string(list_slice(words, p, p + 19), ' ') END AS k FROM w),
f AS (SELECT doc_id, p, word, k IS NOT NULL AND row_number() OVER (PARTITION BY k ORDER BY doc_id, p) > 1 AS again FROM k),
c AS (SELECT doc_id, p, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM f),
g AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""
