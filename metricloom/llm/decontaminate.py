"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters with a budget of k edits is split into k + 1 pieces: a passage within k edits
of the item holds at least one piece unchanged.  An Aho-Corasick automaton finds exact piece hits in whole
texts, hits on neighbouring diagonals become one window, and Myers' bit-parallel algorithm gives the
smallest edit distance of the item to any passage in the window.  Items of any length take part.  Where
the budget leaves pieces too short to tell anything, the whole text is the window.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, read_table

#: Edits allowed for each character of an item.
ERROR_RATE = 0.06
#: Items whose pieces would be shorter are compared with whole texts instead.
LEAST_PIECE = 3
#: Items are searched for in blocks of so many characters, so that no automaton or closure outgrows a task.
BLOCK_CHARS, BLOCKS_AT_ONCE = 400_000, 4
HITS = "array<struct<item_id: bigint, distance: int, budget: int, start: int, end: int>>"


def normalised(text: str) -> str:
    return " ".join(text.lower().split())


def budget(length: int, rate: float = ERROR_RATE) -> int:
    return int(length * rate + 1e-9)


def whole_words(text: str, start: int, end: int) -> bool:
    """Whether the passage is not cut out of longer words."""
    inside = lambda i: text[i - 1].isalnum() and text[i].isalnum()
    return not (start > 0 and inside(start)) and not (end < len(text) and inside(end))


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """(offset, piece): edits + 1 pieces of nearly equal length."""
    bounds = [len(item) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, item[a:b]) for a, b in zip(bounds, bounds[1:])]


def char_masks(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def closest_end(pattern: str, text: str, masks: dict[str, int] | None = None, anchored: bool = False) -> tuple[int, int]:
    """(distance, end) of the substring of ``text`` nearest to the pattern, the earliest end among equals; anchored ones start at 0."""
    m = len(pattern)
    masks = masks or char_masks(pattern)
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = ph << 1 & full | anchored
        mh = mh << 1 & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


class Searcher:
    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items = [(i, t, budget(len(t), rate)) for i, t in items]
        self.masks: dict[int, dict[str, int]] = {}
        self.unsplit: set[int] = set()
        found: dict[str, list[tuple[int, int]]] = {}
        for nth, (_, text, edits) in enumerate(self.items):
            if edits and len(text) // (edits + 1) < LEAST_PIECE:
                self.unsplit.add(nth)
                continue
            for offset, piece in pieces(text, edits):
                found.setdefault(piece, []).append((nth, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self.automaton.add_word(piece, (len(piece), places))
        if found:
            self.automaton.make_automaton()

    def hits(self, raw: str) -> list[tuple[int, int, int, int, int]]:
        """The nearest passage of every item within its budget: (item id, distance, budget, start, end) in the normalised text.

        Of equally near ones the first; items without a budget count only as whole words.
        """
        text = normalised(raw)
        diagonals: dict[int, set[int]] = {nth: set() for nth in self.unsplit} if text else {}
        for last, (length, places) in self.automaton.iter(text) if len(self.automaton) else ():
            for nth, offset in places:
                diagonals.setdefault(nth, set()).add(last + 1 - length - offset)
        out = []
        for nth, found in sorted(diagonals.items()):
            item_id, item, edits = self.items[nth]
            if not edits:
                start = next((d for d in sorted(found) if whole_words(text, d, d + len(item))), None)
                out += [(item_id, 0, 0, start, start + len(item))] if start is not None else []
                continue
            masks = self.masks.get(nth) or self.masks.setdefault(nth, char_masks(item))
            best = None
            for lo, hi in [(0, len(text))] if nth in self.unsplit else self._windows(sorted(found), edits):
                a = max(0, lo - edits)
                distance, end = closest_end(item, text[a : hi + len(item) + edits], masks)
                if distance <= edits and (best is None or distance < best[0]):
                    best = (distance, a + end)
                    if not distance:
                        break
            if best:
                distance, end = best
                back = text[max(0, end - len(item) - edits) : end][::-1]
                out.append((item_id, distance, edits, end - closest_end(item[::-1], back, anchored=True)[1], end))
        return out

    @staticmethod
    def _windows(diagonals: list[int], edits: int) -> list[tuple[int, int]]:
        out = [[diagonals[0], diagonals[0]]]
        for d in diagonals[1:]:
            if d - out[-1][1] <= 2 * edits:
                out[-1][1] = d
            else:
                out.append([d, d])
        return out


def item_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[list[tuple[int, str]]]:
    """Normalised items in blocks of BLOCK_CHARS; null and blank items hold nothing to search for."""
    block, chars = [], 0
    for row in benchmark.select(F.col(id_col).cast("long"), text_col).where(F.col(text_col).isNotNull()).toLocalIterator():
        text = normalised(row[1])
        if not text:
            continue
        if block and chars + len(text) > BLOCK_CHARS:
            yield block
            block, chars = [], 0
        block.append((row[0], text))
        chars += len(text)
    if block:
        yield block


def _hits_in(items: list[tuple[int, str]], rate: float):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        searcher = Searcher(items, rate)
        for texts in batches:
            yield pd.Series([[dict(zip(("item_id", "distance", "budget", "start", "end"), h)) for h in searcher.hits(t)] if t else [] for t in texts], dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, HITS)


def hits_of(text: Column, blocks: list[list[tuple[int, str]]], rate: float = ERROR_RATE) -> Column:
    """An array of hits for each text; positions are in the text with case and white space normalised."""
    columns = [_hits_in(block, rate)(text) for block in blocks]
    return F.flatten(F.array(*columns)) if columns else F.array().cast(HITS)


def _passes(benchmark: DataFrame) -> Iterator[list[list[tuple[int, str]]]]:
    """Blocks by the number that a task can hold at once."""
    blocks = item_blocks(benchmark)
    while held := list(itertools.islice(blocks, BLOCKS_AT_ONCE)):
        yield held


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row (doc_id, item_id, distance, budget, start, end) for each document and item of which it holds a passage within the budget.

    Null and empty texts have no hits, nor has anything when either table is empty.  Items of any length
    are sought; those too short for an edit (under 17 characters at the default rate) count only as whole
    words.  Of equally near passages the first is reported.  Repeated items are reported each under its id,
    and so are rows that repeat a document's.  Texts of any length are searched whole.  Other columns play
    no part, whatever their names.  A large benchmark takes several passes over the documents.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for blocks in _passes(benchmark):
        part = rows.select("doc_id", F.inline(hits_of(F.col("text"), blocks, rate)))
        out = part if out is None else out.unionByName(part)
    return rows.select("doc_id", F.inline(hits_of(F.col("text"), []))) if out is None else out


def without_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, text_col: str = "text") -> DataFrame:
    """The documents that hold no item, with all their columns; between passes they are written to the shared folder.

    Rows with null and empty texts stay, repeated rows stay or go together, an empty benchmark drops none.
    Items of any length count, those too short for an edit as whole words only; texts of any length are searched whole.
    """
    scratch, passes = Scratch(docs.sparkSession, "decontaminate"), 0
    for blocks in _passes(benchmark):
        docs = scratch.write(docs) if passes else docs
        docs = docs.where(F.size(hits_of(docs[text_col], blocks, rate)) == 0)
        passes += 1
    return docs


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and test item that it holds; clean documents have none."""
    return leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
