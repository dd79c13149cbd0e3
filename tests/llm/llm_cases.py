"""Awkward documents for the operators' tests."""

import datetime as dt
import random

#: Names that the operators use inside, as columns of the input.
CLASHES = {"norm": "x", "head": 1, "hash": None, "salt": 2, "key": "k", "slice": "s", "size": 3, "row": 4, "hits": "h", "mark": "m", "node": 5, "band": 6, "n": 7, "shard": 8, "slot": 9, "copies": 10, "language": "l", "at": dt.datetime(2025, 1, 1)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, norm string, head int, hash string, salt int, key string, slice string, size int, row int, hits string, mark string, node int, band int, n int, shard int, slot int, copies int, language string, at timestamp"


def words(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 7))) for _ in range(n))


def make_docs(spark, texts, sources=None, langs=None):
    """texts: (doc_id, text) pairs; ids and texts may be None and repeat."""
    rows = [(i, t, (langs or {}).get(i), None if sources is None else sources.get(i), None, *CLASHES.values()) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


def odd_texts():
    """Every awkward case: null and empty texts, blanks, ties, repeated rows and ids, null ids, a very long text."""
    base = words(1, 60)
    return [
        (5, base), (3, base), (9, base), (9, base), (4, base.replace(" ", "\t", 3)), (11, base.upper()), (12, None), (13, ""), (14, " \n\t "), (15, "one two"), (16, "one two"), (17, "one  two"),
        (None, base), (None, "lonely words here"), (20, words(2, 40_000)), (21, words(3, 200)), (22, " ".join(words(3, 200).split()[:195])), (23, "x" * 50_000), (24, words(4, 25) + " " + words(4, 25)), (25, "é ü " + words(5, 30)),
        (26, "a b c d"),
    ]
