"""Exact, near and substring dedup against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from llm_cases import make_docs, odd_texts, words

from metricloom.llm import exact_dedup, near_dedup, substring_dedup
from metricloom.llm.components import components
from metricloom.llm.shared import Scratch
from metricloom.llm.words import Windows, WordHashes


def exact_brute(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    out = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        kept = [i == keep and ids.index(i) == n for n, i in enumerate(ids)]
        out += [(i, keep, len(ids), k, hashlib.sha256(text.encode()).hexdigest()) for i, k in zip(ids, kept)]
    return out


def order(rows):
    return sorted(rows, key=repr)


def test_exact_dedup_on_odd_rows(odd):
    out = exact_dedup.exact_dedup(odd)
    assert out.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert order(tuple(r) for r in out.collect()) == order(exact_brute(odd_texts()))


def test_exact_dedup_of_a_hot_text(spark):
    rows = [(i, "same  text" if i % 3 else words(i, 5)) for i in range(900, 0, -1)]
    assert order(tuple(r) for r in exact_dedup.exact_dedup(make_docs(spark, rows)).collect()) == order(exact_brute(rows))


def test_salted_runs_of_hot_texts_meet(spark):
    """Several hot texts, one of them only of null ids and one of repeated ids, over many input partitions."""
    rows = [(i if i % 5 else None, ["", "hot one", "hot " * 50, words(2, 9)][i % 4]) for i in range(400)] + [(None, "no id")] * 60 + [(7, "seven")] * 60 + [(900 + i, words(i, 6)) for i in range(50)]
    docs = make_docs(spark, rows).repartition(11)
    hot = exact_dedup.hot_texts(docs, docs["text"], 16, Scratch(spark, "test")).collect()
    assert 4 <= len(hot) <= 64 and any(r["salts"] > 1 for r in hot)
    assert order(tuple(r) for r in exact_dedup.exact_dedup(docs).collect()) == order(exact_brute(rows))


def test_texts_that_share_a_long_head(spark):
    head = "the same head " * 20
    rows = [(i, head + str(i % 40)) for i in range(300, 0, -1)]
    assert order(tuple(r) for r in exact_dedup.exact_dedup(make_docs(spark, rows)).collect()) == order(exact_brute(rows))


def test_neighbours_decide_unless_a_text_is_hot(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    shared = docs.groupBy("text").count().where("count > 1").count()
    hot = exact_dedup.hot_texts(docs, docs["text"], 32, Scratch(spark, "test")).count()
    assert shared > 40 and hot < shared / 4
    plan = exact_dedup.exact_dedup(docs)._jdf.queryExecution().toString()
    assert "pythonudf" not in plan.lower() and "mapinarrow" not in plan.lower()


@pytest.mark.parametrize("operator", (exact_dedup.exact_dedup, near_dedup.near_dedup, substring_dedup.substring_dedup))
def test_empty_tables(empty, operator):
    assert operator(empty).collect() == []


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def near_brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in sets if i is not None}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and i is not None and j is not None and 100 * len(a & b) >= 85 * len(a | b):
                p, q = top(i), top(j)
                root[max(p, q)] = min(p, q)
    return [(i, len(s), None, True) if i is None else (i, len(s), top(i), top(i) == i) for i, s in sets]


def test_near_dedup_on_odd_rows(odd):
    assert order(tuple(r) for r in near_dedup.near_dedup(odd).collect()) == order(near_brute(odd_texts()))


def edited(text, seed, edits):
    draw, w = random.Random(seed), text.split()
    for _ in range(edits):
        w[draw.randrange(len(w))] = f"edit{draw.randrange(10**6)}"
    return " ".join(w)


def test_near_dedup_of_chains_and_groups(spark):
    """A large group of near copies whose members are often under the threshold to each other, small groups, short texts."""
    base = words(7, 150)
    rows = [(i, edited(base, i, i % 5)) for i in range(240)]
    rows += [(1000 + 10 * g + k, edited(words(50 + g, 60 + 7 * g), k, k)) for g in range(20) for k in range(4)]
    rows += [(3000 + i, " ".join(words(99, 14).split()[: 5 + i % 10])) for i in range(30)]
    random.Random(3).shuffle(rows)
    assert order(tuple(r) for r in near_dedup.near_dedup(make_docs(spark, rows)).collect()) == order(near_brute(rows))


def test_blocks_of_a_bucket_cover_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    base = words(8, 150)
    rows = [(i, edited(base, i, 2 + i % 3)) for i in range(150)]
    assert order(tuple(r) for r in near_dedup.near_dedup(make_docs(spark, rows)).collect()) == order(near_brute(rows))


def test_a_family_below_the_threshold_stays_apart(spark, monkeypatch):
    """Documents of one template, of similarity 0.70 to 0.84, of several sizes, with a few true near copies among them."""
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 3000)
    template, rows = words(61, 260).split(), []
    for i in range(140):
        own = words(7000 + i, 30 + i % 20).split()
        size = 150 + 22 * (i % 6)
        rows.append((i, " ".join([*template[:size], *own])))
    rows += [(500 + i, rows[i][1] + " " + words(i, 3)) for i in range(0, 140, 20)] + [(700, rows[3][1]), (701, template[0])]
    sets = [shingles(t) for _, t in rows[:140]]
    close = [len(a & b) / len(a | b) for i, a in enumerate(sets) for b in sets[:i]]
    assert sum(0.7 <= x < 0.85 for x in close) > 1000
    expected = order(near_brute(rows))
    assert order(tuple(r) for r in near_dedup.near_dedup(make_docs(spark, rows)).collect()) == expected and sum(not r[3] for r in expected) > 7


def test_ids_that_repeat_with_other_texts(spark, monkeypatch):
    """An id's texts share its buckets; each is compared where it belongs."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    base, other = words(71, 120), words(72, 400)
    rows = [(i, edited(base, i, i % 4)) for i in range(40)] + [(i, edited(other, i, i % 9)) for i in range(0, 80, 2)] + [(i % 3, words(900 + i, 50)) for i in range(9)]
    assert order(tuple(r) for r in near_dedup.near_dedup(make_docs(spark, rows)).collect()) == order(near_brute(rows))


def test_sizes_that_allow_a_link_are_at_most_one_step_apart(spark):
    from pyspark.sql import functions as F

    for percent in (80, 85, 90):
        pairs = [(a, b) for b in range(1, 400) for a in range(-(-b * percent // 100), b + 1)]
        nodes = spark.createDataFrame([(1, 1000 * a + b, n, 0, True) for a, b in pairs[:: 7] + [p for p in pairs if 100 * p[0] == percent * p[1]] for n in {a, b}], "band long, node long, n long, component long, outside boolean").distinct()
        steps = near_dedup.in_blocks(nodes, Scratch(spark, "test"), percent).groupBy("node", "n").agg(F.collect_set("step").alias("steps")).collect()
        by = {}
        for r in steps:
            by.setdefault(r["node"], []).append(set(r["steps"]))
        assert by and all(set.intersection(*found) for found in by.values())


def test_registers_estimate_jaccard():
    sketcher = near_dedup.Sketcher(5)
    for n in (40, 400, 4000):
        tokens = words(n, 2 * n).split()
        a, b = (sketcher.shingles(" ".join(tokens[i : i + n]).encode()) for i in (0, n // 10))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        found = near_dedup.estimated_jaccard(sketcher.registers(a)[None], sketcher.registers(b)[None], np.array([len(a)]), np.array([len(b)]))[0]
        assert abs(found - true) < 0.12
    a, b = (sketcher.shingles(words(s, 3000).encode()) for s in (1, 2))
    assert near_dedup.estimated_jaccard(sketcher.registers(a)[None], sketcher.registers(b)[None], np.array([len(a)]), np.array([len(b)]))[0] < 0.03


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (500, 400), (400, 300)]
    out = components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "test"))
    found = dict(out.collect())
    assert found == {i: 1 for i in range(2, 41)} | {100 + i: 100 for i in range(1, 60)} | {500: 300, 400: 300}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "test")).collect() == []


def substring_brute(rows, size):
    seen = {}
    unique = {(i, t) for i, t in rows if i is not None}
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    for i, t in unique:
        w = split(t)
        for p in range(len(w) - size + 1):
            k = tuple(w[p : p + size])
            seen[k] = min(seen.get(k, (i, p)), (i, p))
    out = []
    for i, t in rows:
        w, gone = split(t), set()
        for p in range(len(w) - size + 1):
            if i is not None and seen[tuple(w[p : p + size])] < (i, p):
                gone |= set(range(p, p + size))
        out.append((i, " ".join(x for n, x in enumerate(w) if n not in gone), len(w), len(gone)))
    return out


def test_substring_dedup_on_odd_rows(odd):
    assert order(tuple(r) for r in substring_dedup.substring_dedup(odd).collect()) == order(substring_brute(odd_texts(), 20))


@pytest.mark.parametrize("chunk", (50, 4_000_000))
def test_substring_dedup_with_a_shared_passage(spark, monkeypatch, chunk):
    monkeypatch.setattr(substring_dedup, "CHUNK_WORDS", chunk)
    passage, loop = words(31, 30), " ".join(["la"] * 45)
    rows = [(i, f"{words(i, i % 40)} {passage if i % 3 else ''} {words(i, i % 40)} {loop if i % 7 == 0 else ''}") for i in range(120)]
    assert order(tuple(r) for r in substring_dedup.substring_dedup(make_docs(spark, rows)).collect()) == order(substring_brute(rows, 20))


def test_ids_too_far_apart_to_share_a_number_with_places(spark):
    far = 1 << 62
    rows = [(i * 7 - far if i % 2 else far - i, f"{words(i % 9, 25)} {words(i, 12)} {words(i % 9, 25)}") for i in range(40)]
    docs = make_docs(spark, rows)
    typed = docs.select("doc_id", docs["text"].cast("binary").alias("text"))
    assert substring_dedup.layout_for(typed).bits is None and substring_dedup.layout_for(typed.where("doc_id < 0 and doc_id > -1000")).bits
    assert order(tuple(r) for r in substring_dedup.substring_dedup(docs).collect()) == order(substring_brute(rows, 20))


@pytest.mark.parametrize("size", (1, 2, 3, 20))
def test_substring_dedup_with_a_weak_first_hash(spark, monkeypatch, size):
    """Where most grams of the first pass collide the second one decides; few words, so that windows repeat often."""
    monkeypatch.setattr(substring_dedup, "GRAM_BITS", np.uint64(0x3F))
    rows = [(i, " ".join(random.Random(i % 60).choices("ab" if size == 20 else "abcdefgh", k=5 + i % 70))) for i in range(150)]
    out = substring_dedup.substring_dedup(make_docs(spark, rows).repartition(6), size)
    assert order(tuple(r) for r in out.collect()) == order(substring_brute(rows, size))


def test_equal_windows_have_the_same_least_gram():
    known, windows = WordHashes(), Windows(10)
    w, loop = words(5, 300).encode().split(), b"la li lu".split() * 30
    for text, other in ((w, w[:3] + w[40:75] + w[:5]), (loop, w[:7] + loop[2:40])):
        found = [set(substring_dedup.least_grams(windows.of(known.of(t)), 10).tolist()) for t in (text, other)]
        grams = [windows.of(known.of(t)) for t in (text, other)]
        for i in range(len(text) - 19):
            for j in range(len(other) - 19):
                if text[i : i + 20] == other[j : j + 20]:
                    assert any(i <= p <= i + 10 and (j + p - i) in found[1] and grams[0][p] == grams[1][j + p - i] for p in found[0])


def test_window_hashes_depend_on_the_words_alone():
    known, windows = WordHashes(), Windows(3)
    w = words(1, 500).encode().split()
    h = windows.of(known.of(w))
    assert len(h) == 498 and all(windows.of(known.of(w[i : i + 3]))[0] == h[i] for i in range(0, 498, 50))
    assert len(windows.of(known.of(w[:2]))) == 0
