"""The corpus pipeline against brute force on a small corpus."""

import random

import pytest
from llm_cases import words
from test_dedup import near_brute, shingles
from test_rest import distance_brute, feasible

import corpus_pipeline
from metricloom.llm import decontaminate, mixing, near_dedup

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    draw, rows = random.Random(4), []
    for i in range(150):
        base = words(i % 110, 80 + i % 110 % 25).split()
        for _ in range(i // 110):
            base[draw.randrange(len(base))] = "zz"
        text = " ".join(base)
        if i % 17 == 0:
            text = words(900 + i % 3, 25).replace("a", "b", 1) + " " + text
        rows.append((i, text, "xx", f"s{i % 5}" if i % 9 else None, len(text)))
    rows += [(200, "12345 ...", None, "s1", 9), (201, None, None, "s1", None), (202, "", "xx", "s2", 0), (203, rows[3][1], "xx", "s3", 5), (204, rows[3][1], "xx", "s4", 5), (None, "no id at all but words", "xx", "s1", 5)]
    return rows


ITEMS = [(i, words(900 + i, 25)) for i in range(3)]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(corpus(), COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append(docs.collect())
    return folder, out


def pairs(rows):
    return sorted(((r["doc_id"], r["text"]) for r in rows), key=repr)


def test_stages_in_order(stages):
    folder, (spoken, single, clean, mixed, placed) = stages
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "mixing", "sharding"]
    rows = [(r[0], r[1]) for r in corpus()]
    spoken_brute = [(i, t) for i, t in rows if any(c.isalpha() for c in t or "")]
    assert pairs(spoken) == sorted(spoken_brute, key=repr)
    keep = {i for i, _, _, kept in near_brute(spoken_brute) if kept}
    single_brute = [(i, t) for i, t in spoken_brute if i in keep]
    assert pairs(single) == sorted(single_brute, key=repr) and len(single_brute) < len(spoken_brute) - 20
    items = [decontaminate.normalised(t) for _, t in ITEMS]
    clean_brute = [(i, t) for i, t in single_brute if not any(distance_brute(x, decontaminate.normalised(t)) <= decontaminate.budget(len(x)) for x in items)]
    assert pairs(clean) == sorted(clean_brute, key=repr) and len(clean_brute) < len(single_brute)


def test_mix_takes_what_the_weights_say(stages):
    _, (_, _, clean, mixed, _) = stages
    size = lambda r: len((r["text"] or "").split())
    sources = sorted({r["source"] for r in clean}, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(sources)}
    have = {s: sum(size(r) for r in clean if r["source"] == s) for s in sources}
    total, target = sum(have.values()), {}
    while True:  # stop targets one after the other and share the rest again
        left = total - sum(target.values())
        open_ = [s for s in sources if s not in target]
        shares = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = [s for s in open_ if shares[s] > mixing.CAP * have[s]]
        if not above:
            target |= shares
            break
        target |= {s: mixing.CAP * have[s] for s in above}
    longest = max(size(r) for r in clean)
    for s in sources:
        assert abs(sum(size(r) for r in mixed if r["source"] == s) - target[s]) <= longest
    copies = {}
    for r in mixed:
        copies[(r["doc_id"], r["text"])] = copies.get((r["doc_id"], r["text"]), 0) + 1
    assert set(copies) <= {(r["doc_id"], r["text"]) for r in clean} and max(copies.values()) <= mixing.CAP


def test_shards_hold_everything_evenly(stages):
    _, (_, _, _, mixed, placed) = stages
    assert pairs(placed) == pairs(mixed)
    where, groups = {}, {}
    for r in placed:
        where.setdefault(r["text"], set()).add(r["shard"])
        groups[r["text"]] = groups.get(r["text"], 0) + len(r["text"].encode()) + 16
    assert all(len(s) == 1 for s in where.values())
    for shard in {r["shard"] for r in placed}:
        assert sorted(r["slot"] for r in placed if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in placed)))
    heaviest = max(sum(len(r["text"].encode()) + 16 for r in placed if r["shard"] == s) for s in range(40))
    assert heaviest <= sum(groups.values()) / 40 + max(groups.values()) and feasible([1, 2, 3], 2, 3)


def test_run_gives_the_last_stage(spark, stages):
    folder, (*_, placed) = stages
    key = lambda rows: sorted((repr(r["doc_id"]), r["shard"], r["slot"]) for r in rows)
    assert key(corpus_pipeline.run(spark, folder).collect()) == key(placed)


DOCUMENT = "doc_id long, text string"


def test_near_copies_of_similarity_0_8_go(spark, tmp_path):
    """Pairs on both sides of 0.8, of them many in [0.80, 0.85)."""
    rows, left = [], set()
    for i in range(60):
        base = words(2000 + i, 84).split()  # 80 shingles; one word replaced costs five of them, each next one one more
        near = [f"new{i}w{n}" if n in (10, 11, 12, 13, 14)[: i % 6] else w for n, w in enumerate(base)]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(near))]
        a, b = shingles(rows[-2][1]), shingles(rows[-1][1])
        left |= {2 * i} if 100 * len(a & b) >= 80 * len(a | b) else {2 * i, 2 * i + 1}
    similar = [len(shingles(a[1]) & shingles(b[1])) / len(shingles(a[1]) | shingles(b[1])) for a, b in zip(rows[::2], rows[1::2])]
    assert sum(0.8 <= s < 0.85 for s in similar) >= 10 and sum(0.7 < s < 0.8 for s in similar) >= 5
    kept = corpus_pipeline.one_of_near_copies(spark, spark.createDataFrame(rows, DOCUMENT), "")
    assert {r["doc_id"] for r in kept.collect()} == left


def clashing(spark, rows):
    """Documents with columns called as the stages might call theirs."""
    extra = ("_copies", "_copy", "_nth", "_language", "copies", "copy", "nth", "language", "row", "shard", "Slot", "shard_", "key", "size", "band", "node", "at", "component_id", "kept")
    typed = f"{COLUMNS}, " + ", ".join(f"`{c}` string" for c in extra)
    return spark.createDataFrame([(*r, *extra) for r in rows], typed), extra


LONG = " ".join(f"{words(s, 2_000)}" for s in range(3000, 3020))
ODD = [
    (1, words(1, 30), "xx", "s1", 1), (1, words(1, 30), "xx", "s1", 1), (2, words(1, 30), None, None, None), (3, None, "xx", "s1", 0), (4, "", None, "s2", 0), (5, " \n ", "xx", "s1", 0), (6, LONG, "xx", "s2", 9),
    (None, words(1, 30), "xx", "s1", 1), (None, None, None, None, None), (7, LONG + " more", "xx", "s2", 9), (8, "12 34", "xx", "s1", 2), (9, "short", "xx", None, 1),
]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_odd_rows_and_clashing_columns(spark, tmp_path, name, stage):
    spark.createDataFrame([(1, words(77, 30)), (None, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, extra = clashing(spark, ODD)
    out = stage(spark, docs, str(tmp_path))
    rows = out.collect()
    if name == "sharding":
        assert out.columns[:5] == docs.columns[:5] and out.columns[-2:] == ["shard", "slot"] and len(out.columns) == len(docs.columns) + 2 == len({c.lower() for c in out.columns})
        assert {r["shard__"] for r in rows} == {"shard"} and {r["Slot_"] for r in rows} == {"Slot"} and {r["shard_"] for r in rows} == {"shard_"}
    else:
        assert out.columns == docs.columns and all(r[c] == c for r in rows for c in extra)
    kept = sorted(((r["doc_id"], r["text"]) for r in rows), key=repr)
    whole = [r[:2] for r in ODD]
    expected = {
        "language_id": [r for r in whole if any(c.isalpha() for c in r[1] or "")],
        "near_dedup": [(1, words(1, 30)), (3, None), (4, ""), (5, " \n "), (6, LONG), (None, words(1, 30)), (None, None), (8, "12 34"), (9, "short")],
        "decontamination": whole, "sharding": whole,
    }
    if name in expected:
        assert kept == sorted(expected[name], key=repr)
    else:
        assert set(kept) <= set(whole) and kept


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_an_empty_table(spark, tmp_path, name, stage):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = stage(spark, spark.createDataFrame([], COLUMNS), str(tmp_path))
    assert out.collect() == [] and [c for c in out.columns if c not in ("shard", "slot")] == ["doc_id", "text", "lang", "source", "n_chars"]


def test_run_leaves_only_its_result_behind(spark, stages):
    import os

    from metricloom.llm.shared import scratch_root

    folder, root = stages[0], scratch_root(spark).removeprefix("file://")
    before = set(os.listdir(root))
    out = corpus_pipeline.run(spark, folder)
    left = set(os.listdir(root)) - before
    assert len(left) == 1 and len([x for x in os.listdir(f"{root}/{left.pop()}") if not x.startswith(".")]) == 1 and out.count() > 0


def test_bands_miss_one_pair_in_a_million():
    assert near_dedup.band_shape(85) == (36, 7)
    for percent in (70, 80, 85, 90):
        bands, width = near_dedup.band_shape(percent)
        assert bands * width <= near_dedup.BUCKETS and (1 - (percent / 100) ** width) ** bands <= near_dedup.MISSED
