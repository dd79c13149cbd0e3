"""Near-dedup of documents with HyperMinHash sketches.

A document's 5-word shingles are hashed to 64 bits and dealt to 256 buckets; each bucket keeps its least
hash, compressed to a leading-zero count (6 bits) and a mantissa (10 bits).  Empty buckets borrow the
register of another one, found by a fixed permutation, so equal registers stay as likely as the Jaccard
similarity says.  Bands of registers propose pairs, of as many registers as still miss a pair of the least
similarity at most once in a million: 36 bands of 7 for 0.85, 51 of 5 for 0.8.

Equal shingle sets are one class from the start.  In each band bucket every class is first compared with
the bucket's smallest one; similar ones are linked and their components found.  Only buckets that still
hold several components go on, cut by set size: sets are in one size step with those that they may be
linked to, or in neighbouring ones, and only these meet.  There members outside the smallest one's
component meet all others in blocks, bounded by rows and by shingles.  A first pass over the sketches
keeps those that may be linked to another component; a second compares their full sets with matrix
products and returns no more links than join the components.  No pair of a bucket that could link two
components is left out, and pairs never become rows.

Pairs whose similarity, estimated from the registers and corrected for chance collisions, is five
standard deviations too low are dropped; the others are decided on their full shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import Scratch, partitions, read_table, text_or_empty
from .words import Windows, WordHashes, mixed

SHINGLE, PERCENT = 5, 85
BUCKET_BITS, MANTISSA_BITS = 8, 10
BUCKETS = 1 << BUCKET_BITS
DEVIATIONS = 5
#: Chance to miss a pair of exactly the least similarity.
MISSED = 1e-6
#: Members of a bucket that are compared at once and the shingles that they have on average, and columns of a matrix.
BLOCK, BLOCK_SHINGLES, COLUMNS = 512, 1 << 20, 4096


class Sketcher:
    """Shingle sets and HyperMinHash registers of texts."""

    def __init__(self, shingle: int):
        self.shingle, self.known, self.windows = shingle, WordHashes(), Windows(shingle)
        self.bounds = np.arange(BUCKETS, dtype=np.uint64) << np.uint64(64 - BUCKET_BITS)
        order = np.random.Generator(np.random.PCG64(7))
        self.detours = np.stack([order.permutation(BUCKETS) for _ in range(BUCKETS)])

    def shingles(self, text: bytes) -> np.ndarray:
        """Sorted distinct 64-bit hashes."""
        words = text.lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        if len(words) < self.shingle:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], np.uint64)
        h = np.sort(self.windows.of(self.known.of(words)))
        return h[np.append(True, h[1:] != h[:-1])]

    def registers(self, shingles: np.ndarray) -> np.ndarray:
        at = np.searchsorted(shingles, self.bounds)
        filled = at < np.append(at[1:], len(shingles))
        least = shingles[np.minimum(at, len(shingles) - 1)] & np.uint64((1 << (64 - BUCKET_BITS)) - 1)
        fraction, exponent = np.frexp(least.astype(np.float64))
        mantissa = np.maximum(((fraction - 0.5) * (2 << MANTISSA_BITS)).astype(np.int64), 0)
        out = ((64 - BUCKET_BITS - exponent.astype(np.int64)) << MANTISSA_BITS | mantissa).astype(np.uint16)
        if not filled.all():
            empty = np.flatnonzero(~filled)
            detours = self.detours[empty]
            out[empty] = out[detours[np.arange(len(empty)), np.argmax(filled[detours], axis=1)]]
        return out


def _sketches(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(shingle)
        for batch in batches:
            counts, marks, sketches = [], [], []
            for text in batch.column(1):
                shingles = sketcher.shingles(text.as_py())
                counts.append(len(shingles))
                marks.append(xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None)
                sketches.append(sketcher.registers(shingles).tobytes() if len(shingles) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(marks, pa.binary()), pa.array(sketches, pa.binary())], ["doc_id", "n", "mark", "sketch"])

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(shingle)
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([sketcher.shingles(t.as_py()).tobytes() for t in part.column(1)], pa.binary())], ["node", "shingles"])

    return run


def band_shape(percent: int) -> tuple[int, int]:
    """(bands, registers in each): the most registers with which a pair of this similarity is missed with a chance of MISSED at most."""
    missed = lambda width: (1 - (percent / 100) ** width) ** (BUCKETS // width)
    width = max((w for w in range(1, BUCKETS + 1) if missed(w) <= MISSED), default=1)
    return BUCKETS // width, width


def band_keys(registers: np.ndarray, bands: int, width: int) -> np.ndarray:
    """One key for each row and band of registers."""
    factors = mixed(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    salts = mixed(np.arange(1001, 1001 + bands, dtype=np.uint64))
    cut = registers[:, : bands * width].reshape(-1, bands, width).astype(np.uint64) + np.uint64(1)
    return mixed((mixed(cut) * factors).sum(axis=2, dtype=np.uint64) + salts)


def _bands(percent: int):
    bands, width = band_shape(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            registers = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, BUCKETS)
            keys = band_keys(registers, bands, width)
            node, n = (np.repeat(batch.column(i).to_numpy(), bands) for i in (0, 2))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(node), pa.array(n)], ["band", "node", "n"])

    return run


def chance_collisions(n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The share of registers that two unrelated sets of these sizes have equal: both fall in one octave and, within it, on one mantissa."""
    edges = np.append(0.5 ** np.arange(40), 0.0)
    share = lambda n: np.diff(-np.exp(-np.multiply.outer(n / BUCKETS, edges)), axis=1) * -1
    return (share(n_a) * share(n_b)).sum(axis=1) / (1 << MANTISSA_BITS)


def estimated_jaccard(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    chance = chance_collisions(n_a, n_b)
    return np.maximum(((a == b).mean(axis=1) - chance) / (1 - chance), 0)


def _likely(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, BUCKETS) for i in (2, 3))
            n_a, n_b = (batch.column(i).to_numpy().astype(np.float64) for i in (4, 5))
            j = percent / 100
            least = j - DEVIATIONS * np.sqrt(j * (1 - j) / np.minimum(np.minimum(n_a, n_b), BUCKETS))
            yield batch.select([0, 1]).filter(pa.array(estimated_jaccard(a, b, n_a, n_b) >= least))

    return run


def _confirmed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3)):
                a, b = np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)
                both = np.sort(np.concatenate([a, b]))
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(a) + len(b) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def common_shingles(sets: list[np.ndarray]) -> np.ndarray:
    """The matrix of intersection sizes: products of 0/1 columns, one for each shingle that occurs twice."""
    n = len(sets)
    token, at = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    often = np.bincount(at, minlength=len(token))[at] > 1
    at, owner = np.unique(at[often], return_inverse=True)[1], owner[often]
    out = np.zeros((n, n), np.float32)
    for first in range(0, int(at[-1]) + 1 if len(at) else 0, COLUMNS):
        lo, hi = np.searchsorted(at, [first, first + COLUMNS])
        has = np.zeros((n, COLUMNS), np.float32)
        has[owner[lo:hi], at[lo:hi] - first] = 1
        out += has @ has.T
    return out


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of rows with equal first columns; rows come sorted by them."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([batch.column(i).to_numpy() for i in range(keys)])
        bounds = np.flatnonzero(np.concatenate([[True], (k[:, 1:] != k[:, :-1]).any(axis=0), [True]]))
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            key = tuple(k[:, lo])
            if held and key != current:
                yield current, pa.Table.from_batches(held)
                held = []
            current = key
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield current, pa.Table.from_batches(held)


def _hopeful(percent: int):
    """Blocks of (band, step, x, y, node, component, n, sketch) -> (band, node) of those that may be linked to another component there.

    A pair counts in the first band that it shares.
    """
    bands, width = band_shape(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        j = percent / 100
        for (band, *_), rows in _grouped(batches, 4):
            component, n = rows.column(5).to_numpy(), rows.column(6).to_numpy().astype(np.float64)
            if (component == component[0]).all():
                continue
            node = rows.column(4).to_numpy()
            registers = np.frombuffer(b"".join(rows.column(7).to_pylist()), np.uint16).reshape(-1, BUCKETS)
            keys = band_keys(registers, bands, width)
            member = keys.view(np.int64) == band
            inside = member.any(axis=1)  # an id that repeats brings other texts' sketches, which have buckets of their own
            if not inside.any():
                continue
            own = int(np.argmax(member[inside][0]))
            component, n, node, registers, keys = (x[inside] for x in (component, n, node, registers, keys))
            hopeful = np.zeros(len(component), bool)
            least = j - DEVIATIONS * np.sqrt(j * (1 - j) / np.minimum(n, BUCKETS))
            for at in range(0, len(node), 64):
                part = slice(at, at + 64)
                equal = (registers[part, None, :] == registers[None, :, :]).mean(axis=2)
                near = (equal >= np.minimum(least[part, None], least[None, :])) & (component[part, None] != component[None, :])
                near &= (n[part, None] * 100 >= n[None, :] * percent) & (n[None, :] * 100 >= n[part, None] * percent)
                if own and near.any():
                    near &= ~(keys[part, None, :own] == keys[None, :, :own]).any(axis=2)
                hopeful[part] |= near.any(axis=1)
                hopeful |= near.any(axis=0)
            if hopeful.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(int(hopeful.sum()), band)), pa.array(node[hopeful])], ["band", "node"])

    return run


def _spanning(percent: int):
    """Blocks of (band, step, x, y, node, component, shingles) -> links between components, no more than it takes to join them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches, 4):
            nodes, component = rows.column(4).to_numpy(), rows.column(5).to_numpy()
            if (component == component[0]).all():
                continue
            sets = [np.frombuffer(s, np.uint64) for s in rows.column(6).to_pylist()]
            common, n = common_shingles(sets).astype(np.float64), np.array([len(s) for s in sets], np.float64)
            near = 100 * common >= percent * (n[:, None] + n[None, :] - common)
            root = {int(c): int(c) for c in component}

            def top(c: int) -> int:
                while root[c] != c:
                    root[c] = c = root[root[c]]
                return c

            found = []
            for i, j in np.argwhere(np.triu(near & (component[:, None] != component[None, :]))):
                a, b = top(int(component[i])), top(int(component[j]))
                if a != b:
                    root[max(a, b)] = min(a, b)
                    found.append((int(nodes[i]), int(nodes[j])))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    return run


def in_blocks(members: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """Deals (band, node, n, component, outside) to blocks (band, step, x, y) in which every pair of a bucket meets that has a member outside the hub's component and sizes that allow a link.

    Steps of size are so wide that sets of one step can be linked only to those of the same and of the next
    one; a member comes into its own step, and as ``below`` into the step above.  Outsiders make the x
    blocks, all members the y blocks; a step of up to BLOCK rows and BLOCK_SHINGLES is one block.
    """
    step = F.floor(F.log(F.col("n")) / (-math.log(percent / 100) * (1 + 1e-6))).cast("int")
    both = F.array(F.struct(step.alias("step"), F.lit(False).alias("below")), F.struct((step + 1).alias("step"), F.lit(True).alias("below")))
    rows = members.withColumn("in", F.explode(both)).select("band", "in.step", "in.below", "node", "n", "component", "outside")
    large = lambda which: F.greatest(F.sum(which), F.sum(F.col("n") * which) * (BLOCK / BLOCK_SHINGLES))
    blocks = lambda which: F.ceil(large(which) / BLOCK).cast("int")
    sizes = rows.groupBy("band", "step").agg(blocks(F.col("outside").cast("int")).alias("xs"), blocks(F.lit(1)).alias("ys"), F.min("below").alias("only_below"))
    rows = rows.join(scratch.write(sizes.where("xs > 0 and not only_below").drop("only_below")), ["band", "step"])
    x, y = F.pmod(F.xxhash64("node"), F.col("xs")).cast("int"), F.pmod(F.xxhash64("node", F.lit("y")), F.col("ys")).cast("int")
    as_y = F.transform(F.sequence(F.lit(0), F.col("xs") - 1), lambda i: F.struct(i.alias("x"), y.alias("y")))
    as_x = F.transform(F.sequence(F.lit(0), F.col("ys") - 1), lambda i: F.struct(x.alias("x"), i.alias("y")))
    cells = F.when(F.col("outside"), F.array_union(as_y, as_x)).otherwise(as_y)
    return rows.withColumn("cell", F.explode(cells)).select("band", "step", "cell.x", "cell.y", "node", "n", "component")


def by_block(rows: DataFrame, many: int) -> DataFrame:
    return rows.repartition(many, "band", "step", "x", "y").sortWithinPartitions("band", "step", "x", "y")


def near_dedup(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * |A & B| >= ``percent`` * |A | B| for their sets of distinct shingles of
    lower-cased (A-Z) words; fewer words make one shingle.  component_id is the smallest id of the linked
    component, kept says that a document is it.  Documents without words (null or blank texts) and rows
    with a null id are linked with nothing and kept.  Rows that repeat an id are one document in the graph:
    linked with whatever any of their texts is.
    """
    spark = docs.sparkSession
    scratch, many = Scratch(spark, "near-dedup"), partitions(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(docs[text_col]).cast("binary").alias("text"))
    sketches = scratch.write(rows.mapInArrow(_sketches(shingle), "doc_id long, n long, mark binary, sketch binary"))
    # Written, so that joins with it are plain shuffles that Spark can split where a class is large.
    classes = scratch.write(sketches.where("doc_id is not null and n > 0").groupBy("mark").agg(F.min("doc_id").alias("node")))
    members = scratch.write(sketches.select("doc_id", "n", "mark").join(classes, "mark", "left").select("doc_id", "n", "node"))
    nodes = scratch.write(sketches.join(classes, (sketches["mark"] == classes["mark"]) & (sketches["doc_id"] == classes["node"])).select("node", "n", "sketch"))
    scratch.drop(sketches, classes)

    banded = scratch.write(nodes.select("node", "sketch", "n").mapInArrow(_bands(percent), "band long, node long, n long"))
    shared = scratch.write(banded.groupBy("band").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub < last").select("band", "hub"))
    buckets = scratch.write(banded.join(shared, "band"))
    scratch.drop(banded, shared)
    sets = scratch.write(shingle_sets(rows, buckets.select(F.col("node").alias("doc_id")).distinct(), shingle))
    links = verified(buckets.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct(), nodes, sets, percent, scratch)
    first = scratch.write(components(links, scratch))

    # Buckets that still hold several components compare their members in blocks.
    hubs = first.select(F.col("node").alias("hub"), F.col("component").alias("hub_component"))
    placed = buckets.join(first, "node", "left").join(hubs, "hub", "left")
    component = F.coalesce("component", "node")
    placed = scratch.write(placed.select("band", "node", "n", component.alias("component"), (component != F.coalesce("hub_component", "hub")).alias("outside")))
    sketched = in_blocks(placed, scratch, percent).join(nodes, ["node", "n"]).select("band", "step", "x", "y", "node", "component", "n", "sketch")
    hopeful = scratch.write(by_block(sketched, many).mapInArrow(_hopeful(percent), "band long, node long").distinct())
    full = in_blocks(scratch.write(placed.join(hopeful, ["band", "node"], "left_semi")), scratch, percent).join(sets, "node").select("band", "step", "x", "y", "node", "component", "shingles")
    more = scratch.write(by_block(full, many).mapInArrow(_spanning(percent), "a long, b long").distinct())
    scratch.drop(sets, hopeful)
    joined = components(links.unionByName(more), scratch)

    out = members.join(joined, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def shingle_sets(rows: DataFrame, needed: DataFrame, shingle: int) -> DataFrame:
    """(node, shingles) of the documents whose ids are needed; their number grows with the corpus, so they are never broadcast."""
    return rows.join(needed.hint("merge"), "doc_id", "left_semi").mapInArrow(_sets(shingle), "node long, shingles binary")


def verified(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) of nodes whose full shingle sets are similar enough."""
    side = lambda s: nodes.select(F.col("node").alias(s), F.col("sketch").alias(f"sketch_{s}"), F.col("n").alias(f"n_{s}"))
    sketched = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sketch_a", "sketch_b", "n_a", "n_b")
    likely = scratch.write(sketched.mapInArrow(_likely(percent), "a long, b long"))
    side = lambda s: sets.select(F.col("node").alias(s), F.col("shingles").alias(f"set_{s}"))
    full = likely.join(side("a"), "a").join(side("b"), "b").select("a", "b", "set_a", "set_b")
    links = scratch.write(full.mapInArrow(_confirmed(percent), "a long, b long").distinct())
    scratch.drop(likely)
    return links


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(read_table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
p AS (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM d WHERE len(words) > 0),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(list_slice(words, i, i + 4), ' ')) AS h FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS reached FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON r.reached = e.a),
c AS (SELECT node, min(reached) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN c ON c.node = d.doc_id
"""
