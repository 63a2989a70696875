"""SimHash near-dedup: fingerprints meet in the shards of a vantage-point tree, and linked ones form components.

1. ``fingerprints``: 64 bits a document, each the majority of that bit over the XXH64 hashes of its word shingles.
2. Distinct fingerprints are dealt by a vantage-point tree. Its vantage points and radii are fitted on a bounded sample (at most
   ``SAMPLE`` fingerprints); every fingerprint is then indexed. A node sends a fingerprint inwards if its Hamming distance to the
   vantage point is at most the radius. For a search of ``bits``, the triangle inequality leaves out a side unless the distance lies
   within ``bits`` of its boundary; so a fingerprint visits its own shard and those whose boundary its ball crosses.
3. In a shard, rings of equal distance around further vantage points prune in the same way, and what is left is compared exactly. A
   shard returns a spanning forest of its links, never all pairs of a dense group.
4. ``components`` joins the forests.

A shard with more work than ``WORK`` comparisons is salted: its own fingerprints go to each salt, its visitors to one.

Defined cases: a null or empty text, or one of white space, has fingerprint zero, which links like any other; a text of fewer words
than a shingle is one shingle; rows that repeat a doc_id each have a row in the result; a null doc_id keeps its row and is no
component's id; further columns are ignored.

Cost: Hamming balls around random 64-bit codes overlap widely, so the visits grow faster than the corpus (see the README).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagegraph.llm.common import arrow_schema, pieces, record, table, utf8, written
from stagegraph.llm.components import components

CAPACITY = 1 << 14  # fingerprints of a shard
SAMPLE = 1 << 16  # fingerprints that the tree is fitted on, at most
WORK = 1 << 34  # comparisons of a task before pruning
WIDE = {"capacity": 1 << 16, "work": 1 << 33}  # for links so wide that the tree hardly prunes: larger shards, fewer copies
BLOCK = 1 << 20
HALF_CHUNK = 1 << 15
SLOTS = 128
MULTIPLIERS = np.random.default_rng(11).integers(0, 1 << 63, SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: bytes, k: int = 4, seed: int = 42) -> np.ndarray:
    """XXH64 of the word shingles, repeats included; of the whole sequence if it is shorter."""
    words = text.lower().split()  # ASCII: A-Z and the six blanks
    if not words:
        return np.zeros(0, dtype="<u8")
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(k, len(words))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], dtype="<u8")


def simhash(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), HALF_CHUNK):
        ones += np.unpackbits(hashes[i : i + HALF_CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def sketch(hashes: np.ndarray) -> bytes:
    """The low byte of the least shingle under each of SLOTS multipliers: the share of equal bytes estimates the Jaccard similarity."""
    least = np.full(SLOTS, ~np.uint64(0))
    for i in range(0, len(hashes), 1024):
        np.minimum(least, (hashes[i : i + 1024, None] * MULTIPLIERS[None, :]).min(axis=0), out=least)
    return (least & np.uint64(0xFF)).astype(np.uint8).tobytes()


def fingerprints(docs: DataFrame, k: int = 4, sketches: bool = False) -> DataFrame:
    """(doc_id, fp long, sketch binary) of each row; fp holds the 64 bits as a signed long, sketch is empty unless asked for."""
    shape = "doc_id long, fp long, sketch binary"
    target = arrow_schema(docs.sparkSession, shape)

    def run(batches):
        for batch in pieces(batches):
            prints, made = [], []
            for t in utf8(batch.column("text").to_pylist()):
                hashes = shingle_hashes(t, k)
                prints.append(simhash(hashes))
                made.append(sketch(hashes) if sketches else b"")
            yield record({"doc_id": batch.column("doc_id"), "fp": np.array(prints, dtype=np.uint64).view(np.int64), "sketch": made}, target)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, shape)


def distance(a, b) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


class VantageTree:
    """A complete binary tree of ``depth`` levels in two arrays; node i has the children 2i (inside) and 2i + 1."""

    def __init__(self, sample: np.ndarray, depth: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.depth = depth
        self.vantage = np.zeros(1 << depth, dtype=np.uint64)
        self.radius = np.full(1 << depth, 32, dtype=np.int16)
        self._fit(sample, 1, 0, rng)

    def _fit(self, points: np.ndarray, node: int, level: int, rng) -> None:
        if level == self.depth:
            return
        if len(points) == 0:
            points = rng.integers(0, 1 << 63, 2, dtype=np.uint64)
        tried = rng.choice(points, size=min(8, len(points)), replace=False)
        spread = [distance(points, v).std() for v in tried]
        self.vantage[node] = tried[int(np.argmax(spread))]
        far = distance(points, self.vantage[node])
        self.radius[node] = int(np.median(far))
        self._fit(points[far <= self.radius[node]], 2 * node, level + 1, rng)
        self._fit(points[far > self.radius[node]], 2 * node + 1, level + 1, rng)

    def home(self, points: np.ndarray) -> np.ndarray:
        node = np.ones(len(points), dtype=np.int64)
        for _ in range(self.depth):
            node = 2 * node + (distance(points, self.vantage[node]) > self.radius[node])
        return node - (1 << self.depth)

    def visits(self, points: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of point, leaf) for each leaf that a ball of ``bits`` around the point can reach."""
        at, node = np.arange(len(points)), np.ones(len(points), dtype=np.int64)
        for _ in range(self.depth):
            gap = distance(points[at], self.vantage[node]) - self.radius[node]
            inside, outside = gap - bits <= 0, gap + bits > 0
            at, node = np.concatenate((at[inside], at[outside])), np.concatenate((2 * node[inside], 2 * node[outside] + 1))
        return at, node - (1 << self.depth)


class Forest:
    """Union of index pairs, each a whole array at a time."""

    def __init__(self, n: int):
        self.parent = np.arange(n)
        self.open: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self.open.append((a, b))
            self.held += len(a)
            if self.held > BLOCK:
                self.settle()

    def settle(self) -> np.ndarray:
        if self.open:
            a, b = (np.concatenate(x) for x in zip(*self.open, strict=True))
            self.open, self.held, parent = [], 0, self.parent
            while True:
                x, y = parent[a], parent[b]
                apart = x != y
                if not apart.any():
                    break
                a, b, x, y = a[apart], b[apart], x[apart], y[apart]
                np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
                while not np.array_equal(up := parent[parent], parent):
                    parent = up
            self.parent = parent
        return self.parent


def link(codes: np.ndarray, points: np.ndarray, queries: np.ndarray, bits: int, forest: Forest, level: int = 0, sketches: np.ndarray | None = None, least: int = 0) -> None:
    """Add to ``forest`` the links of at most ``bits`` between two index arrays into ``codes``; with ``sketches``, those that agree in
    ``least`` slots too."""
    if not len(points) or not len(queries):
        return
    if len(points) * len(queries) > BLOCK and level < 4:
        vantage = codes[points[len(points) // 2]]
        far_p, far_q = distance(codes[points], vantage), distance(codes[queries], vantage)
        order_p, order_q = np.argsort(far_p, kind="stable"), np.argsort(far_q, kind="stable")
        points, queries, far_p, far_q = points[order_p], queries[order_q], far_p[order_p], far_q[order_q]
        rings, starts = np.unique(far_p, return_index=True)
        lows, highs = np.searchsorted(far_q, rings - bits), np.searchsorted(far_q, rings + bits, side="right")
        if len(rings) > 1:
            for a, b, lo, hi in zip(starts, [*starts[1:], len(points)], lows, highs, strict=True):
                link(codes, points[a:b], queries[lo:hi], bits, forest, level + 1, sketches, least)
            return
    step = max(1, BLOCK // len(points))
    mine = codes[points]
    for i in range(0, len(queries), step):
        some = queries[i : i + step]
        x, y = np.nonzero(np.bitwise_count(codes[some][:, None] ^ mine[None, :]) <= bits)
        x, y = some[x], points[y]
        if sketches is None:
            apart = x != y
            forest.add(x[apart], y[apart])
            continue
        for j in range(0, len(x), 1 << 15):
            a, b = x[j : j + (1 << 15)], y[j : j + (1 << 15)]
            apart = forest.parent[a] != forest.parent[b]  # what is joined already needs no look
            a, b = a[apart], b[apart]
            same = (sketches[a] == sketches[b]).sum(axis=1) >= least
            forest.add(a[same], b[same])
            forest.settle()


ROUTED = "leaf int, salt int, node long, fp long, sketch binary, home boolean"


def links(points: DataFrame, bits: int = 4, similarity: float | None = None, capacity: int = CAPACITY, sample: int = SAMPLE, work: int = WORK) -> DataFrame:
    """(a, b): edges that connect the nodes of ``points(node, fp, sketch)`` whose fingerprints differ in at most ``bits`` bits and, if
    ``similarity`` is given, whose sketches agree in that share of slots."""
    spark = points.sparkSession
    depth = int(np.clip(np.ceil(np.log2(max(1, points.count()) / capacity)), 0, 16))
    seen = points.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(min(sample, 128 << depth)).collect()
    fitted = spark.sparkContext.broadcast(VantageTree(np.array([r.fp for r in seen], dtype=np.int64).view(np.uint64), depth))

    def routed(batch):
        codes, tree = batch.column("fp").to_numpy().view(np.uint64), fitted.value
        home = tree.home(codes)
        at, leaf = tree.visits(codes, bits)
        at, leaf = at[keep := leaf >= home[at]], leaf[keep]  # a pair is met from the side of the lesser leaf
        return at, codes[at], leaf, leaf == home[at]

    def loads(batches):
        for batch in batches:
            _, _, leaf, home = routed(batch)
            found, place = np.unique(leaf, return_inverse=True)
            yield record({"leaf": found, "own": np.bincount(place, weights=home).astype(np.int64), "all": np.bincount(place)}, shape)

    shape = arrow_schema(spark, "leaf int, own long, all long")
    per_leaf = points.select("fp").mapInArrow(loads, "leaf int, own long, all long").groupBy("leaf").agg(F.sum("own").alias("own"), F.sum("all").alias("all")).collect()  # at most 2**16 rows
    salts = np.ones(1 << depth, dtype=np.int64)
    for r in per_leaf:
        salts[r.leaf] = max(1, -(-r.own * r["all"] // work))
    salting = spark.sparkContext.broadcast(salts)
    target = arrow_schema(spark, ROUTED)

    def deal(batches):
        for batch in batches:
            at, codes, leaf, home = routed(batch)
            n = salting.value[leaf]
            salt = ((codes ^ (codes >> np.uint64(29))) % n.astype(np.uint64)).astype(np.int64)
            copies = np.where(home, n, 1)
            every = np.repeat(np.arange(len(codes)), copies)
            of = np.arange(len(every)) - np.repeat(np.cumsum(copies) - copies, copies)
            own = home[every]
            turn = np.where(own, of, salt[every])
            row = at[every]
            yield record({"leaf": leaf[every], "salt": turn, "node": batch.column("node").take(pa.array(row)), "fp": codes[every].view(np.int64), "sketch": batch.column("sketch").take(pa.array(row)), "home": own}, target)

    edge = arrow_schema(spark, "a long, b long")

    def shard(t):
        codes, home, turn = t.column("fp").to_numpy().view(np.uint64), t.column("home").to_numpy(zero_copy_only=False), t.column("salt")[0].as_py()
        leaf = t.column("leaf")[0].as_py()
        n = int(salting.value[leaf])
        node = t.column("node").to_numpy()
        order = np.lexsort((node, codes))  # results don't depend on how rows arrive
        codes, home, node = codes[order], home[order], node[order]
        sketches = None if similarity is None else np.frombuffer(b"".join(t.column("sketch").to_pylist()), dtype=np.uint8).reshape(len(codes), SLOTS)[order]
        mine = ((codes ^ (codes >> np.uint64(29))) % np.uint64(n)).astype(np.int64) == turn
        forest = Forest(len(codes))
        link(codes, np.flatnonzero(home), np.flatnonzero(mine | ~home), bits, forest, 0, sketches, int(np.ceil((similarity or 0) * SLOTS)))
        parent = forest.settle()
        tied = np.flatnonzero(parent != np.arange(len(parent)))
        return pa.Table.from_batches([record({"a": node[tied], "b": node[parent[tied]]}, edge)])

    return points.select("node", "fp", "sketch").mapInArrow(deal, ROUTED).groupBy("leaf", "salt").applyInArrow(shard, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 4, bits: int = 4, similarity: float | None = None) -> DataFrame:
    """(doc_id, fp, component_id) of each row of docs. With ``similarity``, links within ``bits`` also need that estimated Jaccard
    similarity of their shingle sets (from SLOTS minima: its standard error at 0.8 is 0.035)."""
    node = F.col("fp") if similarity is None else F.xxhash64("fp", "sketch")
    prints = written(fingerprints(docs, k, similarity is not None).withColumn("node", node))
    points = written(prints.groupBy("node", "fp", "sketch").agg(F.min("doc_id").alias("first_doc")))
    stars = components(links(points, bits, similarity, **({} if similarity is None else WIDE)))
    tied = stars.join(points.select(F.col("node"), "first_doc"), "node")
    least = tied.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    linked = tied.join(least, "root").select("node", "component_id")
    every = points.select("node", "first_doc").join(linked, "node", "left").select("node", F.coalesce("component_id", "first_doc").alias("component_id"))
    return prints.join(every, "node").select("doc_id", "fp", "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
