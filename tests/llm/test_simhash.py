from __future__ import annotations

import numpy as np
import xxhash
from cases import frame, rows

from stagegraph.llm import simhash
from stagegraph.llm.components import components


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints, bits=4):
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, p in enumerate(prints):
        for j in range(i):
            if (p ^ prints[j]).bit_count() <= bits:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(prints))]


def test_rows_by_brute_force(spark):
    docs = rows()
    prints = [brute_print(r[1]) for r in docs]
    groups = brute_groups(prints)
    least = {g: min((r[0] for r, x in zip(docs, groups, strict=True) if x == g and r[0] is not None), default=None) for g in groups}
    wanted = sorted((repr(r[0]), p, repr(least[g])) for r, p, g in zip(docs, prints, groups, strict=True))
    got = simhash.near_duplicates(frame(spark)).collect()
    assert sorted((repr(r.doc_id), r.fp & (2**64 - 1), repr(r.component_id)) for r in got) == wanted


def test_empty_table(spark):
    assert simhash.near_duplicates(frame(spark, [])).collect() == []


def test_deep_salted_tree_finds_every_link(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    near = base[:150] ^ (np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64))
    ball = base[0] ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))  # a dense group
    codes = np.unique(np.concatenate((base, near, ball)))
    points = spark.createDataFrame([(int(x),) for x in codes.view(np.int64)], "fp long").selectExpr("fp AS node", "fp", "binary('') AS sketch")
    stars = components(simhash.links(points, 4, capacity=16, work=1 << 8)).collect()
    root = {r.node: r.root for r in stars}
    groups = brute_groups([int(c) for c in codes])
    signed = codes.view(np.int64).tolist()
    members = {}
    for s, g in zip(signed, groups, strict=True):
        members.setdefault(g, []).append(s)
    assert root == {s: min(m) for m in members.values() if len(m) > 1 for s in m}


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}


def test_similar_texts_by_sketches(spark):
    import random

    rng = random.Random(5)
    base = [[f"w{rng.randrange(5000)}" for _ in range(200)] for _ in range(40)]
    docs = [(i, " ".join(w)) for i, w in enumerate(base)]
    for i, w in enumerate(base[:30]):  # one changed word: similarity 0.95; a third changed: far below
        docs.append((100 + i, " ".join([*w[:100], "changed", *w[101:]])))
        docs.append((200 + i, " ".join([f"x{j}" if j % 3 == 0 else x for j, x in enumerate(w)])))
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 5, 18, 0.77).collect()}
    assert got == {d: d % 100 if 100 <= d < 200 else d for d, _ in docs}
