from __future__ import annotations

import random

from oracle import assert_matches

from stagegraph.llm import topk_search as s


def test_query_matches_sql(spark, sf_dir):
    assert_matches(s.op7_topk_search, s.OP7_SQL, spark, sf_dir)


def test_ties_repeats_and_few_codes(spark):
    rng = random.Random(2)
    base = rng.getrandbits(63)
    codes = [(i, base) for i in range(30)] + [(100 + i, base ^ (1 << i)) for i in range(40)] + [(7, base), (500, -1)]
    df = spark.createDataFrame(codes, "vec_id long, code long")
    queries = spark.createDataFrame([(0, base), (500, -1)], "vec_id long, code long")
    unique = sorted(set(codes))
    distance = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    for k in (5, 35):
        got = {(r.query_id, r["rank"]): (r.distance, r.vec_id) for r in s.search(df, queries, k).collect()}
        wanted = {(q, n + 1): x for q, c in ((0, base), (500, -1)) for n, x in enumerate(sorted((distance(c, d), v) for v, d in unique)[:k])}
        assert got == wanted


def test_odd_vectors(spark):
    rows = [(0, [1.0, -1.0, None]), (0, [1.0, -1.0, None]), (1, None), (2, []), (None, [1.0]), (20, [1.0, 1.0])]
    codes = s.sign_codes(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert sorted((r.vec_id, r.code) for r in codes.distinct().collect()) == [(0, 1), (20, 3)]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.distance) for r in s.search(codes, codes, 10).collect())
    assert got == [(0, 1, 0, 0), (0, 2, 20, 1), (20, 1, 20, 0), (20, 2, 0, 1)]
