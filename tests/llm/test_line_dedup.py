from __future__ import annotations

from collections import defaultdict

import numpy as np
from cases import frame, rows
from oracle import assert_matches
from pyspark.sql import functions as F

from stagegraph.llm import line_dedup


def key_of(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(line_dedup.SPACE))


def brute(docs, min_docs=5, min_chars=40):
    ident = lambda d: -(2**63) if d is None else d
    holders = defaultdict(set)
    for d, t, *_ in docs:
        for k in {key_of(x) for x in (t or "").split("\n")}:
            if len(k) >= min_chars:
                holders[k].add(ident(d))
    top = {k: max(v) for k, v in holders.items() if len(v) >= min_docs}
    for d, t, *_ in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if top.get(key_of(x), ident(d)) == ident(d)]
        yield repr(d), "\n".join(kept), len(lines), len(lines) - len(kept)


def found(docs):
    return sorted((repr(r.doc_id), r.text, r.n_lines, r.n_dropped) for r in line_dedup.cleaned(docs).select("row.doc_id", "text", "n_lines", "n_dropped").collect())


def test_by_brute_force_with_other_columns(spark):
    assert found(frame(spark)) == sorted(brute(rows()))
    got = line_dedup.drop_lines(frame(spark))
    assert got.columns == frame(spark).columns
    assert sorted((repr(r.doc_id), r.text) for r in got.collect()) == sorted((d, t) for d, t, *_ in brute(rows()))


def test_columns_named_like_the_operators_own_are_carried(spark):
    names = "doc_id long, text string, n_lines string, n_dropped string, row string, doc string, same string, gone string, lines string, `a.b` string"
    docs = spark.createDataFrame([(i, "x" * 50 + "\nkept", *"abcdefgh") for i in range(6)], names)
    got = line_dedup.drop_lines(docs)
    assert got.columns == docs.columns
    assert sorted(tuple(r) for r in got.collect()) == [(i, "kept" if i < 5 else "x" * 50 + "\nkept", *"abcdefgh") for i in range(6)]


def test_a_document_is_an_id(spark):
    long = "a line that is long enough to count for the dedup operator"
    docs = [(1, long), (1, long + "\nx"), (1, long), (2, long), (2, "y\n" + long)]
    assert found(spark.createDataFrame(docs, "doc_id long, text string")) == sorted(brute(docs))
    docs += [(3, long), (4, long), (5, "z\n" + long), (5, long), (5, long + "\n" + long.upper())]
    wanted = sorted(brute(docs))
    assert found(spark.createDataFrame(docs, "doc_id long, text string")) == wanted and sum(x[3] for x in wanted) == 7


def test_odd_lines_by_brute_force(spark):
    base = "Ünïcödé Zeilen ß 漢字 İ ſ K that are long enough for it"
    texts = [base, f" {base}\t", base.replace("Z", "z"), f"\x0b{base}\x0c\r", f" {base}", base + "\n" * 3 + base, "\n".join([base] * 500), "x" * 39, "X" * 40, "x" * 40 + "\n" + "x" * 39, "漢" * 40, "漢" * 39]
    docs = [(i, t) for i, t in enumerate(texts * 2 + ["x" * 40, "X" * 40 + "\n"])] + [(99, "\n".join(f"line {i} of a very long text with very many lines" for i in range(20_000)))]
    docs += [(200 + i, "\n".join(f"line {j} of a very long text with very many lines" for j in range(0, 3000, i + 1))) for i in range(5)]
    wanted = sorted(brute(docs))
    assert found(spark.createDataFrame(docs, "doc_id long, text string")) == wanted and sum(x[3] for x in wanted) > 1000


def test_empty_table(spark):
    assert line_dedup.drop_lines(frame(spark, [])).collect() == []
    counts, filters = line_dedup.inserted(None, None, frame(spark, []), 3)
    assert counts.collect() == filters.collect() == []


def test_query_matches_sql(spark, sf_dir):
    assert_matches(line_dedup.op10_line_dedup, line_dedup.OP10_SQL, spark, sf_dir)


def test_insertions_and_deletions_undo_each_other(spark):
    docs = frame(spark).where("doc_id >= 30").select("doc_id", "text")
    one, two = docs.where("doc_id < 34"), docs.where("doc_id >= 34")
    state = lambda c: {bytes(r.key): (r.n_docs, r.top_doc) for r in c.collect()}
    first, _ = line_dedup.insert(None, None, one, 3)
    both, _ = line_dedup.insert(first, line_dedup.build_filters(first), two, 3)
    assert state(both) == state(line_dedup.insert(None, None, docs, 3)[0])
    assert state(line_dedup.delete(both, two, one, 3)[0]) == state(first)


def test_cuckoo_filter_has_what_was_added_and_forgets_what_was_removed():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
    made = line_dedup.CuckooFilter.of(keys)
    assert made.has(keys).all()
    assert made.has(rng.integers(0, 1 << 63, 5000, dtype=np.uint64)).mean() < 0.01
    again = line_dedup.CuckooFilter.load(made.dump())
    again.remove(keys[:2500])
    assert again.has(keys[2500:]).all() and again.has(keys[:2500]).mean() < 0.01


def test_filters_follow_three_batches_and_a_deletion(spark):
    line = lambda i: f"Line number {i} is long enough to be counted by the dedup."
    rows = [(i, "\n".join([line("common"), line(i), *([line("from the second batch on")] if i >= 10 else [])])) for i in range(30)]
    batch = lambda *r: spark.createDataFrame([rows[i] for x in r for i in x], "doc_id long, text string")
    counted = lambda c: sorted((bytes(r.key), r.shard, r.n_docs, r.top_doc) for r in c.collect())

    def whole(*some):
        return counted(line_dedup.insert(None, None, batch(*some), 3)[0])

    def in_step(counts, filters):
        keys = {}
        for r in counts.collect():
            keys.setdefault(r.shard, []).append(bytes(r.key))
        state = {r.shard: r for r in filters.collect()}
        assert {s: r.n for s, r in state.items()} == {s: len(k) for s, k in keys.items()}
        for shard, held in keys.items():
            made = line_dedup.CuckooFilter.load(state[shard].blob)
            assert made.has(line_dedup._hashes(held)).all() and (made.table != 0).sum() == len(held)

    counts, filters = None, None
    for n, some in enumerate((range(10), range(10, 20), range(20, 30))):
        counts, filters = line_dedup.inserted(counts, filters, batch(some), 3)
        assert counted(counts) == whole(range(10 * n + 10))
        in_step(counts, filters)
    kept = batch(range(10), range(25, 30))
    counts, filters = line_dedup.deleted(counts, filters, batch(range(10, 25)), kept, 3)
    assert counted(counts) == whole(range(10), range(25, 30))
    in_step(counts, filters)
    counts, filters = line_dedup.inserted(counts, filters, batch(range(10, 25)), 3)  # what has gone may come again
    assert counted(counts) == whole(range(30))
    in_step(counts, filters)


def test_unchanged_shards_keep_their_filters(spark):
    lines = [(i, f"Line number {i} is long enough to be counted by the dedup.") for i in range(60)]
    counts, filters = line_dedup.inserted(None, None, spark.createDataFrame(lines, "doc_id long, text string"), 16)
    again, after = line_dedup.inserted(counts, filters, spark.createDataFrame([(99, lines[0][1] + "\n" + "y" * 60)], "doc_id long, text string"), 16)
    old, new = ({r.shard: bytes(r.blob) for r in f.collect()} for f in (filters, after))
    assert sum(old.get(s) != b for s, b in new.items()) == 1
    assert again.agg(F.sum("n_docs")).first()[0] == 62
