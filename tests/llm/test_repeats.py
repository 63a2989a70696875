from __future__ import annotations

import hashlib

import numpy as np
import pytest
from cases import frame, rows
from oracle import assert_matches

from stagegraph.llm import repeats, substring_dedup, suffix_dedup


def ordered(docs):
    return sorted(((r[0], r[1] or "") for r in docs), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def brute(seqs, width):
    seen, out = set(), []
    for s in seqs:
        edge = np.zeros(len(s) + 1, dtype=int)
        for i in range(len(s) - width + 1):
            k = bytes(s[i : i + width]) if isinstance(s, bytes) else tuple(s[i : i + width])
            if k in seen:
                edge[i] += 1
                edge[i + width] -= 1
            seen.add(k)
        out.append(np.cumsum(edge)[: len(s)] > 0)
    return out


@pytest.mark.parametrize("hot", [(2048, 256), (1, 256), (2048, 2)])
def test_bytes_by_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot[0])
    monkeypatch.setattr(repeats, "TASK_HOT", hot[1])
    docs = [(d, t.encode()) for d, t in ordered(rows())]
    wanted = []
    for (d, t), off in zip(docs, brute([t for _, t in docs], 100), strict=True):
        kept = np.frombuffer(t, dtype=np.uint8)[~off].tobytes()
        wanted.append((repr(d), len(t), len(t) - len(kept), int((np.diff(off.astype(int), prepend=0) == 1).sum()), kept))
    got = suffix_dedup.drop_repeats(frame(spark)).collect()
    assert sorted((repr(r.doc_id), r.n_bytes, r.n_removed, len(r.spans), bytes(r.text)) for r in got) == sorted(wanted)


@pytest.mark.parametrize("hot", [(2048, 256), (1, 256), (2048, 2)])
def test_words_by_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot[0])
    monkeypatch.setattr(repeats, "TASK_HOT", hot[1])
    docs = [(d, t.encode().split()) for d, t in ordered(rows())]
    wanted = []
    for (d, t), off in zip(docs, brute([t for _, t in docs], 20), strict=True):
        kept = [w for w, o in zip(t, off, strict=True) if not o]
        wanted.append((repr(d), len(t), len(t) - len(kept), b" ".join(kept).decode()))
    got = substring_dedup.drop_repeats(frame(spark)).collect()
    assert sorted((repr(r.doc_id), r.n_words, r.n_removed, r.text) for r in got) == sorted(wanted)


def test_queries_digest_what_is_kept(spark, sf_dir):
    done = {r.doc_id: r for r in suffix_dedup.drop_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()}
    for r in suffix_dedup.op4_suffix_dedup(spark, sf_dir).collect():
        d = done[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (d.n_bytes, d.n_removed, len(d.spans), hashlib.sha256(bytes(d.text)).hexdigest())


def test_queries_match_sql(spark, sf_dir):
    assert_matches(suffix_dedup.op4_suffix_dedup, suffix_dedup.OP4_SQL, spark, sf_dir)
    assert_matches(substring_dedup.op5_substring_dedup, substring_dedup.OP5_SQL, spark, sf_dir)


def test_empty_tables(spark):
    assert suffix_dedup.drop_repeats(frame(spark, [])).collect() == []
    assert substring_dedup.drop_repeats(frame(spark, [])).collect() == []


@pytest.mark.parametrize("seed", range(5))
def test_shard_indexes_agree_with_brute_force(seed):
    rng = np.random.default_rng(seed)
    texts = [rng.integers(97, 99 + seed, rng.integers(8, 120)).astype(np.uint8) for _ in range(12)]
    texts += [texts[0][3:60], texts[1].copy()]
    seen, wanted = set(), []
    for t in texts:
        hits = []
        for i in range(len(t) - 8 + 1):
            k = t[i : i + 8].tobytes()
            if k in seen:
                hits.append(i)
            seen.add(k)
        wanted.append(hits)
    assert [x.tolist() for x in suffix_dedup.shared_windows([t.tobytes() for t in texts], 8)] == wanted
    assert [x.tolist() for x in substring_dedup.shared_windows([" ".join(map(str, t)).encode() for t in texts], 8)] == wanted


def test_common_prefixes_come_by_increasing_value():
    text = np.frombuffer(b"banana\xff", dtype=np.uint8)
    order = np.array(sorted(range(7), key=lambda i: text[i:].tobytes()))
    common = [next(k for k in range(8) if text[a : a + k + 1].tobytes() != text[b : b + k + 1].tobytes()) for a, b in zip(order, order[1:], strict=False)]
    for least in range(1, 5):
        marks = suffix_dedup.expand(text[order - 1], least, 0xFF)
        assert marks[1:-1].tolist() == [c < least for c in common]


def test_wavelet_rank():
    rng = np.random.default_rng(0)
    s = rng.integers(0, 37, 1000)
    tree = substring_dedup.WaveletMatrix(s, 36)
    at, symbol = rng.integers(0, 1001, 300), rng.integers(0, 37, 300)
    assert tree.rank(symbol, at).tolist() == [int((s[:a] == c).sum()) for a, c in zip(at, symbol, strict=True)]


TWINS = "abfafabdgaaadcabaa", "daaiadaaaadaaabafe"  # the polynomial hash of tokens.span_hashes is the same for both


@pytest.mark.parametrize("hot", [(2048, 256), (0, 256), (2048, 1)])
def test_texts_whose_hashes_collide_stay(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot[0])
    monkeypatch.setattr(repeats, "TASK_HOT", hot[1])
    t = substring_dedup.word_tokens([" ".join(TWINS).encode()])
    assert t.values[0] == t.values[1]
    first = [f"word{i}" for i in range(19)]
    for parts in (1, 2):
        docs = spark.createDataFrame([(i, " ".join([*first, w])) for i, w in enumerate(TWINS)], "doc_id long, text string").repartition(parts)
        assert [r.n_removed for r in substring_dedup.drop_repeats(docs).collect()] == [0, 0]
    rng = np.random.default_rng(3)
    for _ in range(2):
        left = bytes(rng.integers(97, 123, 90).astype(np.uint8)).decode()
        docs = spark.createDataFrame([(i, left + w) for i, w in enumerate(TWINS)], "doc_id long, text string").repartition(2)
        assert [r.n_removed for r in suffix_dedup.drop_repeats(docs).collect()] == [0, 0]
