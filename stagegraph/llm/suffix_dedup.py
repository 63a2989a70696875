"""Suffix-array dedup: byte strings of a minimum length that also start earlier, by threshold-bounded interval expansion.

``repeats`` brings the texts that may share a window to one shard. There, ``expand`` works on the Burrows-Wheeler transform of the
shard's text: it starts from the interval of the empty string and extends strings backwards, breadth first. The interval of a string
of length l that ends at a place not marked before shows a common prefix of exactly l between the suffixes on both sides. So the
common prefixes come by increasing value, and the expansion stops at the minimum length: suffixes with no mark between them share it.

Defined cases: a null or empty text has no bytes; a text shorter than the minimum length keeps all; rows that repeat a doc_id (or have
none) are separate documents in the order of (doc_id, nulls first; text); an empty table gives an empty result; further columns are
ignored; a long text is whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from stagegraph.llm.common import arrow_schema, pieces, record, table, utf8
from stagegraph.llm.repeats import Tokens, Windows, gone, joined, keyed, later_ones, ordered_suffixes, per_text, removed

SENTINEL = 0xFF  # no byte of UTF-8


def byte_tokens(texts: list[bytes]) -> Tokens:
    bounds = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)))))
    data = b"".join(texts)
    return Tokens(np.frombuffer(data, dtype=np.uint8), bounds, data)


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes by their first ``depth`` bytes at least, from words of eight bytes."""
    padded = np.concatenate((text, np.zeros(8, dtype=np.uint8))).astype(np.uint64)
    eight = np.zeros(len(text), dtype=np.uint64)
    for i in range(8):
        eight = (eight << np.uint64(8)) | padded[i : i + len(text)]
    order = np.argsort(eight, kind="stable")
    line = eight[order]
    ranks = np.empty(len(text), dtype=np.uint64)
    ranks[order] = np.concatenate(([0], np.cumsum(line[1:] != line[:-1]))).astype(np.uint64)
    return ordered_suffixes(ranks, 8, depth)


def expand(transform: np.ndarray, least: int, sentinel: int) -> np.ndarray:
    """Marks of n + 1 places between suffixes: False where both sides share at least ``least`` symbols."""
    n = len(transform)
    step = np.empty(n, dtype=np.int64)  # where the suffix that is one symbol longer lies
    step[np.argsort(transform, kind="stable")] = np.arange(n)
    marks = np.zeros(n + 1, dtype=bool)
    marks[[0, n]] = True
    low, high = np.array([0]), np.array([n])
    for length in range(least):
        size = high - low
        one = size == 1
        ends = np.cumsum(size[~one])
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(low[~one] - (ends - size[~one]), size[~one])
        symbol = transform[at].astype(np.int64)
        key = np.repeat(np.arange(len(ends)), size[~one]) << 8 | symbol
        order = np.argsort(key, kind="stable")
        line = key[order]
        new = np.flatnonzero(np.concatenate((np.ones(min(1, len(line)), dtype=bool), line[1:] != line[:-1])))
        first, last = at[order[new]], at[order[np.append(new[1:], len(line)) - 1]] if len(new) else at[:0]
        first, last = np.concatenate((first, low[one])), np.concatenate((last, low[one]))
        if length:  # a string that has gone over the end of a text is of no use
            inside = transform[first] != sentinel
            first, last = first[inside], last[inside]
        low, high = step[first], step[last] + 1
        fresh = ~marks[high]
        low, high = low[fresh], high[fresh]
        marks[high] = True
        if not len(low):
            break
    return marks


def shared_windows(texts: list[bytes], width: int) -> list[np.ndarray]:
    """For each text, given in order, its starts of ``width`` bytes that an earlier start has too."""
    if not texts:
        return []
    whole, starts = joined([np.frombuffer(t, dtype=np.uint8) for t in texts], SENTINEL)
    order = suffix_order(whole, width)
    marks = expand(whole[order - 1], width, SENTINEL)
    group = np.cumsum(marks[:-1])
    inside = np.zeros(len(whole), dtype=bool)
    for s, t in zip(starts.tolist(), texts, strict=True):
        inside[s : s + len(t) - width + 1] = True
    keep = inside[order]
    return per_text(later_ones(group[keep], order[keep]), starts)


def windows(width: int = 100) -> Windows:
    return Windows(width, max(1, width // 5), byte_tokens, shared_windows)


DONE = "doc_id long, text binary, n_bytes long, n_removed long, spans array<struct<lo:long,hi:long>>"


def drop_repeats(docs: DataFrame, width: int = 100) -> DataFrame:
    """Per row of docs: the bytes that stay, and the maximal removed spans."""
    target = arrow_schema(docs.sparkSession, DONE)

    def run(batches):
        for batch in pieces(batches):
            out = {f.name: [] for f in target}
            texts = utf8(batch.column("text").to_pylist())
            for doc, text, lo, hi in zip(batch.column("doc_id").to_pylist(), texts, batch.column("lo").to_pylist(), batch.column("hi").to_pylist(), strict=True):
                spans = []
                if lo:
                    off = gone(len(text), lo, hi)
                    edge = np.flatnonzero(np.diff(off, prepend=False, append=False))
                    spans = [{"lo": a, "hi": b} for a, b in edge.reshape(-1, 2).tolist()]
                kept = b"".join(text[a:b] for a, b in zip([0, *(s["hi"] for s in spans)], [*(s["lo"] for s in spans), len(text)], strict=True))
                for name, value in zip(out, (doc, kept, len(text), len(text) - len(kept), spans), strict=True):
                    out[name].append(value)
            yield record(out, target)

    return removed(keyed(docs), windows(width)).select("doc_id", "text", "lo", "hi").mapInArrow(run, DONE)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = drop_repeats(table(spark, sf_dir, "documents"))
    shape = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    target = arrow_schema(spark, shape)

    def digest(batches):
        for batch in pieces(batches):
            yield record({"doc_id": batch.column("doc_id"), "n_bytes": batch.column("n_bytes"), "n_removed": batch.column("n_removed"), "n_spans": [len(x) for x in batch.column("spans").to_pylist()], "kept_sha256": [hashlib.sha256(x).hexdigest() for x in batch.column("text").to_pylist()]}, target)

    return done.mapInArrow(digest, shape)


OP4_SQL = r"""
WITH bytes AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
placed AS (SELECT doc_id, n, unnest(regexp_extract_all(h, '..')) AS b, unnest(generate_series(1, n)) AS i FROM bytes),
tens AS (SELECT doc_id, n, i, string_agg(b, '') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS t FROM placed),
keyed AS (
  SELECT doc_id, i, n, md5_number(t || lead(t, 10) OVER w || lead(t, 20) OVER w || lead(t, 30) OVER w || lead(t, 40) OVER w || lead(t, 50) OVER w || lead(t, 60) OVER w || lead(t, 70) OVER w || lead(t, 80) OVER w || lead(t, 90) OVER w) AS k
  FROM tens WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM keyed WHERE i <= n - 99) WHERE r > 1),
runs AS (
  SELECT doc_id, i AS lo, i + 100 AS hi,
         CASE WHEN i <= max(i + 100) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM again),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY lo) AS run FROM runs),
spans AS (SELECT doc_id, run, min(lo) AS lo, max(hi) AS hi FROM numbered GROUP BY doc_id, run),
kept AS (
  SELECT doc_id, lo, hi, lag(hi, 1, 1) OVER (PARTITION BY doc_id ORDER BY lo) AS since FROM (
    SELECT doc_id, lo, hi FROM spans UNION ALL SELECT doc_id, n + 1, n + 1 FROM bytes))
SELECT b.doc_id, any_value(b.n) AS n_bytes, CAST(sum(k.hi - k.lo) AS BIGINT) AS n_removed, count(*) FILTER (WHERE k.hi > k.lo) AS n_spans,
       sha256(unhex(string_agg(substr(b.h, 2 * k.since - 1, 2 * (k.lo - k.since)), '' ORDER BY k.lo, k.hi))) AS kept_sha256
FROM bytes b JOIN kept k ON k.doc_id = b.doc_id GROUP BY b.doc_id
"""
