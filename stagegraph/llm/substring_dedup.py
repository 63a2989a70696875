"""Substring dedup: windows of words that also start earlier, by matching statistics against a compressed FM-index per shard.

``repeats`` brings the texts that may share a window to one shard, whose FM-index is a wavelet matrix of packed bits over the
Burrows-Wheeler transform of the shard's words. The texts then stream past the index: from each window's last word, backward search
counts how many words still occur elsewhere (the matching statistic, cut at the threshold). A window that reaches the threshold has
the interval of all its occurrences, and is reported unless it is the earliest of them.

Defined cases: a null or empty text has no words; a text of fewer words than a window keeps all; rows that repeat a doc_id (or have
none) are separate documents in the order of (doc_id, nulls first; text); an empty table gives an empty result; further columns are
ignored; a long text is whole.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from itertools import count

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from stagegraph.llm.common import arrow_schema, pieces, record, table, utf8
from stagegraph.llm.repeats import Tokens, Windows, gone, joined, keyed, ordered_suffixes, per_text, removed
from stagegraph.llm.tokens import span_hashes, word_spans


def word_tokens(texts: list[bytes]) -> Tokens:
    data = b"\n".join(texts)
    ends = np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1)
    every = np.frombuffer(data, dtype=np.uint8)
    start, end = word_spans(every)
    return Tokens(span_hashes(every, start, end), np.concatenate(([0], np.searchsorted(start, ends))), data, start, end)


class WaveletMatrix:
    """Rank over a sequence of small ints: one packed bit vector a level, with counts before each 64-bit word."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.levels = max(1, int(top).bit_length())
        self.bits, self.counts, self.zeros = [], [], []
        for level in reversed(range(self.levels)):
            bit = (symbols >> level) & 1
            packed = np.packbits(np.concatenate((bit.astype(np.uint8), np.zeros(64 + -len(bit) % 64, dtype=np.uint8))), bitorder="little").view("<u8")
            self.bits.append(packed)
            self.counts.append(np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int64))))
            self.zeros.append(int(len(bit) - bit.sum()))
            symbols = np.concatenate((symbols[bit == 0], symbols[bit == 1]))

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.counts[level][word] + np.bitwise_count(self.bits[level][word] & low)

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place."""
        low = np.zeros(len(at), dtype=np.int64)
        for level in range(self.levels):
            one = ((symbols >> (self.levels - 1 - level)) & 1).astype(bool)
            ones_low, ones_at = self._ones(level, low), self._ones(level, at)
            low = np.where(one, self.zeros[level] + ones_low, low - ones_low)
            at = np.where(one, self.zeros[level] + ones_at, at - ones_at)
        return at - low


class FMIndex:
    """Of joined texts of word numbers, 0 closing each text; exact for patterns of up to ``depth`` words."""

    def __init__(self, whole: np.ndarray, depth: int):
        self.suffixes = ordered_suffixes(whole, 1, depth + 1)
        top = int(whole.max())
        self.tree = WaveletMatrix(whole[self.suffixes - 1], top)
        self.before = np.concatenate(([0], np.cumsum(np.bincount(whole, minlength=top + 1))))

    def extend(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        base = self.before[symbols]
        return base + self.tree.rank(symbols, low), base + self.tree.rank(symbols, high)

    def statistics(self, text: np.ndarray, ends: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each end (the place after a window): how many words before it, at most ``threshold``, occur twice at least; and the
        interval of those that reach it."""
        length = np.zeros(len(ends), dtype=np.int64)
        low, high = np.zeros(len(ends), dtype=np.int64), np.full(len(ends), len(self.suffixes))
        open_ = np.arange(len(ends))
        for step in range(1, threshold + 1):
            low[open_], high[open_] = self.extend(text[ends[open_] - step], low[open_], high[open_])
            open_ = open_[high[open_] - low[open_] > 1]
            length[open_] = step
        return length, low, high


def shared_windows(texts: list[bytes], width: int) -> list[np.ndarray]:
    """For each text, given in order, its starts of ``width`` words that an earlier start has too. Words are numbered by their bytes."""
    if not texts:
        return []
    known = defaultdict(count(1).__next__)
    number = known.__getitem__
    numbers, starts = joined([np.fromiter(map(number, words), dtype=np.int64, count=len(words)) for words in map(bytes.split, texts)], 0)
    texts = np.diff(starts, append=len(numbers)) - 1
    index = FMIndex(numbers, width)
    ends = np.concatenate([np.arange(s + width, s + t + 1) for s, t in zip(starts.tolist(), texts.tolist(), strict=True)])
    hits = []
    for i in range(0, len(ends), 1 << 16):
        some = ends[i : i + (1 << 16)]
        length, low, high = index.statistics(numbers, some, width)
        full = np.flatnonzero(length >= width)
        if len(full):
            lows, which = np.unique(low[full], return_inverse=True)
            highs = np.zeros(len(lows), dtype=np.int64)
            highs[which] = high[full]
            bounds = np.column_stack((lows, highs)).ravel()
            bounds = bounds[:-1] if bounds[-1] >= len(index.suffixes) else bounds
            earliest = np.minimum.reduceat(index.suffixes, bounds)[::2]  # intervals of one length are apart or equal
            start = some[full] - width
            hits.append(start[start > earliest[which]])
    return per_text(np.concatenate([*hits, np.zeros(0, dtype=np.int64)]), starts)


def windows(width: int = 20) -> Windows:
    return Windows(width, max(1, width // 5), word_tokens, shared_windows)


DONE = "doc_id long, text string, n_words long, n_removed long"


def drop_repeats(docs: DataFrame, width: int = 20) -> DataFrame:
    """Per row of docs: the words that stay, joined by one space."""
    target = arrow_schema(docs.sparkSession, DONE)

    def run(batches):
        for batch in pieces(batches):
            out = {f.name: [] for f in target}
            texts = utf8(batch.column("text").to_pylist())
            for doc, text, lo, hi in zip(batch.column("doc_id").to_pylist(), texts, batch.column("lo").to_pylist(), batch.column("hi").to_pylist(), strict=True):
                words = text.split()
                kept = [words[i] for i in np.flatnonzero(~gone(len(words), lo, hi)).tolist()] if lo else words
                for name, value in zip(out, (doc, b" ".join(kept).decode("utf-8", "surrogatepass"), len(words), len(words) - len(kept)), strict=True):
                    out[name].append(value)
            yield record(out, target)

    return removed(keyed(docs), windows(width)).select("doc_id", "text", "lo", "hi").mapInArrow(run, DONE)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = drop_repeats(table(spark, sf_dir, "documents"))
    shape = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    target = arrow_schema(spark, shape)

    def digest(batches):
        for batch in pieces(batches):
            yield record({"doc_id": batch.column("doc_id"), "n_words": batch.column("n_words"), "n_removed": batch.column("n_removed"), "kept_sha256": [hashlib.sha256(x).hexdigest() for x in utf8(batch.column("text").to_pylist())]}, target)

    return done.mapInArrow(digest, shape)


OP5_SQL = r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
placed AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM words),
keyed AS (
  SELECT doc_id, i, n, md5_number(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)) AS k FROM placed),
again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM keyed WHERE i <= n - 19) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, i + unnest(generate_series(0, 19)) AS i FROM again),
judged AS (SELECT placed.*, gone.i IS NOT NULL AS off FROM placed LEFT JOIN gone ON placed.doc_id = gone.doc_id AND placed.i = gone.i)
SELECT d.doc_id, count(word) AS n_words, count(*) FILTER (WHERE off) AS n_removed,
       sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT off), '')) AS kept_sha256
FROM documents d LEFT JOIN judged ON judged.doc_id = d.doc_id GROUP BY d.doc_id
"""
