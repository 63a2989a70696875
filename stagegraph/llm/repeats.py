"""Windows of tokens that also start earlier in the corpus: the part that byte and word operators share.

Every window owns one anchor (see ``anchors``), so equal windows meet wherever their anchors do. Windows of one anchor occurrence form
a *run*; its tokens are the run's text.

1. ``found``: each task folds equal runs of its own documents to the first, and deals the rest by anchor, packed per bucket. There,
   equal runs are folded again: all but the first are removed whole. Runs are equal by anchor and a 128-bit BLAKE2 digest of their
   bytes; no two texts with one such digest are known. First runs whose anchor has other texts too are *asked* for.
2. ``matched``: the asked runs' texts go to shards by anchor, where a string index over the texts themselves finds the windows that they
   share.
3. The runs of a hot anchor (of more than ``HOT`` different texts, or ``TASK_HOT`` in one task) are cut into single windows instead,
   which fold by their digests; so no bucket and no shard grows with a frequent passage.
4. ``removed``: all removed spans by document.

"Earlier" is a smaller document key, or the same document and an earlier start.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagegraph.llm.anchors import owned_runs
from stagegraph.llm.bpe import pack, unpack
from stagegraph.llm.common import arrow_schema, partitions, pieces, record, utf8, written
from stagegraph.llm.tokens import blocks, mix, span_hashes

HOT = 2048  # different runs of one anchor
TASK_HOT = 256  # the same among HELD runs of a task
SHARD_TOKENS = 1 << 20  # tokens of a shard's index
HELD = 1 << 20  # runs that a task folds at once
FOUND = "doc long, lo long, hi long, anchor long, ask int"
SPAN, ASK, CUT = 0, 1, 2


@dataclass(frozen=True)
class Tokens:
    """The tokens of joined texts: their hashes, the texts' n + 1 offsets in tokens, the bytes, and each token's place there (None: a
    token is a byte)."""

    values: np.ndarray
    bounds: np.ndarray
    data: bytes
    start: np.ndarray | None = None
    end: np.ndarray | None = None

    def cut(self, lo: np.ndarray, hi: np.ndarray) -> list[bytes]:
        """The bytes of tokens lo to hi, hi excluded, of none of which there are none."""
        if self.start is not None:
            lo, hi = self.start[lo], self.end[hi - 1]
        return [self.data[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]

    def digests(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        made = hashlib.blake2b
        return np.frombuffer(b"".join([made(x, digest_size=16).digest() for x in self.cut(lo, hi)]), dtype="<u8").reshape(-1, 2)


@dataclass(frozen=True)
class Windows:
    """What counts as a token, how long a window is, and how a shard finds equal windows."""

    width: int
    gram: int
    tokens: Callable[[list[bytes]], Tokens]
    match: Callable[[list[bytes], int], list[np.ndarray]]  # texts of runs in order, width -> for each its window starts that occur earlier


def keyed(docs: DataFrame) -> DataFrame:
    """(key long, doc_id, text), keys unique and in the order of doc_id. Where ids are unique they are the keys; else rows are numbered
    in the order of (doc_id, nulls first; text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    odd = docs.groupBy("doc_id").count().where("doc_id IS NULL OR count > 1").limit(1).count()
    if not odd:
        return docs.select(F.col("doc_id").alias("key"), "doc_id", "text")
    order = [F.asc_nulls_first("doc_id"), F.asc_nulls_first("text")]
    return written(docs.repartitionByRange(partitions(docs), *order).sortWithinPartitions(*order).select(F.monotonically_increasing_id().alias("key"), "doc_id", "text"))


def _held(parts: Iterator[tuple[np.ndarray, ...]]) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs together, about HELD at a time."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(part[0])
        if size > HELD:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held, size = [], 0
    if size:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _runs(batches, windows: Windows) -> Iterator[tuple[np.ndarray, ...]]:
    """(doc, anchor, digest, first window, windows) of the runs of some texts at a time."""
    for batch in pieces(batches):
        keys, texts = batch.column("key").to_numpy(), utf8(batch.column("text").to_pylist())
        for at, some in blocks(texts, 1 << 19):
            t = windows.tokens(some)
            doc, anchor, first, count = owned_runs(t.values, t.bounds, windows.gram, windows.width)
            start = t.bounds[doc] + first
            yield keys[at + doc], anchor, t.digests(start, start + count + windows.width - 1), first, count


def _fold(doc, anchor, text, first, count):
    """The runs in the order of (anchor, text, doc, first), and which are the first of their text."""
    order = np.lexsort((first, doc, text[:, 1], text[:, 0], anchor))
    doc, anchor, text, first, count = (x[order] for x in (doc, anchor, text, first, count))
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]).any(axis=1)
    return (doc, anchor, text, first, count), new


def _groups(anchor: np.ndarray) -> np.ndarray:
    """Numbers of the groups of equal neighbours."""
    return np.cumsum(np.concatenate((np.zeros(min(1, len(anchor)), dtype=np.int64), anchor[1:] != anchor[:-1])))


def _merged(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans with those of a document that touch made one."""
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order], lo[order], hi[order]
    if not len(doc):
        return doc, lo, hi
    base = np.cumsum(np.concatenate(([0], doc[1:] != doc[:-1]))) * (int(hi.max()) + 2)  # one line for all documents
    reach = np.maximum.accumulate(hi + base)
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (lo + base)[1:] > reach[:-1]
    starts = np.flatnonzero(new)
    return doc[starts], lo[starts], (reach - base)[np.append(starts[1:], len(doc)) - 1]


def found(docs: DataFrame, windows: Windows) -> DataFrame:
    """FOUND rows: spans of runs that equal an earlier one, and the runs to ask for."""
    return _folded(docs.select("key", "text"), lambda batches: _runs(batches, windows), windows.width)


def _folded(rows: DataFrame, runs_of: Callable, width: int, cut: bool = True) -> DataFrame:
    """FOUND rows of the runs that ``runs_of`` yields from batches of rows, by two folds: in each task, and in each bucket of anchors.
    Without ``cut`` no anchor is hot."""
    spark, n = rows.sparkSession, partitions(rows)
    buckets, hot, task_hot = 4 * n, HOT if cut else np.inf, TASK_HOT if cut else np.inf
    piece, target = arrow_schema(spark, "bucket int, ask int, data binary"), arrow_schema(spark, FOUND)
    plain = lambda doc, first, count: [doc.view(np.uint64), first.astype(np.uint32), count.astype(np.uint32)]

    def dealt(batches):
        task = TaskContext.get().partitionId()
        for runs in _held(runs_of(batches)):
            (doc, anchor, text, first, count), new = _fold(*runs)
            again = _merged(doc[~new], first[~new], (first + count + width - 1)[~new])
            packed = [(task % buckets, SPAN, pack(plain(again[0], again[1], again[2] - again[1])))] if len(again[0]) else []
            doc, anchor, text, first, count = (x[new] for x in (doc, anchor, text, first, count))
            group = _groups(anchor)
            many = np.bincount(group)[group] >= task_hot
            if many.any():  # their bucket only learns that they are hot: an anchor without runs
                packed.append((task % buckets, CUT, pack(plain(doc[many], first[many], (count + width - 1)[many]))))
                one = np.flatnonzero(many & np.concatenate(([True], anchor[1:] != anchor[:-1])))
                count = np.where(many, 0, count)
                keep = ~many
                keep[one] = True
                doc, anchor, text, first, count = (x[keep] for x in (doc, anchor, text, first, count))
            bucket = (mix(anchor) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for b in np.unique(bucket):
                at = order[edges[b] : edges[b + 1]]
                packed.append((int(b), ASK, pack([anchor[at], np.ascontiguousarray(text[at, 0]), np.ascontiguousarray(text[at, 1]), *plain(doc[at], first[at], count[at])])))
            for i in range(0, len(packed), 64):
                yield record(dict(zip(("bucket", "ask", "data"), zip(*packed[i : i + 64], strict=True), strict=True)), piece)

    def out(doc, lo, hi, anchor, ask):
        for i in range(0, len(doc), 1 << 16):
            s = slice(i, i + (1 << 16))
            yield record({"doc": doc[s], "lo": lo[s], "hi": hi[s], "anchor": anchor[s], "ask": ask[s]}, target)

    def bucket_rows(blobs):
        anchor, *text, doc, first, count = (np.concatenate(x) for x in zip(*map(unpack, blobs), strict=True))
        (doc, anchor, text, first, count), new = _fold(doc.view(np.int64), anchor, np.column_stack(text), first.astype(np.int64), count.astype(np.int64))
        group = _groups(anchor)
        told = np.bincount(group, weights=count == 0)[group] > 0
        texts = np.bincount(group, weights=new)[group]
        ask = np.where(told, CUT, np.where(new, np.where(texts > hot, CUT, ASK), SPAN))
        keep = (~new | (texts > 1) | told) & (count > 0)
        yield from out(doc[keep], first[keep], (first + count + width - 1)[keep], anchor.view(np.int64)[keep], ask[keep])

    def folded(batches):
        bucket, blobs = None, []
        for batch in batches:
            for b, ask, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ask != ASK:
                    doc, lo, size = unpack(data)
                    yield from out(doc.view(np.int64), lo.astype(np.int64), lo.astype(np.int64) + size, np.zeros(len(doc), dtype=np.int64), np.full(len(doc), ask))
                    continue
                if b != bucket and blobs:
                    yield from bucket_rows(blobs)
                    blobs = []
                bucket = b
                blobs.append(data)
        if blobs:
            yield from bucket_rows(blobs)

    sent = rows.mapInArrow(dealt, "bucket int, ask int, data binary")
    return sent.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(folded, FOUND)


def _with_asked(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(key, text, lo array, hi array, anchor array) of the documents that have asked runs."""
    by_doc = asked.groupBy("doc").agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"), F.collect_list("anchor").alias("anchor"))
    return docs.join(by_doc.hint("shuffle_hash"), docs["key"] == by_doc["doc"]).select("key", "text", "lo", "hi", "anchor")


def _slices(docs: DataFrame, asked: DataFrame, emit, schema: str) -> DataFrame:
    """``emit(key, values, lo, hi, anchor)`` on the tokens of each document that has asked runs; yields columns of ``schema``."""
    target = arrow_schema(docs.sparkSession, schema)

    def run(batches):
        for batch in pieces(batches):
            for key, text, lo, hi, anchor in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "lo", "hi", "anchor")), strict=True):
                yield from (record(x, target) for x in emit(key, text, lo, hi, anchor))

    return _with_asked(docs, asked).mapInArrow(run, schema)


PIECES = "shard int, doc long, lo long, data binary"


def matched(docs: DataFrame, asked: DataFrame, windows: Windows) -> DataFrame:
    """(doc, lo, hi): spans of windows that asked runs share with an earlier one."""
    spark, width = docs.sparkSession, windows.width
    size = asked.agg(F.coalesce(F.sum(F.col("hi") - F.col("lo")), F.lit(0)).alias("n")).first().n
    shards = max(1, -(-4 * size // SHARD_TOKENS))

    def emit(key, text, lo, hi, anchor):
        data = windows.tokens(utf8([text])).cut(np.array(lo), np.array(hi))
        yield {"shard": (mix(np.array(anchor, dtype=np.int64).view(np.uint64)) % np.uint64(shards)).astype(np.int64), "doc": [key] * len(lo), "lo": lo, "data": data}

    target = arrow_schema(spark, "doc long, lo long, hi long")

    def shard(t: pa.Table) -> pa.Table:
        t = t.combine_chunks().sort_by([("doc", "ascending"), ("lo", "ascending")])
        starts = windows.match(t.column("data").to_pylist(), width)
        doc = np.repeat(t.column("doc").to_numpy(), list(map(len, starts)))
        lo = np.repeat(t.column("lo").to_numpy(), list(map(len, starts))) + np.concatenate([*starts, np.zeros(0, dtype=np.int64)])
        doc, lo, hi = _merged(doc, lo, lo + width)
        return pa.Table.from_batches([record({"doc": doc, "lo": lo, "hi": hi}, target)])

    return _slices(docs, asked, emit, PIECES).groupBy("shard").applyInArrow(shard, "doc long, lo long, hi long")


def cut_windows(docs: DataFrame, hot: DataFrame, windows: Windows) -> DataFrame:
    """(doc, lo, hi): spans of the hot anchors' single windows that equal an earlier one."""
    width = windows.width

    def runs(batches):
        for batch in pieces(batches):
            for key, text, lo, hi in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "lo", "hi")), strict=True):
                t = windows.tokens(utf8([text]))
                at = np.concatenate([np.arange(a, b - width + 1) for a, b in zip(lo, hi, strict=True)])
                yield np.full(len(at), key), span_hashes(t.values, at, at + width), t.digests(at, at + width), at, np.ones(len(at), dtype=np.int64)

    return _folded(_with_asked(docs, hot), runs, width, cut=False).where(F.col("ask") == SPAN).select("doc", "lo", "hi")


def removed(docs: DataFrame, windows: Windows) -> DataFrame:
    """(key, doc_id, text, lo array, hi array): docs (keyed) with the token spans to remove, unordered, or null."""
    every = written(found(docs, windows))
    kinds = {r.ask for r in every.select("ask").distinct().collect()}  # of three
    asked = lambda kind: every.where(F.col("ask") == kind)
    spans = asked(SPAN).select("doc", "lo", "hi")
    if ASK in kinds:
        spans = spans.unionByName(matched(docs, asked(ASK), windows))
    if CUT in kinds:
        spans = spans.unionByName(cut_windows(docs, asked(CUT), windows))
    by_doc = spans.groupBy("doc").agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"))  # at most a text's tokens
    return docs.join(by_doc.hint("shuffle_hash"), docs["key"] == by_doc["doc"], "left").select("key", "doc_id", "text", "lo", "hi")


def gone(n: int, lo, hi) -> np.ndarray:
    """Which of n tokens the spans cover."""
    edge = np.zeros(n + 1, dtype=np.int64)
    if lo:
        np.add.at(edge, lo, 1)
        np.add.at(edge, hi, -1)
    return np.cumsum(edge)[:n] > 0


def joined(texts: list[np.ndarray], sentinel) -> tuple[np.ndarray, np.ndarray]:
    """The texts one after another, each closed by the sentinel; and where each begins."""
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
    starts = np.cumsum(lengths) - lengths
    whole = np.full(int(lengths.sum()), sentinel, dtype=texts[0].dtype)
    for a, t in zip(starts.tolist(), texts, strict=True):
        whole[a : a + len(t)] = t
    return whole, starts


def ordered_suffixes(ranks: np.ndarray, known: int, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` symbols at least; ``ranks`` orders them by the first ``known``."""
    n, ranks = len(ranks), ranks.astype(np.uint64)
    while True:
        if known >= depth:
            return np.argsort(ranks, kind="stable")
        later = np.zeros(n, dtype=np.uint64)
        later[: max(0, n - known)] = ranks[known:] + np.uint64(1)
        both = (ranks << np.uint64(32)) | later
        order = np.argsort(both, kind="stable")
        line = both[order]
        new = np.concatenate(([0], np.cumsum(line[1:] != line[:-1]))).astype(np.uint64)
        ranks = np.empty(n, dtype=np.uint64)
        ranks[order] = new
        known *= 2
        if new[-1] == n - 1:
            return order


def later_ones(group: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The places of each group but its least."""
    order = np.lexsort((place, group))
    return place[order[1:][group[order[1:]] == group[order[:-1]]]]


def per_text(hits: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """Places in the joined texts as window starts of each text."""
    hits = np.sort(hits)
    cuts = np.searchsorted(hits, starts)
    return [hits[a:b] - s for a, b, s in zip(cuts, [*cuts[1:], len(hits)], starts, strict=True)]
