"""Byte-level BPE encoding and decoding: a global shuffle of distinct words.

1. ``_chunks`` reads runs of documents of about ``chunk_words`` pre-tokens, and numbers each run's distinct words by first appearance;
   a document is then the positions' word numbers. What a run holds is set by the rows of its input partition, so ``docs`` must be a
   plan that gives the same rows in the same order when it is computed again, such as a table; the two passes below both read it.
2. Each run sends each distinct word once, to the bucket of the word's hash. There every distinct word of the corpus is encoded once.
3. The ids go back to the runs, where each document is put together by position.

A word thus crosses the shuffle once for each run that has it, however often it occurs, and no partition holds more than a bucket's
distinct words. Decoding joins the token-byte table, whose size is that of the vocabulary and is fixed.

Words are split with the classes of characters that the library's own tables give (see ``splitter``).

Defined cases: a null text is empty and has no ids; a null id stays null; equal rows give equal results; an empty table gives an empty
result; further columns are ignored; a text of any length is a run of its own at most.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
from collections import defaultdict
from functools import cache
from itertools import count

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from stagegraph.llm.common import arrow_schema, partitions, pieces, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _encoder(pattern: str, ranks: dict[bytes, int], kept: dict = {}):  # noqa: B006  one for each worker process
    if "made" not in kept:
        import tiktoken

        kept["made"] = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return kept["made"]


def library_class(atom: str) -> frozenset[str]:
    """The characters that the library's own tables put in a class such as \\p{L}; its release of Unicode need not be that of ``regex``."""
    import tiktoken

    every = "".join(map(chr, itertools.chain(range(0xD800), range(0xE000, 0x110000))))
    single = tiktoken.Encoding("class", pat_str=atom, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    return frozenset(bytes(single.encode_ordinary(every)).decode())


@cache
def splitter(pattern: str):
    """A function that splits a text as the library would. ``regex`` does it, but characters that the two put in different classes are
    first replaced, place by place, by characters of the class that the library gives them."""
    find, atoms = regex.compile(pattern), sorted({x[:2].lower() + x[2:] for x in re.findall(r"\\[pP]\{[^}]*\}|\\[swdSWD]", pattern)})  # a class and its complement differ alike
    every = "".join(map(chr, itertools.chain(range(0xD800), range(0xE000, 0x110000))))
    theirs, ours = [library_class(a) for a in atoms], [frozenset(regex.findall(a, every)) for a in atoms]
    odd = frozenset().union(*(a ^ b for a, b in zip(theirs, ours, strict=True)))
    if not odd:
        return find.findall
    kinds = {c: tuple(c in x for x in theirs) for c in odd}
    standins, wanted = {}, set(kinds.values())
    for c in map(chr, range(0xA1, 0x3000)):
        kind = tuple(c in x for x in theirs)
        if c not in odd and kind in wanted and c not in pattern and c.lower() == c.upper():
            standins.setdefault(kind, c)
    table = {ord(c): standins[k] for c, k in kinds.items()}
    maybe = re.compile(f"[{re.escape(''.join(sorted(c for c in odd if c < chr(0x10000))))}\U00010000-\U0010ffff]").search  # a bitmap

    def split(text: str) -> list[str]:
        if text.isascii() or not maybe(text) or odd.isdisjoint(text):
            return find.findall(text)
        return [text[m.start() : m.end()] for m in find.finditer(text.translate(table))]

    return split


def _chunks(batches, pattern: str, chunk_words: int):
    """(run id, doc ids, word numbers, words of each document, distinct words)."""
    find, run = splitter(pattern), (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32

    def fresh():
        return [], [], [], defaultdict(count().__next__)

    ids, codes, lengths, words = fresh()
    held = 0
    for batch in pieces(batches):
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = find(text or "")
            codes.append(np.fromiter(map(words.__getitem__, found), dtype=np.uint32, count=len(found)))
            ids.append(doc)
            lengths.append(len(found))
            held += len(found) + 1
            if held >= chunk_words:
                yield run, ids, np.concatenate(codes), lengths, list(words)
                run, held = run + 1, 0
                ids, codes, lengths, words = fresh()
    if ids:
        yield run, ids, np.concatenate(codes), lengths, list(words)


def _order(words: list[str], buckets: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The words' bytes, and the order that puts them by bucket; the buckets in that order."""
    data = [w.encode("utf-8", "surrogatepass") for w in words]
    bucket = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in data), dtype=np.uint64, count=len(data)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    return data, order, bucket[order].astype(np.int64)


def pack(arrays: list[np.ndarray]) -> bytes:
    """Arrays of unsigned ints, each by planes of bytes, which compress better."""
    head = np.array([x for a in arrays for x in (a.dtype.itemsize, len(a))], dtype="<u4").tobytes()
    body = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(len(arrays).to_bytes(4, "little") + head + body)


def unpack(blob: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob, max_output_size=1 << 31)
    n, out = int.from_bytes(data[:4], "little"), []
    head, at = np.frombuffer(data, dtype="<u4", count=2 * n, offset=4).reshape(n, 2), 4 + 8 * n
    for width, length in head.tolist():
        plane = np.frombuffer(data, dtype=np.uint8, count=width * length, offset=at).reshape(width, length)
        out.append(np.ascontiguousarray(plane.T).view(f"<u{width}").ravel())
        at += width * length
    return out


def _pack_bytes(items: list[bytes]) -> bytes:
    return pack([np.fromiter(map(len, items), dtype=np.uint32, count=len(items)), np.frombuffer(b"".join(items), dtype=np.uint8)])


def _unpack_bytes(blob: bytes) -> list[bytes]:
    lengths, data = unpack(blob)
    ends = np.cumsum(lengths.astype(np.int64)).tolist()
    data = data.tobytes()
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


PIECE = "chunk long, bucket int, data binary"


def encode(docs: DataFrame, path: str, pattern: str, buckets: int | None = None, chunk_words: int = 1_000_000) -> DataFrame:
    """(doc_id, ids array<int>) of docs' doc_id and text by the ranks in the file ``path``. ``buckets`` of distinct words: by default
    four for each shuffle partition, 256 at least."""
    return _encoded(docs, path, pattern, buckets, chunk_words, lambda batches: batches, "doc_id long, ids array<int>")


def _encoded(docs: DataFrame, path: str, pattern: str, buckets: int | None, chunk_words: int, finish, shape: str) -> DataFrame:
    """What ``finish`` makes of a run's batches of (doc_id, ids), in the task and worker that put them together."""
    spark = docs.sparkSession
    buckets = buckets or max(256, 4 * partitions(docs))
    docs = docs.select("doc_id", "text")
    ranks = spark.sparkContext.broadcast(load_ranks(path))  # a vocabulary: of fixed size
    piece, done, target = (arrow_schema(spark, x) for x in (PIECE, "doc_id long, ids array<int>", shape))

    def distinct_words(batches):
        for chunk, _, _, _, words in _chunks(batches, pattern, chunk_words):
            if not words:
                continue
            data, order, bucket = _order(words, buckets)
            starts = np.flatnonzero(np.diff(bucket, prepend=-1))
            blobs = [_pack_bytes([data[i] for i in order[a:b]]) for a, b in zip(starts, [*starts[1:], len(order)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(blobs), pa.int64()), pa.array(bucket[starts].astype(np.int32)), pa.array(blobs, pa.binary())], schema=piece)

    def encoded_words(batches):
        encoder, bucket, known = _encoder(pattern, ranks.value), None, {}
        for batch in batches:
            out = []
            for b, blob in zip(batch.column("bucket").to_pylist(), batch.column("data").to_pylist(), strict=True):
                if b != bucket:
                    bucket, known = b, {}
                rows = []
                for word in _unpack_bytes(blob):
                    if (ids := known.get(word)) is None:
                        ids = known[word] = np.array(encoder._encode_single_piece(word), dtype=np.uint32)
                    rows.append(ids)
                out.append(pack([np.fromiter(map(len, rows), dtype=np.uint32, count=len(rows)), np.concatenate(rows)]))
            yield pa.RecordBatch.from_arrays([batch.column("chunk"), batch.column("bucket"), pa.array(out, pa.binary())], schema=piece)

    def positions(batches):
        for chunk, ids, codes, lengths, words in _chunks(batches, pattern, chunk_words):
            _, order, _ = _order(words, buckets)
            place = np.empty(len(order), dtype=np.uint32)
            place[order] = np.arange(len(order), dtype=np.uint32)
            known = np.fromiter((x is not None for x in ids), dtype=np.uint8, count=len(ids))
            blob = pack([place[codes] if len(codes) else codes, np.array(lengths, dtype=np.uint32), np.array([x or 0 for x in ids], dtype=np.int64).view(np.uint64), known])
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([-1], pa.int32()), pa.array([blob], pa.binary())], schema=piece)

    def together(encoded: pa.Table, positioned: pa.Table) -> pa.Table:
        codes, lengths, ids, known = unpack(positioned.column("data")[0].as_py())
        both = [unpack(blob) for _, blob in sorted(zip(encoded.column("bucket").to_pylist(), encoded.column("data").to_pylist(), strict=True))]
        size = np.concatenate([x[0] for x in both]).astype(np.int64) if both else np.zeros(0, np.int64)
        flat = np.concatenate([x[1] for x in both]).astype(np.int32) if both else np.zeros(0, np.int32)
        start = np.cumsum(size) - size
        ends = np.concatenate(([0], np.cumsum(lengths.astype(np.int64))))
        doc, parts = pa.array(ids.view(np.int64), mask=known == 0), []
        for a, b in _runs(ends):  # a run of documents at a time
            mine = codes[ends[a] : ends[b]]
            per_word = size[mine]
            to = np.concatenate(([0], np.cumsum(per_word)))
            gather = np.repeat(start[mine] - to[:-1], per_word) + np.arange(to[-1])
            offsets = to[ends[a : b + 1] - ends[a]].astype(np.int32)
            parts.append(pa.RecordBatch.from_arrays([doc.slice(a, b - a), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat[gather]))], schema=done))
        return pa.Table.from_batches(list(finish(parts)), schema=target)

    n = partitions(docs)
    words = docs.mapInArrow(distinct_words, PIECE)
    ids = words.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(encoded_words, PIECE)
    # Each side is dealt from a stage of its own, whose partitions are those of docs; so both passes number the runs alike.
    return ids.groupBy("chunk").cogroup(docs.mapInArrow(positions, PIECE).groupBy("chunk")).applyInArrow(together, shape)


def _runs(offsets: np.ndarray, most: int = 1 << 18):
    """Runs of documents of about ``most`` words, so that no Arrow batch grows with the chunk."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        yield a, min(b, n)
        a = b


def token_bytes(ranks: dict[bytes, int]) -> list[bytes]:
    """The token-byte table: the bytes of each id."""
    table: list[bytes] = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        table[i] = token
    return table


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, data binary): the bytes that the ids stand for."""
    spark = encoded.sparkSession
    tokens = spark.sparkContext.broadcast(token_bytes(load_ranks(path)))
    shape = "doc_id long, ids array<int>, data binary"
    target = arrow_schema(spark, shape)

    def run(batches):
        of = tokens.value
        for batch in pieces(batches):
            texts = [b"".join([of[i] for i in ids]) for ids in _lists(batch.column("ids"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(texts, pa.binary())], schema=target)

    return encoded.select("doc_id", "ids").mapInArrow(run, shape)


def _lists(column) -> list[list[int]]:
    flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_pylist()
    return [flat[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)]


DIGESTS = "doc_id long, ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _digester(spark: SparkSession, path: str):
    target = arrow_schema(spark, DIGESTS)
    tokens = spark.sparkContext.broadcast(token_bytes(load_ranks(path)))

    def run(batches):
        of = tokens.value
        decimal = [b"%d" % i for i in range(len(of))]
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in pieces(batches):
            lists = _lists(batch.column("ids"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array([len(x) for x in lists], pa.int64()), pa.array([sha(b",".join([decimal[i] for i in x])) for x in lists]), pa.array([sha(b"".join([of[i] for i in x])) for x in lists])], schema=target)

    return run


def digests(encoded: DataFrame, path: str) -> DataFrame:
    """Per document: ids, n_tokens, and the SHA-256 of the decimal ids joined by commas and of the decoded bytes."""
    return encoded.mapInArrow(_digester(encoded.sparkSession, path), DIGESTS)


def encoded_digests(docs: DataFrame, path: str, pattern: str, buckets: int | None = None, chunk_words: int = 1_000_000) -> DataFrame:
    """``digests`` of ``encode``. Both steps run in one Python worker for each task, not in two that are in memory at once."""
    return _encoded(docs, path, pattern, buckets, chunk_words, _digester(docs.sparkSession, path), DIGESTS)


def op6_byte_bpe(spark: SparkSession, sf_dir: str, path: str | None = None, pattern: str | None = None) -> DataFrame:
    import public_tokenizers

    path = path or public_tokenizers.path(VOCABULARY)
    done = encoded_digests(table(spark, sf_dir, "documents"), path, pattern or public_tokenizers.PATTERN)
    return done.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
