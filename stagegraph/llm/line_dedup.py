"""Line dedup: sharded cuckoo filters backed by exact reference-count tables, so that insertions and document deletions are reversible.

State (two tables, both DataFrames that a caller may write anywhere):

* ``counts(key binary, shard int, n_docs long, top_doc long)``: the exact reference counts. ``key`` is the SHA-256 of a line's key,
  ``n_docs`` the documents that hold it, ``top_doc`` the largest id among them.
* ``filters(shard int, blob binary, n long)``: for each shard a cuckoo filter of its keys.

``inserted`` and ``deleted`` return both after a batch of documents. A shard's filter answers "certainly new" without a look at the
counts; every "maybe" is settled by the exact table, so a false positive of the filter never reaches a result. Only shards whose keys
changed get a new filter: ``add`` takes the new keys, ``remove`` those whose count reached zero, and a filter that is full is built from
the exact counts. Filters of an earlier state must not be used with later counts. Deletion lowers the counts and finds the largest
remaining holder from the remaining documents.

Lines are split, trimmed, lower-cased, measured and hashed by built-in functions; only filters are Python. A shard's lines stream past
its filter, and a shard with many lines is dealt to several tasks.

Defined cases: a null or empty text is one empty line; a document is a doc_id, so rows that repeat an id are one document, whose rows
must come in one batch, and each row has a row in the result; a null doc_id is one id, before all others; keys shorter than
``min_chars`` code points are never dropped; an empty table gives an empty result, empty counts and no filters; a text of any length is
whole; further columns are carried, also those that are called like the operator's own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stagegraph.llm.common import doc_key, partitions, table, written
from stagegraph.llm.tokens import mix

SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
COUNTS = "key binary, shard int, n_docs long, top_doc long"
FILTERS = "shard int, blob binary, n long"


class CuckooFilter:
    """Buckets of four 16-bit fingerprints with partial-key cuckoo hashing; supports deletion.

    A key is a 64-bit hash. ``kicks`` bounds an insertion's walk; when it ends without a place, the filter doubles from ``hashes``.
    """

    SLOTS = 4

    def __init__(self, n: int, kicks: int = 500):
        self.buckets = 1 << max(1, int(np.ceil(np.log2(max(1, n) / (self.SLOTS * 0.85)))))
        self.table = np.zeros((self.buckets, self.SLOTS), dtype=np.uint16)
        self.kicks = kicks

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        hashes = np.asarray(hashes, dtype=np.uint64)
        mark = ((hashes >> np.uint64(48)).astype(np.uint16)) | np.uint16(1)
        one = (hashes & np.uint64(self.buckets - 1)).astype(np.int64)
        return mark, one, self.other(one, mark)

    def other(self, bucket, mark):
        return bucket ^ (mix(np.asarray(mark, dtype=np.uint64)) & np.uint64(self.buckets - 1)).astype(np.int64)

    def add(self, hashes: np.ndarray) -> bool:
        """False if there was no room; the caller then builds a larger filter from its exact table."""
        mark, one, two = self.places(hashes)
        rest = np.arange(len(mark))
        for bucket in (one, two):  # whole columns first: the first comer of each bucket takes a free slot
            for slot in range(self.SLOTS):
                free = rest[self.table[bucket[rest], slot] == 0]
                _, firsts = np.unique(bucket[free], return_index=True)
                taken = free[firsts]
                self.table[bucket[taken], slot] = mark[taken]
                rest = np.setdiff1d(rest, taken, assume_unique=True)
        return all(self._walk(int(mark[i]), int(two[i])) for i in rest)

    def _walk(self, mark: int, bucket: int) -> bool:
        for step in range(self.kicks):
            row = self.table[bucket]
            if len(free := np.flatnonzero(row == 0)):
                row[free[0]] = mark
                return True
            slot = step % self.SLOTS
            mark, row[slot] = int(row[slot]), mark
            bucket = int(self.other(np.array([bucket]), np.array([mark]))[0])
        return False

    def has(self, hashes: np.ndarray) -> np.ndarray:
        mark, one, two = self.places(hashes)
        return (self.table[one] == mark[:, None]).any(1) | (self.table[two] == mark[:, None]).any(1)

    def remove(self, hashes: np.ndarray) -> None:
        for m, *both in zip(*(x.tolist() for x in self.places(hashes)), strict=True):
            for b in both:
                if len(at := np.flatnonzero(self.table[b] == m)):
                    self.table[b, at[0]] = 0
                    break

    def dump(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def load(cls, blob: bytes) -> CuckooFilter:
        made = cls(1)
        made.table = np.frombuffer(blob, dtype=np.uint16).reshape(-1, cls.SLOTS).copy()
        made.buckets = len(made.table)
        return made

    @classmethod
    def of(cls, hashes: np.ndarray) -> CuckooFilter:
        room = len(hashes)
        while True:
            made = cls(room)
            if made.add(hashes):
                return made
            room = 2 * max(1, room)


def split_lines(text: Column | str = "text") -> Column:
    return F.split(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def keyed_lines(docs: DataFrame, min_chars: int, *more: Column) -> DataFrame:
    """(doc, *more, n, key): the n-th line's key where it is long enough, as the SHA-256 of its text."""
    own = docs.select(doc_key().alias("doc"), *more, F.posexplode(F.transform(split_lines(), line_key)).alias("n", "line"))
    rest = [c for c in own.columns if c != "line"]
    return own.where(F.char_length("line") >= min_chars).select(*rest, F.unhex(F.sha2(F.col("line").cast("binary"), 256)).alias("key"))


def _sharded(keys: DataFrame, shards: int) -> DataFrame:
    return keys.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))


def deltas(docs: DataFrame, shards: int, min_chars: int) -> DataFrame:
    """The counts that a batch of documents adds, one row a key. Documents are told apart in groups of (key, doc) first, so a key that a
    third of all documents hold is dealt evenly, and is one row for each task in the second step."""
    each = keyed_lines(docs, min_chars).select("doc", "key").distinct()
    return _sharded(each.groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc").alias("top_doc")), shards).select("key", "shard", "n_docs", "top_doc")


def _hashes(keys) -> np.ndarray:
    return np.frombuffer(b"".join(k[:8] for k in keys), dtype="<u8") if len(keys) else np.zeros(0, dtype=np.uint64)


def build_filters(counts: DataFrame) -> DataFrame:
    """A cuckoo filter for each shard of exact counts; a shard is a bounded number of distinct keys, as ``shards_for`` sizes it."""

    def build(key: tuple, keys: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": [key[0]], "blob": [CuckooFilter.of(_hashes(keys["key"])).dump()], "n": [len(keys)]})

    return counts.select("shard", "key").groupBy("shard").applyInPandas(build, FILTERS)


def probed(rows: DataFrame, filters: DataFrame, n: int, salts: DataFrame | None = None) -> DataFrame:
    """``rows(shard, key, ...)`` with ``maybe``: whether the shard's filter may hold the key; false where the shard has no filter.

    A shard's filter meets its rows in one partition for each salt, as a row that sorts before them; rows stream past it, so a very
    frequent key costs no memory. ``salts(shard, salts)`` is of a row a shard at most.
    """
    names = rows.columns
    one = filters.select("shard", F.lit(1).alias("salts")) if salts is None else salts
    one = F.broadcast(one)  # a row a shard at most, as many as shuffle partitions
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema if f.name != "shard"]
    held = filters.join(one, "shard").select("shard", *blank, F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("__salt"), "blob")
    asked = rows.join(one, "shard", "left").select("shard", *[c for c in names if c != "shard"], F.pmod(F.xxhash64(*[c for c in names if c != "shard"]), F.coalesce("salts", F.lit(1))).cast("int").alias("__salt"), F.lit(None).cast("binary").alias("blob"))
    both = held.unionByName(asked).repartition(n, "shard", "__salt").sortWithinPartitions("shard", "__salt", F.col("blob").isNull())
    shape = rows.select(*names, F.lit(True).alias("maybe")).schema

    def probe(batches):
        place, now = None, None
        for batch in batches:
            shards = (np.asarray(batch.column("shard")).astype(np.int64) << 32) | np.asarray(batch.column("__salt"))
            edges = np.flatnonzero(np.diff(shards)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(shards)], strict=True):
                if a == b:
                    continue
                if shards[a] != place:
                    place, now = shards[a], None
                if (blob := batch.column("blob")[a].as_py()) is not None:
                    now, a = CuckooFilter.load(blob), a + 1
                if a < b:
                    part = batch.slice(a, b - a)
                    seen = now.has(_hashes(part.column("key").to_pylist())) if now is not None else np.zeros(b - a, dtype=bool)
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(seen)], names=[*names, "maybe"])

    return both.mapInArrow(probe, shape)


def insert(counts: DataFrame | None, filters: DataFrame | None, docs: DataFrame, shards: int, min_chars: int = 40) -> tuple[DataFrame, DataFrame | None]:
    """(counts, changes) after a batch of documents. With an empty state the counts are the batch's own and changes are None; else each
    shard's filter parts the batch's keys into certainly new ones, which are appended, and ones that are looked up in the counts.
    ``changes(shard, key, add)``: the keys that the filters must take or forget."""
    new = deltas(docs, shards, min_chars)
    if counts is None or filters is None:
        return new, None
    known = written(probed(new, filters, partitions(docs)))
    maybe = known.where("maybe").alias("m")
    settled = counts.alias("o").join(maybe, "key", "full_outer").select(
        "key", F.coalesce("o.shard", "m.shard").alias("shard"), (F.coalesce("o.n_docs", F.lit(0)) + F.coalesce("m.n_docs", F.lit(0))).alias("n_docs"),
        F.greatest("o.top_doc", "m.top_doc").alias("top_doc"), F.col("o.key").isNull().alias("first"),
    )
    after = written(settled.unionByName(known.where("NOT maybe").select("key", "shard", "n_docs", "top_doc", F.lit(True).alias("first"))))
    return after.drop("first"), after.where("first").select("shard", "key", F.lit(True).alias("add"))


def delete(counts: DataFrame, removed: DataFrame, remaining: DataFrame, shards: int, min_chars: int = 40) -> tuple[DataFrame, DataFrame]:
    """(counts, changes) after ``removed`` (documents inserted before) have gone; ``remaining`` are the documents that stay. Only keys
    whose largest holder has gone are looked for among ``remaining``."""
    gone = deltas(removed, shards, min_chars).select("key", F.col("n_docs").alias("less"), F.col("top_doc").alias("gone_top"))
    left = written(counts.join(gone, "key", "left").withColumn("n_docs", F.col("n_docs") - F.coalesce("less", F.lit(0))))
    stay = left.where("n_docs > 0")
    open_keys = stay.where(F.col("gone_top") == F.col("top_doc")).select("key")
    tops = keyed_lines(remaining, min_chars).join(open_keys, "key", "left_semi").groupBy("key").agg(F.max("doc").alias("new_top"))
    after = stay.join(tops, "key", "left").select("key", "shard", "n_docs", F.coalesce("new_top", "top_doc").alias("top_doc"))
    return after, left.where("n_docs <= 0").select("shard", "key", F.lit(False).alias("add"))


def changed_filters(filters: DataFrame, changes: DataFrame, after: DataFrame) -> DataFrame:
    """The filters of ``after`` (counts): those of shards with ``changes`` take and forget keys, the others stay as they are."""

    def update(key: tuple, old: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
        if not len(keys):
            return old[["shard", "blob", "n"]]
        add, gone = _hashes(keys.loc[keys["add"], "key"]), _hashes(keys.loc[~keys["add"], "key"])
        if not len(old):
            return pd.DataFrame({"shard": [key[0]], "blob": [CuckooFilter.of(add).dump()], "n": [len(add)]})
        made = CuckooFilter.load(old["blob"].iloc[0])
        made.remove(gone)
        fits = made.add(add)
        return pd.DataFrame({"shard": [key[0]], "blob": [made.dump() if fits else None], "n": [old["n"].iloc[0] + len(add) - len(gone)]})

    new = written(filters.groupBy("shard").cogroup(changes.groupBy("shard")).applyInPandas(update, FILTERS))
    full = new.where("blob IS NULL").select("shard")
    return new.where("blob IS NOT NULL AND n > 0").unionByName(build_filters(after.join(full, "shard", "left_semi")))


def inserted(counts: DataFrame | None, filters: DataFrame | None, docs: DataFrame, shards: int, min_chars: int = 40) -> tuple[DataFrame, DataFrame]:
    """(counts, filters) after a batch of documents."""
    after, changes = insert(counts, filters, docs, shards, min_chars)
    after = written(after)
    return after, written(build_filters(after) if changes is None else changed_filters(filters, changes, after))


def deleted(counts: DataFrame, filters: DataFrame, removed: DataFrame, remaining: DataFrame, shards: int, min_chars: int = 40) -> tuple[DataFrame, DataFrame]:
    """(counts, filters) after ``removed`` have gone."""
    after, changes = delete(counts, removed, remaining, shards, min_chars)
    after = written(after)
    return after, written(changed_filters(filters, changes, after))


def shards_for(docs: DataFrame) -> int:
    return partitions(docs)


def cleaned(docs: DataFrame, min_docs: int = 5, min_chars: int = 40, shards: int | None = None) -> DataFrame:
    """(row struct of docs' columns, text, n_lines, n_dropped): lines whose key at least ``min_docs`` documents hold go everywhere but
    in the largest doc_id.

    The documents are inserted into an empty state. The filters of the heavy keys part the documents' lines: only a line that its
    shard's filter may hold is joined with the exact counts. A row's dropped lines come back as their places in it.
    """
    n, shards = partitions(docs), shards or shards_for(docs)
    counts, _ = insert(None, None, docs, shards, min_chars)
    heavy = written(counts.where(F.col("n_docs") >= min_docs))
    same = F.substring(F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)), 1, 16)  # rows of one id and text are alike
    lines = _sharded(keyed_lines(docs, min_chars, same.alias("same")), shards)
    maybe = probed(lines, build_filters(heavy), n, _salts(heavy, n)).where("maybe")
    drops = maybe.join(heavy.select("key", "top_doc"), "key").where(F.col("doc") != F.col("top_doc"))
    places = drops.groupBy("doc", "same").agg(F.array_sort(F.collect_set("n")).alias("gone"))  # at most a text's lines
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), doc_key().alias("doc"), same.alias("same"))
    joined = rows.join(places.hint("shuffle_hash"), ["doc", "same"], "left").select("row", split_lines(F.col("row.text")).alias("lines"), "gone")
    before = F.concat(F.array(F.lit(-1)), "gone")
    gaps = F.arrays_zip(before.alias("a"), F.concat("gone", F.array(F.size("lines"))).alias("b"))
    kept = F.flatten(F.transform(gaps, lambda g: F.slice("lines", g["a"] + 2, g["b"] - g["a"] - 1)))
    text = F.when(F.col("gone").isNull(), F.coalesce("row.text", F.lit(""))).otherwise(F.array_join(kept, "\n"))
    return joined.select("row", text.alias("text"), F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))


def drop_lines(docs: DataFrame, min_docs: int = 5, min_chars: int = 40, shards: int | None = None) -> DataFrame:
    """docs' columns with ``text`` cleaned; all others are as they were."""
    done = cleaned(docs, min_docs, min_chars, shards)
    return done.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def _salts(heavy: DataFrame, n: int) -> DataFrame:
    """(shard, salts): into how many parts a shard's lines are dealt, so that the lines of a very frequent key are many tasks' work. A part
    gets four times the mean at most."""
    loads = heavy.groupBy("shard").agg(F.sum("n_docs").alias("load"))
    total = loads.agg(F.coalesce(F.sum("load"), F.lit(0)).alias("n")).first().n
    return loads.select("shard", F.ceil(F.col("load") / max(1024, 4 * total // n)).cast("int").alias("salts"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = cleaned(table(spark, sf_dir, "documents"))
    return done.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents),
keyed AS (
  SELECT doc_id, i, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
heavy AS (
  SELECT k, max(doc_id) AS top FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
judged AS (
  SELECT keyed.*, heavy.top IS NOT NULL AND heavy.top <> doc_id AS gone FROM keyed LEFT JOIN heavy USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
