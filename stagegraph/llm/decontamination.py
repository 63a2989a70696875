"""Benchmark decontamination by template canonicalisation: re-parameterised questions are found, not only verbatim ones.

1. ``Canon`` turns words into template tokens: numbers, names and units become typed placeholders; other words lose case and outer
   punctuation. A name is a capitalised word inside a sentence, a unit is a unit word after a number. A capitalised word that begins a
   sentence may be either: items have a window for each reading of theirs, documents one with all of them plain and one with all as names.
2. Windows of ``WIDTH`` template tokens of both sides meet in a hash join. The documents' windows first pass a bitmap of fixed size
   (``BITS``) of the benchmark's window hashes; it only saves rows, the join decides.
3. For each document, item and offset the slots must be consistent: each slot value of the item stands for one value of the document.
   Two values of the item may have become one in the document.
   Windows that both sides read plainly, and windows of any reading, are judged apart; so a second reading never undoes the first.
4. A pair is reported if consistent windows cover at least ``least`` of the item's tokens, or ``run`` tokens of it.

Items of fewer than WIDTH tokens are one window of their own length. A template window needs ``LITERALS`` ordinary words; all windows meet
by their literal tokens too (numbers, names and units as they are), so a verbatim copy is found whatever its words. An item of a single
token identifies nothing and is never reported.

Defined cases: null and empty texts have no windows; repeated rows of an id count as one document (or item); a null id is an id of its
own; an empty benchmark reports nothing; further columns are ignored; texts are whole at any length.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagegraph.llm.common import arrow_schema, pieces, record, table, utf8
from stagegraph.llm.tokens import blocks, span_hashes

WIDTH = 8
LITERALS = 4  # ordinary words that a template window needs
LITERAL = np.uint64(0x5851F42D4C957F2D)  # parts the hashes of literal tokens from those of template tokens
BITS = 1 << 24

# Unit words (only after a number) and number words.
UNITS = frozenset("mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres mg g kg t lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons ml cl l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years mph kph kmh w kw kwh v a hz khz mhz ghz b kb mb gb tb c f k °c °f percent % usd eur gbp dollar dollars euro euros cent cents degree degrees".split())
NUMBERS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split())

DROPPED, WORD, NUMBER, QUANTITY, UNIT, NAME = range(6)
_NUMBER = re.compile(r"[-+]?\d+(?:[.,:/]\d+)*(?:st|nd|rd|th)?")
_QUANTITY = re.compile(r"[-+]?\d+(?:[.,]\d+)*([^\W\d_]+|°[cf])", re.IGNORECASE)
_ASCII = bytes(c for c in range(128) if not chr(c).isalnum())
_CORE = re.compile(r"[^\W_](?:.*[^\W_])?", re.DOTALL)
_SLOT = np.array([xxhash.xxh64_intdigest(b"slot", kind) for kind in range(6)], dtype=np.uint64)


class Canon(dict):
    """Word (bytes) -> its number; for each number the kind, the hash of the plain form, whether a sentence ends, the plain form."""

    def __init__(self):
        self.kind, self.hash, self.ends, self.plain = [], [], [], []
        self.made = np.zeros(0, dtype=np.int8), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=bool)

    def __missing__(self, word: bytes) -> int:
        core = word.strip(_ASCII)
        if core.isalpha():  # ASCII letters between punctuation, as most words are: the same answers without patterns
            low = core.lower()
            plain = low.decode("ascii")
            if plain in NUMBERS:
                kind = NUMBER
            elif plain in UNITS:
                kind = UNIT
            else:
                kind = NAME if core[:1].isupper() and core[1:] and not core[1:].isupper() else WORD
            return self._add(word, kind, low, len(core) < len(word) and any(c in b".!?" for c in word[word.index(core) + len(core) :]), plain)
        text = word.decode("utf-8", "replace")
        found = _CORE.search(text)
        core = found[0] if found else ""
        low = core.lower()
        if not core:
            kind = DROPPED
        elif _NUMBER.fullmatch(low) or low in NUMBERS:
            kind = NUMBER
        elif (q := _QUANTITY.fullmatch(low)) and q[1] in UNITS:
            kind = QUANTITY
        elif low in UNITS:
            kind = UNIT
        elif core[:1].isupper() and core[1:] and not core[1:].isupper():
            kind = NAME
        else:
            kind = WORD
        return self._add(word, kind, low.encode("utf-8", "replace"), any(c in ".!?" for c in (text[found.end() :] if found else text)), low)

    def _add(self, word: bytes, kind: int, low: bytes, ends: bool, plain: str) -> int:
        self.kind.append(kind)
        self.hash.append(xxhash.xxh64_intdigest(low, 7))
        self.ends.append(ends)
        self.plain.append(plain)
        self[word] = number = len(self.kind) - 1
        return number

    def arrays(self):
        """The words' kinds, hashes and ends as arrays; only words that came since the last call are turned into arrays anew."""
        n = len(self.made[0])
        if n < len(self.kind):
            self.made = tuple(np.concatenate((old, np.array(of[n:], dtype=old.dtype))) for old, of in zip(self.made, (self.kind, self.hash, self.ends), strict=True))
        return self.made

    def templates(self, texts: list[bytes]):
        """Of texts without their dropped words: (token hashes, literal hashes, whether a slot, whether a capitalised word that begins a
        sentence, word numbers, the texts' n + 1 offsets)."""
        words = [t.split() for t in texts]
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        number = np.fromiter(map(self.__getitem__, itertools.chain.from_iterable(words)), dtype=np.int64, count=int(lengths.sum()))
        kind, plain, ends = (x[number] for x in self.arrays())
        text = np.repeat(np.arange(len(texts)), lengths)
        kept = kind != DROPPED
        stop = np.concatenate(([True], ends[:-1])) if len(ends) else ends
        count = np.cumsum(stop)  # a sentence begins if one has ended since the last kept word
        number, kind, plain, text, count = (x[kept] for x in (number, kind, plain, text, count))
        first = np.ones(len(number), dtype=bool)
        first[1:] = (text[1:] != text[:-1]) | (count[1:] != count[:-1])
        after = np.zeros(len(number), dtype=bool)
        after[1:] = (kind[:-1] == NUMBER) & (text[1:] == text[:-1])
        slot = (kind == NUMBER) | (kind == QUANTITY) | ((kind == UNIT) & after) | ((kind == NAME) & ~first)
        return np.where(slot, _SLOT[kind], plain), plain ^ LITERAL, slot, (kind == NAME) & first, number, np.searchsorted(text, np.arange(len(texts) + 1))

    def fit(self, most: int = 1 << 19) -> None:
        """Forget words between texts, before the table grows past its bound."""
        if len(self.kind) > most:
            self.clear()
            self.__init__()


def _windows(values, slot, bounds, width: int, least: int = LITERALS):
    """(start, text) of the windows with at least ``least`` ordinary words."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    plain = np.concatenate(([0], np.cumsum(~slot)))
    start = np.flatnonzero(plain[width:] - plain[:n] >= least)
    text = np.searchsorted(bounds, start, side="right") - 1
    inside = start + width <= bounds[text + 1]
    return start[inside], text[inside]


ITEMS = "h long, width int, item_id long, item_pos int, n_tokens int, item_slots array<string>, literal boolean, item_first boolean"


def item_windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    target = arrow_schema(benchmark.sparkSession, ITEMS)

    def run(batches):
        canon = Canon()
        for batch in pieces(batches):
            out, rows = {f.name: [] for f in target}, []
            for item, text in zip(batch.column("item_id").to_pylist(), utf8(batch.column("text").to_pylist()), strict=True):
                values, literal, slot, begins, number, bounds = canon.templates([text])
                n = len(values)
                w = min(width, n)
                if w < 2:
                    continue
                at = np.arange(n - w + 1)
                for s, h in enumerate(span_hashes(literal, at, at + w).view(np.int64).tolist()):
                    rows.append((h, w, item, s, n, [], True, True))
                for s in at.tolist():
                    open_ = s + np.flatnonzero(begins[s : s + w])
                    for names in itertools.product((False, True), repeat=len(open_)):  # 2 ** w at most
                        as_slot, tokens = slot[s : s + w].copy(), values[s : s + w].copy()
                        chosen = open_[list(names)] - s if len(open_) else open_
                        as_slot[chosen], tokens[chosen] = True, _SLOT[NAME]
                        if w - as_slot.sum() >= LITERALS:
                            h = int(span_hashes(tokens, np.array([0]), np.array([w])).view(np.int64)[0])
                            rows.append((h, w, item, s, n, [canon.plain[i] for i in number[s : s + w][as_slot]], False, not any(names)))
            for row in rows:
                for name, value in zip(out, row, strict=True):
                    out[name].append(value)
            yield record(out, target)

    return benchmark.select(F.col("item_id").cast("long"), "text").mapInArrow(run, ITEMS).dropDuplicates(["h", "item_id", "item_pos"])


def bitmap(hashes: DataFrame, bits: int = BITS) -> np.ndarray:
    """A bit for each hash, modulo ``bits``: bits / 8 bytes, whatever the number of hashes."""
    at = F.pmod("h", F.lit(bits))
    found = hashes.select(F.shiftright(at, 6).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(h, {bits}) & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    words = np.zeros(bits // 64, dtype=np.uint64)
    words[found.column("word").to_numpy()] = found.column("bit").to_numpy().view(np.uint64)
    return words


HITS = "h long, doc_id long, doc_pos int, doc_slots array<string>, doc_first boolean"


def doc_windows(docs: DataFrame, widths: list[int], words: np.ndarray) -> DataFrame:
    """The windows of docs whose hash the bitmap has."""
    spark = docs.sparkSession
    target, shared, bits = arrow_schema(spark, HITS), spark.sparkContext.broadcast(words), len(words) * 64

    def run(batches):
        canon, has = Canon(), shared.value
        for batch in pieces(batches):
            ids, texts = batch.column("doc_id").to_pylist(), utf8(batch.column("text").to_pylist())
            for first, some in blocks(texts, 1 << 19):
                values, literal, slot, begins, number, bounds = canon.templates(some)
                named, opened = np.where(begins, _SLOT[NAME], values), np.concatenate(([0], np.cumsum(begins)))
                readings = (values, slot, LITERALS, True), (named, slot | begins, LITERALS, False), (literal, slot, 0, True)
                for width, (tokens, as_slot, least, plainly) in itertools.product(widths, readings):
                    start, text = _windows(tokens, as_slot, bounds, width, least)
                    if not plainly:
                        other = opened[start + width] > opened[start]
                        start, text = start[other], text[other]
                    h = span_hashes(tokens, start, start + width)
                    at = h & np.uint64(bits - 1)  # as pmod of the signed long
                    seen = np.flatnonzero((has[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1))
                    if not len(seen):
                        continue
                    slots = [[canon.plain[i] for i in number[s : s + width][as_slot[s : s + width]]] if least else [] for s in start[seen].tolist()]
                    yield record({"h": h[seen].view(np.int64), "doc_id": [ids[first + t] for t in text[seen].tolist()], "doc_pos": start[seen] - bounds[text[seen]], "doc_slots": slots, "doc_first": np.full(len(seen), plainly)}, target)
                canon.fit()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, HITS)


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, least: float = 0.6, run: int = 20) -> DataFrame:
    """(doc_id, item_id, n_windows, n_covered, coverage, n_changed): the documents that hold an item of the benchmark, verbatim or with
    other slot values; n_changed counts the slots whose values differ."""
    items = item_windows(benchmark, width)
    widths = sorted(r.width for r in items.select("width").distinct().collect())  # at most WIDTH values
    hits = doc_windows(docs, widths, bitmap(items.select("h")))
    pairs = F.transform(F.arrays_zip("item_slots", "doc_slots"), lambda x: F.struct(x["item_slots"].alias("item"), x["doc_slots"].alias("doc")))
    joined = hits.join(items, "h").where(F.size("item_slots") == F.size("doc_slots"))
    judged = F.when(F.col("literal"), F.array(F.lit(0))).when(F.col("item_first") & F.col("doc_first"), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(2)))
    aligned = joined.withColumn("reading", F.explode(judged)).groupBy("doc_id", "item_id", "reading", (F.col("doc_pos") - F.col("item_pos")).alias("offset")).agg(
        F.max("n_tokens").alias("n_tokens"),
        F.collect_set(F.struct("item_pos", "width")).alias("windows"),  # at most the item's length
        F.array_distinct(F.flatten(F.collect_set(pairs))).alias("pairs"),
    )
    consistent = aligned.where(F.size("pairs") == F.size(F.array_distinct("pairs.item")))
    tokens = F.flatten(F.transform("windows", lambda w: F.sequence(w["item_pos"], w["item_pos"] + w["width"] - 1)))
    found = consistent.select("doc_id", "item_id", "reading", "n_tokens", F.explode(F.array_distinct(tokens)).alias("token"), F.size("windows").alias("n"), F.size(F.filter("pairs", lambda p: p["item"] != p["doc"])).alias("changed"))
    covered = found.groupBy("doc_id", "item_id").agg(F.max("n_tokens").alias("n_tokens"), F.countDistinct("token").alias("n_covered"), F.max("n").cast("long").alias("n_windows"), F.coalesce(F.min(F.when(F.col("reading") > 0, F.col("changed"))), F.lit(0)).cast("long").alias("n_changed"))
    share = F.col("n_covered") / F.col("n_tokens")
    return covered.where((share >= least) | (F.col("n_covered") >= run)).select("doc_id", "item_id", "n_windows", "n_covered", share.alias("coverage"), "n_changed")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
