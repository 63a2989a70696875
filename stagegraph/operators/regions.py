"""Interval sets: (chr, start, end) rows with start <= end, half-open in size and closed in overlap."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def padded(bed: DataFrame, by: int) -> DataFrame:
    """Each interval widened on both sides; a start never falls below zero."""
    return bed.withColumn("start", F.greatest(F.col("start") - by, F.lit(0).cast("long"))).withColumn("end", F.col("end") + by)


def partition(bed: DataFrame, size: int, zero_tails: bool = False) -> DataFrame:
    """Intervals cut into parts of ``size``; ``zero_tails`` keeps the empty last part where the size divides the length."""
    stop = F.col("end") if zero_tails else F.greatest(F.col("end") - 1, F.col("start"))
    return bed.withColumn("part_start", F.explode(F.sequence("start", stop, F.lit(size).cast("long")))).withColumn("part_end", F.least(F.col("part_start") + size, "end"))


def text(chr_: Column | str = "chr", start: Column | str = "start", end: Column | str = "end") -> Column:
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return F.concat(c(chr_), F.lit(":"), c(start).cast("string"), F.lit("-"), c(end).cast("string"))


def region_id(value: Column | str) -> Column:
    """The first eight hex digits of a text's SHA-1; 'empty' for a blank one."""
    value = F.col(value) if isinstance(value, str) else value
    return F.when(F.trim(value) == "", "empty").otherwise(F.substring(F.sha1(value.cast("binary")), 1, 8))


def summary(bed: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Extent, number of chromosomes and total size of a set, or of each key's set."""
    return bed.groupBy(*(by or [])).agg(F.min("start").alias("range_from"), F.max("end").alias("range_to"), F.countDistinct("chr").alias("n_chr"), F.sum(F.abs(F.col("end") - F.col("start"))).alias("total_size"))


def overlaps(left: DataFrame, right: DataFrame, bin_size: int) -> DataFrame:
    """Pairs of intervals on one chromosome that share a point. Both sides are cut into bins and meet in an equi-join on (chr, bin); a
    pair is reported in the bin of its later start, so once. ``left``: (chr, start, end, l_id), ``right``: with r_id."""
    bins = lambda d: d.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / bin_size), F.floor(F.col("end") / bin_size))))
    a, b = bins(left).alias("a"), bins(right).alias("b")
    met = a.join(b, (F.col("a.chr") == F.col("b.chr")) & (F.col("a.bin") == F.col("b.bin")) & (F.col("a.start") <= F.col("b.end")) & (F.col("b.start") <= F.col("a.end")))
    return met.where(F.col("a.bin") == F.floor(F.greatest("a.start", "b.start") / bin_size)).select(F.col("a.chr").alias("chr"), "l_id", "r_id", F.greatest("a.start", "b.start").alias("start"), F.least("a.end", "b.end").alias("end"))


def whole_chromosomes(labels: DataFrame, sizes: DataFrame) -> DataFrame:
    """Each label with its region ``chr:0-size``, or the label itself where the size is not known."""
    return labels.join(sizes, "chr", "left").withColumn("region", F.coalesce(text("chr", F.lit(0), "size"), "chr"))


def split_sequential(bed: DataFrame, parts: int, max_distance: int) -> DataFrame:
    """Parts of about total / ``parts``, in order of (chr, start). A part ends at a change of chromosome, at a gap of more than
    ``max_distance``, or when full: an interval that overfills a part of at least three quarters by more than a quarter is cut where
    the part is full. The running size starts anew at each such gap, so the spans between gaps, found by an ordered window, are scanned
    apart from each other; a part's number is that in its span after the parts of the spans before.
    """
    total = bed.agg(F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).alias("n")).first().n
    target = max(1, total // parts)
    line = Window.partitionBy("chr").orderBy("start", "end")
    rows = bed.select("chr", F.col("start").cast("long"), F.col("end").cast("long"))
    gap = F.coalesce(F.col("start") - F.lag("end").over(line) > max_distance, F.lit(False)).cast("int")
    spans = rows.withColumn("gap", gap).select("chr", "start", "end", F.sum("gap").over(line.rowsBetween(Window.unboundedPreceding, 0)).alias("span"))

    def scan(batches):
        now, held, part = None, 0, 0
        for rows in batches:
            out = []
            for *key, start, end in rows.itertuples(index=False):
                if key != now:
                    now, held, part = key, 0, 0
                while True:
                    size = end - start
                    if held * 4 < target * 3:
                        out.append((*key, part, start, end))
                        held += size
                    elif (held + size) * 4 <= target * 5:
                        out.append((*key, part, start, end))
                        part, held = part + 1, 0
                    elif 0 < target - held < size:
                        cut = start + target - held
                        out.append((*key, part, start, cut))
                        part, held, start = part + 1, 0, cut
                        continue
                    else:
                        part += 1
                        out.append((*key, part, start, end))
                        held = size
                    break
            yield pd.DataFrame(out, columns=["chr", "span", "part", "start", "end"])

    dealt = spans.repartition("chr", "span").sortWithinPartitions("chr", "span", "start", "end")  # rows stream, spans may be of any size
    made = dealt.select("chr", "span", "start", "end").mapInPandas(scan, "chr string, span long, part long, start long, end long")
    counts = made.groupBy("chr", "span").agg((F.max("part") + 1).alias("n"))
    before = counts.select("chr", "span", (F.sum("n").over(Window.partitionBy("chr").orderBy("span")) - F.col("n")).alias("before"))
    return made.join(before, ["chr", "span"]).select("chr", (F.col("part") + F.col("before")).alias("part"), "start", "end")


def split_balanced(bed: DataFrame, parts: int, by_chromosome: bool = False, allow_breaks: bool = True, most: int = 10_000) -> DataFrame:
    """(part, chr, start, end): ``parts`` sets of about equal size. Starts from one set for each interval, joins the two smallest while
    there are too many and halves the largest while there are too few; then evens out until the largest is at most twice the smallest.

    The rule is a global one over a region set (an interval file of a genome, bounded by its number of regions), so it runs as one
    group. A set of over ``most`` intervals is refused: sum it up first (``summary``, ``partition`` of extents), as the query does.
    """
    if bed.limit(most + 1).count() > most:
        raise ValueError(f"a balanced split takes at most {most} intervals")

    def size(s):
        return sum(b - a for _, a, b in s)

    def halves(s):
        """Two parts of a set, or None if no fair cut exists."""
        one, two = [], []
        for x in sorted(s, key=lambda r: (r[1] - r[2], r)):
            (one if size(one) <= size(two) else two).append(x)
        if size(one) < size(two):
            one, two = two, one
        if allow_breaks and size(one) > 2 * size(two):
            for x in sorted(one, key=lambda r: (r[1] - r[2], r)):
                middle = (x[1] + x[2]) // 2
                rest = [y for y in one if y is not x]
                a, b = [*rest, (x[0], x[1], middle)], [*two, (x[0], middle, x[2])]
                if middle > x[1] and size(b) and 0.1 < size(a) / size(b) < 10:
                    one, two = (a, b) if size(a) >= size(b) else (b, a)
                    break
        return (one, two) if size(two) and 0.1 < size(one) / size(two) < 10 else None

    def joinable(sets):
        for i in range(len(sets) - 1, 0, -1):
            for j in range(i - 1, -1, -1):
                if not by_chromosome or {c for c, _, _ in sets[i]} & {c for c, _, _ in sets[j]}:
                    return j, i
        return None

    def join(sets):
        pair = joinable(sets)
        if pair is None:
            return None
        rest = [s for k, s in enumerate(sets) if k not in pair]
        return ordered([*rest, sets[pair[0]] + sets[pair[1]]])

    def ordered(sets):
        return sorted(sets, key=lambda s: (-size(s), sorted(s)))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        sets = ordered([[tuple(r)] for r in rows[["chr", "start", "end"]].itertuples(index=False)])
        while len(sets) > parts and (fewer := join(sets)) is not None:
            sets = fewer
        while len(sets) < parts and (two := halves(sets[0])) is not None:
            sets = ordered([*sets[1:], *two])
        for _ in range(len(sets)):
            if len(sets) < 2 or size(sets[0]) <= 2 * size(sets[-1]) or (two := halves(sets[0])) is None:
                break
            joined = join(ordered([*sets[1:], *two]))
            if joined is None or len(joined) != len(sets):
                break
            sets = joined
        return pd.DataFrame([(i, *x) for i, s in enumerate(sets) for x in sorted(s)], columns=["part", "chr", "start", "end"])

    return bed.select("chr", F.col("start").cast("long"), F.col("end").cast("long")).groupBy(F.lit(0).alias("_")).applyInPandas(lambda rows: run(rows), "part long, chr string, start long, end long")


def without_minor_contigs(bed: DataFrame) -> DataFrame:
    from stagegraph.functions.scalars import is_minor_contig

    return bed.where(~is_minor_contig("chr"))


def labels(*items, with_: str = "chr") -> list[str]:
    """Chromosome labels of numbers, ranges and names, each prefixed once."""
    flat = [str(x) for item in items for x in (item if isinstance(item, (range, list, tuple)) else [item])]
    return [x if x.startswith(with_) else with_ + x for x in flat]


def gene_extents(genes: DataFrame) -> DataFrame:
    """(chr, gene, start, end): the widest extent of each gene's rows."""
    return genes.groupBy("chr", "gene").agg(F.min("start").alias("start"), F.max("end").alias("end"))



def ordered(bed: DataFrame) -> DataFrame:
    """By size descending, then name descending, start, end."""
    return bed.orderBy(F.desc(F.col("end") - F.col("start")), F.desc("chr"), "start", "end")


def chromosome_rank(label: Column | str = "chr") -> Column:
    """A sort key: numbered labels by number, then X, Y and M, then all others by name."""
    name = F.regexp_replace(F.col(label) if isinstance(label, str) else label, "^chr", "")
    number = name.try_cast("int")
    known = F.when(number.isNotNull(), number).when(name == "X", 1_000_001).when(name == "Y", 1_000_002).when(name.isin("M", "MT"), 1_000_003)
    return F.struct(F.coalesce(known, F.lit(2_000_000)).alias("rank"), F.when(known.isNull(), name).otherwise("").alias("name"))
