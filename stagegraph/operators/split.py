"""Splitting files into keyed, ordered groups by a wildcard pattern or a regular expression.

In a pattern, ``%`` is a part of the key, ``*`` anything and ``#`` digits; none of them crosses a '/'. A wildcard is lazy if a literal
character follows it. Groups are in natural order by default: numbers count as numbers. The order ``first_digit`` compares only the
first digit of parts that begin with one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagegraph.functions.scalars import file_name


@dataclass(frozen=True)
class SplitPattern:
    """A compiled pattern: its regular expression, which groups are the key, and whether it looks at whole paths."""

    regex: str
    keys: tuple[int, ...]
    groups: int
    whole_path: bool = False


def compile_pattern(pattern: str) -> SplitPattern:
    """Compile a wildcard pattern. Wildcards side by side are refused, as nothing says where one ends."""
    parts = re.split(r"([%*#])", pattern)
    literals, wild = parts[0::2], parts[1::2]
    if any(x == "" for x in literals[1:-1]):
        raise ValueError(f"wildcards without a character between them: {pattern}")
    out, keys = [literals[0].replace(".", r"\.")], []
    for i, kind in enumerate(wild):
        after = literals[i + 1]
        if kind == "%":
            keys.append(i)
        out.append(f"({'[0-9]' if kind == '#' else '[^/]'}*{'?' if after else ''})")
        out.append(after.replace(".", r"\."))
    return SplitPattern("".join(out), tuple(keys), len(wild), "/" in pattern)


def regex_pattern(regex: str) -> SplitPattern:
    """A regular expression whose first group is the key."""
    return SplitPattern(regex, (0,), re.compile(regex).groups, "/" in regex)


def subject(pattern: SplitPattern, path: Column | str = "path") -> Column:
    return (F.col(path) if isinstance(path, str) else path) if pattern.whole_path else file_name(path)


def key(pattern: SplitPattern, path: Column | str = "path") -> Column:
    """The key of a path: the key groups joined by '.', or 'all' without any."""
    name = subject(pattern, path)
    if not pattern.keys:
        return F.lit("all")
    return F.concat_ws(".", *[F.regexp_extract(name, pattern.regex, i + 1) for i in pattern.keys])


def sort_key(pattern: SplitPattern, path: Column | str = "path", order: str = "natural") -> Column:
    """An array to order the files of a group by: for each wildcard that is not the key, (number or first digit, text)."""
    name, out = subject(pattern, path), []
    for i in range(pattern.groups):
        if i in pattern.keys:
            continue
        part = F.regexp_extract(name, pattern.regex, i + 1)
        digits = F.regexp_extract(part, r"^(\d)" if order == "first_digit" else r"^(\d{1,18})", 1).try_cast("long")
        text = F.when(digits.isNotNull(), F.lit("") if order == "first_digit" else F.regexp_replace(part, r"^\d{1,18}", "")).otherwise(part)
        out.append(F.struct(F.coalesce(digits, F.lit(2**62)).alias("number"), text.alias("text")))
    return F.array(*out) if out else F.array(F.struct(F.lit(0).cast("long").alias("number"), F.lit("").alias("text")))


def split(files: DataFrame, pattern: SplitPattern, order: str = "natural", tie: str = "ord") -> DataFrame:
    """(key, path, place): the files that match, with their place in their group; other files are dropped.

    Rows stay rows: a group is a key and never an array, so a group of any size is spread like any other rows.
    """
    from pyspark.sql import Window

    found = files.where(subject(pattern).rlike(pattern.regex)).withColumn("key", key(pattern)).withColumn("_by", sort_key(pattern, order=order))
    place = F.row_number().over(Window.partitionBy("key").orderBy("_by", tie)) - 1
    return found.withColumn("place", place).drop("_by")
