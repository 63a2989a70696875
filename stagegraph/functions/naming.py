"""Output names as Column expressions over input paths."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagegraph.functions.scalars import col, ext, file_name, prefix


def collapsed(path: Column) -> Column:
    """Runs of dots made one, and a leading dot dropped."""
    return F.regexp_replace(F.regexp_replace(path, r"\.{2,}", "."), r"^\.", "")


def transform_name(path: Column | str, new_ext: str, branch: Column | str | None = None, stage: str = "stage") -> Column:
    """The name with its last extension replaced. A branch that the name does not have yet goes before the extension; where the result
    would be the input's own name, the stage's name does."""
    path = col(path)
    name = file_name(path)
    stem = prefix(name)
    if branch is not None:
        branch = col(branch)
        has = F.concat(F.lit("."), name, F.lit(".")).contains(F.concat(F.lit("."), branch, F.lit("."))) | name.startswith(branch)
        stem = F.when(branch.isNull() | (branch == "") | has, stem).otherwise(F.concat_ws(".", stem, branch))
    made = collapsed(F.concat(stem, F.lit(f".{new_ext}")))
    return F.when(made == name, collapsed(F.concat(stem, F.lit(f".{stage}.{new_ext}")))).otherwise(made)


def filter_name(path: Column | str, name: str) -> Column:
    """The name with ``.name`` before its last extension."""
    own = file_name(path)
    return F.when(own.contains("."), F.regexp_replace(own, r"(\.[^.]*)$", f".{name}$1")).otherwise(F.concat(own, F.lit(f".{name}")))


def merged_name(path: Column | str, branch: Column | str) -> Column:
    """The first ``.branch.`` of a name as ``.merge.``."""
    path, branch = col(path), col(branch)
    return F.regexp_replace(path, F.concat(F.lit(r"^(.*?)\Q."), branch, F.lit(r".\E")), F.lit("$1.merge."))


def in_folder(folder: str, name: Column | str) -> Column:
    return F.concat(F.lit(folder.rstrip("/") + "/"), file_name(name))


def substituted(path: Column | str, pattern: str, to: str) -> Column:
    """A name by a pattern whose groups the target names as $1, $2, ...; null where the pattern is not found."""
    name = file_name(path)
    return F.when(name.rlike(pattern), F.regexp_replace(F.regexp_extract(name, f"({pattern})", 1), f"^{pattern}$", to))


def n_to_m(files: DataFrame, targets: list[str], order: str = "ord") -> DataFrame:
    """``files(path, ord)`` mapped to target extensions: the k-th use of an extension takes file k modulo the number of files.

    All files share one output list, so the mapping is computed from positions, not by a loop over files.
    """
    n = files.count()
    spark = files.sparkSession
    uses, rows = {}, []
    for at, target in enumerate(targets):
        rows.append((at, target, uses.get(target, 0)))
        uses[target] = uses.get(target, 0) + 1
    wanted = spark.createDataFrame(rows, "at int, target string, turn int").withColumn("place", F.pmod("turn", F.lit(max(1, n))))
    from pyspark.sql import Window

    placed = files.withColumn("place", F.row_number().over(Window.orderBy(order)) - 1)  # a stage's own input list
    return wanted.join(placed, "place").select("at", "path", transform_name("path", "X").alias("_"), "target").withColumn("output", F.concat(prefix(file_name("path")), F.lit("."), F.col("target"))).drop("_")


def next_run_directory(existing: DataFrame, stem: str) -> str:
    """The next of ``stem`` with a four-digit number, from the names that exist."""
    number = F.regexp_extract("name", rf"^{re.escape(stem)}(\d+)$", 1).try_cast("int")
    last = existing.agg(F.max(number).alias("n")).first().n
    return f"{stem}{(last or 0) + 1:04d}"


def virtual_extension(files: DataFrame, mapping: dict[str, list[str]], wanted: str) -> DataFrame:
    """Files whose extension a virtual one stands for, ranked by the place in its list."""
    listed = files.sparkSession.createDataFrame([(e, i) for i, e in enumerate(mapping[wanted])], "ext string, rank int")
    return files.withColumn("ext", ext("path")).join(F.broadcast(listed), "ext")
