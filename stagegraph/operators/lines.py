"""Line and row operators. Lines that start with '#' are comments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_comment(line: Column | str = "line") -> Column:
    return (F.col(line) if isinstance(line, str) else line).startswith("#")


def grep(lines: DataFrame, pattern: str) -> DataFrame:
    """Lines in which the pattern is found; comments never are."""
    return lines.where(~is_comment() & F.col("line").rlike(pattern))


def filter_lines(lines: DataFrame, predicate: Column) -> DataFrame:
    """Comments, and the lines that meet the predicate."""
    return lines.where(is_comment() | predicate)


def filter_rows(lines: DataFrame, columns: list[str], predicate) -> DataFrame:
    """Comments, and the tab-separated rows for which ``predicate(named columns)`` holds; rows come out as lines again."""
    cells = F.split("line", "\t", -1)
    named = {name: F.get(cells, i) for i, name in enumerate(columns)}
    return lines.where(is_comment() | predicate(named))


def without_runs(rows: DataFrame, value: str, order: list[str], partition: list[str] | None = None) -> DataFrame:
    """Rows whose value differs from the one before; a null never hides its successor."""
    from pyspark.sql import Window

    before = F.lag(value).over(Window.partitionBy(*(partition or [F.lit(0)])).orderBy(*order))
    return rows.withColumn("_before", before).where(F.col("_before").isNull() | ~F.col("_before").eqNullSafe(F.col(value))).drop("_before")


def last_lines(lines: DataFrame, by: list[str], order: str, k: int = 5) -> DataFrame:
    """The last k lines of each key; Spark keeps k a key in each task before the shuffle."""
    from pyspark.sql import Window

    return lines.withColumn("from_end", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order)))).where(F.col("from_end") <= k)
