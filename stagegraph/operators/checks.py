"""Quality checks: ``checks(check_id, stage, name, branch, passed, override, comment)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def failed() -> Column:
    """Neither passed nor overridden."""
    return ~F.coalesce("passed", F.lit(False)) & ~F.coalesce("override", F.lit(False))


def summary(checks: DataFrame, by: list[str]) -> DataFrame:
    return checks.groupBy(*by).agg(F.count("*").alias("n_checks"), F.count_if(failed()).alias("n_failed"))


def overridden(checks: DataFrame, which: DataFrame) -> DataFrame:
    """Checks named in ``which(check_id, comment)`` are overridden with the comment."""
    new = which.select("check_id", F.col("comment").alias("_comment"), F.lit(True).alias("_named"))
    return checks.join(new, "check_id", "left").withColumn("override", F.coalesce("_named", "override")).withColumn("comment", F.coalesce("_comment", "comment")).drop("_named", "_comment")


def due(checks: DataFrame, inputs: DataFrame) -> DataFrame:
    """Checks that have not run since their newest input changed; ``inputs(check_id, ts)``, ``checks(check_id, executed)``."""
    newest = inputs.groupBy("check_id").agg(F.max("ts").alias("_newest"))
    return checks.join(newest, "check_id", "left").where(F.col("executed").isNull() | (F.col("_newest") > F.col("executed"))).drop("_newest")
