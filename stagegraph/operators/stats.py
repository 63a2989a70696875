"""Run statistics over ``commands(stage, branch, start_ms, stop_ms, exit_code, procs, bytes)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def duration() -> Column:
    return F.col("stop_ms") - F.col("start_ms")


def valid() -> Column:
    """A command that succeeded and has begun."""
    return (F.col("exit_code") == 0) & (F.col("start_ms") > 0)


def total(c: Column) -> Column:
    """The exact sum of longs. Milliseconds of some 30 million commands of days come to more than a long holds."""
    return F.sum(c.cast("decimal(20,0)"))


def stage_stats(commands: DataFrame) -> DataFrame:
    """Per stage: the number of all commands, and of the valid ones the durations, weight in seconds, input bytes and the extent
    relative to the run's first start. Stages without a valid command are left out."""
    ok = F.when(valid(), duration())
    per_stage = commands.groupBy("stage").agg(
        F.count("*").alias("n_commands"), F.count_if(valid()).alias("n_valid"), F.min(ok).alias("min_ms"), F.round(total(ok).cast("double") / F.nullif(F.count(ok), F.lit(0)), 3).alias("mean_ms"), F.max(ok).alias("max_ms"),
        F.floor(total(ok).cast("double") / 1000).cast("long").alias("weight_s"), F.max(F.when(valid(), F.col("procs"))).alias("max_procs"), F.sum(F.when(valid(), F.col("bytes"))).alias("input_bytes"),
        F.min(F.when(valid(), F.col("start_ms"))).alias("first_start"), F.max(F.when(valid(), F.col("stop_ms"))).alias("last_stop"),
        F.min(F.when(F.col("start_ms") > 0, F.col("start_ms"))).alias("any_start"),
    ).withColumn("run_start", F.min("any_start").over(Window.partitionBy(F.lit(0)))).where("n_valid > 0")
    return per_stage.select(  # the window is over the stages' rows
        "stage", "n_commands", "n_valid", "min_ms", "mean_ms", "max_ms", "weight_s", "max_procs", "input_bytes",
        (F.col("first_start") - F.col("run_start")).alias("rel_start"), (F.col("last_stop") - F.col("run_start")).alias("rel_end"),
    )


def run_totals(commands: DataFrame, now_ms: int) -> DataFrame:
    """Of the whole run: commands, whether all succeeded, command time, and CPU hours, in which a running command counts until now."""
    stop = F.coalesce("stop_ms", F.lit(now_ms))
    ran = (F.col("start_ms") > 0) & (stop > F.col("start_ms"))
    return commands.agg(
        F.count("*").alias("n_commands"), F.bool_and(F.col("exit_code") == 0).alias("succeeded"), total(duration()).cast("long").alias("command_ms"),
        F.round(total(F.when(ran, (stop - F.col("start_ms")) * F.col("procs"))).cast("double") / 3_600_000, 4).alias("cpu_hours"),
    )


def instances(commands: DataFrame, keys: list[str]) -> DataFrame:
    """Per command: its times relative to its stage's first start. The stages' starts, a row for each stage, go to every task: commands are
    not dealt by stage, so a stage with most of them is no single task."""
    begun = commands.where("start_ms > 0 AND stage IS NOT NULL")
    first = begun.groupBy("stage").agg(F.min("start_ms").alias("stage_start"))
    return begun.join(F.broadcast(first), "stage").select(*keys, "stage", duration().alias("ms"), (F.col("start_ms") - F.col("stage_start")).alias("rel_start"), (F.col("stop_ms") - F.col("stage_start")).alias("rel_end"))


def status_summary(commands: DataFrame) -> DataFrame:
    """Commands by status, and how many of them failed."""
    return commands.groupBy("status").agg(F.count("*").alias("n"), F.count_if(F.col("exit_code") != 0).alias("n_failed"))


def latest_by(jobs: DataFrame, by: str, order: str) -> DataFrame:
    """Each directory's latest job; Spark keeps one row a key in each task before the shuffle."""
    return jobs.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order), F.desc("job")))).where("_n = 1").drop("_n")


def error_summary(errors: DataFrame) -> DataFrame:
    """Per message: how often, in how many branches and stages."""
    return errors.groupBy("message").agg(F.count("*").alias("n"), F.countDistinct("branch").alias("n_branches"), F.countDistinct("stage").alias("n_stages"))


def shares(requests: DataFrame, free: int) -> DataFrame:
    """Free resource units dealt evenly over ``requests(ord, wanted)``, the remainder one each in order, never more than wanted."""
    n = requests.count()
    place = F.row_number().over(Window.orderBy("ord")) - 1  # the requests of one moment
    return requests.withColumn("granted", F.least("wanted", F.lit(free // max(1, n)) + F.when(place < free % max(1, n), 1).otherwise(0)))
