"""Sessions and the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "stagegraph", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` keys use __ for dots."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in ({"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true"} | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df by its keys in the session's number of shuffle partitions, which adaptive execution leaves as they are: for a task that holds
    its rows several times over (two sorts and two aggregates, say), where 64 MB of shuffled bytes are too many."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def shared_folder(spark: SparkSession) -> str | None:
    """The folder of spark.checkpoint.dir. Only a local session, as in tests, may go without (None): no executor's own disk will do."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if found is None and current.isDefined():
        found = current.get()
    if found is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return found


def settled(df: DataFrame) -> DataFrame:
    """df computed once, for a loop that reads it again and again: a Parquet table of its own in the shared folder (a checkpoint would
    run df's last stage twice, and hide its size from joins), or in a local session without such a folder, persisted."""
    folder = shared_folder(df.sparkSession)
    if folder is None:
        return df.persist()
    path = f"{folder}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
