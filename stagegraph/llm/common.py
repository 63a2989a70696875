"""Helpers of the operators: whole-table reads, batches of Arrow, lineage cuts in the shared folder."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset (a local session, as in tests), a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if found is None:
        current = context._jsc.sc().getCheckpointDir()
        found = current.get() if current.isDefined() else tempfile.mkdtemp(prefix="checkpoints-")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut: written once to the shared folder, so that a lost executor costs no earlier stage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, *partition_by: str) -> DataFrame:
    """df as a Parquet table of its own in the shared folder, read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.parquet(path)


def give_back() -> None:
    """Memory that is free in this process goes back to the system. Spark keeps a task's Python worker for later tasks, and a worker
    keeps what it freed, so without this each worker stays at the largest size that it ever had."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:  # glibc has it
        trim(0)


def pieces(batches: Iterator[pa.RecordBatch], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``most`` bytes, so that a task holds few of its texts as Python objects at a time. What is free
    goes back before the first, about every four slices and after the last."""
    give_back()
    held = 0
    for batch in batches:
        held += batch.nbytes
        step = max(1, batch.num_rows * most // max(1, batch.nbytes))
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)
        if held > 4 * most:
            batch, held = None, 0
            give_back()
    batch = None
    give_back()


def record(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def _arrow(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


arrow_schema = _arrow


def partitions(df: DataFrame) -> int:
    """Shuffle partitions for a dealt stage: the session's setting, which the operator of a cluster sizes to its input."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def utf8(texts: list) -> list[bytes]:
    return [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]


def doc_key(column: str = "doc_id"):
    """A null id as the least long, so that rows without an id keep a place in the order."""
    return F.coalesce(F.col(column).cast("long"), F.lit(-(2**63)))
