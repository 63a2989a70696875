"""Exact top-k search in binary codes by incremental multi-index hashing.

A 64-bit code is cut into four segments of 16 bits, each with an index from segment value to codes. A code at distance d from a query
differs from it in at most d / 4 bits of some segment. So once every segment has been searched to radius r, all codes up to distance
4r + 3 have been met. The radius grows until that covers the k-th best distance found; the query is then done, and exact.

Every probe is a row of an equi-join with the index, and candidates are verified against the whole code and the query's current k-th
distance inside the join. Rounds are written to the shared folder. Equal codes are one entry with their k least ids, which is all that
a top-k can hold of them, so a very common code costs no more than another; equal query codes are searched once.

Neighbours are ranked by (distance, vec_id); a query's own row is among them.

Defined cases: a null or empty embedding has no code: its row is neither found nor searched; a null element counts as not positive; an
embedding of over 64 dimensions is refused; repeated rows of one id and code are one; with fewer than k codes all are returned;
further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stagegraph.llm.common import arrow_schema, record, table, written

SEGMENTS, BITS = 4, 16


def sign_codes(vectors: DataFrame) -> DataFrame:
    """(vec_id, code long): bit i is set where element i is positive."""
    e = F.col("embedding")
    bits = F.transform(e, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    code = F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    checked = F.when(F.size(e) > SEGMENTS * BITS, F.raise_error(F.lit("codes have at most 64 bits")).cast("long")).otherwise(code)
    return vectors.where(F.size("embedding") > 0).select(F.col("vec_id").cast("long"), checked.alias("code")).where("vec_id IS NOT NULL")


def _masks(radii: list[int]) -> np.ndarray:
    every = np.arange(1 << BITS, dtype=np.int64)
    return every[np.isin(np.bitwise_count(every), radii)]


def probes(active: DataFrame, radii: list[int]) -> DataFrame:
    """(key, query, bound): each query's segment values with ``radii`` bits flipped; a key is a segment and a value."""
    target, masks = arrow_schema(active.sparkSession, "key int, query long, bound int"), _masks(radii)
    shifts = np.arange(SEGMENTS, dtype=np.uint64) * np.uint64(BITS)

    def run(batches):
        for batch in batches:
            codes, bounds = batch.column("query").to_numpy(), batch.column("bound").to_numpy()
            step = max(1, (1 << 18) // (SEGMENTS * len(masks)))
            for i in range(0, len(codes), step):
                some = codes[i : i + step]
                values = ((some.view(np.uint64)[:, None] >> shifts[None, :]) & np.uint64(0xFFFF)).astype(np.int64)
                keys = ((values[:, :, None] ^ masks[None, None, :]) | (np.arange(SEGMENTS) << BITS)[None, :, None]).reshape(len(some), -1)
                n = keys.shape[1]
                yield record({"key": keys.ravel(), "query": np.repeat(some, n), "bound": np.repeat(bounds[i : i + step], n)}, target)

    return active.select("query", "bound").mapInArrow(run, "key int, query long, bound int")


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def search(codes: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, distance) of the k nearest ``codes`` of each of ``queries``; both are (vec_id, code)."""
    n = F.row_number().over(Window.partitionBy("code").orderBy("vec_id"))
    least = codes.distinct().withColumn("n", n).where(F.col("n") <= k)  # Spark limits each group before the shuffle
    entries = least.groupBy("code").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    keys = F.array(*[F.shiftrightunsigned("code", BITS * s).bitwiseAND(F.lit(0xFFFF)).cast("int").bitwiseOR(F.lit(s << BITS)) for s in range(SEGMENTS)])
    index = written(entries.select(F.explode(keys).alias("key"), "code", "ids"))
    active = written(queries.select(F.col("code").alias("query")).distinct().withColumn("bound", F.lit(SEGMENTS * BITS)))
    done, best, radii = [], None, [0, 1]  # few probes first: what they find bounds the later, larger rounds
    while True:
        asked = probes(active, radii)
        distance = F.bit_count(asked["query"].bitwiseXOR(index["code"]))
        met = asked.join(index.hint("shuffle_hash"), (asked["key"] == index["key"]) & (distance <= asked["bound"])).select("query", distance.alias("distance"), "ids").distinct()
        near = F.row_number().over(Window.partitionBy("query").orderBy("distance", F.get("ids", 0)))  # the k best ids are of the k best codes
        found = met.withColumn("near", near).where(F.col("near") <= k).select("query", "distance", F.explode("ids").alias("vec_id"))
        if best is not None:
            found = found.unionByName(best).distinct()
        ranked = written(_best(found, k))
        covered = SEGMENTS * (radii[-1] + 1) - 1
        state = active.select("query").join(ranked.groupBy("query").agg(F.count("*").alias("n"), F.max("distance").alias("worst")), "query", "left")
        over = (F.coalesce("n", F.lit(0)) >= k) & (F.col("worst") <= covered) | F.lit(covered >= SEGMENTS * BITS)
        state = written(state.select("query", F.when(F.col("n") >= k, F.col("worst")).otherwise(F.lit(SEGMENTS * BITS)).cast("int").alias("bound"), over.alias("over")))
        done.append(ranked.join(state.where("over"), "query", "left_semi"))
        active = state.where("NOT over").select("query", "bound")
        if active.isEmpty():
            break
        best = ranked.join(active, "query", "left_semi").select("query", "distance", "vec_id")
        radii = [radii[-1] + 1]
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    asked = queries.select(F.col("vec_id").alias("query_id"), F.col("code").alias("query")).distinct()
    return asked.join(result, "query").select("query_id", "rank", "vec_id", "distance")


def op7_topk_search(spark: SparkSession, sf_dir: str, k: int = 10, every: int = 20) -> DataFrame:
    codes = written(sign_codes(table(spark, sf_dir, "embeddings")))
    return search(codes, codes.where(F.col("vec_id") % every == 0), k)


OP7_SQL = """
WITH codes AS (
  SELECT DISTINCT vec_id, list_aggregate(list_transform(embedding, lambda x, i: CASE WHEN x > 0 THEN (1::HUGEINT << (i - 1)::HUGEINT)::UBIGINT ELSE 0::UBIGINT END), 'bit_or') AS code
  FROM embeddings WHERE len(embedding) > 0 AND vec_id IS NOT NULL),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(bit_count(xor(q.code, c.code)) AS INTEGER) AS distance
  FROM codes q JOIN codes c ON q.vec_id % 20 = 0),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, rank, vec_id, distance FROM ranked WHERE rank <= 10
"""
