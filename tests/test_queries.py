"""Every registered query of the reference's own operators against its SQL."""

from __future__ import annotations

import pytest
from oracle import assert_matches
from pyspark.sql import functions as F

from stagegraph import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(name, spark, sf_dir):
    assert_matches(queries.QUERIES[name], queries.ORACLE_SQL[name], spark, sf_dir)


def test_sequential_split_keeps_every_base(spark, sf_dir):
    bed = queries.bed(spark, sf_dir)
    parts = queries.QUERIES["region_split_sequential"](spark, sf_dir)
    size = F.sum(F.col("end") - F.col("start")).alias("n")
    assert parts.agg(size).first() == bed.agg(size).first()
    assert parts.where("end <= start").count() == 0


def test_balanced_split_gives_the_parts_asked_for(spark, sf_dir):
    parts = queries.QUERIES["region_split_balanced"](spark, sf_dir)
    sizes = [r.n for r in parts.groupBy("part").agg(F.sum(F.col("end") - F.col("start")).alias("n")).collect()]
    assert len(sizes) == 7 and max(sizes) <= 4 * min(sizes)


def test_throttled_notifications_by_brute_force(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    got = {r.event_id for r in queries.QUERIES["throttled_notifications"](spark, sf_dir).collect()}
    last, wanted = {}, set()
    for r in e.select("event_id", "event_type", (F.col("user_id") % 5).alias("c"), queries._ms("ts").alias("t")).orderBy("t", "event_id").collect():
        key = (r.c, r.event_type)
        if key not in last or r.t - last[key] >= 6 * 3_600_000:
            last[key] = r.t
            wanted.add(r.event_id)
    assert got == wanted


def test_tiebreak_keeps_the_number_of_partitions(spark, sf_dir):
    out = queries.QUERIES["newer_inputs_tiebreak"](spark, sf_dir)
    out.collect()
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()
