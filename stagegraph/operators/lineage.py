"""Provenance as relations: ``nodes(node, ts, ...)`` and ``edges(src, dst)``, src an input of dst.

The graph may be of any size: each traversal is a frontier join a level, over rows only, and ends when a level is empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagegraph.session import settled


def _levels(start: DataFrame, edges: DataFrame, here: str, there: str, most: int) -> list[DataFrame]:
    """``start(origin, node)`` and its frontiers, one a level, each distinct."""
    out, now = [start], start
    for _ in range(most):
        now = now.join(edges.select(F.col(here).alias("node"), F.col(there).alias("next")), "node").select("origin", F.col("next").alias("node")).distinct()
        out.append(now)
    return out


def reach(start: DataFrame, edges: DataFrame, down: bool, depth: int | None = None) -> DataFrame:
    """(origin, node, level): what each start node reaches along the edges (down: to outputs), at its least level.

    With a known ``depth`` the plan is lazy and has one join a level. Else levels run until one is empty, and a level is kept only for
    nodes not met before, so cycles and diamonds end.
    """
    here, there = ("src", "dst") if down else ("dst", "src")
    start = start.select(F.col("node").alias("origin"), "node")
    if depth is not None:
        levels = _levels(start, edges, here, there, depth)
        every = reduce(DataFrame.unionByName, (x.withColumn("level", F.lit(i)) for i, x in enumerate(levels)))
        return every.groupBy("origin", "node").agg(F.min("level").alias("level"))
    met = now = start.withColumn("level", F.lit(0))
    level = 0
    steps = edges.select(F.col(here).alias("node"), F.col(there).alias("next"))
    while True:
        level += 1
        now = now.join(steps, "node").select("origin", F.col("next").alias("node")).distinct().join(met, ["origin", "node"], "left_anti").withColumn("level", F.lit(level))
        now = settled(now)
        if now.isEmpty():
            return met
        met = met.unionByName(now)


def ancestors(edges: DataFrame, of: DataFrame, depth: int | None = None) -> DataFrame:
    return reach(of, edges, down=False, depth=depth).where("level > 0")


def descendants(edges: DataFrame, of: DataFrame, depth: int | None = None) -> DataFrame:
    return reach(of, edges, down=True, depth=depth).where("level > 0")


def neighbourhood(edges: DataFrame, of: DataFrame, depth: int | None = None) -> DataFrame:
    """The edges of the subgraph of the nodes' ancestors, themselves and their descendants."""
    nodes = reach(of, edges, True, depth).select("node").unionByName(reach(of, edges, False, depth).select("node")).distinct()
    return edges.join(nodes.withColumnRenamed("node", "src"), "src", "left_semi").join(nodes.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst")


def leaves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that are no one's input."""
    return nodes.join(edges.select(F.col("src").alias("node")), "node", "left_anti")


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without an input among the nodes."""
    inside = edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi")
    return nodes.join(inside.select(F.col("dst").alias("node")), "node", "left_anti")


def max_timestamps(nodes: DataFrame, edges: DataFrame, depth: int | None = None) -> DataFrame:
    """(node, max_ts): the latest of a node's own time and those of all its ancestors. A level carries on only the times that are later
    than the own one of the node they reach; others have been carried on by that node. It ends when no time is carried on."""
    own, edges = settled(nodes.select("node", "ts")), settled(edges.select("src", "dst"))
    carried, risen, level = own.select(F.col("node").alias("src"), F.col("ts").alias("up")), None, 0
    while depth is None or level < depth:
        above = edges.join(carried, "src").groupBy(F.col("dst").alias("node")).agg(F.max("up").alias("up"))
        later = settled(own.join(above, "node").where(F.col("ts").isNull() | (F.col("up") > F.col("ts"))).select("node", "up"))
        if later.isEmpty():
            break
        risen = later if risen is None else risen.unionByName(later)
        carried, level = later.select(F.col("node").alias("src"), "up"), level + 1
    if risen is None:
        return own.select("node", F.col("ts").alias("max_ts"))
    return own.join(risen.groupBy("node").agg(F.max("up").alias("up")), "node", "left").select("node", F.greatest("ts", "up").alias("max_ts"))


def is_newer(max_ts: Column, ts: Column, stopped: Column, created: Column) -> Column:
    """Whether an input is newer than an output. Equal times are told apart by when the input was done and the output begun; without
    the first the input counts as newer, without the second it doesn't. Unknown times are 0 or null."""
    unknown = lambda c: c.isNull() | (c == 0)
    return F.when(max_ts < ts, False).when(max_ts > ts, True).when(unknown(stopped), True).when(unknown(created), False).otherwise(stopped >= created)


def up_to_date(nodes: DataFrame, edges: DataFrame, depth: int | None = None) -> DataFrame:
    """(node, fresh) of ``nodes(node, ts, file_exists, cleaned[, stop_ms, create_ms])``.

    A node with a newer input is stale; else it is fresh if it exists, and stale if it is missing and was not cleaned; a cleaned one is
    as fresh as its outputs, all of which must be, and stale without any. Only cleaned nodes without a newer input are left open by
    their own state; a level looks at the edges out of open nodes alone.
    """
    have = nodes.select("node", "ts", "file_exists", "cleaned", *[F.col(c) if c in nodes.columns else F.lit(0).cast("long").alias(c) for c in ("stop_ms", "create_ms")])
    have, edges = settled(have), settled(edges.select("src", "dst"))

    # an input is newer if one with its time and the most telling stop is: none known, or the latest
    telling = F.struct("in_ts", F.when(F.coalesce("in_stop", F.lit(0)) == 0, F.lit(2**63 - 1)).otherwise(F.col("in_stop")).alias("in_stop"))
    into = lambda up: edges.join(up, "src").groupBy(F.col("dst").alias("node")).agg(F.max(telling).alias("newest"))
    risen = lambda of: of.where(F.coalesce(F.col("newest.in_ts") > F.coalesce("ts", F.lit(-(2**63))), F.lit(False))).select(F.col("node").alias("src"), F.col("newest.in_ts").alias("in_ts"), F.col("stop_ms").alias("in_stop"))
    # the first level looks at the inputs' own times; an input that has a later one from its ancestors is looked at again with that
    met = settled(have.join(into(have.select(F.col("node").alias("src"), F.col("ts").alias("in_ts"), F.col("stop_ms").alias("in_stop"))), "node", "left"))
    carried, more, level = risen(met), None, 0
    while depth is None or level < depth:
        found = settled(into(carried))
        if found.isEmpty():
            break
        more = found if more is None else more.unionByName(found)
        carried, level = risen(have.join(found, "node")), level + 1
    if more is not None:
        again = more.groupBy("node").agg(F.max("newest").alias("again"))
        met = settled(met.join(again, "node", "left").withColumn("newest", F.greatest("newest", "again")))
    stop = F.when(F.col("newest.in_stop") < 2**63 - 1, F.col("newest.in_stop"))
    newer = F.col("newest").isNotNull() & is_newer(F.col("newest.in_ts"), F.col("ts"), stop, F.col("create_ms"))
    state = F.when(F.coalesce(newer, F.lit(False)), False).when(F.col("file_exists"), True).when(~F.col("cleaned"), False)
    own = met.select("node", state.alias("fresh"))  # null: up to the outputs
    still = own.where("fresh IS NULL").select(F.col("node").alias("src"))
    below = settled(edges.join(still, "src", "left_semi").join(own.select(F.col("node").alias("dst"), F.col("fresh").alias("f")), "dst"))
    known = None
    while True:
        votes = below.groupBy(F.col("src").alias("node")).agg(F.count_if(F.col("f") == F.lit(False)).alias("stale"), F.count_if(F.col("f").isNull()).alias("open"))
        now = settled(votes.select("node", F.when(F.col("stale") > 0, False).when(F.col("open") == 0, True).alias("said")).where("said IS NOT NULL"))
        if now.isEmpty():
            break
        known = now if known is None else known.unionByName(now)
        rest = below.join(now.select(F.col("node").alias("src")), "src", "left_anti")
        below = settled(rest.join(now.select(F.col("node").alias("dst"), "said"), "dst", "left").select("src", "dst", F.coalesce("f", "said").alias("f")))
    if known is None:
        return own.select("node", F.coalesce("fresh", F.lit(False)).alias("fresh"))
    told = own.where("fresh IS NULL").select("node").join(known, "node", "left").select("node", F.coalesce("said", F.lit(False)).alias("fresh"))
    return own.where("fresh IS NOT NULL").unionByName(told)


def cleanup_candidates(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Existing, not preserved outputs that are not leaves, unless a leaf is intermediate; and what accompanies them.
    ``nodes(node, file_exists, preserve, intermediate, accompanies)``."""
    inner = edges.select(F.col("src").alias("node")).distinct().withColumn("inner", F.lit(True))
    own = nodes.join(inner, "node", "left").where(F.col("file_exists") & ~F.col("preserve") & (F.coalesce("inner", F.lit(False)) | F.col("intermediate")))
    with_them = nodes.where(F.col("file_exists") & ~F.col("preserve")).join(own.select(F.col("node").alias("accompanies")), "accompanies", "left_semi")
    return own.select("node").unionByName(with_them.select("node")).distinct()


def out_of_date(outputs: DataFrame, inputs: DataFrame, by: str) -> DataFrame:
    """Outputs that are missing or older than an input of theirs. ``outputs(by, path, ts)``, ``inputs(by, ts)``: a missing input has
    time 0 and never asks for a rebuild, a missing output has a null time. Only the latest input matters, so inputs are summed first."""
    latest = inputs.groupBy(by).agg(F.max(F.coalesce("ts", F.lit(0))).alias("latest"))
    return outputs.join(latest, by, "left").where(F.col("ts").isNull() | (F.col("latest") > F.col("ts"))).drop("latest")


def missing(expected: DataFrame, existing: DataFrame, on: str) -> DataFrame:
    """Expected files that neither exist nor were cleaned away."""
    return expected.where(~F.coalesce(F.col("cleaned"), F.lit(False))).join(existing, on, "left_anti")


def grouped_by_inputs(outputs: DataFrame) -> DataFrame:
    """(inputs, output): each output with its sorted, comma-joined inputs; ``outputs(output, input)``."""
    return outputs.groupBy("output").agg(F.array_join(F.array_sort(F.collect_list("input")), ",").alias("inputs"))


def marked(nodes: DataFrame, flag: str, paths: DataFrame) -> DataFrame:
    """``flag`` set for the nodes named in ``paths(node)``: preserve, intermediate, cleaned or forced."""
    named = paths.select("node").distinct().withColumn("_named", F.lit(True))
    return nodes.join(named, "node", "left").withColumn(flag, F.coalesce("_named", F.col(flag))).drop("_named")


def touched(nodes: DataFrame, paths: DataFrame, now_ms: int) -> DataFrame:
    """The named outputs take the time ``now_ms``, and so become fresh."""
    named = paths.select("node").distinct().withColumn("_named", F.lit(True))
    return nodes.join(named, "node", "left").withColumn("ts", F.when(F.col("_named"), F.lit(now_ms)).otherwise(F.col("ts"))).drop("_named")


def modified_commands(outputs: DataFrame, commands: DataFrame) -> DataFrame:
    """Outputs whose recorded fingerprint is not that of the command that would make them now."""
    from stagegraph.functions.scalars import fingerprint

    return outputs.join(commands, "output").where(F.col("fingerprint") != fingerprint("command", "output"))


def stubs(nodes: DataFrame, edges: DataFrame, depth: int | None = None) -> DataFrame:
    """Nodes that are stubs or come from one; ``nodes(node, stub)``."""
    return reach(nodes.where("stub"), edges, down=True, depth=depth).select("node").distinct()


def provenance(outputs: DataFrame) -> DataFrame:
    """Per output what made it, how long it waited and how long it ran; unknown times and names are '-' or null."""
    known = lambda a, b: F.when((F.col(a) > 0) & (F.col(b) > 0), F.col(b) - F.col(a))
    return outputs.select("output_path", F.coalesce("stage", F.lit("Unknown")).alias("stage"), F.coalesce("command", F.lit("-")).alias("command"), known("create_ms", "start_ms").alias("pending_ms"), known("start_ms", "stop_ms").alias("running_ms"), F.coalesce("tools", F.lit("-")).alias("tools"))


def added(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph with new records in the place of those of the same node, and their edges instead of the old ones into them."""
    keep = nodes.join(new_nodes.select("node"), "node", "left_anti").unionByName(new_nodes)
    stay = edges.join(new_nodes.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst")
    return keep, stay.unionByName(new_edges.select("src", "dst"))


def outline(nodes: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(path, node, level): the graph as an indented text, a row for each way from a root; order by path."""
    now = roots(nodes, edges).select("node", F.col("node").alias("path"), F.lit(0).alias("level"))
    out = [now]
    for i in range(1, depth + 1):
        now = now.join(edges.select(F.col("src").alias("node"), F.col("dst").alias("next")), "node").select(F.col("next").alias("node"), F.concat_ws("/", "path", "next").alias("path"), F.lit(i).alias("level"))
        out.append(now)
    return reduce(DataFrame.unionByName, out)


def cleanup_totals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """How many outputs a cleanup would remove, and their bytes; ``nodes`` as for the candidates, with ``size``."""
    return nodes.join(cleanup_candidates(nodes, edges), "node", "left_semi").agg(F.count("*").alias("n_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
