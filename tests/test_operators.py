"""Lineage, lanes, intervals, files and streams on small cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from stagegraph.operators import checks, lineage, lines, regions, resolve, stats
from stagegraph.plans import lanes
from stagegraph.sources import files
from stagegraph.streaming import events

EDGES = [("a", "b"), ("a", "c"), ("c", "d")]
NODE = "node string, ts long, file_exists boolean, cleaned boolean"


@pytest.mark.parametrize(
    ("change", "stale"),
    [
        ({}, set()),
        ({"a": {"ts": 100}}, {"b", "c", "d"}),
        ({"b": {"ts": 100}}, set()),
        ({"c": {"ts": 100}}, {"d"}),
        ({"d": {"file_exists": False}}, {"d"}),
        ({"c": {"file_exists": False, "cleaned": True}}, set()),
        ({"c": {"file_exists": False, "cleaned": True}, "d": {"file_exists": False}}, {"c", "d"}),
        ({"a": {"file_exists": False, "cleaned": True}, "c": {"file_exists": False, "cleaned": True}}, set()),
    ],
)
def test_up_to_date_states(spark, change, stale):
    state = {n: {"ts": t, "file_exists": True, "cleaned": False} | change.get(n, {}) for n, t in (("a", 0), ("b", 1), ("c", 1), ("d", 2))}
    nodes = spark.createDataFrame([(n, s["ts"], s["file_exists"], s["cleaned"]) for n, s in state.items()], NODE)
    got = lineage.up_to_date(nodes, spark.createDataFrame(EDGES, "src string, dst string"), depth=3).collect()
    assert {r.node for r in got if not r.fresh} == stale


def test_graph_shape(spark):
    nodes, edges = spark.createDataFrame([(n,) for n in "abcd"], "node string"), spark.createDataFrame(EDGES, "src string, dst string")
    assert {r.node for r in lineage.leaves(nodes, edges).collect()} == {"b", "d"}
    assert {r.node for r in lineage.roots(nodes, edges).collect()} == {"a"}
    of = nodes.where("node = 'c'")
    assert {tuple(r) for r in lineage.neighbourhood(edges, of, 3).collect()} == {("a", "c"), ("c", "d")}
    assert {(r.node, r.level) for r in lineage.descendants(edges, nodes.where("node = 'a'")).collect()} == {("b", 1), ("c", 1), ("d", 2)}


def test_reach_ends_in_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a")], "src string, dst string")
    assert {r.node for r in lineage.reach(spark.createDataFrame([("a",)], "node string"), edges, True).collect()} == {"a", "b"}


def test_lanes(spark):
    df = spark.createDataFrame([("x.txt", 0), ("y.txt", 1)], "path string, ord int")
    hello = lanes.Stage("hello", lambda d, to="hello": d.withColumn("path", F.concat("path", F.lit(f".{to}"))))
    plan = hello + [hello.using(to="a"), hello.using(to="b")]
    out = plan(df)
    assert {(r.branch, r.path) for r in out.collect()} == {("0", "x.txt.hello.a"), ("0", "y.txt.hello.a"), ("1", "x.txt.hello.b"), ("1", "y.txt.hello.b")}
    assert plan.edges()[0] == [("hello", "hello"), ("hello", "hello")]
    assert hello.when(False)(df).collect() == df.collect()
    assert ([] * hello)(df).count() == 2
    assert {r.branch for r in ([2, 10, "2"] * hello)(df).collect()} == {"10", "2"}
    nested = ["s1", "s2"] * (hello + {"x": hello, "y": hello})
    assert {r.branch for r in nested(df).collect()} == {"s1_x", "s1_y", "s2_x", "s2_y"}
    merged = lanes.merge(out.withColumn("path", F.substring_index("path", ".", 2)))
    assert {(r.branch, r.path) for r in merged.collect()} == {("0", "x.txt"), ("0", "y.txt")}
    assert {r.src for r in lanes.graph(hello + lanes.Stage("end", lambda d: d), spark).collect()} == {"hello"}
    assert lanes.sequentially([1, 2], lambda n: hello.using(to=str(n)))(df).first().path.endswith(".1.2")


def test_hundred_lanes_are_one_plan(spark):
    df = spark.range(3).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("path"))
    out = (list(range(100)) * lanes.Stage("n", lambda d: d.groupBy("branch").count()))(df)
    assert out.count() == 100 and out._jdf.queryExecution().executedPlan().toString().count("Scan") <= 2


def test_check(spark):
    df = spark.range(4).toDF("x")
    seen = []
    row = lanes.check(df, "small", F.col("x") < 3, lambda bad: seen.extend(r.x for r in bad.collect())).first()
    assert (row.n, row.n_failed, row.passed, seen) == (4, 1, False, [3])


def test_lines(spark):
    df = spark.createDataFrame([("#c",), ("hello",), ("x",)], "line string")
    assert [r.line for r in lines.grep(df, "l+").collect()] == ["hello"]
    assert [r.line for r in lines.filter_lines(df, F.col("line") == "x").collect()] == ["#c", "x"]
    runs = spark.createDataFrame([(i, v) for i, v in enumerate(["a", "a", None, None, "a", "b"])], "i int, v string")
    assert [r.i for r in lines.without_runs(runs, "v", ["i"]).orderBy("i").collect()] == [0, 2, 3, 4, 5]


def test_regions(spark):
    bed = spark.createDataFrame([("chr1", 0, 999), ("chr1", 1000, 2000)], "chr string, start long, end long")
    assert regions.partition(bed.limit(1), 500).count() == 2
    exact = spark.createDataFrame([("chr1", 0, 1000)], "chr string, start long, end long")
    assert regions.partition(exact, 500).count() == 2 and regions.partition(exact, 500, zero_tails=True).count() == 3
    assert regions.padded(bed, 20).first().start == 0
    assert regions.labels(range(1, 3), "X", "chrY") == ["chr1", "chr2", "chrX", "chrY"]
    four = spark.createDataFrame([(f"chr{i}", 0, 1000) for i in range(4)], "chr string, start long, end long")
    assert regions.split_balanced(four, 2).select("part").distinct().count() == 2
    assert regions.split_balanced(four, 2, by_chromosome=True).select("part").distinct().count() == 4
    assert regions.split_balanced(exact, 4).agg(F.sum(F.col("end") - F.col("start")).alias("n")).first().n == 1000
    assert regions.split_sequential(exact, 4, 10).count() >= 1
    assert regions.split_balanced(exact.limit(0), 3).count() == 0


def test_resolution(spark):
    files_ = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a")], "ord int, path string")
    assert [r.ord for r in resolve.first_wins(files_, ["path"], ["ord"]).orderBy("ord").collect()] == [0, 1]
    assert resolve.nth_match(files_, ["path"], [F.asc("ord")], 2).first().ord == 2


def test_statistics_of_failed_stages(spark):
    schema = "stage string, branch string, start_ms long, stop_ms long, exit_code int, procs int, bytes long"
    c = spark.createDataFrame([("a", "x", 1000, 3000, 0, 2, 10), ("a", "x", 2000, 2500, 1, 1, None), ("b", "x", 500, 600, 1, 1, None)], schema)
    row = stats.stage_stats(c).collect()
    assert len(row) == 1 and (row[0].n_commands, row[0].n_valid, row[0].min_ms, row[0].rel_start) == (2, 1, 2000, 500)
    shares = stats.shares(spark.createDataFrame([(0, 4), (1, 4), (2, 1)], "ord int, wanted int"), 8)
    assert [r.granted for r in shares.orderBy("ord").collect()] == [3, 3, 1]


def test_times_add_up_beyond_a_long(spark):
    schema = "stage string, branch string, start_ms long, stop_ms long, exit_code int, procs int, bytes long"
    c = spark.createDataFrame([("a", "x", 1, 10**18 + 1, 0, 7, 1)] * 4, schema)
    assert tuple(stats.run_totals(c, 0).first()) == (4, True, 4 * 10**18, round(28 * 10**18 / 3_600_000, 4))
    long = spark.createDataFrame([("a", "x", 1, 3 * 10**18 + 1, 0, 1, 1)] * 4, schema)
    row = stats.stage_stats(long).first()
    assert (row.weight_s, row.mean_ms) == (12 * 10**15, 3e18)


def exchanges(df):
    """The shuffles of a plan before it runs, each as its text."""
    return [x.strip() for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x]


def test_stage_instances_deal_no_command_by_its_stage(spark):
    schema = "id long, stage string, start_ms long, stop_ms long"
    c = spark.createDataFrame([(1, "a", 5, 9), (2, "a", 3, 4), (3, "b", 7, 8), (4, None, 1, 2), (5, "b", 0, 2)], schema)
    out = stats.instances(c, ["id"])
    assert len(exchanges(out)) == 1  # that of the stages' starts
    assert sorted(tuple(r) for r in out.collect()) == [(1, "a", 4, 2, 6), (2, "a", 1, 0, 1), (3, "b", 1, 0, 1)]


def test_settings_by_precedence_deal_no_command(spark):
    c = spark.createDataFrame([(1, "a", "x"), (2, "b", None), (3, None, "y")], "id long, stage string, config string")
    s = spark.createDataFrame([("default", "", "k", "0"), ("default", "", "q", "0"), ("stage", "a", "k", "1"), ("stage", "a", "only", "1"), ("command", "x", "k", "2"), ("command", "y", "k", None), ("command", "y", "z", "2"), ("default", "b", "k", "9")], "level string, name string, key string, value string")
    out = resolve.configured(c, s)
    assert all("level" in x or "name" in x for x in exchanges(out))
    assert {tuple(r) for r in out.collect()} == {(1, "k", "2"), (1, "q", "0"), (1, "only", "1"), (2, "k", "0"), (2, "q", "0"), (3, "k", None), (3, "z", "2"), (3, "q", "0")}
    assert out.count() == 8
    assert resolve.configured(c, s.limit(0)).collect() == [] and resolve.configured(c, s.where("level = 'stage'")).count() == 2


def test_checks(spark):
    c = spark.createDataFrame([(1, "s", True, False, ""), (2, "s", False, False, ""), (3, "s", None, None, None)], "check_id int, stage string, passed boolean, override boolean, comment string")
    assert checks.summary(c, ["stage"]).first().n_failed == 2
    named = spark.createDataFrame([(2, "fine")], "check_id int, comment string")
    assert checks.summary(checks.overridden(c, named), ["stage"]).first().n_failed == 1


def test_files(spark, tmp_path):
    (tmp_path / "a.bed").write_text("# x\nchr1\t100\t300\nchr2\t5\t60\nbad\n")
    assert [tuple(r) for r in files.bed(spark, str(tmp_path / "a.bed"), 20).orderBy("chr").collect()] == [("chr1", 80, 320), ("chr2", 0, 80)]
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "o.properties").write_text("outputPath=x.txt\ninputs=a,b\ntimestamp=12\ncleaned=true\ncommand=cp a=b\n")
    r = files.output_records(spark, str(tmp_path / "p")).first()
    assert (r.output_path, r.inputs, r.ts, r.cleaned, r.command, r.stub) == ("x.txt", ["a", "b"], 12, True, "cp a=b", False)
    (tmp_path / "run.xml").write_text("<runs><job><id>1</id><commands><command><stage>a</stage></command><command><stage>b</stage></command></commands></job></runs>")
    assert sorted(x.stage for x in files.run_results(spark, str(tmp_path / "run.xml")).collect()) == ["a", "b"]
    (tmp_path / "t.tsv").write_text("#id\tname\n1\tx\n2\ty\n")
    assert [r.name for r in files.tsv(spark, str(tmp_path / "t.tsv")).collect()] == ["x", "y"]
    assert files.listing(spark, str(tmp_path), "*.bed").first().name == "a.bed"
    assert files.parameters(["a=1", "@f"], lambda _: "b=2\nc=x=y") == {"a": "1", "b": "2", "c": "x=y"}


def test_demultiplexed_log(spark):
    log = spark.createDataFrame([(0, "[0.43]\thow"), (1, "noise"), (2, "[b-x.1581]\tyou"), (3, "[0.43]\tare")], "n int, line string")
    assert {(r.branch, r.command_id, r.content) for r in files.demultiplexed(log).collect()} == {("0", 43, "how\nare"), ("b-x", 1581, "you")}


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(i, "t", "c", t) for i, t in enumerate([0, 5, 10, 14, 30])], "event_id long, event_type string, channel string, ts_ms long")
    assert sorted(r.event_id for r in events.throttled(rows, 10).collect()) == [0, 2, 4]
    rows.coalesce(1).write.parquet(str(tmp_path / "in" / "events.parquet"))
    stream = events.read_events(spark, str(tmp_path / "in" / "events.parquet"), rows)
    events.run_once(events.throttled_stream(stream, 10), str(tmp_path / "out"), str(tmp_path / "check"))
    assert sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 2, 4]
    events.send_once(events.read_events(spark, str(tmp_path / "in" / "events.parquet"), rows), str(tmp_path / "sent"), str(tmp_path / "check2"), "event_id")
    assert spark.read.parquet(str(tmp_path / "sent")).count() == 5


def test_definition_as_json(spark):
    import json

    one = lambda n: lanes.Stage(n, lambda d: d)
    got = json.loads(lanes.graph_json(one("a") + [one("b"), one("c")] + one("d"), spark).first().json)
    assert got["nodes"] == ["a", "b", "c", "d"] and {"from": "c", "to": "d"} in got["edges"] and len(got["edges"]) == 4


def test_new_records_replace_old_ones(spark):
    nodes, edges = spark.createDataFrame([(n,) for n in "abcd"], "node string"), spark.createDataFrame(EDGES, "src string, dst string")
    new_nodes, new_edges = lineage.added(nodes, edges, spark.createDataFrame([("d",), ("e",)], "node string"), spark.createDataFrame([("b", "d"), ("d", "e")], "src string, dst string"))
    assert {r.node for r in lineage.leaves(new_nodes, new_edges).collect()} == {"c", "e"}


def test_branch_ancestry_and_siblings(spark):
    made = spark.createDataFrame([("s", ["x"], "p1"), ("s", ["x", "y"], "p2"), ("s", ["x", "z"], "p3"), ("s", ["q"], "p4")], "stage string, branch_path array<string>, path string")
    asked = spark.createDataFrame([(1, "s", ["x", "y"])], "request_id int, stage string, branch_path array<string>")
    assert {r.path for r in resolve.from_stages(made, asked).collect()} == {"p1", "p2"}
    assert {r.path for r in resolve.siblings(made, asked).collect()} == {"p2", "p3"}


def test_sequential_split_by_one_scan(spark):
    import random

    rng = random.Random(3)
    bed, at = [], {}
    for _ in range(400):
        c = f"chr{rng.randrange(3)}"
        start = at.get(c, 0) + rng.choice([0, 1, 5, 50, 900])
        at[c] = start + rng.randrange(200)
        bed.append((c, start, at[c]))
    target = max(1, sum(b - a for _, a, b in bed) // 9)
    wanted, now, part, held, before = [], None, 0, 0, None
    for c, start, end in sorted(bed):
        if c != now:
            now, part, held, before = c, 0, 0, None
        if held and before is not None and start - before > 300:
            part, held = part + 1, 0
        while True:
            size = end - start
            if 4 * held < 3 * target:
                wanted.append((c, part, start, end))
                held += size
            elif 4 * (held + size) <= 5 * target:
                wanted.append((c, part, start, end))
                part, held = part + 1, 0
            elif 0 < target - held < size:
                wanted.append((c, part, start, start + target - held))
                part, held, start = part + 1, 0, start + target - held
                continue
            else:
                part += 1
                wanted.append((c, part, start, end))
                held = size
            before = end
            break
    got = [tuple(r) for r in regions.split_sequential(spark.createDataFrame(bed, "chr string, start long, end long"), 9, 300).collect()]
    dense = lambda rows: sorted((c, sorted({p for d, p, _, _ in rows if d == c}).index(p), a, b) for c, p, a, b in rows)
    assert dense(got) == dense(wanted)
    with pytest.raises(ValueError):
        regions.split_balanced(spark.createDataFrame(bed, "chr string, start long, end long"), 3, most=10)


def test_freshness_through_cleaned_nodes_of_several_levels(spark):
    nodes = spark.createDataFrame([("a", 1, True, False, None, None), ("b", 2, False, True, None, None), ("c", 3, False, True, None, None), ("d", 4, True, False, None, None), ("e", 1, True, False, 5, 9), ("f", 2, False, True, None, None), ("g", 1, True, False, 9, 5), ("h", None, False, False, None, None)], "node string, ts long, file_exists boolean, cleaned boolean, stop_ms long, create_ms long")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "e"), ("e", "f"), ("g", "e"), ("x", "a")], "src string, dst string")
    # e has an input of its own time: a has no known stop, so it counts as newer; f has no outputs
    assert {r.node: r.fresh for r in lineage.up_to_date(nodes, edges).collect()} == {"a": True, "b": True, "c": True, "d": True, "e": False, "f": False, "g": True, "h": False}
    assert {r.node: r.max_ts for r in lineage.max_timestamps(nodes, edges).collect()} == {"a": 1, "b": 2, "c": 3, "d": 4, "e": 1, "f": 2, "g": 1, "h": None}


def test_freshness_computes_nodes_and_edges_once(spark):
    def counted(df, seen):
        def run(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        return df.mapInArrow(run, df.schema)

    nodes = spark.createDataFrame([("a", 9, True, False), ("b", 1, True, False), ("c", 9, False, True), ("d", 9, True, False)], NODE)
    read = [spark.sparkContext.accumulator(0) for _ in range(2)]
    got = lineage.up_to_date(counted(nodes, read[0]), counted(spark.createDataFrame(EDGES, "src string, dst string"), read[1])).collect()
    assert {r.node: r.fresh for r in got} == {"a": True, "b": False, "c": False, "d": False}
    assert [x.value for x in read] == [4, 3]


def test_check_records(spark, tmp_path):
    from stagegraph.sources import files

    for i, text in enumerate(("#Checks\nstage=align\nname=depth\nbranch=s1\npassed=false\noverride=true\ncomment=ok = fine\nexecuted=1700\nstate=x\n", "stage=align\npassed=true\n", "stage=qc\nname=depth\npassed=false\nexecuted=soon\n")):
        (tmp_path / f"{i}.properties").write_text(text)
    found = files.check_records(spark, str(tmp_path))
    rows = {(r.stage, r.name): r for r in found.collect()}
    assert rows[("align", "depth")].override and rows[("align", "depth")].comment == "ok = fine" and rows[("align", "depth")].executed == 1700 and rows[("qc", "depth")].executed is None
    assert len({r.check_id for r in rows.values()}) == 3
    assert {r.stage: (r.n_checks, r.n_failed) for r in checks.summary(found, ["stage"]).collect()} == {"align": (2, 0), "qc": (1, 1)}
