"""Scalar functions, names and patterns on small cases."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from stagegraph.functions import naming, scalars
from stagegraph.operators.split import compile_pattern, regex_pattern, split


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("path", "ext"), [("foo.txt", "txt"), ("foo", ""), ("foo.", ""), ("a.b/c.tar.gz", "gz")])
def test_ext(spark, path, ext):
    assert one(spark, scalars.ext(F.lit(path))) == ext


@pytest.mark.parametrize(("n", "text"), [(None, "-"), (0, "0 B"), (1023, "1023 B"), (1024, "1.0 KiB"), (5 * 1024**3, "5.0 GiB")])
def test_human_bytes(spark, n, text):
    assert one(spark, scalars.human_bytes(F.lit(n).cast("long"))) == text


@pytest.mark.parametrize(("spec", "ms"), [("60", 60_000), ("01:00", 60_000), ("01:00:01", 3_601_000), ("1:00:00:00", 86_400_000), ("x", None)])
def test_walltime(spark, spec, ms):
    assert one(spark, scalars.walltime_ms(F.lit(spec))) == ms


@pytest.mark.parametrize(("mode", "spec", "mb"), [("literal", "4", 4), ("gigabytes", "4", 4096), ("literal", "4gb", 4000), ("literal", "12MB", 12), ("literal", "x", None)])
def test_memory(spark, mode, spec, mb):
    assert one(spark, scalars.memory_mb(F.lit(spec), mode)) == mb


@pytest.mark.parametrize(("text", "joined"), [("a\n  b", "a b"), ("a\n\nb", "a;  b"), ("a;\n\nb", "a;  b"), ('echo "x\n  y"', 'echo "x   y"')])
def test_join_shell_lines(spark, text, joined):
    assert one(spark, scalars.join_shell_lines(F.lit(text))) == joined


def test_split_shell_args(spark):
    df = spark.createDataFrame([("a 'b c' \"d e\"",), (r"x\ y z",), (None,), ("",)], "c string")
    assert [r.x for r in df.select(scalars.split_shell_args("c").alias("x")).collect()] == [["a", "b c", "d e"], ["x y", "z"], None, []]


def test_tool_in_command(spark):
    for command, there in (("bwa mem x", True), ("/usr/bin/bwa mem", True), ("mybwa mem", False), ("cat x | bwa", True), ("bwa.sh", False)):
        assert one(spark, scalars.has_tool(F.lit(command), "bwa")) is there


def test_glob_to_regex():
    assert re.match(scalars.glob_to_regex("*.t?t"), "foo.txt") and not re.match(scalars.glob_to_regex("*.txt"), "footxt")


@pytest.mark.parametrize(("path", "ext", "branch", "name"), [("foo.txt", "tsv", None, "foo.tsv"), ("dir/foo.txt", "tsv", "b1", "foo.b1.tsv"), ("foo.b1.txt", "tsv", "b1", "foo.b1.tsv"), ("foo.txt", "txt", None, "foo.stage.txt"), ("foo..x", "tsv", None, "foo.tsv")])
def test_transform_name(spark, path, ext, branch, name):
    assert one(spark, naming.transform_name(F.lit(path), ext, None if branch is None else F.lit(branch))) == name


def test_filter_and_merge_names(spark):
    assert one(spark, naming.filter_name(F.lit("a/foo.txt"), "clean")) == "foo.clean.txt"
    assert one(spark, naming.merged_name(F.lit("test.x.there.xml"), F.lit("x"))) == "test.merge.there.xml"


def test_n_to_m(spark):
    files = spark.createDataFrame([("foo.txt", 0), ("bar.txt", 1)], "path string, ord int")
    assert [r.output for r in naming.n_to_m(files, ["tsv", "tsv", "bam"]).orderBy("at").collect()] == ["foo.tsv", "bar.tsv", "foo.bam"]


def test_next_run_directory(spark):
    assert naming.next_run_directory(spark.createDataFrame([("run0001",), ("run0012",), ("other",)], "name string"), "run") == "run0013"
    assert naming.next_run_directory(spark.createDataFrame([], "name string"), "run") == "run0001"


def groups(spark, names, pattern, **kw):
    files = spark.createDataFrame(list(enumerate(names)), "ord int, path string")
    out = {}
    for r in split(files, pattern, **kw).orderBy("key", "place").collect():
        out.setdefault(r.key, []).append(r.path)
    return out


def test_single_key(spark):
    assert groups(spark, ["s_1_1.txt", "s_1_2.txt", "s_2_1.txt", "s_2_2.txt", "foo.bar"], compile_pattern("s_%_*.txt")) == {"1": ["s_1_1.txt", "s_1_2.txt"], "2": ["s_2_1.txt", "s_2_2.txt"]}


def test_two_keys(spark):
    names = [f"s_{i}_ignore_{c}_{j}.txt" for i in (1, 2) for c in "ab" for j in (1, 2)]
    assert list(groups(spark, names, compile_pattern("s_%_ignore_%_*.txt"))) == ["1.a", "1.b", "2.a", "2.b"]


def test_lazy_and_digit_wildcards(spark):
    assert set(groups(spark, ["11D_F_H14.txt", "11D_H14.txt", "11D_M_H14.txt"], compile_pattern("%_H"))) == {"11D_F", "11D", "11D_M"}
    assert set(groups(spark, ["test1_R1.gz", "test1_R2.gz", "test2_RX_R1.gz", "test2_RX_R2.gz"], compile_pattern("%_R#.gz"))) == {"test1", "test2_RX"}
    assert groups(spark, ["test.chr22.csv", "test.chr22.realign.bam"], compile_pattern(".chr%.")) == {"22": ["test.chr22.csv", "test.chr22.realign.bam"]}


def test_natural_and_first_digit_order(spark):
    names = ["s_1_17", "s_1_2", "s_1_1"]
    assert groups(spark, names, compile_pattern("s_%_*"))["1"] == ["s_1_1", "s_1_2", "s_1_17"]
    assert groups(spark, names, compile_pattern("s_%_*"), order="first_digit")["1"] == ["s_1_17", "s_1_1", "s_1_2"]


def test_regex_and_refused_patterns(spark):
    assert set(groups(spark, ["test_foo.txt", "test_bar.txt"], regex_pattern(r"test_([a-z]*)\.txt"))) == {"foo", "bar"}
    with pytest.raises(ValueError, match="wildcards"):
        compile_pattern("a%*b")
