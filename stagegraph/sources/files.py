"""Readers and writers of the file forms: listings, lines, tab-separated rows, intervals, logs, properties, run results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OUTPUTS = "output_path string, inputs array<string>, cleaned boolean, ts long, preserve boolean, intermediate boolean, command_id string, start_ms long, create_ms long, stop_ms long, tools string, branch_path string, stage string, stage_id string, command string, fingerprint string, accompanies string, stub boolean"
TAG = r"^\[([^\[\]]+)\.(\d+)\]\s+(.*)$"


def listing(spark: SparkSession, folder: str, glob: str = "*", regex: str | None = None, recursive: bool = False) -> DataFrame:
    """(path, name, ts, size) of files by a glob and, on top, a regular expression on the name."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", recursive).load(folder)
    found = found.select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), F.col("modificationTime").alias("ts"), F.col("length").alias("size"))
    return found.where(F.col("name").rlike(regex)) if regex else found


def input_list(spark: SparkSession, paths: list[str], existing: DataFrame) -> DataFrame:
    """(ord, path) of the given paths; those that do not exist raise an error when the rows are read."""
    given = spark.createDataFrame(list(enumerate(paths)), "ord int, path string")
    known = existing.select("path").distinct().withColumn("_there", F.lit(True))
    return given.join(known, "path", "left").select("ord", F.when(F.col("_there"), F.col("path")).otherwise(F.raise_error(F.concat(F.lit("no such input: "), "path")).cast("string")).alias("path"))


def resolved_storage(files: DataFrame, storages: DataFrame) -> DataFrame:
    """Each path with the first storage, by priority, in which it exists; ``storages(path, storage, priority)``; else 'unknown'."""
    first = storages.groupBy("path").agg(F.min_by("storage", "priority").alias("storage"))
    return files.join(first, "path", "left").withColumn("storage", F.coalesce("storage", F.lit("unknown")))


def bed(spark: SparkSession, path: str, padding: int = 0) -> DataFrame:
    """(chr, start, end) of a tab-separated interval file without a header; comments and other lines are skipped."""
    from stagegraph.operators.regions import padded

    cells = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("#")).select(cells[0].alias("chr"), F.get(cells, 1).try_cast("long").alias("start"), F.get(cells, 2).try_cast("long").alias("end"))
    return padded(rows.where("start IS NOT NULL AND end IS NOT NULL"), padding)


def write_bed(regions: DataFrame, path: str) -> None:
    regions.select("chr", "start", "end").write.mode("overwrite").csv(path, sep="\t")


def genes(spark: SparkSession, path: str, strip_chr: bool = False) -> DataFrame:
    """(chr, gene, start, end) of a gene table (tab separated, may be gzipped): columns 3, 13, 5 and 6."""
    cells = F.split("value", "\t")
    label = F.regexp_replace(cells[2], "^chr", "") if strip_chr else cells[2]
    return spark.read.text(path).where(~F.col("value").startswith("#")).select(label.alias("chr"), F.get(cells, 12).alias("gene"), F.get(cells, 4).try_cast("long").alias("start"), F.get(cells, 5).try_cast("long").alias("end")).where("start IS NOT NULL")


def tsv(spark: SparkSession, path: str, header: list[str] | None = None) -> DataFrame:
    """Named columns of tab-separated rows. Without ``header`` the first line names them if it starts with one '#'."""
    lines = spark.read.text(path)
    if header is None:
        first = lines.first()
        if first is None or not first.value.startswith("#") or first.value.startswith("##"):
            raise ValueError("the first line names no columns")
        header = first.value.lstrip("#").split("\t")
    cells = F.split("value", "\t", -1)
    return lines.where(~F.col("value").startswith("#")).select(*[F.get(cells, i).alias(name) for i, name in enumerate(header)])


def properties(spark: SparkSession, path: str) -> DataFrame:
    """(path, entries map<string,string>) of property files, one row a file; keys without a value are ''."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    lines = F.filter(F.split("value", "\r?\n"), lambda x: x.contains("=") & ~x.rlike("^[#!]"))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("k"), F.trim(F.regexp_replace(x, "^[^=]*=", "")).alias("v")))
    return raw.select("path", F.map_from_entries(pairs).alias("entries"))


def output_records(spark: SparkSession, path: str) -> DataFrame:
    """Provenance records of property files, with the fields that are missing null and the inputs split at commas."""
    e = properties(spark, path)
    text = lambda k: F.col("entries")[k]
    flag = lambda k: F.coalesce(F.lower(text(k)) == "true", F.lit(False))
    num = lambda k: text(k).try_cast("long")
    return e.select(
        text("outputPath").alias("output_path"), F.filter(F.split(F.coalesce(text("inputs"), F.lit("")), ","), lambda x: x != "").alias("inputs"), flag("cleaned").alias("cleaned"), num("timestamp").alias("ts"),
        flag("preserve").alias("preserve"), flag("intermediate").alias("intermediate"), text("commandId").alias("command_id"), num("startTimeMs").alias("start_ms"), num("createTimeMs").alias("create_ms"), num("stopTimeMs").alias("stop_ms"),
        text("tools").alias("tools"), text("branchPath").alias("branch_path"), text("stageName").alias("stage"), text("stageId").alias("stage_id"), text("command").alias("command"), text("fingerprint").alias("fingerprint"), text("accompanies").alias("accompanies"), flag("stub").alias("stub"),
    )


def check_records(spark: SparkSession, path: str) -> DataFrame:
    """Checks of property files, as ``operators.checks`` takes them; check_id is the id of stage, name and branch."""
    e = properties(spark, path)
    text = lambda k: F.col("entries")[k]
    flag = lambda k: F.coalesce(F.lower(text(k)) == "true", F.lit(False))
    check_id = F.sha1(F.concat_ws("\0", F.coalesce(text("stage"), F.lit("")), F.coalesce(text("name"), F.lit("")), F.coalesce(text("branch"), F.lit(""))))
    return e.select(
        check_id.alias("check_id"), text("stage").alias("stage"), text("name").alias("name"), text("branch").alias("branch"), flag("passed").alias("passed"), flag("override").alias("override"),
        text("comment").alias("comment"), text("message").alias("message"), text("executed").try_cast("long").alias("executed"), text("script").alias("script"), text("state").alias("state"),
    )


def upserted(records: DataFrame, new: DataFrame) -> DataFrame:
    """Records with ``new`` ones of the same output in their place."""
    return records.join(new.select("output_path"), "output_path", "left_anti").unionByName(new)


def run_results(spark: SparkSession, path: str) -> DataFrame:
    """Commands of run result documents (a ``job`` element each); documents that cannot be read are skipped."""
    jobs = spark.read.format("xml").option("rowTag", "job").option("mode", "DROPMALFORMED").load(path)
    return jobs.select("id", F.explode("commands.command").alias("command")).select(F.col("id").alias("job_id"), "command.*")


def demultiplexed(lines: DataFrame, order: str = "n") -> DataFrame:
    """(branch, command_id, n_lines, content): tagged log lines together by tag, in order; lines without a tag are dropped.
    ``lines(line, n)``. The content of a command is one value, as its log is."""
    tagged = lines.where(F.col("line").rlike(TAG)).select(F.regexp_extract("line", TAG, 1).alias("branch"), F.regexp_extract("line", TAG, 2).cast("long").alias("command_id"), F.regexp_extract("line", TAG, 3).alias("content"), order)
    return tagged.groupBy("branch", "command_id").agg(F.count("*").alias("n_lines"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "content"))), lambda x: x["content"]), "\n").alias("content"))


def parameters(args: list[str], read_file=None) -> dict[str, str]:
    """``k=v`` arguments; ``@file`` stands for the arguments on the lines of a file."""
    out: dict[str, str] = {}
    for a in args:
        if a.startswith("@"):
            out |= parameters([x.strip() for x in read_file(a[1:]).splitlines() if x.strip()], read_file)
        else:
            k, _, v = a.partition("=")
            out[k] = v
    return out


def as_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))


def duplicate_outputs(outputs: DataFrame, path: Column | str = "path") -> DataFrame:
    """Paths that more than one writer names."""
    return outputs.groupBy(path).agg(F.count("*").alias("n")).where("n > 1")
