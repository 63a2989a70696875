"""Scalar functions as Column expressions; a null argument gives null unless said otherwise."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

SECOND, MINUTE, HOUR, DAY = 1_000, 60_000, 3_600_000, 86_400_000
# Name parts of minor contigs.
MINOR_STARTS = ("NC_", "GL", "Un_", "chrUn_", "M", "chrM", "HLA-")
MINOR_ENDS = ("_random", "_alt", "_fix", "EBV")
HAPLOTYPE = "^.*_hap[0-9]+$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ext(path: Column | str) -> Column:
    """What follows the last dot; '' without a dot or with a trailing one."""
    return F.regexp_extract(col(path), r"\.([^.]+)$", 1)


def prefix(path: Column | str) -> Column:
    """The path without its last extension."""
    return F.regexp_replace(col(path), r"\.[^.]*$", "")


def file_name(path: Column | str) -> Column:
    return F.regexp_extract(col(path), r"([^/]*)$", 1)


def strip_char(value: Column | str, char: str) -> Column:
    c = re.escape(char)
    return F.regexp_replace(col(value), f"^{c}+|{c}+$", "")


def dot_join(*parts: Column | str) -> Column:
    """Parts joined by one dot; nulls and empty parts are skipped and dots at a part's ends dropped."""
    cleaned = [strip_char(p, ".") for p in parts]
    return F.array_join(F.filter(F.array(*cleaned), lambda x: x.isNotNull() & (x != "")), ".")


def glob_to_regex(pattern: str) -> str:
    """A file glob as an anchored regular expression: * and ? are wildcards and all else is literal."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def human_bytes(n: Column | str) -> Column:
    """Bytes with one decimal in the largest fitting unit of 1,024; '-' for null."""
    n = col(n)
    out = F.when(n.isNull(), "-").when(n < 1024, F.concat(n.cast("long").cast("string"), F.lit(" B")))
    units = ("KiB", "MiB", "GiB", "TiB", "PiB")
    for i, unit in enumerate(units, 1):
        scaled = F.format_string(f"%.1f {unit}", n / F.lit(float(1024**i)))
        out = out.otherwise(scaled) if i == len(units) else out.when(n < 1024 ** (i + 1), scaled)
    return out


def walltime_ms(spec: Column | str) -> Column:
    """Whole seconds, or [[DD:]HH:]MM:SS, in milliseconds."""
    spec = col(spec)
    parts = F.reverse(F.transform(F.split(spec, ":"), lambda x: x.cast("long")))
    units = F.array(*[F.lit(x).cast("long") for x in (SECOND, MINUTE, HOUR, DAY)])
    total = F.aggregate(F.zip_with(parts, F.slice(units, 1, F.size(parts)), lambda a, b: a * b), F.lit(0).cast("long"), lambda a, b: a + b)
    return F.when(spec.rlike(r"^\d+(:\d+){0,3}$"), total)


def format_walltime(seconds: Column | str) -> Column:
    s = col(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60)))


def memory_mb(spec: Column | str, mode: str = "literal") -> Column:
    """Memory in MB. ``literal``: a bare number is MB. ``gigabytes``: a bare number is GB of 1,024 MB. GB are 1,000 MB in both."""
    spec = F.upper(F.trim(col(spec)))
    amount = F.regexp_extract(spec, r"^(\d+)", 1).try_cast("long")
    unit = F.regexp_extract(spec, r"^\d+\s*([A-Z]{2})$", 1)
    bare = amount * (1024 if mode == "gigabytes" else 1)
    return F.when(spec.rlike(r"^\d+$"), bare).when(unit == "MB", amount).when(unit == "GB", amount * 1000).when(unit == "TB", amount * 1_000_000)


def join_shell_lines(text: Column | str) -> Column:
    """Lines of a command as one: leading blanks go until a quote has been seen, a blank line ends a statement by ';'."""
    state = F.struct(F.lit("").alias("out"), F.lit(False).alias("quoted"))

    def step(acc: Column, line: Column) -> Column:
        quoted = acc["quoted"] | line.contains('"') | line.contains("'")
        body = F.when(quoted, line).otherwise(F.regexp_replace(line, r"^\s+", ""))
        ended = F.rtrim(acc["out"]).rlike("[;&]$")
        blank = F.concat(acc["out"], F.when(ended, " ").otherwise("; "))
        return F.struct(F.when((F.trim(body) != "") | (acc["out"] == ""), F.concat(acc["out"], F.lit(" "), body)).otherwise(blank).alias("out"), quoted.alias("quoted"))

    return F.trim(F.aggregate(F.split(F.regexp_replace(col(text), r"^\s+|\s+$", ""), "\r?\n"), state, step, lambda acc: acc["out"]))


@pandas_udf(ArrayType(StringType()))
def split_shell_args(commands: pd.Series) -> pd.Series:
    """Arguments of a command line; quotes group, a backslash escapes outside single quotes. A state machine, so not an expression."""

    def split(command: str | None) -> list[str] | None:
        if command is None:
            return None
        out, now, quote, started, escaped = [], [], "", False, False
        for c in command:
            if escaped:
                now.append(c)
                escaped = False
            elif c == "\\" and quote != "'":
                escaped = started = True
            elif quote:
                if c == quote:
                    quote = ""
                else:
                    now.append(c)
            elif c in "'\"":
                quote, started = c, True
            elif c.isspace():
                if started:
                    out.append("".join(now))
                now, started = [], False
            else:
                now.append(c)
                started = True
        return out + ["".join(now)] if started else out

    return commands.map(split)


def truncate_line(text: Column | str, most: int) -> Column:
    """The first line, and of it at most ``most`` characters, marked by '...' if anything was left out."""
    text = col(text)
    first = F.substring_index(text, "\n", 1)
    return F.when((F.length(first) > most) | (first != text), F.concat(F.substring(first, 1, most), F.lit("..."))).otherwise(text)


def indent(text: Column | str, by: int) -> Column:
    return F.regexp_replace(col(text), "(?m)^", " " * by)


def upper_case_words(text: Column | str) -> Column:
    return F.regexp_replace(F.initcap(col(text)), "^$", "")


def quote(text: Column | str) -> Column:
    return F.concat(F.lit("'"), F.replace(col(text), F.lit("'"), F.lit("'\\''")), F.lit("'"))


def url_to_file_name(url: Column | str, default_ext: str) -> Column:
    """The last part of a URL's path, or else its host; with the default extension if it has none."""
    url = col(url)
    last = F.regexp_extract(url, r"([^/]*)$", 1)
    host = F.regexp_replace(F.regexp_extract(url, r"^[a-z]+://([^/:]+)", 1), r"^www\.", "")
    named = F.when(last == "", F.concat(host, F.lit(f".{default_ext}"))).otherwise(last)
    return F.when(named.contains("."), named).otherwise(F.concat(named, F.lit(f".{default_ext}")))


def clean_path(path: Column | str) -> Column:
    return F.regexp_replace(col(path), r"^\./", "")


def add_prefix(label: Column | str, with_: str = "chr") -> Column:
    label = col(label)
    return F.when(label.startswith(with_), label).otherwise(F.concat(F.lit(with_), label))


def is_minor_contig(label: Column | str) -> Column:
    label, out = col(label), F.lit(False)
    for s in MINOR_STARTS:
        out = out | label.startswith(s)
    for s in MINOR_ENDS:
        out = out | label.endswith(s)
    return out | label.rlike(HAPLOTYPE)


def sanitised_name(name: Column | str) -> Column:
    """A branch name without its trailing numbered parts."""
    return F.regexp_replace(col(name), r"(\.\d+)+$", "")


def format_bases(n: Column | str) -> Column:
    n = col(n)
    return (
        F.when(n >= 1_000_000_000, F.format_string("%.2f Gbp", n / 1e9)).when(n >= 1_000_000, F.format_string("%.1f Mbp", n / 1e6))
        .when(n >= 1_000, F.format_string("%.1f Kbp", n / 1e3)).otherwise(F.concat(n.cast("string"), F.lit(" bp")))
    )


def timing_bar(start: Column | str, end: Column | str, total: Column | str, width: int = 30) -> Column:
    """A bar of '=' whose length and offset are the share of the whole time."""
    start, end, total = col(start), col(end), col(total)
    length = F.floor(width * (end - start) / total).cast("int")
    before = F.floor(width * start / total).cast("int")
    return F.when((total > 0) & (length > 0), F.concat(F.repeat(F.lit(" "), before), F.repeat(F.lit("="), length))).otherwise("")


def has_tool(command: Column | str, tool: str) -> Column:
    """Whether a command runs a tool: its name between the delimiters that can surround a program."""
    return col(command).rlike(rf"(^|[\s/;&|(`$]){re.escape(tool)}($|[\s;&|)`])")


def fingerprint(command: Column | str, output: Column | str) -> Column:
    return F.sha1(F.concat_ws("_", col(command), col(output)))


def flags(items: Column | str, flag: str) -> Column:
    """'-f x' for each item, or '-f=x' if the flag ends so, joined by blanks."""
    return F.array_join(F.transform(col(items), lambda x: F.concat(F.lit(flag if flag.endswith("=") else flag + " "), x)), " ")


def without_secrets(config: Column | str, pattern: str = "(?i)password|secret|token|key") -> Column:
    return F.map_filter(col(config), lambda k, _: ~k.rlike(pattern))
