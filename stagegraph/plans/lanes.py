"""The branch algebra as lazy plans: a stage maps a DataFrame to a DataFrame, and a lane is a key column.

``a + b`` runs b on a's output. ``a + [b, c]`` gives both the same input, as lanes named by position or, with a dict, by name.
``split(...) * plan`` runs the plan once over all keys: lanes differ by their rows' ``branch``, so a hundred lanes are one plan and not a
hundred. ``merge`` is the union of lanes with the first of equal paths kept. Nothing runs before an action.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Body = Callable[..., DataFrame]
LANE, SEGMENT = "branch", "segment"


class Plan:
    """Something that maps a DataFrame to a DataFrame, and composes."""

    def __call__(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def __add__(self, other) -> Plan:
        return Chain((self, as_plan(other)))

    def __radd__(self, other) -> Plan:
        return Chain((as_plan(other), self))

    def __rmul__(self, keys) -> Plan:
        return Keyed(keys, self)

    def when(self, condition: Callable[[DataFrame], bool] | bool) -> Plan:
        """Run only if the condition holds; else the input passes through."""
        return When(self, condition)

    def edges(self, before: Sequence[str] = ()) -> tuple[list[tuple[str, str]], list[str]]:
        """(edges of stage names, the names at the end) of the definition."""
        raise NotImplementedError


@dataclass(frozen=True)
class Stage(Plan):
    """A named body. ``using`` binds parameters, ``note`` documents it."""

    name: str
    body: Body
    params: Mapping[str, object] = field(default_factory=dict)
    note: str = ""

    def __call__(self, df: DataFrame) -> DataFrame:
        made = self.body(df, **self.params)
        return df if made is None else made  # a stage without an output passes its input on

    def using(self, **params) -> Stage:
        return replace(self, params={**self.params, **params})

    def about(self, note: str) -> Stage:
        return replace(self, note=note)

    def edges(self, before=()):
        return [(b, self.name) for b in before], [self.name]


def stage(body: Body | None = None, *, name: str | None = None):
    """Decorator: a function as a stage of its name."""
    return partial(stage, name=name) if body is None else Stage(name or body.__name__, body)


@dataclass(frozen=True)
class Chain(Plan):
    parts: tuple[Plan, ...]

    def __call__(self, df):
        return reduce(lambda d, p: p(d), self.parts, df)

    def edges(self, before=()):
        out: list[tuple[str, str]] = []
        for p in self.parts:
            more, before = p.edges(before)
            out += more
        return out, list(before)


@dataclass(frozen=True)
class Fan(Plan):
    """Segments side by side over one input; a lane is named by segment, after the branch it comes from."""

    segments: tuple[tuple[str, Plan], ...]

    def __call__(self, df):
        alone = len(self.segments) == 1

        def lane(name, plan):
            own = plan(df).withColumn(SEGMENT, F.lit(name))
            if LANE in df.columns:  # the branch that it comes from, and the segment if there is more than one
                return own.withColumn(LANE, F.concat_ws("_", F.nullif(F.col(LANE), F.lit("all")), *([] if alone else [F.lit(name)])))
            return own if LANE in own.columns else own.withColumn(LANE, F.lit(name))  # keys of the segment's own name its lanes

        return reduce(partial(DataFrame.unionByName, allowMissingColumns=True), (lane(n, p) for n, p in self.segments)) if self.segments else df

    def edges(self, before=()):
        out, ends = [], []
        for _, p in self.segments:
            more, last = p.edges(before)
            out, ends = out + more, ends + last
        return out, ends


@dataclass(frozen=True)
class Keyed(Plan):
    """A plan over keys: ``keys`` is a function that gives rows their ``branch`` (a split, a channel), or a list of keys, which every row
    then meets. A list is de-duplicated as text; an empty one passes the input through."""

    keys: Callable[[DataFrame], DataFrame] | Sequence
    plan: Plan

    def __call__(self, df):
        if callable(self.keys):
            return self.plan(self.keys(df))
        names = sorted({str(k) for k in self.keys})
        return self.plan(df.withColumn(LANE, F.explode(F.array(*map(F.lit, names))))) if names else df

    def edges(self, before=()):
        return self.plan.edges(before)


@dataclass(frozen=True)
class When(Plan):
    plan: Plan
    condition: Callable[[DataFrame], bool] | bool

    def __call__(self, df):
        return self.plan(df) if (self.condition(df) if callable(self.condition) else self.condition) else df

    def edges(self, before=()):
        return self.plan.edges(before)


def as_plan(x) -> Plan:
    if isinstance(x, Plan):
        return x
    if isinstance(x, Mapping):
        return Fan(tuple((str(k), as_plan(v)) for k, v in x.items()))
    if isinstance(x, (list, tuple)):
        return Fan(tuple((str(i), as_plan(v)) for i, v in enumerate(x)))
    return Stage(getattr(x, "__name__", "stage"), x)


def by_pattern(pattern, order: str = "natural") -> Callable[[DataFrame], DataFrame]:
    """Lanes from a split of ``path`` by a compiled pattern."""
    from stagegraph.operators.split import split

    return lambda files: split(files, pattern, order).withColumnRenamed("key", LANE)


def by_map(mapping: DataFrame, on: str = "path") -> Callable[[DataFrame], DataFrame]:
    """Lanes from a table (branch, path) of explicit files."""
    return lambda files: files.join(mapping.select(LANE, on), on)


def by_column(key: Column | str) -> Callable[[DataFrame], DataFrame]:
    """Lanes computed from the rows, as a stage's own forward split."""
    return lambda df: df.withColumn(LANE, key if isinstance(key, Column) else F.col(key).cast("string"))


def by_channel(channel: DataFrame, key: str) -> Callable[[DataFrame], DataFrame]:
    """Lanes of a channel's keys; rows of other keys go."""
    return lambda df: df.join(channel.select(F.col(key)).distinct(), key, "left_semi").withColumn(LANE, F.col(key).cast("string"))


def forward(source: DataFrame, target: DataFrame, key: str = LANE) -> DataFrame:
    """What one channel's lanes hand to another's lanes of the same key, besides the target's own rows."""
    return target.unionByName(source.join(target.select(key).distinct(), key, "left_semi"), allowMissingColumns=True)


def merge(lanes: DataFrame, by: str = "path", order: Sequence[str] = (LANE, "ord")) -> DataFrame:
    """The union of all lanes, the first of equal paths kept in lane order."""
    from stagegraph.operators.resolve import first_wins

    return first_wins(lanes, [by], list(order))


def merge_stages(lanes: DataFrame, value: str = "path") -> DataFrame:
    """Outputs of equal stages at equal positions of parallel lanes together, repeats included, in order."""
    ordered = F.array_sort(F.collect_list(F.struct(LANE, "ord", value)))
    return lanes.groupBy("position", "stage").agg(ordered[value].alias("outputs"))


def sequentially(items: Sequence, make: Callable[[object], Plan]) -> Plan:
    """A stage for each element, one after another."""
    return Chain(tuple(make(x) for x in items))


def only(df: DataFrame, branches: Sequence[str]) -> DataFrame:
    return df.where(F.col(LANE).isin(list(branches)))


def chromosome_lanes(files: DataFrame, names: Sequence[str]) -> DataFrame:
    """A lane for each label over the files that carry it as a dotted part; lanes without a file are skipped."""
    return files.withColumn("chr", F.explode(F.array(*map(F.lit, names)))).where(F.concat(F.lit("."), F.col("path"), F.lit(".")).contains(F.concat(F.lit("."), F.col("chr"), F.lit("."))))


def graph(plan: Plan, spark) -> DataFrame:
    """(src, dst): the definition's edges."""
    return spark.createDataFrame(sorted(set(plan.edges()[0])), "src string, dst string")


def check(df: DataFrame, name: str, condition: Column, otherwise: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One row (name, n, n_failed, passed) on the rows that break a condition; ``otherwise`` runs on those rows."""
    result = df.agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.count_if(~F.coalesce(condition, F.lit(False))).alias("n_failed")).withColumn("passed", F.col("n_failed") == 0)
    if otherwise is not None and not result.first().passed:
        otherwise(df.where(~F.coalesce(condition, F.lit(False))))
    return result


def graph_json(plan: Plan, spark) -> DataFrame:
    """One row: the definition as {"nodes": [...], "edges": [{"from", "to"}]}, stages in order of appearance."""
    edges, ends = plan.edges()
    names = list(dict.fromkeys([x for e in edges for x in e] + list(ends)))
    rows = spark.createDataFrame([(names, [{"from": a, "to": b} for a, b in dict.fromkeys(edges)])], "nodes array<string>, edges array<struct<from:string,to:string>>")
    return rows.select(F.to_json(F.struct("nodes", "edges")).alias("json"))
