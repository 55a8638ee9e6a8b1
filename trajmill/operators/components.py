"""Scores from component rows: struct<name, value, tags> arrays a trajectory."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ComponentFilter:
    """Matches a component by any of: its name, one of its tags, its sign."""

    names: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    positive: bool = False
    negative: bool = False

    def matches(self, c: Column) -> Column:
        out = F.lit(False)
        if self.names:
            out = out | c["name"].isin(*self.names)
        if self.tags:
            out = out | F.arrays_overlap(c["tags"], F.array(*map(F.lit, self.tags)))
        if self.positive:
            out = out | (c["value"] > 0)
        if self.negative:
            out = out | (c["value"] < 0)
        return out


@dataclass(frozen=True)
class Ablation:
    """A spec: components that match include (all, if there is none) and don't match exclude."""

    name: str
    include: ComponentFilter | None = None
    exclude: ComponentFilter | None = None
    zero: bool = False
    keep: dict = field(default_factory=dict)

    def select(self, components: Column) -> Column:
        if self.zero:
            return F.filter(components, lambda _: F.lit(False))
        return F.filter(components, lambda c: (self.include.matches(c) if self.include else F.lit(True)) & ~(self.exclude.matches(c) if self.exclude else F.lit(False)))


def score(components: Column) -> Column:
    return F.aggregate(components, F.lit(0.0), lambda acc, c: acc + c["value"])


def normalized(components: Column) -> Column:
    """The sum over the sum of absolutes; 0 where that is 0."""
    size = F.aggregate(components, F.lit(0.0), lambda acc, c: acc + F.abs(c["value"]))
    return F.when(size > 0, score(components) / size).otherwise(0.0)


def risk_tags(components: Column) -> Column:
    """The sorted distinct tags of the negative components."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter(components, lambda c: c["value"] < 0), lambda c: c["tags"]))))


def scored(df: DataFrame, components: str = "components") -> DataFrame:
    c = F.col(components)
    return df.withColumns({"score": score(c), "normalized": normalized(c), "risk_tags": risk_tags(c)})


def ablated(df: DataFrame, specs: list[Ablation], components: str = "components") -> DataFrame:
    """A row for each trajectory and spec, with score, normalized and risk_tags of the spec's components.

    The specs are expressions of one projection and one explode: no join, and df is read once."""
    per_spec = F.array(*[F.struct(F.lit(s.name).alias("spec"), s.select(F.col(components)).alias("kept")) for s in specs])
    df = df.withColumn("__s", F.explode(per_spec)).drop(components).withColumns({"spec": F.col("__s.spec"), components: F.col("__s.kept")}).drop("__s")
    return scored(df, components)


def scored_rows(rows: DataFrame, *key: str) -> DataFrame:
    """scored() for components as rows (key, name, value, tags): one aggregate, no arrays of components."""
    total, size = F.sum("value"), F.sum(F.abs("value"))
    tags = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(F.col("value") < 0, F.col("tags"))))))
    return rows.groupBy(*key).agg(total.alias("score"), F.when(size > 0, total / size).otherwise(0.0).alias("normalized"), tags.alias("risk_tags"))


def ablated_rows(rows: DataFrame, specs: list[Ablation], *key: str) -> DataFrame:
    """(key, spec, score, normalized) for components as rows (key, name, value, tags): two sums a spec in one aggregate."""
    c = F.struct("name", "value", "tags")

    def kept(s: Ablation) -> Column:
        return F.lit(False) if s.zero else (s.include.matches(c) if s.include else F.lit(True)) & ~(s.exclude.matches(c) if s.exclude else F.lit(False))

    of = lambda s, x: F.coalesce(F.sum(F.when(kept(s), x)), F.lit(0.0))
    sums = rows.groupBy(*key).agg(*[F.struct(F.lit(s.name).alias("spec"), of(s, F.col("value")).alias("score"), of(s, F.abs("value")).alias("size")).alias(f"__{i}") for i, s in enumerate(specs)])
    out = sums.select(*key, F.explode(F.array(*[f"__{i}" for i in range(len(specs))])).alias("s"))
    return out.select(*key, "s.spec", "s.score", F.when(F.col("s.size") > 0, F.col("s.score") / F.col("s.size")).otherwise(0.0).alias("normalized"))
