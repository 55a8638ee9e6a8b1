"""Rewards and advantage estimators by name. Built-in ones are columns and windows; a user's may also be functions over Arrow arrays.

A reward is a number for each row from its text and its gold. An estimator gives each row of a group its advantage from the group's
values and outcomes. What a user's function returns is checked where it is used: as many numbers as rows, none missing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajmill.functions import rewards
from trajmill.functions import text as tx
from trajmill.operators import groups
from trajmill.operators.guards import fail_closed, require, require_columns


@dataclass(frozen=True)
class Reward:
    """score: (text, gold) columns to a column; or arrow: (texts, golds) to as many numbers."""

    score: Callable[[Column, Column], Column] | None = None
    arrow: Callable[[pa.Array, pa.Array], pa.Array] | None = None


@dataclass(frozen=True)
class Estimator:
    """frame: (df, key, value, outcome) to df with column `advantage`; or arrow: a group's (values, outcomes) to as many advantages."""

    frame: Callable[[DataFrame, str, str, str], DataFrame] | None = None
    arrow: Callable[[pa.Array, pa.Array], pa.Array] | None = None


REWARDS: dict[str, Reward] = {}
ESTIMATORS: dict[str, Estimator] = {}


def _register(known: dict, name: str, made: Reward | Estimator, forms: tuple) -> None:
    if not name or sum(f is not None for f in forms) != 1:
        raise ValueError("a plugin has a name and one of its two forms")
    if name in known:
        raise ValueError(f"{name} is registered already")
    known[name] = made


def register_reward(name: str, score: Callable | None = None, arrow: Callable | None = None) -> None:
    _register(REWARDS, name, Reward(score, arrow), (score, arrow))


def register_estimator(name: str, frame: Callable | None = None, arrow: Callable | None = None) -> None:
    _register(ESTIMATORS, name, Estimator(frame, arrow), (frame, arrow))


def _numbers(found: pa.Array, n: int, name: str) -> pa.Array:
    found = found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found if isinstance(found, pa.Array) else pa.array(found)
    found = found.cast(pa.float64())
    if len(found) != n:
        raise ValueError(f"{name}: {len(found)} numbers for {n} rows")
    if found.null_count or (n and not pc.all(pc.is_finite(found)).as_py()):
        raise ValueError(f"{name}: a value that is no number")
    return found


def _named(known: dict, name: str):  # noqa: ANN202
    if name not in known:
        raise ValueError(f"unknown name {name}, known are {', '.join(sorted(known))}")
    return known[name]


def reward(name: str, text: Column, gold: Column) -> Column:
    """The registered reward as a column."""
    own = _named(REWARDS, name)
    if own.score is not None:
        return own.score(text, gold).cast("double")
    made = own.arrow

    @F.arrow_udf("double")
    def run(texts: pa.Array, golds: pa.Array) -> pa.Array:
        return _numbers(made(texts, golds), len(texts), name)

    return run(text, gold)


def scored(df: DataFrame, by: str, text: str, gold: str, names: list[str], out: str = "reward") -> DataFrame:
    """df with each row's reward by the registered one that its column `by` names; a row that names none of `names` is an error."""
    value = F.lit(None).cast("double")
    for name in names:  # a function over arrays sees all rows, and its numbers are used where it is named
        value = F.when(F.col(by) == name, reward(name, F.col(text), F.col(gold))).otherwise(value)
    df = require(df, F.col(by).isin(*names), F.concat(F.lit("no such reward: "), F.coalesce(F.col(by), F.lit("null"))))
    return df.withColumn(out, value)


def advantages(df: DataFrame, name: str, key: str, value: str, outcome: str) -> DataFrame:
    """df with `advantage` by the registered estimator. Rows without group, value or outcome are an error, as is an estimator that
    gives other than one number a row; a user's function gets a group's rows in one task."""
    own = _named(ESTIMATORS, name)
    df = fail_closed(require(require_columns(df, value), F.col(value).isNotNull(), "refused: a row without a value"), key, outcome)
    if own.frame is not None:
        made = own.frame(df, key, value, outcome)
        return require(require_columns(made, "advantage"), F.col("advantage").isNotNull(), f"{name}: a row without an advantage")
    made, columns = own.arrow, df.columns

    def run(group: pa.Table) -> pa.Table:
        return group.select(columns).append_column("advantage", _numbers(made(group[value].combine_chunks(), group[outcome].combine_chunks()), len(group), name))

    return df.groupBy(key).applyInArrow(run, ", ".join(f"`{c}` {kind}" for c, kind in df.dtypes) + ", advantage double")


register_reward("exact_match", lambda text, gold: rewards.qa_reward(text, F.array(gold), "em"))
register_reward("token_f1", lambda text, gold: rewards.qa_reward(text, F.array(gold), "f1"))
register_reward("number", lambda text, gold: tx.number_score(tx.flexible_answer(text)["value"], tx.flexible_answer(gold)["value"]))
register_reward("marked_number", lambda text, gold: F.when(tx.flexible_answer(text)["rule"] == "hash", tx.number_score(tx.flexible_answer(text)["value"], tx.flexible_answer(gold)["value"])).otherwise(0.0))
register_estimator("standard", lambda df, key, value, outcome: groups.sample_advantage(df, key, value))
register_estimator("gated", lambda df, key, value, outcome: groups.gated_advantage(df, key, value, outcome).drop("keep"))
register_estimator("population_gated", lambda df, key, value, outcome: groups.population_advantage(df, key, value, outcome))
register_estimator("continuous", lambda df, key, value, outcome: groups.population_advantage(df, key, value, value))
