"""Conditions that a table must meet, as filters of its own plan: a row that breaks one fails the action that would have used it.

No job runs ahead of the result, and none can be left out: an optimiser may move a filter, not drop it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajmill.operators.groups import _contrast


def require(df: DataFrame, condition: Column, message: Column | str) -> DataFrame:
    """df, whose rows all meet the condition (null is no), or an error with the message of one that does not."""
    text = F.lit(message) if isinstance(message, str) else message
    return df.where(F.when(F.coalesce(condition, F.lit(False)), F.lit(True)).otherwise(F.raise_error(text).cast("boolean")))


def _shown(*columns: str) -> Column:
    return F.concat_ws(", ", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns])


def require_columns(df: DataFrame, *columns: str) -> DataFrame:
    """df, if it has the columns; else an error now."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError("refused: no column " + ", ".join(missing))
    return df


def require_unique(df: DataFrame, id_col: str, among: Column | None = None) -> DataFrame:
    """df, if no two of its rows (of those `among` is true for) share an id. One window over the id."""
    looked_at = F.lit(True) if among is None else F.coalesce(among, F.lit(False))
    counted = df.withColumn("__same", F.count_if(looked_at).over(Window.partitionBy(id_col)))
    return require(counted, ~looked_at | (F.col("__same") == 1), F.concat(F.lit("repeated id: "), _shown(id_col))).drop("__same")


def require_all(wanted: DataFrame, df: DataFrame, id_col: str, what: str) -> DataFrame:
    """The rows of df for the ids of `wanted`, all of which df must have."""
    marked = wanted.select(id_col).distinct().join(df.withColumn("__there", F.lit(True)), id_col, "left")
    return require(marked, F.col("__there"), F.concat(F.lit(f"{what}: "), _shown(id_col))).select(*df.columns)


def fail_closed(df: DataFrame, key: str, outcome: str) -> DataFrame:
    """df, every row of which has a group and an outcome that is a number; an outcome is never guessed from another column."""
    df = require_columns(df, key, outcome)
    number = F.col(outcome).try_cast("double")
    good = F.col(key).isNotNull() & number.isNotNull() & ~F.isnan(number)
    return require(df, good, F.concat(F.lit("refused: a row without group or outcome: "), _shown(key, outcome)))


def live_rows_only(df: DataFrame, key: str, outcome: str, ready: str | None = None) -> DataFrame:
    """The filter before an aggregate over groups: rows of groups with contrast, by the raw outcome. Fails where key or outcome is
    missing, and where rows came but none is left: a mean over nothing is no mean. `ready`: a column that says so is also required to be true."""
    df = fail_closed(df, key, outcome)
    if ready is not None:
        df = require(require_columns(df, ready), F.col(ready), f"refused: a row that is not {ready}")
    marked = df.withColumn("__live", _contrast(Window.partitionBy(key), outcome))
    some = marked.agg(F.max("__live").alias("__some"))  # one row
    return require(marked.join(F.broadcast(some)), F.col("__some"), "refused: no group has contrast").where("__live").drop("__live", "__some")
