"""Writing rows as JSON lines, CSV and Parquet, and small summaries as JSON or Markdown."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sorted_fields(kind: T.DataType, value: Column) -> Column:
    """`value` with the fields of all its structs in order of name."""
    if isinstance(kind, T.StructType):
        inner = F.struct(*[sorted_fields(kind[n].dataType, value[n]).alias(n) for n in sorted(kind.names)])
        return F.when(value.isNotNull(), inner)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: sorted_fields(kind.elementType, x))
    return value


def write_jsonl(df: DataFrame, path: str, order: list[str] | None = None, mode: str = "error") -> None:
    """JSON lines with sorted keys; in one file and this order, if given (for tables that fit one task)."""
    df = df.select(*[sorted_fields(df.schema[n].dataType, F.col(f"`{n}`")).alias(n) for n in sorted(df.columns)])
    if order:
        df = df.coalesce(1).sortWithinPartitions(*order)
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def csv_cells(df: DataFrame, digits: int = 4) -> DataFrame:
    """df with lists joined by | and doubles with fixed digits."""
    def cell(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ArrayType):
            return F.array_join(c.cast("array<string>"), "|")
        if isinstance(f.dataType, T.DoubleType | T.FloatType):
            return F.when(c.isNotNull(), F.format_string(f"%.{digits}f", c))
        return c

    return df.select(*[cell(f).alias(f.name) for f in df.schema])


def write_csv(parts: list[DataFrame], path: str, mode: str = "error") -> None:
    """The union of tables under the union of their columns, in order of first appearance."""
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    csv_cells(whole).write.mode(mode).option("header", True).csv(path)


def write_rollouts(df: DataFrame, path: str, mode: str = "append") -> None:
    """JSON lines in whatever order rows are done; order is no part of what is written."""
    write_jsonl(df, path, mode=mode)


def append_manifest(df: DataFrame, path: str) -> None:
    """Adds rows to a manifest: a folder of CSV parts without headers, and `_columns.csv`, written when the manifest is new."""
    spark = df.sparkSession
    names = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_columns.csv")
    files = names.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(names):
        with_header = files.create(names, False)
        with_header.write(bytearray((",".join(df.columns) + "\n").encode()))
        with_header.close()
    csv_cells(df).write.mode("append").option("header", False).csv(path)


def train_and_test(df: DataFrame, ordinal: str, n_test: int) -> tuple[DataFrame, DataFrame]:
    """(all but the first n_test rows, these); a table with no more rows than that is both."""
    if df.count() <= n_test:
        return df, df
    return df.where(F.col(ordinal) >= n_test), df.where(F.col(ordinal) < n_test)


def write_train_and_test(df: DataFrame, path: str, ordinal: str, n_test: int) -> None:
    """train_and_test() as the Parquet tables `train` and `test` below path."""
    for name, part in zip(("train", "test"), train_and_test(df, ordinal, n_test), strict=True):
        part.write.parquet(f"{path}/{name}")


def console(df: DataFrame, title: str, rows: int = 40) -> str:
    """A summary's first rows as an aligned table, printed and returned."""
    cells = [df.columns, *[["-" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r] for r in df.limit(rows).collect()]]
    widths = [max(len(r[i]) for r in cells) for i in range(len(df.columns))]
    text = "\n".join([title, *["  ".join(c.ljust(w) for c, w in zip(r, widths, strict=True)).rstrip() for r in cells]])
    print(text)
    return text


#: Rows of a summary at most: summaries go through the driver, tables don't.
SUMMARY_ROWS = 10_000


def _few(df: DataFrame) -> list:
    rows = df.limit(SUMMARY_ROWS + 1).collect()
    if len(rows) > SUMMARY_ROWS:
        raise ValueError(f"a summary of more than {SUMMARY_ROWS} rows; write it as a table")
    return rows


def summary_json(df: DataFrame) -> str:
    """A summary of a few rows as JSON with sorted keys; more than SUMMARY_ROWS are an error."""
    return json.dumps([json.loads(x[0]) for x in _few(df.select(F.to_json(F.struct(*df.columns))))], indent=2, sort_keys=True, ensure_ascii=False)


def summary_markdown(df: DataFrame, title: str) -> str:
    """A summary of a few rows as a Markdown table; more than SUMMARY_ROWS are an error."""
    rows = [df.columns, ["---"] * len(df.columns), *[[("" if v is None else f"{v:.4f}" if isinstance(v, float) else "<br>".join(map(str, v)) if isinstance(v, list) else str(v)) for v in r] for r in _few(df)]]
    return f"# {title}\n\n" + "\n".join("| " + " | ".join(r) + " |" for r in rows) + "\n"
