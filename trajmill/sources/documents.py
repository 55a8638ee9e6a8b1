"""Large JSON documents: the elements of one array in a file, read by as many tasks as the file has splits.

Spark's text reader cuts files at closing braces, wherever its splits begin, so no task reads a whole file and any store that Spark
reads will do. Whether a split begins inside a string, and how deep, is known from the splits before it: a first pass finds what each
split does to either case, a second one starts every split as it must. Elements that lie in one split are given out there; parts
of the others are put together by their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajmill.sinks.tables import written

#: Bytes before a container in which its key is looked for.
_CONTEXT = 128
_STATES = ((0, False), (1, False), (1, True))


def _outside(text: np.ndarray, inside: int, escaped: bool) -> tuple[np.ndarray, int, bool]:
    """Which bytes lie outside strings (quotes don't), and whether the text ends in a string and after an odd run of backslashes."""
    place = np.arange(len(text))
    slash = text == 92
    other = np.maximum.accumulate(np.where(slash, -2 if escaped else -1, place))
    odd = (place - other) & 1 == 1  # runs of backslashes that end here
    quote = (text == 34) & ~np.append(escaped, odd[:-1])
    count = np.cumsum(quote)
    return ((inside + count - quote) & 1 == 0) & ~quote, int(inside + count[-1]) & 1, bool(odd[-1])


def _delta(text: np.ndarray, outside: np.ndarray) -> np.ndarray:
    return ((((text == 91) | (text == 123)) & outside).astype(np.int32)) - (((text == 93) | (text == 125)) & outside)


def _splits(batches: Iterator[pa.RecordBatch], known: int) -> Iterator[tuple[list, Iterator[np.ndarray]]]:
    """For each (file, block) of a partition its first `known` columns and its bytes, part by part."""
    from itertools import chain, groupby

    def parts() -> Iterator[tuple[tuple, np.ndarray]]:
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(known)), strict=True))
            at = 0
            for key, same in groupby(keys):
                n = len(list(same))
                pieces = batch.column(known).slice(at, n).to_pylist()
                yield key, np.frombuffer(("}".join(pieces) + "}").encode(), np.uint8)
                at += n

    for key, same in groupby(parts(), key=lambda p: p[0]):
        yield list(key), chain(x[1] for x in same)


def elements(spark: SparkSession, paths: str | list[str], field: str, bare: bool = False, **options: str) -> DataFrame:
    """(file_path, ordinal, value): the JSON texts of the elements of each file's array, in order from 0: that of the top-level object's
    key `field`, or (bare) a top-level array. A file without such an array has no rows; one that is no whole document is an error.

    The driver learns two numbers a split, and no text. options: of Spark's text reader."""
    text = spark.read.options(**options).option("lineSep", "}").text(paths)
    pieces = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")

    def effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, parts in _splits(batches, 2):
            now, depth, first = [list(s) for s in _STATES], [0, 0, 0], ""
            for part in parts:
                first = first or part.tobytes().strip()[:1].decode("latin-1")
                for s in range(3):
                    outside, now[s][0], now[s][1] = _outside(part, *now[s])
                    depth[s] += int(_delta(part, outside).sum())
            ends = [_STATES.index((i, i == 1 and e)) for i, e in now]
            yield pa.RecordBatch.from_pylist([{"file": key[0], "block": key[1], "first": first, "ends": ends, "depths": depth}], pa.schema([("file", pa.string()), ("block", pa.int64()), ("first", pa.string()), ("ends", pa.list_(pa.int32())), ("depths", pa.list_(pa.int32()))]))

    def starts(table: pa.Table) -> pa.Table:
        state, depth, out, root = 0, 0, [], ""
        rows = sorted(table.to_pylist(), key=lambda r: r["block"])
        for r in rows:
            root = root or r["first"]
            out.append({"file": r["file"], "block": r["block"], "state": state, "depth": depth, "root": root})
            state, depth = r["ends"][state], depth + r["depths"][state]
        if state or depth not in (0, -1):  # -1: a file that does not end with the brace that it was cut at
            raise ValueError(f"{rows[0]['file']}: not a whole JSON document")
        return pa.Table.from_pylist(out, pa.schema([("file", pa.string()), ("block", pa.int64()), ("state", pa.int32()), ("depth", pa.int32()), ("root", pa.string())]))

    effect = pieces.mapInArrow(effects, "file string, block bigint, first string, ends array<int>, depths array<int>")
    start = effect.groupBy("file").applyInArrow(starts, "file string, block bigint, state int, depth int, root string")  # as many rows as splits
    begins = {(r.file, r.block): (r.state, r.depth, r.root) for r in start.collect()}
    sent = spark.sparkContext.broadcast(begins)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a split, by kind: whole elements (e), what lies before the first border (head) and, of an element, after the last (tail, else
        gap), containers ([ or {, with what stands before) and the split's last bytes (end). container: the number of the split's container, 0
        for one that began before."""
        for (file, block), parts in _splits(batches, 2):
            state, depth, root = sent.value[file, block]
            inside, escaped = _STATES[state]
            level = 1 if root == "[" else 2
            rest, out, n, container, context, size, kind = [], [], 0, 0, b"", 0, "head"
            for part in parts:
                outside, inside, escaped = _outside(part, inside, escaped)
                delta = _delta(part, outside)
                after = depth + np.cumsum(delta, dtype=np.int32)
                opens = (delta == 1) & (after == level)
                closes = (delta == -1) & (after == level - 1)
                depth, at, raw = int(after[-1]), 0, part.tobytes()
                for p in np.flatnonzero(opens | closes | ((part == 44) & outside & (after == level))).tolist():
                    rest.append(raw[at:p])
                    if kind != "gap":
                        value = b"".join(rest)
                        size += len(value)
                        out.append((file, block, n, kind, container, value.decode()))
                    if opens[p]:
                        container += 1
                        out.append((file, block, n, chr(part[p]), container, (context + raw[:p])[-_CONTEXT:].decode(errors="replace")))
                    n, kind, at, rest = n + 1, "gap" if closes[p] else "e", p + 1, []
                    if size > 1 << 22:
                        yield _rows(out)
                        out, size = [], 0
                rest.append(raw[at:])
                context = (context + raw)[-_CONTEXT:]
            out.append((file, block, n, {"e": "tail"}.get(kind, kind), container, b"".join(rest).decode() if kind != "gap" else ""))
            out.append((file, block, n, "end", container, context.decode(errors="replace")))
            yield _rows(out)

    rows = written(pieces.mapInArrow(found, "file string, block bigint, n bigint, kind string, container bigint, value string"))
    return _gathered(rows, field, bare)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["file", "block", "n", "kind", "container", "value"])


def _gathered(rows: DataFrame, field: str, bare: bool) -> DataFrame:
    """The elements of the wanted containers: whole ones, and those whose parts lie in several splits (a few rows a split)."""
    kind = F.col("kind")
    place = F.struct("block", "container")
    splits = rows.where("kind != 'e'").groupBy("file", "block").agg(
        F.max(F.when(F.col("container") > 0, place)).alias("last"), F.max(F.when(kind == "end", F.col("value"))).alias("end"), F.max(F.when(kind.isin("tail", "gap"), F.struct("block", "kind"))).alias("open"),
    )
    by = Window.partitionBy("file").orderBy("block")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "block", F.last("last", ignorenulls=True).over(before).alias("earlier"), F.coalesce(F.lag("end").over(by), F.lit("")).alias("context"), F.last("open", ignorenulls=True).over(before).alias("opened"))
    known = rows.join(splits, ["file", "block"]).withColumn("id", F.when(F.col("container") > 0, place).otherwise(F.col("earlier")))

    named = r'"((?:[^"\\]|\\.)*)"\s*:\s*$'
    said = F.concat("context", "value")
    wanted = F.regexp_extract(said, named, 1) == field
    wanted = known.where(kind == "[").where(wanted | ~said.rlike(named) if bare else wanted & said.rlike(named)).select("file", "id")

    whole = known.where(kind == "e").select("file", "block", "n", "id", "value")
    parts = known.where(kind == "tail").select("file", F.col("block").alias("from"), "block", "n", "id", "value").unionByName(
        known.where((kind == "head") & (F.col("opened.kind") == "tail")).select("file", F.col("opened.block").alias("from"), "block", F.lit(None).cast("bigint").alias("n"), F.lit(None).cast("struct<block:bigint,container:bigint>").alias("id"), "value")
    )
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "value"))), lambda x: x["value"]), "")
    joined = parts.groupBy("file", "from").agg(F.max("n").alias("n"), F.max("id").alias("id"), text.alias("value")).select("file", F.col("from").alias("block"), "n", "id", "value")
    all_ = whole.unionByName(joined).withColumn("value", F.regexp_replace("value", r"^[ \t\r\n]+|[ \t\r\n]+$", "")).where("value != ''").join(wanted, ["file", "id"], "left_semi")
    counts = all_.groupBy("file", "block").agg(F.count("*").alias("c")).select("file", "block", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("earlier"))
    inside = F.row_number().over(Window.partitionBy("file", "block").orderBy("n")) - 1
    return all_.withColumn("i", inside).join(counts, ["file", "block"]).select(F.col("file").alias("file_path"), (F.col("earlier") + F.col("i")).alias("ordinal"), "value")
