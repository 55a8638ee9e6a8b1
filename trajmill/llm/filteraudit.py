"""What filters remove in every order: an incidence matrix product.

k filters split the rows of a part by which of them a row fails: 2**k masks. How many rows have a mask is a row of a matrix,
once for all rows of the part and once for each label; stacked, these rows are multiplied by integer matrices with a row for
each mask and a column for each (order, step), which say whether a row of that mask is kept after the step, removed there,
fails there but went earlier, or fails nothing else. Five filters make 32 masks and 600 columns. The texts are read once,
whatever the number of orders.

A later copy of a text (E) fails the same filters on its content as the first one, so copies are never gathered: the rows
with the smallest doc_id of their text are counted and taken from all rows of the part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajmill.llm.common import release, text_or_empty, written

#: Filters of the contract, in the order of their bits: short, repetitive, in capitals, symbols, copies.
FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10
SYMBOLS = r"[#$%&*|]"
_PARTS_AT_ONCE = 64


@cache
def incidence(filters: str) -> dict[str, np.ndarray]:
    """Integer matrices of 2**k masks by k! * k (order, step) pairs: kept, removed, redundant, unique."""
    masks = np.arange(1 << len(filters))
    orders = list(permutations(range(len(filters))))
    out = {name: np.zeros((len(masks), len(orders) * len(filters)), np.int64) for name in ("kept", "removed", "redundant", "unique")}
    for i, order in enumerate(orders):
        earlier = 0
        for step, f in enumerate(order):
            column, fails, gone = i * len(filters) + step, masks >> f & 1 == 1, masks & earlier != 0
            out["kept"][:, column] = ~fails & ~gone
            out["removed"][:, column] = fails & ~gone
            out["redundant"][:, column] = fails & gone
            out["unique"][:, column] = masks == 1 << f
            earlier |= 1 << f
    return out


@cache
def steps(filters: str) -> tuple[list[str], list[int], np.ndarray]:
    """Of every column of the matrices: the order, the step (from 1) and the filter applied there."""
    orders = list(permutations(range(len(filters))))
    names = ["".join(filters[f] for f in order) for order in orders for _ in order]
    return names, [s + 1 for order in orders for s in range(len(order))], np.array([f for order in orders for f in order])


def interactions(masks: DataFrame, filters: str = FILTERS) -> DataFrame:
    """masks: (part, mask int, n, good, toxic: longs), a part's rows of a mask in any number of rows. One row a part, order
    and step; no rows: no rows. At most eight filters, as the number of orders is their factorial."""
    if not 0 < len(set(filters)) == len(filters) <= 8:
        raise ValueError("one to eight filters of different names")
    k, size = len(filters), 1 << len(filters)
    summed = masks.groupBy("part", "mask").agg(*[F.sum(c).cast("bigint").alias(c) for c in ("n", "good", "toxic")])
    cells = summed.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # at most 2**k a part

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrices, (names, numbers, applied) = incidence(filters), steps(filters)
        for whole in batches:
            for at in range(0, len(whole), _PARTS_AT_ONCE):
                batch = whole.slice(at, _PARTS_AT_ONCE)
                parts = batch.column(0)
                flat = batch.column(1).flatten()
                row = np.repeat(np.arange(len(parts)), np.diff(batch.column(1).offsets.to_numpy()))
                mask, *counts = (np.asarray(flat.field(i)) for i in range(4))
                stacked = np.zeros((3, len(parts), size), np.int64)  # all, good, toxic
                for label, n in enumerate(counts):
                    stacked[label, row, mask] = n
                stacked = stacked.reshape(-1, size)
                removed = (stacked @ matrices["removed"]).reshape(3, len(parts), -1)
                totals = np.stack([removed[0][:, applied == f].sum(axis=1) for f in range(k)], axis=1)  # over all orders
                found = {
                    "kept": stacked[: len(parts)] @ matrices["kept"], "removed": removed[0], "redundant": stacked[: len(parts)] @ matrices["redundant"],
                    "unique_fails": stacked[: len(parts)] @ matrices["unique"], "good_lost": removed[1], "toxic_lost": removed[2], "shapley": totals[:, applied],
                }
                yield pa.RecordBatch.from_arrays(
                    [parts.take(pa.array(np.repeat(np.arange(len(parts)), len(names)))), pa.array(names * len(parts)), pa.array(numbers * len(parts), pa.int32()), *[pa.array(x.ravel()) for x in found.values()]],
                    ["part", "filter_order", "step", *found],
                )

    longs = ", ".join(f"{c} bigint" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))
    return cells.mapInArrow(run, f"part {dict(masks.dtypes)['part']}, filter_order string, step int, {longs}")


def content_mask(text: Column) -> Column:
    """Bits 0 to 3: the text fails A, B, C, D."""
    words = F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "), "")
    n, distinct, chars = F.size(words), F.size(F.array_distinct(words)), F.char_length(text)
    capitals = chars - F.char_length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    fails = [n < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * n, 100 * capitals > MOST_CAPITALS * chars, text.rlike(SYMBOLS)]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters for every lang of docs.

    A null text is empty, a null lang the part ''. Of rows with equal texts all fail E but those with the smallest doc_id;
    a null doc_id is neither smaller nor larger than another, so its row passes and makes no other fail. A document is good
    (toxic) if any of its rows in `labels` says so; null labels say nothing, those of a null doc_id belong to no document.
    Other columns are ignored. No rows: no rows.
    """
    text = text_or_empty()
    part = F.coalesce("lang", F.lit("")).alias("part")
    own = written(docs.select("doc_id", part, content_mask(text).alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest")))
    rows = own.where("doc_id is not null").groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n"))
    flag = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c)
    said = labels.where("doc_id is not null and (quality = 1 or toxic = 1)").groupBy("doc_id").agg(flag("quality"), flag("toxic"))
    known = written(rows.join(said, "doc_id", "left").select("doc_id", "digest", "part", "mask", "n", F.coalesce(F.col("quality") * F.col("n"), F.lit(0)).alias("good"), F.coalesce(F.col("toxic") * F.col("n"), F.lit(0)).alias("toxic")))
    first = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    counts = lambda df: df.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
    nameless = counts(own.where("doc_id is null").select("part", "mask", F.lit(1).alias("n"), F.lit(0).alias("good"), F.lit(0).alias("toxic")))
    kept = written(counts(known.join(first, ["doc_id", "digest"], "left_semi")).unionByName(nameless))  # as few rows as parts have masks
    copies = counts(counts(known).unionByName(nameless).unionByName(kept.select("part", "mask", *[(-F.col(c)).alias(c) for c in ("n", "good", "toxic")])))
    masks = written(kept.unionByName(copies.withColumn("mask", F.col("mask") + (1 << FILTERS.index("E")))))
    release(own, known, kept)
    return interactions(masks)


#: The same counts for DuckDB, without matrices.
ORACLE = r"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, CASE WHEN len(words) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END
 || CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t) THEN 'C' ELSE '' END
 || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN w.doc_id > first THEN 'E' ELSE '' END AS fails, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic
 FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
h AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
s AS (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM o),
q AS (SELECT filter_order, step, filter_order[step] AS own, CASE WHEN step > 1 THEN filter_order[1:step - 1] ELSE '' END AS before FROM s),
r AS (SELECT part, filter_order, step, own, fails, n, good, toxic, contains(fails, own) AS hit, length(translate(fails, before, '')) < length(fails) AS gone FROM h, q),
g AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (NOT hit AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (hit AND NOT gone), 0) AS removed, coalesce(sum(n) FILTER (hit AND gone), 0) AS redundant,
 coalesce(sum(n) FILTER (fails = own), 0) AS unique_fails, coalesce(sum(good) FILTER (hit AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (hit AND NOT gone), 0) AS toxic_lost FROM r GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
 CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM g"""
