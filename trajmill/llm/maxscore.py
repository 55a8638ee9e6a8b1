"""Exact top-k inner-product search by MaxScore.

A vector's components are the weights of its terms. Candidates lie in blocks (shards), term by term, each term with the
largest and the smallest weight of the block. For a query these bound what a term can add. Taking terms from the largest
bound down, the essential ones are those without which the others' bounds could still reach the query's threshold: only
they are traversed for all candidates of the block. The others are probed, in groups, for the candidates whose score so far
plus the remaining bounds is competitive. Blocks' top k are merged by a window.

A query's threshold is its k-th best score with the SEEDS longest vectors of the whole table: it is found once, before the
blocks, and goes with the query to all of them; a block whose bounds don't reach it is passed over. Every candidate is
shuffled once, to its block; the queries are repeated, once a block, and stream past it: a task holds one block of
candidates, whose size does not depend on the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajmill.llm.common import partitions, written

K = 5
EVERY = 50
SCALE = 256
#: Components in a block of candidates.
_BLOCK, _LEAST_ROWS = 1 << 20, 256
_PROBE = 8
SEEDS = 256


def usable(vector: Column) -> Column:
    """Whether a vector is neither null nor holds null or non-finite components."""
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))


def integers(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """One row a term, one column a vector; shorter vectors end in zeros."""
    sizes = np.asarray(column.value_lengths())
    out = np.zeros((len(sizes), width), np.int64)
    if not len(sizes) or not width:
        return out.T
    values = np.asarray(column.flatten())
    if (sizes == width).all():
        return np.ascontiguousarray(values.reshape(-1, width).T)
    out[np.arange(width) < sizes[:, None]] = values
    return np.ascontiguousarray(out.T)


class Shard:
    """A block of candidates."""

    def __init__(self, ids: np.ndarray, terms: np.ndarray):
        order = np.argsort(ids, kind="stable")  # of equal scores the smaller id is found first
        self.ids, self.terms = ids[order], np.ascontiguousarray(terms[:, order])
        self.high, self.low = self.terms.max(1, initial=0), self.terms.min(1, initial=0)

    def top(self, own: int, query: np.ndarray, k: int, floor: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best candidates but `own`, ties to the smaller id; of those below `floor` none is needed."""
        bound = np.where(query > 0, query * self.high, query * self.low)
        if floor is not None and bound.sum() < floor:
            return self.ids[:0], self.ids[:0]
        order = np.argsort(-bound, kind="stable")
        left = np.append(np.cumsum(bound[order][::-1])[::-1][1:], 0)  # after each term, what the following can add
        essential = len(order) if floor is None else int(np.argmax(left < floor)) + 1 if (left < floor).any() else len(order)
        score = np.zeros(len(self.ids), np.int64)
        for j in order[:essential]:
            score += query[j] * self.terms[j]
        at = np.flatnonzero(self.ids != own)
        score = score[at]
        for i in range(essential, len(order), _PROBE):
            competitive = score + left[i - 1] >= floor
            at, score = at[competitive], score[competitive]
            group = order[i : i + _PROBE]
            score = score + query[group] @ self.terms[np.ix_(group, at)]
            if len(score) >= k:
                floor = max(floor, np.partition(score, -k)[-k] + min(0, int((query * np.where(query > 0, self.low, self.high))[order[i + _PROBE :]].sum())))
        if floor is not None:
            at, score = at[score >= floor], score[score >= floor]
        best = np.lexsort((self.ids[at], -score))[:k]
        return self.ids[at[best]], score[best]


def with_threshold(asked: DataFrame, seeds: list[tuple[int, list[int]]], width: int, k: int) -> DataFrame:
    """Queries (vec_id, x, row) with `floor`: the k-th best score among the seeds but the query's own; null if they are fewer."""
    ids = np.array([i for i, _ in seeds], np.int64)
    terms = _matrix(pa.array([x for _, x in seeds], pa.list_(pa.int64())), width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own = np.asarray(batch.column(0))
            scores = _matrix(batch.column(1), width).T @ terms
            floors = []
            for i, mine in zip(own, scores, strict=True):
                mine = mine[ids != i]
                floors.append(int(np.partition(mine, -k)[-k]) if len(mine) >= k else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(floors, pa.int64())], ["vec_id", "x", "row", "floor"])

    return asked.select("vec_id", "x", "row").mapInArrow(run, "vec_id bigint, x array<bigint>, row bigint, floor bigint")


def search(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each row whose vec_id is divisible by `every`.

    Rows with a null vec_id, a null vector or one with null or non-finite components take no part; a query's own vec_id is
    no candidate. Rows that share a vec_id are candidates (and queries) each. Vectors of several lengths are compared over
    the shorter one. An empty vector scores 0 with all. Other columns are ignored. No queries or candidates: no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    rows = written(rows.select("vec_id", integers(F.col("embedding")).alias("x"), F.monotonically_increasing_id().alias("row")))
    is_query = F.col("vec_id") % every == 0
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    length = F.aggregate("x", F.lit(0.0), lambda acc, v: acc + v.cast("double") * v)
    seeds = [(r.vec_id, list(r.x)) for r in rows.orderBy(length.desc(), "vec_id", "row").limit(SEEDS).collect()]
    blocks = max(1, -(-n * max(1, width) // _BLOCK), min(2 * partitions(spark), n // _LEAST_ROWS))
    asked = with_threshold(rows.where(is_query), seeds, width, k)
    candidates = rows.select(F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("side"), "vec_id", "x", F.lit(None).cast("long").alias("row"), F.lit(None).cast("long").alias("floor"))
    repeated = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("side"), "vec_id", "x", "row", "floor")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, shard = None, [], None
        for batch in batches:
            at, side, ids = (np.asarray(batch.column(i)) for i in range(3))
            cuts = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (side[1:] != side[:-1]))) if len(at) else []
            for a, b in zip(cuts, [*cuts[1:], len(at)], strict=True):
                if at[a] != block:
                    block, held, shard = at[a], [], None
                if side[a] == 0:
                    held.append((ids[a:b], _matrix(batch.column(3).slice(a, b - a), width)))
                    continue
                if held:
                    shard, held = Shard(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held], axis=1)), []
                if shard is None:
                    continue
                asking, out = _matrix(batch.column(3).slice(a, b - a), width), []
                for j, (line, floor) in enumerate(zip(batch.column(4).slice(a, b - a).to_pylist(), batch.column(5).slice(a, b - a).to_pylist(), strict=True)):
                    found, score = shard.top(ids[a + j], asking[:, j], k, floor)
                    out.append((np.full(len(found), ids[a + j]), np.full(len(found), line), found, score))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out, strict=True)], ["query_id", "row", "vec_id", "score"])

    dealt = candidates.union(repeated).repartition(blocks, "block").sortWithinPartitions("block", "side")
    found = dealt.mapInArrow(run, "query_id bigint, row bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
