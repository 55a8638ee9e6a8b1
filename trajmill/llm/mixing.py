"""Mixing sources to target weights with a low-discrepancy schedule.

The mix is a sequence of slots of BLOCK tokens (words). Slot t has the golden-ratio point frac(t / phi); the cumulative
target weights map the point to a source. The r-th slot of a source takes block r (modulo the number of blocks: a second
pass over the source) of the source's shuffled documents, laid end to end and cut into blocks of equal tokens. Points of
the golden-ratio sequence spread evenly, so any stretch of the mix has every source within a few blocks of its weight.

Ranks and positions are running sums per source. They are computed in buckets (of slot numbers, or of the hash that
shuffles) with the buckets' offsets added, so a source with a third of all rows is spread over many tasks; so are rows that
share a doc_id, or have none, by their texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajmill.llm.common import WORD, range_of, written

BLOCK = 128
SHARE = 1.5
MOST = 2
WEIGHTS = (3, 1, 2)
SEED = 20
_SCALE = 2**31
#: The odd integer next to 2**31 / phi: multiples modulo 2**31 are the golden-ratio points, exactly, for any slot number.
_GOLDEN = 1327217885
_SLOT_BUCKET = 4096
_ROWS_A_BUCKET = 512


def source_targets(totals: list[tuple[str | None, int]], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> dict[str | None, float]:
    """Each source's target: sources by code point (null last) have the repeating weights and share `share` of all sizes;
    none gets more than `most` times its size, and what that leaves over is shared again by weight."""
    ordered = sorted(totals, key=lambda x: (x[0] is None, (x[0] or "").encode()))
    weight = {s: float(weights[i % len(weights)]) for i, (s, _) in enumerate(ordered)}
    open_, left = dict(ordered), share * sum(n for _, n in ordered)
    done: dict[str | None, float] = {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = [s for s, n in open_.items() if unit * weight[s] > most * n]
        if not full:
            return done | {s: unit * weight[s] for s in open_}
        for s in full:
            done[s] = float(most * open_.pop(s))
            left -= done[s]
    return done


def running(df: DataFrame, keys: list[str], bucket: str, order: list[str], value: Column, name: str) -> DataFrame:
    """df with the sum of `value` over the rows of its keys that come before it; buckets must agree with the order."""
    df = df.withColumn("__v", value)
    sums = df.groupBy(*keys, bucket).agg(F.sum("__v").alias("__s"))
    earlier = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, bucket, F.coalesce(F.sum("__s").over(earlier), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("__in", F.coalesce(F.sum("__v").over(inside), F.lit(0)))
    return df.join(sums, [*keys, bucket]).withColumn(name, F.col("__before") + F.col("__in")).drop("__v", "__before", "__in", bucket)


def schedule(spark, sources: list[dict], block: int = BLOCK) -> DataFrame:
    """The mix's slots: t, s (a source's index in `sources`), rank among the source's slots, and the block it takes."""
    total = sum(x["target"] for x in sources)
    slots = round(total / block)
    bounds, at = [], 0.0
    for x in sources[:-1]:
        at += x["target"]
        bounds.append(min(_SCALE, round(at / max(total, 1) * _SCALE)))
    point = F.expr(f"((id + 1) % {_SCALE} * {_GOLDEN}) % {_SCALE}")
    df = spark.range(slots).withColumn("__p", point).select(F.col("id").alias("t"), range_of(F.col("__p"), bounds, "long").cast("long").alias("s"), F.expr(f"id div {_SLOT_BUCKET}").alias("__bucket"))
    df = running(df, ["s"], "__bucket", ["t"], F.lit(1), "rank")
    blocks = F.get(F.array(*[F.lit(x["blocks"]).cast("long") for x in sources]), F.col("s").cast("int"))
    return df.withColumn("__n", blocks).where(f"__n > 0 and rank < {MOST} * __n").select("t", "s", "rank", F.expr("rank % __n").alias("block"))


def token_blocks(rows: DataFrame, buckets: int, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """The pieces of the sources' blocks: s, block, row, and words from `begin` up to `end` of the document.

    rows: s, doc_id, digest, row, size. Documents are shuffled by a hash of doc_id and text; of rows equal in both, which one
    comes first makes no difference to the result."""
    df = rows.where("size > 0").withColumn("__h", F.xxhash64(F.lit(seed), "doc_id", "digest"))
    bits = max(0, (buckets - 1).bit_length())
    df = df.withColumn("__bucket", F.shiftright("__h", 64 - bits) if bits else F.lit(0).cast("long"))
    df = running(df, ["s"], "__bucket", ["__h", "doc_id", "digest", "size", "row"], F.col("size"), "__start")
    df = df.withColumn("block", F.explode(F.expr(f"sequence(__start div {block}, (__start + size - 1) div {block})")))
    begin = F.greatest(F.lit(0).cast("long"), F.col("block") * block - F.col("__start"))
    return df.select("s", "block", "row", begin.alias("begin"), F.least(F.col("size"), (F.col("block") + 1) * block - F.col("__start")).alias("end"))


def sizes(docs: DataFrame) -> DataFrame:
    """A written table of doc_id, source, row number, size in words (a null text has none) and the text's digest."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return written(docs.select("doc_id", "source", F.monotonically_increasing_id().alias("row"), size.alias("size"), F.xxhash64("text").alias("digest")))


def mix(docs: DataFrame, block: int = BLOCK, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(the mix: t, row, begin, end of each piece in its order; the documents: doc_id, source, row, size, source_size, target)."""
    rows = sizes(docs)
    totals = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()  # a row a source
    targets = source_targets([(r.source, r["size"]) for r in totals])
    names = sorted(targets, key=lambda s: (s is None, (s or "").encode()))
    total = {r.source: r["size"] for r in totals}
    sources = [{"target": targets[s], "blocks": -(-total[s] // block)} for s in names]
    spark = docs.sparkSession
    plan = spark.createDataFrame([(s, i, total[s], targets[s]) for i, s in enumerate(names)], "__source string, s long, source_size long, target double")
    rows = rows.join(F.broadcast(plan) if len(names) <= 10_000 else plan, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    buckets = max(1, sum(r.n for r in totals) // _ROWS_A_BUCKET)
    pieces = token_blocks(rows, buckets, block, seed)
    return schedule(spark, sources, block).join(pieces, ["s", "block"]).select("t", "row", "begin", "end"), rows


def mix_documents(docs: DataFrame, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """Every document's size, its source's size and target, and `taken`: the words that the mix takes of it, with repeats.

    Every row has one result, also rows that share a doc_id, rows without words (taken 0) and those of a null source.
    A source's taken words differ from its target by a few blocks; no document is taken more than twice. The result depends
    on the rows alone: it is the same from run to run and for any order or partitioning of them. Other columns are ignored.
    No rows: no rows.
    """
    pieces, rows = mix(docs, block, seed)
    taken = pieces.groupBy("row").agg(F.sum(F.col("end") - F.col("begin")).alias("taken"))
    df = rows.join(taken, "row", "left")
    return df.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source")
