"""Shards of near-equal bytes by a k-d tree over document metadata.

A node that is to hold k shards is split at the weighted quantile floor(k/2)/k along its widest dimension (the one whose
range, as a share of the whole table's, is largest). Weights are bytes. The quantile is found by distributed histograms:
each pass counts the bytes of every node's remaining range in equal bins, and only those counts (at most MOST_BINS rows for
up to MOST_BINS / 16 shards) reach the driver. Rows with one value are ordered by the text's checksum. Where a split would
run through a group of equal texts, it goes to the group's nearer end; only if that costs the smaller side more than GROUP
of each of its shards (a group about as heavy as a shard) is the group parted, in order of its rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajmill.llm.common import written

BINS, MOST_BINS = 1024, 1 << 18
#: Share of a shard's target bytes that a split may be off; the same to keep a group of equal texts whole.
TOLERANCE, GROUP = 0.002, 0.05


@dataclass
class Node:
    shards: int
    first: int
    #: Where it was split: the dimension and the last (value, checksum, row) that goes left.
    dim: str | None = None
    cut: tuple = ()
    left: Node | None = None
    right: Node | None = None


def _longs(values: list) -> Column:
    return F.array(*[F.lit(int(v)).cast("long") for v in values])


def leaf_of(root: Node, dims: list[str]) -> Column:
    """The number of the first shard of the leaf that a row falls into: the tree as arrays, walked level by level."""
    nodes, depth, front = [root], 0, [root]
    while front := [x for n in front if n.left for x in (n.left, n.right)]:
        nodes += front
        depth += 1
    first = _longs([n.first for n in nodes])
    if not depth:
        return F.lit(root.first).cast("long")
    index = {id(n): i for i, n in enumerate(nodes)}
    left, right = (_longs([index[id(getattr(n, side) or n)] for n in nodes]) for side in ("left", "right"))
    dim = _longs([dims.index(n.dim) if n.dim and n.left else 0 for n in nodes])
    cuts = [_longs([n.cut[k] if n.left else 0 for n in nodes]) for k in range(3)]
    values = F.array(*[F.col(d).cast("long") for d in dims])

    def step(node: Column, _: Column) -> Column:
        i = node.cast("int")
        a, v, w, r = F.get(values, F.get(dim, i).cast("int")), *(F.get(c, i) for c in cuts)
        goes = (a < v) | ((a == v) & ((F.col("crc") < w) | ((F.col("crc") == w) & (F.col("row") <= r))))
        return F.when(goes, F.get(left, i)).otherwise(F.get(right, i))

    return F.get(first, F.aggregate(F.array(*[F.lit(0)] * depth), F.lit(0).cast("long"), step).cast("int"))


def code(column: str, kind: str) -> Column:
    """A non-negative long that orders a column: numbers by value (negative ones as 0), strings by their first 7 bytes; null is 0."""
    if kind == "string":
        return F.coalesce(F.conv(F.rpad(F.hex(F.substring(F.col(column).cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("long") + 1, F.lit(0).cast("long"))
    return F.greatest(F.coalesce(F.col(column).cast("long"), F.lit(0)), F.lit(0).cast("long"))


def _choose(nodes: list[dict], rows: DataFrame, shards: int) -> None:
    """For each node where to cut: `want` bytes lie to the left. A value that has to be parted is cut by the next key.

    A node's keys are its dimension, the checksum and the row number; `cuts` holds the values of the keys before the one
    that is being searched, `lo` and `hi` its remaining range.
    """
    active = [n for n in nodes if n["open"]]
    while active:
        of = {n["first"]: n for n in active}
        count = max(16, min(BINS, MOST_BINS // len(active)))
        for n in active:
            n["width"] = (n["hi"] - n["lo"]) // count + 1
        param = lambda f, default=-1: F.get(_longs([f(of[i]) if i in of else default for i in range(shards)]), F.col("at").cast("int"))
        values = F.array(*[F.col(d).cast("long") for d in active[0]["dims"]], F.col("crc"), F.col("row"))
        dims = len(active[0]["dims"])
        key = lambda level: F.get(values, (dim if level == 0 else F.lit(dims - 1 + level)).cast("int"))
        dim = param(lambda n: n["dim"])
        level = param(lambda n: len(n["cuts"]))
        within = (level >= 0) & ((level < 1) | (key(0) == param(lambda n: (n["cuts"] or [0])[0]))) & ((level < 2) | (key(1) == param(lambda n: [*n["cuts"], 0, 0][1])))
        k = F.when(level == 0, key(0)).when(level == 1, key(1)).otherwise(key(2))
        lo, hi, width = param(lambda n: n["lo"], 0), param(lambda n: n["hi"]), param(lambda n: n["width"], 1)
        offset = F.when(within & (k >= lo) & (k <= hi), k - lo)
        found = rows.select("at", "size", k.alias("__k"), offset.alias("__o"), width.alias("__w")).withColumn("__b", F.expr("__o div __w")).where("__b is not null")
        bins: dict = {}
        for r in found.groupBy("at", "__b").agg(F.sum("size"), F.min("__k"), F.max("__k")).collect():
            bins.setdefault(r[0], []).append(tuple(r[1:]))
        for n in active:
            for _, s, least, most in sorted(bins.get(n["first"], [])):
                if n["done"] + s <= n["want"]:
                    n["done"] += s
                    continue
                takes = n["want"] - n["done"] > s / 2
                off = min(n["want"] - n["done"], n["done"] + s - n["want"])
                level = len(n["cuts"])
                if s <= n["slack"] or least == most and (level == 2 or level == 1 and off <= n["whole"]):  # the nearer end of this bin will do
                    n["cuts"].append(most if takes else least - 1)
                    n["open"] = False
                elif least == most:
                    n["cuts"].append(least)
                    n["lo"], n["hi"] = n["ranges"][len(n["cuts"]) - 1]
                else:
                    n["lo"], n["hi"] = least, most
                break
            else:  # all that is left goes left
                n["cuts"].append(n["hi"])
                n["open"] = False
        active = [n for n in active if n["open"]]


def tree(rows: DataFrame, dims: list[str], shards: int) -> Node:
    """The k-d tree of `rows` (columns size, crc, row and the codes of dims)."""
    root, slack, total = Node(shards, 0), 0.0, None
    front = [root] if shards > 1 else []
    while front:
        at = rows.withColumn("at", leaf_of(root, dims))
        stats = [F.sum("size").alias("bytes"), *[f(d).alias(f"{f.__name__}_{d}") for d in [*dims, "crc", "row"] for f in (F.min, F.max)]]
        found = {r["at"]: r for r in at.groupBy("at").agg(*stats).collect()}
        if total is None:
            if 0 not in found:
                return root
            total = found[0]
            slack = TOLERANCE * total["bytes"] / shards
        nodes = []
        for n in front:
            if (r := found.get(n.first)) is None:
                continue
            n.dim = max(dims, key=lambda d: (r[f"max_{d}"] - r[f"min_{d}"]) / max(1, total[f"max_{d}"] - total[f"min_{d}"]))
            ranges = [(r[f"min_{k}"], r[f"max_{k}"]) for k in ("crc", "row")]
            nodes.append({"node": n, "first": n.first, "dims": dims, "dim": dims.index(n.dim), "want": r["bytes"] * (n.shards // 2) / n.shards, "done": 0, "slack": slack, "whole": slack / TOLERANCE * GROUP * (n.shards // 2), "open": True, "cuts": [], "lo": r[f"min_{n.dim}"], "hi": r[f"max_{n.dim}"], "ranges": ranges})
        _choose(nodes, at, shards)
        front = []
        for n in nodes:
            node, half = n["node"], n["node"].shards // 2
            node.cut = (*n["cuts"], *[2**63 - 1] * (3 - len(n["cuts"])))  # a value that isn't parted goes left whole
            node.left, node.right = Node(half, node.first), Node(node.shards - half, node.first + half)
            front += [x for x in (node.left, node.right) if x.shards > 1]
    return root


def with_shards(rows: DataFrame, dims: list[str], shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """rows with shard and slot (gapless from 0 within a shard). rows must be written(): it is read many times."""
    if shards is None:
        total = rows.agg(F.sum("size")).first()[0] or 0
        shards = max(1, -(-total // target_bytes))
    df = rows.withColumn("shard", leaf_of(tree(rows, dims, shards), dims)).withColumn("__part", F.shiftrightunsigned("row", 33))
    counts = df.groupBy("shard", "__part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    order = Window.partitionBy("shard", "__part").orderBy("row")
    df = df.withColumn("__n", F.row_number().over(order) - 1)
    return df.join(counts, ["shard", "__part"]).withColumn("slot", F.col("__before") + F.col("__n")).drop("__part", "__n", "__before")


def metadata(docs: DataFrame, dims: list[str]) -> DataFrame:
    """A written table of each document's doc_id, size, crc, row number and dimensions' codes."""
    docs = docs.withColumn("__bytes", F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    docs = docs.withColumn("__size", F.octet_length("__bytes").cast("long") + 8).withColumn("__crc", F.crc32("__bytes"))
    kinds = dict(docs.dtypes)
    docs = docs.withColumn("__chars", F.coalesce(F.char_length("text"), F.lit(0)).cast("long"))
    codes = [(F.col(f"__{d}") if d in ("size", "crc", "chars") else code(d, kinds[d])).alias(f"dim_{d}") for d in dims]
    return written(docs.select("doc_id", F.col("__size").alias("size"), F.col("__crc").alias("crc"), F.monotonically_increasing_id().alias("row"), *codes))


def shard_documents(docs: DataFrame, shards: int = 24, dims: tuple[str, ...] = ("size", "chars", "crc")) -> DataFrame:
    """Every row's shard and slot by the law `bytes`.

    Size: UTF-8 bytes of the text (null: none) plus 8. Sizes of shards differ from the mean by about TOLERANCE for each
    level of the tree, by a document where one is larger than that, and by up to GROUP where a split meets a group of equal
    texts. Equal texts share a shard, unless their group is so heavy that no split beside it would do; as dims are
    properties of the text alone, other columns do not part them. Repeated rows count as often as they occur; a null
    in a dimension counts as its least value. Fewer rows than shards leave shards empty; no rows: no rows. A column of
    documents that is not named in dims plays no part.
    """
    rows = metadata(docs, list(dims))
    df = with_shards(rows, [f"dim_{d}" for d in dims], shards)
    return df.select("doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
