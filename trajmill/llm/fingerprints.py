"""Document fingerprints by a homomorphic multiset hash, in DataFrame functions only.

A paragraph (a line; an empty line counts, an empty text has none) is hashed into WIDTH lanes of +1 or -1: those of the
whole paragraph and, so that likeness is felt within a paragraph too, those of each of its clauses. A document's
fingerprint is the lane-wise sum over its paragraphs modulo 2**15, with the number of summed vectors as one more lane.
Sums commute and have inverses, hence the order of paragraphs does not matter, `insert` and `delete` update a fingerprint
without the rest of the text, and texts with the same paragraphs have the same fingerprint. As the lanes are sums of
random signs, the cosine of two fingerprints estimates the share of common pieces (error about WIDTH ** -0.5).

Four lanes lie in one long, 16 bits apart. Additions leave out the lanes' top bits, which are added without carry, so no
lane runs into the next one and no long overflows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajmill.llm.common import partitions, range_of, text_or_empty

WIDTH = 128
_ONES, _KEEP, _LANE = 0x0001000100010001, 0x7FFF7FFF7FFF7FFF, 0x7FFF
_TOP, _BELOW = 0x4000400040004000, 0x3FFF3FFF3FFF3FFF
_LONGS = WIDTH // 4
#: Ends of clauses, besides the ends of lines.
CLAUSE_END = "[.!?,;:|]+"


def pieces(text: Column) -> Column:
    """A text's paragraphs, then their clauses (marked, to differ from equal paragraphs)."""
    lines = F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.split(text, "\n", -1))
    clauses = F.filter(F.split(text, f"{CLAUSE_END}|\n", -1), lambda c: F.trim(c) != "")
    return F.concat(lines, F.transform(clauses, lambda c: F.concat(F.lit("\x01"), F.trim(c))))


def _hashed(items: Column) -> Column:
    """Two independent 64-bit hashes of each piece."""
    return F.transform(items, lambda p: F.struct(F.xxhash64(p).alias("a"), F.xxhash64(F.lit(1), p).alias("b")))


def _sum_bits(hashes: Column, shift: int) -> Column:
    return F.aggregate(hashes, F.lit(0).cast("long"), lambda acc, h: (acc.bitwiseAND(F.lit(_BELOW)) + F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(_ONES))).bitwiseXOR(acc.bitwiseAND(F.lit(_TOP))))


def _lanes_added(a: Column, b: Column) -> Column:
    return (a.bitwiseAND(F.lit(_BELOW)) + b.bitwiseAND(F.lit(_BELOW))).bitwiseXOR(a.bitwiseXOR(b).bitwiseAND(F.lit(_TOP)))


def with_fingerprint(df: DataFrame, text: Column, name: str) -> DataFrame:
    """df with the packed lanes of `text` (null: empty) in column `name`, an array of longs."""
    tmp = f"__{name}_hashes"
    df = df.withColumn(tmp, _hashed(pieces(F.coalesce(text, F.lit("")))))
    lanes = [_sum_bits(F.col(f"{tmp}.{half}"), k) for half in ("a", "b") for k in range(16)]
    return df.withColumn(name, F.array(*lanes, F.size(f"{tmp}.a").cast("long").bitwiseAND(F.lit(_LANE)))).drop(tmp)


def insert(fingerprint: Column, other: Column) -> Column:
    """The fingerprint of the union of two multisets of paragraphs."""
    return F.zip_with(fingerprint, other, _lanes_added)


def delete(fingerprint: Column, other: Column) -> Column:
    """What is left after taking `other`'s paragraphs out; the inverse of `insert`."""
    complement = lambda b: F.bitwise_not(b).bitwiseAND(F.lit(_KEEP))
    return F.zip_with(fingerprint, other, lambda a, b: _lanes_added(_lanes_added(a, complement(b)), F.lit(_ONES)))


def lanes(fingerprint: Column) -> Column:
    """The WIDTH signed sums: twice the number of ones less the number of vectors, modulo 2**15."""
    n = F.element_at(fingerprint, _LONGS + 1)
    signed = lambda packed, k: ((F.shiftrightunsigned(packed, 16 * k).bitwiseAND(F.lit(_LANE)) * 2 - n + 16384).bitwiseAND(F.lit(_LANE)) - 16384).cast("double")
    return F.flatten(F.transform(F.slice(fingerprint, 1, _LONGS), lambda packed: F.array(*[signed(packed, k) for k in range(4)])))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def with_likeness(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """df with a column for each of `pairs`: the likeness (0 to 1) of two fingerprint columns; equal ones have 1."""
    names = sorted({c for pair in pairs.values() for c in pair})
    df = df.withColumns({f"__{c}_lanes": lanes(F.col(c)) for c in names})
    df = df.withColumns({f"__{c}_norm": _dot(F.col(f"__{c}_lanes"), F.col(f"__{c}_lanes")) for c in names})
    for out, (a, b) in pairs.items():
        scale = F.sqrt(F.col(f"__{a}_norm") * F.col(f"__{b}_norm"))
        cosine = F.when(scale > 0, _dot(F.col(f"__{a}_lanes"), F.col(f"__{b}_lanes")) / scale).otherwise(0.0)
        df = df.withColumn(out, F.when(F.col(a) == F.col(b), 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine))))
    return df.drop(*[f"__{c}_{k}" for c in names for k in ("lanes", "norm")])


def as_string(fingerprint: Column) -> Column:
    """32 packed longs and the number of vectors, 16 hex digits each."""
    return F.lower(F.concat(*[F.lpad(F.hex(F.element_at(fingerprint, i + 1)), 16, "0") for i in range(_LONGS + 1)]))


#: A range of documents has about so many rows, or a fourth of a task's share of them.
RANGE_ROWS = 1 << 16


def with_next(docs: DataFrame, id_col: str, carried: list[str], prepare=lambda df: df) -> DataFrame:
    """docs (with __text) with next_<c> for each of `carried`: the value in the next row by id (after the last row: the first).

    Rows with one id follow each other by a hash of their text; a null id comes last. Rows are dealt to ranges of (id, hash),
    whose bounds are keys of the table: a row that starts a range (the smallest: also after the last range) goes to the range
    before it as well, hence each range finds every successor by itself. One shuffle. The number of ranges grows with the
    table, and an id that many rows share has several; only rows equal in id and text stay together. `prepare` adds columns
    after the shuffle.
    """
    # 60 bits of hash below the id
    key = F.coalesce(F.col(id_col), F.lit(2**63 - 1)).cast("decimal(38,0)") * F.lit(2**60).cast("decimal(19,0)") + F.shiftrightunsigned(F.xxhash64("__text"), 4).cast("decimal(19,0)")
    kind = "decimal(38,0)"
    n = partitions(docs.sparkSession)
    ids = docs.select(key.cast(kind).alias("id")).withColumn("k", F.col("id").cast("double"))
    ranges = max(4 * n, docs.count() // RANGE_ROWS)
    near = sorted(set(ids.stat.approxQuantile("k", [i / ranges for i in range(1, ranges)], 0.25 / ranges)))
    firsts = ids.groupBy(range_of(F.col("k"), near, "double").alias("r")).agg(F.min("id").alias("id")).collect()  # as many rows as ranges
    first, *bounds = sorted(r.id for r in firsts) or [0]
    starts = F.array(*[F.lit(str(b)).cast(kind) for b in bounds]) if bounds else F.array().cast(f"array<{kind}>")
    last = len(bounds)
    df = docs.withColumn("__key", key.cast(kind))
    df = df.withColumn("__at", range_of(F.col("__key"), [str(b) for b in bounds], kind))
    df = df.withColumn("__start", F.coalesce(F.get(starts, F.col("__at") - 1) == F.col("__key"), F.lit(False)))
    own = F.struct(F.col("__at").alias("range"), F.lit(0).alias("ghost"))
    before = F.struct((F.col("__at") - 1).alias("range"), F.lit(1).alias("ghost"))
    around = F.struct(F.lit(last).alias("range"), F.lit(2).alias("ghost"))
    places = F.array_compact(F.array(own, F.when(F.col("__start"), before), F.when(F.col("__key") == F.lit(str(first)).cast(kind), around)))
    df = df.withColumn("__place", F.explode(places))
    df = df.withColumns({"__range": F.col("__place.range"), "__ghost": F.col("__place.ghost")}).drop("__place", "__at", "__start")
    df = prepare(df.repartition(n, "__range"))
    order = Window.partitionBy("__range").orderBy(F.col("__ghost"), F.col("__key"), F.col("__text"))
    df = df.withColumns({f"next_{c}": F.lead(c).over(order) for c in carried})
    return df.where("__ghost = 0").drop("__range", "__ghost", "__key")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likenesses.

    The edited text has the last floor(n / 4) code points replaced by the first as many (or all) of the next document's,
    by ascending doc_id; after the last document comes the first. A null text is empty. Every row has one result: rows
    that share a doc_id follow each other by a hash of the text, a null doc_id is last. Other columns are ignored. No rows: no rows.
    """
    docs = docs.select("doc_id", text_or_empty().alias("__text"))
    prepare = lambda df: with_fingerprint(df, F.col("__text"), "__print")
    df = with_next(docs, "doc_id", ["__text", "__print"], prepare)
    n = F.char_length("__text")
    k = F.floor(n / 4).cast("int")
    df = df.withColumn("n_chars", n.cast("long")).withColumn("__edited", F.concat(F.substring(F.col("__text"), F.lit(1), n - k), F.substring(F.col("next___text"), F.lit(1), k)))
    df = with_fingerprint(df, F.col("__edited"), "__eprint")
    df = df.select("doc_id", "n_chars", F.sha2("__edited", 256).alias("edited_sha256"), F.col("__print").alias("p"), F.col("__eprint").alias("e"), F.col("next___print").alias("q"))
    df = with_likeness(df, {"near_edited": ("p", "e"), "near_next": ("p", "q")})
    return df.select("doc_id", "n_chars", "edited_sha256", as_string(F.col("p")).alias("fingerprint"), as_string(F.col("e")).alias("edited_fingerprint"), "near_edited", "near_next")
