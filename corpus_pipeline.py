"""A corpus pipeline of the training-data operators: language ID, near-duplicates, mixing, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajmill.llm import bpe, jaccard, langid, mixing
from trajmill.llm.common import bounded_batches, release, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document is used once more if the mix takes at least this share of it beyond its whole uses.
PART = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language was found: those without a letter or a text go. lang is the language found."""
    bounded_batches(spark)
    found = langid.identify_documents(docs, keep=[c for c in COLUMNS if c != "lang"])
    return found.where(F.col("lang_pred") != langid.UNKNOWN).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row, that with the smallest doc_id, if any has one; rows that share a doc_id or
    have none are told apart by their texts. SimHash (operator 3) proposes, five-word similarity decides: `llm/jaccard.py`."""
    bounded_batches(spark)
    own = docs.withColumn("node", jaccard.node()).withColumn("row", F.xxhash64("node", *[c for c in COLUMNS if c != "text"]))
    rows = written(own.select("node", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row").alias("of")))
    firsts = rows.groupBy("node").agg(F.min("of").alias("of"))
    kept = firsts.join(jaccard.near_duplicates(docs), "node", "left").groupBy(F.coalesce("root", "node")).agg(F.min("of").alias("of")).select("of.row")
    # a merge join at every size: texts move once, and rows that are equal in everything are together
    return own.join(kept.hint("merge"), "row", "left_semi").dropDuplicates(["row"]).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: its whole uses, and once more for a further PART of it.

    Documents without words stay once: the mix has no say in them. Rows that share a doc_id, or have none, are used as often as
    the mix takes them together."""
    found = mixing.mix_documents(docs).groupBy("doc_id").agg(F.sum("size").alias("size"), F.sum("taken").alias("taken"))
    times = F.when(F.col("size") == 0, 1).otherwise(F.floor(F.col("taken") / F.col("size") + F.lit(1 - PART))).cast("int")
    uses = written(found.select("doc_id", times.alias("__times")).where("__times > 0"))
    df = docs.join(uses.hint("merge"), docs["doc_id"].eqNullSafe(uses["doc_id"])).drop(uses["doc_id"])
    return df.withColumn("__use", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's number of tokens, and digests of its tokens and of the text they decode to."""
    import public_tokenizers

    bounded_batches(spark)
    return bpe.digest_tokens(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language ID", language), ("SimHash near-dedup", near_duplicates), ("mixing sources", mix), ("BPE tokens", tokens)]
#: No SQL states language models or BPE; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents, each written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs)
            release(before)
    return docs
