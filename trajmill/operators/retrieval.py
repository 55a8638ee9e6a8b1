"""BM25 over postings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajmill.functions.text import terms
from trajmill.operators import postings as postings_index


def postings(corpus: DataFrame, doc: str, text: str, only: DataFrame | None = None) -> DataFrame:
    """(doc, term, tf, dl): a term's count in a document and the document's length; of the terms in `only`, if given."""
    words = corpus.select(F.col(doc).alias("doc"), terms(F.col(text)).alias("__t"))
    long = words.select("doc", F.size("__t").alias("dl"), F.explode("__t").alias("term"))
    if only is not None:
        long = long.join(only, "term", "left_semi")
    return long.groupBy("doc", "term").agg(F.count("*").alias("tf"), F.max("dl").alias("dl"))


def corpus_statistics(corpus: DataFrame, text: str) -> DataFrame:
    """One row: the number of documents and their mean length in terms."""
    return corpus.agg(F.count("*").alias("n_docs"), F.coalesce(F.avg(F.size(terms(F.col(text)))), F.lit(0.0)).alias("avgdl"))


def term_statistics(corpus: DataFrame, text: str) -> DataFrame:
    """(term, df, idf): how many documents have a term. A document counts each of its terms once in its own row, so counts are
    all that is shuffled."""
    counts = corpus.select(F.explode(F.array_distinct(terms(F.col(text)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    n = corpus.agg(F.count("*").alias("__n"))  # one row
    return counts.join(F.broadcast(n)).select("term", "df", F.log((F.col("__n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0).alias("idf"))


def bm25(corpus: DataFrame, queries: DataFrame, doc: str, text: str, query: str, query_text: str, k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query, rank, doc, score): the k best documents with a score above 0; of equal scores the larger doc comes first. The corpus is
    tokenised once, and the postings of the queries' terms are an index (see `postings`) that the search prunes by bounds."""
    asked = queries.select(F.explode(F.array_distinct(terms(F.col(query_text)))).alias("term")).distinct()
    index = postings_index.build(corpus, doc, text, only=asked, k1=k1, b=b)
    return postings_index.search(index, queries, query, query_text, k).select("query", "rank", "doc", "score")


def first_by_prefix(corpus: DataFrame, order: str, text: str, chars: int = 200) -> DataFrame:
    """Of passages with the same first `chars` characters the first one."""
    w = Window.partitionBy(F.xxhash64(F.substring(text, 1, chars)), F.substring(text, 1, chars)).orderBy(order)
    return corpus.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
