"""Ranking by BM25, by cosine and by the fusion of both, for a table of queries at once.

Queries have query_id and query. Only documents that share a term with a query are scored; documents with score
zero take part where fewer than k have more, in corpus order, so the first 2k documents are all that is needed of
them. Ranks come from a window that keeps k rows a query before the shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from acervo.functions.text import tokenize
from acervo.operators.index import Index

K1, B = 1.5, 0.75
ALPHA, RRF_K = 0.5, 60
#: Rows of a block of vectors and of a block of queries in nearest_of_many, about.
VECTORS, QUERIES = 4096, 1024
#: Rows made of queries that are sent to every task.
FEW = 100_000
NEAREST = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, term and how often the query repeats it."""
    return queries.select("query_id", F.explode(tokenize(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qn"))


def few(asked: DataFrame) -> bool:
    """Whether rows made of queries alone may go to every task."""
    return asked.limit(FEW + 1).count() <= FEW


def met(corpus: DataFrame, asked: DataFrame, on: str, small: bool) -> DataFrame:
    """Rows of the corpus joined with what is asked: this goes to every task if it is small, else both are shuffled.

    The planner's estimates must not choose: rows from Python have none, and those of the corpus are of what its texts
    are made of, so the corpus would be gathered on the driver.
    """
    return corpus.join(F.broadcast(asked), on) if small else corpus.hint("merge").join(asked, on)


def only(corpus: DataFrame, asked: DataFrame, small: bool) -> DataFrame:
    """Rows of the corpus with a term that is asked, before they are counted; all rows if many terms are asked."""
    return corpus.join(F.broadcast(asked.select("term")), "term", "left_semi") if small else corpus


def bm25_scores(index: Index, queries: DataFrame) -> DataFrame:
    """query_id, doc_idx and score of the pairs that share a term."""
    terms = query_terms(queries)
    small = few(terms)
    asked = met(only(index.terms.select("term", "idf"), terms, small), terms, "term", small)
    tf, dl = F.col("tf"), F.col("dl")
    weight = F.col("qn") * F.col("idf") * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * dl / F.col("avg_dl")))
    pairs = met(only(index.postings, terms, small), asked, "term", small)
    pairs = pairs.join(index.doc_stats.hint("merge"), "doc_idx").crossJoin(F.broadcast(index.stats))
    return pairs.groupBy("query_id", "doc_idx").agg(F.sum(weight).alias("score"))


def cosine_scores(index: Index, queries: DataFrame) -> DataFrame:
    """query_id, doc_idx and cosine over the vocabulary of the pairs that share one of its words."""
    weighed = query_terms(queries).join(F.broadcast(index.vocabulary), "term").withColumn("w", F.col("qn") * F.col("weight_idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("query_id")))
    asked = weighed.select("query_id", "term", (F.col("w") / norm).alias("q"))
    return met(index.vectors, asked, "term", few(queries.select("query_id"))).groupBy("query_id", "doc_idx").agg(F.sum(F.col("q") * F.col("weight")).alias("score"))


def ranked(scores: DataFrame, index: Index, queries: DataFrame, k: int) -> DataFrame:
    """The first k documents of each query, those without a score last and in corpus order; rank starts at 1.

    Scores are not negative. Those of the first k are all that zeros can meet, so the scores are made once.
    """
    first = index.doc_stats.select("doc_idx").orderBy("doc_idx").limit(2 * k)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "doc_idx")
    numbered = lambda rows: rows.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)
    rest = queries.select("query_id").crossJoin(F.broadcast(first)).withColumn("score", F.lit(0.0))
    both = numbered(scores).drop("rank").unionByName(rest).groupBy("query_id", "doc_idx").agg(F.max("score").alias("score"))
    return numbered(both)


def search_bm25(index: Index, queries: DataFrame, k: int = 10) -> DataFrame:
    """The first k by BM25, without those that score nothing."""
    return ranked(bm25_scores(index, queries), index, queries, k).where("score > 0")


def search_cosine(index: Index, queries: DataFrame, k: int = 10) -> DataFrame:
    return ranked(cosine_scores(index, queries), index, queries, k).where("score > 0")


def search_hybrid(index: Index, queries: DataFrame, k: int = 10, alpha: float = ALPHA, rrf_k: int = RRF_K, steady: bool = False) -> DataFrame:
    """Reciprocal rank fusion of the first 2k of both lists, zeros included; ties go to the better BM25 rank.

    steady cuts scores at nine digits before they are ranked, so that ties do not hang on the order of additions.
    """
    cut = lambda scores: scores.withColumn("score", F.round("score", 9)) if steady else scores
    lexical = ranked(cut(bm25_scores(index, queries)), index, queries, 2 * k).select("query_id", "doc_idx", F.col("score").alias("score_bm25"), F.col("rank").alias("rank_bm25"))
    dense = ranked(cut(cosine_scores(index, queries)), index, queries, 2 * k).select("query_id", "doc_idx", F.col("score").alias("score_semantico"), F.col("rank").alias("rank_semantico"))
    part = lambda rank, weight: F.coalesce(F.lit(weight) / (F.col(rank) + rrf_k), F.lit(0.0))
    both = lexical.join(dense, ["query_id", "doc_idx"], "full")
    both = both.withColumn("score_combinado", part("rank_bm25", 1 - alpha) + part("rank_semantico", alpha))
    order = W.partitionBy("query_id").orderBy(F.desc("score_combinado"), F.asc_nulls_last("rank_bm25"), "rank_semantico")
    both = both.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return both.select("query_id", "doc_idx", zero("score_bm25"), zero("score_semantico"), "score_combinado", "rank")


def search(index: Index, queries: DataFrame, k: int = 10, method: str = "hibrido", **options) -> DataFrame:
    """By method: "bm25", "semantico", anything else is the fusion."""
    if method == "bm25":
        return search_bm25(index, queries, k)
    if method == "semantico":
        return search_cosine(index, queries, k)
    return search_hybrid(index, queries, k, **options)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; 0 if either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    length = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(length > 0, dot(a, b) / length).otherwise(0.0)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The k rows of vectors (vec_id, embedding) with the largest cosine to each of a few queries (query_id, vector)."""
    pairs = vectors.crossJoin(F.broadcast(queries)).select("query_id", "vec_id", cosine(F.col("vector"), F.col("embedding")).alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def _best_of_block(k: int):
    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        vectors = vectors.sort_by("vec_id")  # a stable sort by score then leaves ties in this order
        ids = [vectors.column("vec_id").to_numpy(), queries.column("query_id").to_numpy()]
        if not len(ids[0]) or not len(ids[1]):
            return NEAREST.empty_table()
        sides = []
        for table, name in ((vectors, "embedding"), (queries, "vector")):
            side = np.array(table.column(name).to_pylist(), np.float64)
            length = np.linalg.norm(side, axis=1, keepdims=True)
            sides.append(np.divide(side, length, out=np.zeros_like(side), where=length > 0))
        scores = np.round(sides[1] @ sides[0].T, 9) + 0.0
        best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        found = [np.repeat(ids[1], best.shape[1]), ids[0][best.ravel()], np.take_along_axis(scores, best, 1).ravel()]
        return pa.table(found, schema=NEAREST)

    return run


def nearest_of_many(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """As nearest, for any number of queries: every block of queries meets every block of vectors in a task of its own.

    Scores are cut at nine digits before ranking; rows without a vector neither ask nor are found.
    """
    vectors, queries = vectors.where("embedding IS NOT NULL"), queries.where("vector IS NOT NULL")
    n, asked = -(-vectors.count() // VECTORS) or 1, -(-queries.count() // QUERIES) or 1
    place = lambda key, parts: F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = vectors.select(place("vec_id", n).alias("vb"), every(asked).alias("qb"), "vec_id", "embedding")
    right = queries.select(every(n).alias("vb"), place("query_id", asked).alias("qb"), "query_id", "vector")
    met = left.groupBy("vb", "qb").cogroup(right.groupBy("vb", "qb")).applyInArrow(_best_of_block(k), "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)
