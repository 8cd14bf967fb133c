"""The lexical and the vector index of a corpus, as tables.

A corpus has doc_idx (its order decides ties) and text. Statistics of terms come from one shuffle on the term
after partial aggregation; the 128-word vocabulary and the one-row statistics are the only broadcast sides, and
their size is fixed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from acervo.functions.text import tokenize

DIMENSIONS = 128
TERM_BUCKETS = 64


@dataclass
class Index:
    """doc_stats(doc_idx, dl), postings(doc_idx, term, tf), terms(term, df, idf, first_doc), stats(n_docs, avg_dl),
    vocabulary(term, slot, weight_idf), vectors(doc_idx, term, weight)."""

    doc_stats: DataFrame
    postings: DataFrame
    terms: DataFrame
    stats: DataFrame
    vocabulary: DataFrame
    vectors: DataFrame


def corpus_tokens(corpus: DataFrame) -> DataFrame:
    return corpus.select("doc_idx", tokenize(F.col("text")).alias("tokens"))


def exploded(tokens: DataFrame) -> DataFrame:
    """A row for each token, as term, with all other columns.

    The outer form, as explode has the planner test the array first: it would be made a second time, below any shuffle.
    """
    return tokens.select("*", F.explode_outer("tokens").alias("term")).drop("tokens").where("term IS NOT NULL")


def postings(tokens: DataFrame) -> DataFrame:
    """How often each document has each of its terms."""
    return exploded(tokens).groupBy("doc_idx", "term").agg(F.count("*").alias("tf"))


def doc_stats(tokens: DataFrame) -> DataFrame:
    """Every document's length, zero for those without tokens."""
    return tokens.select("doc_idx", F.size("tokens").cast("long").alias("dl"))


def corpus_stats(stats: DataFrame) -> DataFrame:
    return stats.agg(F.count("*").alias("n_docs"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avg_dl"))


def document_frequency(found: DataFrame) -> DataFrame:
    return found.groupBy("term").agg(F.count("*").alias("df"), F.min("doc_idx").alias("first_doc"))


def with_idf(terms: DataFrame, stats: DataFrame) -> DataFrame:
    n, df = F.col("n_docs"), F.col("df")
    return terms.crossJoin(F.broadcast(stats)).select("term", "df", F.log((n - df + 0.5) / (df + 0.5) + 1).alias("idf"), "first_doc", "n_docs")


def vocabulary(terms: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """The terms of most documents; ties go to the term met first, then to the lesser one.

    terms has n_docs. The order and limit make one top-k plan; numbering sees only those rows.
    """
    top = terms.orderBy(F.desc("df"), "first_doc", "term").limit(dimensions)
    slot = F.row_number().over(W.orderBy(F.desc("df"), "first_doc", "term")) - 1
    return top.select("term", slot.cast("long").alias("slot"), (F.log((F.col("n_docs") + 1) / (F.col("df") + 1)) + 1).alias("weight_idf"))


def vectors(found: DataFrame, words: DataFrame) -> DataFrame:
    """Each document's unit vector over the vocabulary, as rows; a document without its words has none."""
    weighed = found.join(F.broadcast(words), "term").select("doc_idx", "term", (F.col("tf") * F.col("weight_idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("doc_idx")))
    return weighed.select("doc_idx", "term", (F.col("w") / norm).alias("weight"))


def build(corpus: DataFrame, dimensions: int = DIMENSIONS) -> Index:
    """The index of a corpus (doc_idx, text), lazily; `save` writes it for later queries."""
    tokens = corpus_tokens(corpus)
    lengths, found = doc_stats(tokens), postings(tokens)
    stats = corpus_stats(lengths)
    terms = with_idf(document_frequency(found), stats)
    words = vocabulary(terms, dimensions)
    return Index(lengths, found, terms, stats, words, vectors(found, words))


def _bucket(term):
    return F.pmod(F.xxhash64(term), F.lit(TERM_BUCKETS)).cast("int")


def save(index: Index, path: str) -> None:
    """Writes the index; postings, terms and vectors are partitioned by a bucket of their term, so that a query reads its terms' buckets."""
    for name in ("doc_stats", "stats", "vocabulary"):
        getattr(index, name).write.mode("overwrite").parquet(f"{path}/{name}")
    for name in ("postings", "terms", "vectors"):
        rows = getattr(index, name).withColumn("bucket", _bucket(F.col("term")))
        rows.repartition("bucket", F.pmod(F.xxhash64("term"), F.lit(8))).sortWithinPartitions("term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str) -> Index:
    read = {n: spark.read.parquet(f"{path}/{n}") for n in ("doc_stats", "postings", "terms", "stats", "vocabulary", "vectors")}
    return Index(**{n: df.drop("bucket") for n, df in read.items()})


def statistics(index: Index, alpha: float = 0.5, dimensions: int = DIMENSIONS) -> DataFrame:
    """One row on the index: documents, terms, vocabulary, dimensions, weight of the vector side."""
    documents = index.doc_stats.agg(F.count("*").alias("total_documentos"))
    words = index.terms.agg(F.count("*").alias("vocabulario_bm25"))
    slots = index.vocabulary.agg(F.count("*").alias("vocabulario_embedding"))
    one = documents.crossJoin(words).crossJoin(slots)  # three single rows
    return one.select("*", F.lit(dimensions).cast("long").alias("dimensao_embedding"), F.lit(alpha).alias("alpha"), (F.col("total_documentos") > 0).alias("indexado"))
