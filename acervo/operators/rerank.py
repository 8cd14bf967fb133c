"""Reranking of candidates by seven features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from acervo.functions.lexicons import BOOSTS, FEATURE_WEIGHTS, RERANK_REFERENCE
from acervo.functions.regexes import render
from acervo.functions.text import bigrams, rerank_tokens

IDEAL_TOKENS = 100


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def _boosted(*texts: Column) -> Column:
    """The weight of the boosted terms that all of these lower-cased texts have."""
    total = F.lit(0.0)
    for term, weight in BOOSTS.items():
        has = F.lit(True)
        for text in texts:
            has = has & F.contains(text, F.lit(term))
        total = total + F.when(has, F.lit(weight)).otherwise(0.0)
    return total


def features(pairs: DataFrame) -> DataFrame:
    """pairs (query, text, score_original) with a column for each feature and score_reranked."""
    query, text = F.lower(F.coalesce("query", F.lit(""))), F.lower(F.coalesce("text", F.lit("")))
    pattern = render(RERANK_REFERENCE, ignore_case=True)
    refs = lambda t: F.array_distinct(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)))
    x = pairs.select("*", rerank_tokens(F.col("query")).alias("_q"), rerank_tokens(F.col("text")).alias("_d"), query.alias("_ql"), text.alias("_dl"))
    x = x.select("*", bigrams(F.col("_q")).alias("_qb"), bigrams(F.col("_d")).alias("_db"), refs(F.col("_ql")).alias("_qr"), refs(F.col("_dl")).alias("_dr"))
    both = F.size(F.array_intersect("_q", "_d"))
    x = x.select(
        *pairs.columns,
        _share(both, F.size(F.array_union("_q", "_d"))).alias("term_overlap"),
        _share(both, F.size(F.array_distinct("_q"))).alias("query_coverage"),
        _share(F.size(F.array_intersect("_qb", "_db")), F.size("_qb")).alias("term_proximity"),
        _share(_boosted(F.col("_dl"), F.col("_ql")), _boosted(F.col("_ql"))).alias("juridic_terms"),
        F.when(F.size("_qr") > 0, F.size(F.array_intersect("_qr", "_dr")) / F.size("_qr")).otherwise(0.5).alias("exact_match"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.abs(F.size("_d") - IDEAL_TOKENS) / (IDEAL_TOKENS * 3))).alias("doc_quality"),
        F.least(F.lit(1.0), F.col("score_original").cast("double")).alias("original_score"),
    )
    total = F.lit(0.0)
    for name, weight in FEATURE_WEIGHTS.items():
        total = total + F.col(name) * weight
    return x.withColumn("score_reranked", total)


def rerank(pairs: DataFrame, k: int = 10) -> DataFrame:
    """The k best of each query_id by score_reranked, with their rank; pairs has in_rank, which decides ties."""
    order = W.partitionBy("query_id").orderBy(F.desc("score_reranked"), "in_rank")
    return features(pairs).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= (k or 10))


def explain(row_id: Column) -> Column:
    """A reranked row as lines of text: scores, then each feature with value, weight, contribution and bar."""
    lines = [
        F.concat(F.lit("Documento: "), row_id),
        F.format_string("Score Original: %.4f", F.col("score_original")),
        F.format_string("Score Reranked: %.4f", F.col("score_reranked")),
        F.lit(""),
        F.lit("Detalhamento das Features:"),
    ]
    for name, weight in sorted(FEATURE_WEIGHTS.items(), key=lambda x: -x[1]):
        value = F.col(name)
        bar = F.repeat(F.lit("█"), F.floor(value * 20).cast("int"))
        lines.append(F.concat(F.format_string(f"  {name:20s} = %.3f × {weight:.2f} = %.4f |", value, value * weight), bar))
    return F.array_join(F.array(*lines), "\n")
