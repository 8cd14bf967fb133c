"""Texts that exercise every rule, made from orders by one SQL expression that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acervo.functions.regexes import sql

_LINES = [
    "CASE WHEN k % 11 = 0 THEN 'Preâmbulo; disposições gerais.' ELSE '' END",
    "concat('TÍTULO ', CASE k % 3 WHEN 0 THEN 'I' WHEN 1 THEN 'II' ELSE 'IV' END, ' - Da terra')",
    "concat('Art. ', CAST(k % 23 AS STRING), 'º da Lei nº 4.', lpad(CAST(k % 997 AS STRING), 3, '0'), '/64 trata da reforma agrária ,, e do imóvel rural.')",
    "CASE WHEN k % 2 = 0 THEN concat('§ ', CAST(k % 5 + 1 AS STRING), 'º O prazo é de ', CAST(k % 60 AS STRING), ' dias úteis; multa de R$ ', CAST(k % 900 AS STRING), '.000,00.') ELSE 'I - inciso IV, alínea a) e alínea \"b\") do Decreto-Lei 200/67;' END",
    "'CAPÍTULO II'",
    "CASE WHEN k % 6 = 1 THEN 'SEÇÃO III – Das provas' ELSE '' END",
    "concat('Art. ', CAST(k % 200 AS STRING), ' O STF e o IBAMA julgaram a ADI ', CAST(k % 5000 AS STRING), ' em ', CAST(k % 28 + 1 AS STRING), ' de março de 2024', CASE WHEN k % 4 = 0 THEN '...' ELSE '.' END)",
    "CASE WHEN k % 5 = 0 THEN concat('CPF 123.456.', lpad(CAST(k % 1000 AS STRING), 3, '0'), '-00 e CNPJ 12.345.678/', lpad(CAST(k % 10000 AS STRING), 4, '0'), '-90.') ELSE 'MP 12 e Medida Provisória nº 870/2019; Súmula Vinculante 13 do STF; Acórdão 22/3.' END",
    "CASE WHEN k % 7 = 0 THEN 'O mandado de seguranca e o habeas-corpus, através de peticao, a grande maioria, data venia.' ELSE 'Parágrafo único' END",
    "CASE WHEN k % 8 = 3 THEN 'TÍTULO V' WHEN k % 8 = 4 THEN concat('a) art 5 e arts 6 da Constituição Federal de 1988, CF/88, Art.7 ; processo 0001234-56.2020.8.26.', lpad(CAST(k % 10000 AS STRING), 4, '0'), ' em 3/4/2021 !!') ELSE '' END",
    "CASE WHEN k % 10 = 7 THEN repeat(concat('Art. 12 da Lei 8.629/93 e Art. 13 da Lei 8.629/93; a posse, o crime e a pena: trabalho rural ', CAST(k AS STRING), ' no TJSP. '), 9) ELSE 'des. relator, fls. 3, onde se lê o mesmo.' END",
]
LEGAL_TEXT = "concat(" + ", chr(10), ".join(_LINES) + ")"
LEGAL_SQL = f"SELECT k AS doc_id, {LEGAL_TEXT} AS text FROM (SELECT o_orderkey AS k FROM orders)"

#: (query_id, query) of the questions that retrieval is tried with.
QUESTIONS = [
    (1, "O que é a função social da terra e a reforma agrária?"),
    (2, "Qual o prazo da multa do Art. 12 da Lei 8.629/93?"),
    (3, "mandado de segurança e habeas corpus"),
    (4, "crime ambiental, posse e pena"),
    (5, "imóvel rural imóvel rural"),
    (6, "the of and that this"),
]
#: Texts made in one task, at most about.
TASK_ROWS = 20_000
QUESTIONS_SQL = "SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, {sql(q)})" for i, q in QUESTIONS) + ") AS t(query_id, query)"


def legal(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    keys = orders.select(F.col("o_orderkey").alias("k"))
    # keys are few bytes; the texts made of them are work for all cores, which may not have come yet when the query is planned
    keys = keys.repartition(max(spark.sparkContext.defaultParallelism, -(-keys.count() // TASK_ROWS)), "k")
    return keys.select(F.col("k").alias("doc_id"), F.expr(LEGAL_TEXT).alias("text"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def corpus(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("doc_idx"), "text")


def questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUESTIONS, "query_id long, query string")


def benchmark_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
