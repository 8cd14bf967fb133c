"""Quality rules as a ledger: every rule is evaluated once, its measurements and failure bits are stored, and
versioned policies, verdicts and ablations are bit operations on the stored column.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from acervo.llm.common import WORD, kept, mapped, read, rows_of, whole_text

#: Bit of each rule, by name. A bit never changes its meaning; new rules get new bits.
RULES = {
    "few_words": 0,
    "repeated_windows": 1,
    "many_symbols": 2,
    "repeated_lines": 3,
    "word_length": 4,
    "capitals": 5,
    "no_sentence_end": 6,
}
#: Rules that a policy rejects on, by version.
POLICIES = {
    1: ("few_words", "repeated_windows"),
    2: ("few_words", "repeated_windows", "many_symbols", "word_length", "capitals"),
}
CURRENT = 2
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_letters long, n_capitals long, n_ends long"

_WORD = re.compile(WORD)
_SYMBOL = re.compile(r"[#*$%&|<>]")
_CAPITAL = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_LETTER = re.compile(r"[^\W\d_]")
_END = re.compile(r"[.!?](?=\s|$)")


def repeated_words(words: list[str]) -> int:
    """Words that lie in a window of three words that the text has twice or more."""
    if len(words) < 4:
        return 0
    code: dict[str, int] = {}
    ids = np.fromiter((code.setdefault(w, len(code)) for w in words), np.int64, len(words))
    _, pairs = np.unique(ids[:-1] * len(code) + ids[1:], return_inverse=True)
    _, window, count = np.unique(pairs[:-1] * np.int64(len(code)) + ids[2:], return_inverse=True, return_counts=True)
    again = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(count[window] > 1)
    np.add.at(again, starts, 1)
    np.add.at(again, starts + 3 if len(starts) else starts, -1)
    return int((np.cumsum(again) > 0).sum())


def measure(text: str) -> tuple[int, ...]:
    words = _WORD.findall(text)
    lines = [line for line in text.split("\n") if _WORD.search(line)]
    return (
        len(words),
        sum(map(len, words)),
        len(_SYMBOL.findall(text)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(_LETTER.findall(text)),
        len(_CAPITAL.findall(text)),
        len(_END.findall(text)),
    )


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [part.split()[0] for part in MEASURES.split(",")]
    for batch in rows_of(batches):
        found = np.array([measure(t) for t in batch.column("_text").to_pylist()], np.int64).reshape(-1, len(names))
        kept = [n for n in batch.schema.names if n != "_text"]
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], *[pa.array(c) for c in found.T]], [*kept, *names])


def failure_bits() -> Column:
    """One bit for each rule that the measured row fails."""
    c = F.col
    fails = {
        "few_words": c("n_words") < 50,
        "repeated_windows": 100 * c("n_repeat_words") > 50 * c("n_words"),
        "many_symbols": 4 * c("n_symbols") > c("n_words"),
        "repeated_lines": 10 * c("n_dup_lines") > 3 * c("n_lines"),
        "word_length": (c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 20 * c("n_words")),
        "capitals": 2 * c("n_capitals") > c("n_letters"),
        "no_sentence_end": c("n_ends") == 0,
    }
    bits = F.lit(0).cast("long")
    for rule, bit in RULES.items():
        bits = bits.bitwiseOR(F.when(fails[rule], F.lit(1 << bit)).otherwise(F.lit(0)).cast("long"))
    return bits


def ledger(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep's columns, every measurement and failed (the rules' bits).

    A row for each row of docs, repeated ones too. A null or empty text has zero for every measurement. Clashing
    names follow common.kept.
    """
    keep = kept(keep, (*[part.split()[0] for part in MEASURES.split(",")], "failed"))
    schema = docs.select(*keep).schema
    for part in MEASURES.split(","):
        schema = schema.add(part.split()[0], "long")
    rows = docs.select(*keep, whole_text(text).alias("_text")).transform(mapped, _measured, schema)
    return rows.withColumn("failed", failure_bits())


def mask(policy: int) -> int:
    return sum(1 << RULES[rule] for rule in POLICIES[policy])


def apply_policy(rows: DataFrame, policy: int = CURRENT) -> DataFrame:
    """rows of a ledger with kept: no rule of the policy failed."""
    return rows.withColumn("kept", F.col("failed").bitwiseAND(F.lit(mask(policy)).cast("long")) == 0)


def ablations(rows: DataFrame, policy: int = CURRENT) -> DataFrame:
    """For each rule: rows that fail it, that fail only it, and that the policy keeps with and without it.

    The ledger is first counted by its distinct bit patterns, of which there are 2 to the number of rules at
    most, so the rules' figures come from that small table.
    """
    patterns = rows.groupBy("failed").agg(F.count("*").alias("_n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << b).cast("long").alias("bit")) for r, b in RULES.items()]))
    all_bits = F.lit(mask(policy)).cast("long")
    rest = F.bitwise_not(F.col("r.bit")).bitwiseAND(all_bits)
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("_n"))), F.lit(0)).cast("long")
    return (
        patterns.select("*", rules.alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            total(F.col("failed").bitwiseAND(F.col("r.bit")) != 0).alias("n_failed"),
            total(F.col("failed") == F.col("r.bit")).alias("n_only"),
            total(F.col("failed").bitwiseAND(all_bits) == 0).alias("n_kept"),
            total(F.col("failed").bitwiseAND(rest) == 0).alias("n_kept_without"),
        )
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = apply_policy(ledger(read(spark, sf_dir, "documents")))
    base = F.col("failed").bitwiseAND(F.lit(mask(1)).cast("long")) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", F.col("failed").alias("failed_bits"))


SQL = r"""
WITH cut AS (
  SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS text FROM documents
), listed AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM cut
), placed AS (
  SELECT rid, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM listed
), windows AS (
  SELECT rid, i, word AS a, lead(word) OVER w AS b, lead(word, 2) OVER w AS c FROM placed WINDOW w AS (PARTITION BY rid ORDER BY i)
), twice AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM windows WHERE c IS NOT NULL
), covered AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY rid
), measured AS (
  SELECT doc_id, text, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
         len(lines) AS n_lines, len(regexp_extract_all(text, '\p{L}')) AS n_letters, len(regexp_extract_all(text, '[A-ZÀ-ÖØ-Þ]')) AS n_capitals,
         len(regexp_extract_all(text, '[.!?]([\x09-\x0D\x1C-\x20\x{85}\p{Z}]|$)')) AS n_ends
  FROM listed LEFT JOIN covered USING (rid)
), bits AS (
  SELECT *, n_words < 50 AS few, 100 * n_repeat_words > 50 * n_words AS rep, 4 * n_symbols > n_words AS sym, 10 * n_dup_lines > 3 * n_lines AS dup,
         word_chars < 2 * n_words OR word_chars > 20 * n_words AS len_, 2 * n_capitals > n_letters AS cap FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, few OR rep AS base_failed, NOT (few OR rep OR sym OR len_ OR cap) AS kept,
       CAST(few::INT + 2 * rep::INT + 4 * sym::INT + 8 * dup::INT + 16 * len_::INT + 32 * cap::INT + 64 * (n_ends = 0)::INT AS BIGINT) AS failed_bits
FROM bits
"""
