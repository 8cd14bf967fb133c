"""Mixing sources to target weights by hash-random keys and distributed prefix sums.

Every row gets a hash-random key. The key's first bits name a range, so a source of any size is sorted in
many small ranges at once; the ranges' sums give each range its offset, and a window inside the range gives
each row its own. A source's budget is cut exactly there, after as many whole epochs as fit in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from acervo.llm.common import WORD, kept, materialize, read

WEIGHTS = (5, 2, 1)
SHARE = 1.5
EPOCHS = 2
#: Hex digits of the key that name a range: 16 bits, so a source of 10 billion rows has 150,000 a range.
RANGE_HEX = 4


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with size (its words) and the hash-random key; equal rows have equal keys and are interchangeable."""
    body = F.coalesce(F.col(text), F.lit(""))
    key = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(body)))
    return docs.withColumn("size", F.regexp_count(body, F.lit(WORD)).cast("long")).withColumn("_key", key)


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """source and its source_size, with target: share of all words by weight, at most epochs times the source.

    sizes has a row for each source. A source is full when its limit over its weight lies under the level that
    the others reach; in the order of that ratio, prefix sums give every level at once.
    """
    order = W.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    by_ratio = W.orderBy(F.col("_limit") / F.col("_weight"), F.col("source").isNull(), F.encode("source", "UTF-8"))
    before, after = by_ratio.rowsBetween(W.unboundedPreceding, -1), by_ratio.rowsBetween(0, W.unboundedFollowing)
    everything = W.partitionBy(F.lit(1))
    x = sizes.withColumn("_weight", weight.cast("long")).withColumn("_limit", F.col("source_size") * epochs)
    x = x.withColumn("_level", (F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("_limit").over(before), F.lit(0))) / F.sum("_weight").over(after))
    x = x.withColumn("_full", F.col("_limit") < F.col("_level") * F.col("_weight"))
    level = F.min(F.when(~F.col("_full"), F.struct("_ratio", "_level"))).over(everything)["_level"]
    x = x.withColumn("_ratio", F.col("_limit") / F.col("_weight"))
    return x.select("source", "source_size", F.when(F.col("_full"), F.col("_limit").cast("double")).otherwise(level * F.col("_weight")).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and copies, with the columns named in keep.

    taken counts the words that the mix takes from the row, repeats included; at the cut it is a part of the
    row. copies counts the epochs in which some of the row is taken. A null text has size 0, a null source is a
    source of its own, ties of the key are equal rows but for kept columns, whose digest then decides. An empty table
    gives an empty result. Clashing names follow common.kept.
    """
    columns = dict.fromkeys(["doc_id", "source", *kept(keep, ("size", "source_size", "target", "taken", "copies"))])
    rows = sized(docs.select(*dict.fromkeys([*columns, text])), text).select(*columns, "size", "_key", F.xxhash64(*columns).alias("_tie"))
    rows = materialize(rows.withColumn("_range", F.substring("_key", 1, RANGE_HEX)), "sized")
    ranges = rows.groupBy("source", "_range").agg(F.sum("size").alias("_words"))
    aim = targets(ranges.groupBy("source").agg(F.sum("_words").alias("source_size")), weights, share, epochs)
    offset = F.sum("_words").over(W.partitionBy("source").orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    ranges = ranges.withColumn("_offset", F.coalesce(offset, F.lit(0))).select(F.col("source").alias("_s"), F.col("_range").alias("_r"), "_offset")
    aim = aim.withColumnRenamed("source", "_t")
    ranges = ranges.join(aim, F.col("_s").eqNullSafe(F.col("_t"))).drop("_t")
    inside = W.partitionBy("source", "_range").orderBy("_key", "doc_id", "_tie").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(ranges, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r")))
    budget = F.floor("target").cast("long")
    rounds = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    last = F.greatest(F.lit(0), F.least(F.col("size"), budget - F.col("_rounds") * F.col("source_size") - F.col("_offset") - F.col("_before")))
    rows = rows.withColumn("_rounds", rounds).withColumn("_last", last)
    taken = F.col("_rounds") * F.col("size") + F.col("_last")
    copies = F.when(F.col("size") > 0, F.col("_rounds") + (F.col("_last") > 0).cast("long")).otherwise(F.lit(0))
    return rows.select(*columns, "size", "source_size", "target", taken.cast("long").alias("taken"), copies.cast("long").alias("copies"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(concat_ws(':', coalesce(CAST(doc_id AS VARCHAR), ''), md5(coalesce(text, '')))) AS k FROM documents
), per_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighted AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1)::INT] AS w, source_size * 2 AS lim FROM per_source
), levels AS (
  SELECT *, (CAST(sum(source_size) OVER () AS BIGINT) * CAST(1.5 AS DOUBLE)
    - coalesce(CAST(sum(lim) OVER (ORDER BY lim / w, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0))
    / CAST(sum(w) OVER (ORDER BY lim / w, source IS NULL, encode(source) ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS lev FROM weighted
), marked AS (SELECT *, lim < lev * w AS is_full FROM levels
), aimed AS (
  SELECT source, source_size, CASE WHEN is_full THEN CAST(lim AS DOUBLE)
    ELSE (SELECT lev FROM marked WHERE NOT is_full ORDER BY lim / w, lev LIMIT 1) * w END AS target FROM marked
), placed AS (
  SELECT doc_id, source, size, coalesce(CAST(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS before FROM sized
), cut AS (
  SELECT doc_id, size, source_size, target, before, CAST(floor(target) AS BIGINT) AS budget,
         CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS rounds
  FROM placed p JOIN aimed a ON p.source IS NOT DISTINCT FROM a.source
)
SELECT doc_id, size, source_size, target,
       CAST(rounds * size + greatest(0, least(size, budget - rounds * source_size - before)) AS BIGINT) AS taken
FROM cut
"""
