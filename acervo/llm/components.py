"""Connected components of a table of links, by alternating star contractions.

Every step is an aggregation and a join over the links; nothing is collected but a count and a checksum, which are
taken while a round is written. Each round is a table in the shared folder, which cuts the lineage, and is deleted
when the round after the next is there. Joins are merge joins: no side is broadcast, so nothing of the links passes
through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from acervo.llm.common import delete, materialize, new_path


def _least(links: DataFrame) -> DataFrame:
    return links.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the least of it and its neighbours."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    out = both.where("b > a").join(_least(both).hint("merge"), F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the least of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    low = _least(down)
    out = down.join(low.hint("merge"), F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    out = out.unionByName(low.select(F.col("k").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def _written(links: DataFrame, label: str) -> tuple[DataFrame, tuple, str]:
    """The table of links, its count and checksum, and its path."""
    seen, path = Observation(), new_path(links.sparkSession, label)
    links = links.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("check"))
    table = materialize(links, label, path=path)
    return table, (seen.get["n"], seen.get["check"]), path


def components(links: DataFrame) -> DataFrame:
    """node and root (the least node of its component) for every node of links (a, b), any order, repeats allowed."""
    spark = links.sparkSession
    state, seen, path = _written(links.where("a <> b").select("a", "b").distinct(), "links")
    while True:
        before, gone = seen, path
        state, seen, path = _written(_small_star(_large_star(state)), "stars")
        delete(spark, gone)
        if seen == before:
            return state.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                state.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
