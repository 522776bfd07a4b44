"""Connected components by alternating stars, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm._store import dropped, written


def _round(edges: DataFrame) -> DataFrame:
    """Each node's larger, then its smaller neighbours move to the least one it sees."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _unsettled(edges: DataFrame) -> bool:
    """Whether the edges are anything but stars: some node hangs from two others, or hangs from one and holds others."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")), F.struct(F.col("v").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))).alias("e")).select("e.*")
    return not ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds")).where("hangs > 1 or hangs = 1 and holds = 1").isEmpty()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``links`` (a, b: long) -> (node, component), written: the least node reachable.

    Only nodes with a link to another node come out. Each round is written to
    the shared folder, so neither plans nor recovery grow with the rounds; the
    driver sees one answer a round. Rows whose ends are null or equal are
    ignored. A star's centre is a grouped minimum, so it meets in partial sums.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    for _ in range(max_rounds):
        if not _unsettled(edges):
            # the centres of stars are their least nodes
            rows = F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("component")), F.struct(F.col("v").alias("node"), F.col("v").alias("component")))
            found = written(edges.select(F.explode(rows).alias("e")).select("e.*").distinct(), "components")
            dropped(edges)
            return found
        last = edges
        edges = written(_round(last), "edges")
        dropped(last)
    raise RuntimeError("components did not settle")
