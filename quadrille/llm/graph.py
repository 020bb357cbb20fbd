"""Connected components by alternating large-star and small-star steps on an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import materialize, small


def _to_minimum(edges: DataFrame, hubs: DataFrame) -> DataFrame:
    """Each (node, hub) becomes (node, least id the hub knows)."""
    return (
        edges.join(hubs, "hub")
        .where(F.col("node") != F.col("least"))
        .select(F.greatest("node", "least").alias("a"), F.least("node", "least").alias("b"))
    )


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("hub"), F.col("b").alias("node")).unionByName(
        edges.select(F.col("b").alias("hub"), F.col("a").alias("node"))
    )
    hubs = materialize(both.groupBy("hub").agg(F.min("node").alias("least")).select("hub", F.least("hub", "least").alias("least")), "hubs")
    return _to_minimum(both.where("node > hub"), small(hubs, 16)).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    hubs = materialize(edges.groupBy(F.col("a").alias("hub")).agg(F.min("b").alias("least")), "hubs")
    down = edges.select(F.col("a").alias("hub"), F.col("b").alias("node"))
    return (
        _to_minimum(down, small(hubs, 16))
        .unionByName(hubs.select(F.col("hub").alias("a"), F.col("least").alias("b")))
        .distinct()
    )


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node with an edge; component is the least id reachable.

    edges: two long columns (a, b), any order, repeats and loops allowed. Every round is
    two aggregations and two joins on written tables; rounds grow with the logarithm of the
    longest path. Nothing is gathered on the driver but counts. An empty table gives none.
    """
    now = materialize(
        edges.where("a is not null and b is not null and a != b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    seen = None
    for _ in range(max_rounds):
        now = materialize(_small_star(materialize(_large_star(now), "edges")), "edges")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
