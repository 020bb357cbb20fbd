"""Property paths as edge tables: every path is a DataFrame (src, dst)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.functions.scratch import Pile, small, written


def step(quads: DataFrame, predicate: str) -> DataFrame:
    return quads.where(F.col("p") == predicate).select(F.col("s").alias("src"), F.col("o").alias("dst"))


def other_than(quads: DataFrame, *predicates: str) -> DataFrame:
    return quads.where(~F.col("p").isin(list(predicates))).select(F.col("s").alias("src"), F.col("o").alias("dst"))


def inverse(path: DataFrame) -> DataFrame:
    return path.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def sequence(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("src", F.col("dst").alias("mid")).join(b.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst")


def either(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


def nodes(quads: DataFrame) -> DataFrame:
    return quads.select(F.explode(F.array("s", "o")).alias("n")).distinct()


def zero_or_one(path: DataFrame, all_nodes: DataFrame) -> DataFrame:
    return path.unionByName(all_nodes.select(F.col("n").alias("src"), F.col("n").alias("dst"))).distinct()


def one_or_more(path: DataFrame) -> DataFrame:
    """All pairs joined by one edge or more, cycles included, by semi-naive doubling.

    Each round joins the pairs found last with all pairs so far, so the length of the paths
    covered doubles; only new pairs go on. A round is one join, one anti join and a written
    table; the tables that hold all pairs are merged as they pile up.
    """
    delta = written(path.distinct(), "paths")
    pile = Pile(delta)
    while True:
        known = pile.table()
        longer = sequence(delta, known).unionByName(sequence(known, delta)).distinct()
        delta = written(longer.join(known, ["src", "dst"], "left_anti"), "paths")
        if not pile.add(delta):
            return known


def zero_or_more(path: DataFrame, all_nodes: DataFrame) -> DataFrame:
    return zero_or_one(one_or_more(path), all_nodes)


def reachable(starts: DataFrame, path: DataFrame) -> DataFrame:
    """(start, dst) of all nodes that each start reaches by one edge or more: only the frontier is joined."""
    edges = written(path.distinct(), "edges")
    near = small(edges)
    delta = written(starts.select(F.col(starts.columns[0]).alias("start")).join(edges.withColumnRenamed("src", "start"), "start").distinct(), "reach")
    pile = Pile(delta)
    while True:
        known = pile.table()
        step_ = delta.select("start", F.col("dst").alias("src")).join(near, "src").select("start", "dst").distinct()
        delta = written(step_.join(known, ["start", "dst"], "left_anti"), "reach")
        if not pile.add(delta):
            return known
