"""Transforms of solutions that no pattern expresses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions.scratch import affordable, sided, written


def strongly_connected(edges: DataFrame, prefix: str = "") -> DataFrame:
    """(comp, node) of the graph of (src, dest): a component is named by its least node.

    Nodes with no edge back to themselves are components of their own. Edges into or out of dead
    ends are trimmed first, a few layers deep, and chains are contracted, so that closed ones are
    found and of the others one node each is left. In what is left then every node is coloured
    with the least node that reaches it; the nodes of a colour that reach its namesake are that
    node's component, and edges between colours lie in none. What remains is coloured anew.
    Nodes are numbers on the way. Tables are never larger than the edges; rounds grow with the
    logarithm of the longest chain, and with the length of the shortest paths between branches.
    """
    names, seed = _numbered(edges)
    core = written(edges.where("src is not null and dest is not null and src != dest").select(_number("src", seed).alias("src"), _number("dest", seed).alias("dest")), "core")
    for _ in range(TRIMS):
        sources, targets = core.select("src").distinct(), core.select("dest").distinct()
        core = written(core.join(sources.withColumnRenamed("src", "dest"), "dest", "left_semi").join(targets.withColumnRenamed("dest", "src"), "src", "left_semi").select("src", "dest"), "core")
        nodes = written(_inner(core), "inner")
        if nodes.where("dead").isEmpty():
            break
    links, roots = _contracted(nodes.where("pred is not null").select("id", "pred"))
    core = core.join(links.select(F.col("id").alias("dest")), "dest", "left_anti")
    if roots is not None:
        core = core.join(roots.select(F.col("id").alias("src"), "root"), "src", "left").select(F.coalesce("root", "src").alias("src"), "dest")
    core, found = written(core.where("src != dest"), "core"), None
    while not core.isEmpty():
        colours = _coloured(core)
        part = _reaching(core, colours)
        found = part if found is None else found.unionByName(part)
        left = colours.join(part.select("node"), "node", "left_anti")
        ends = [left.select(F.col("node").alias(n), F.col("colour").alias(f"colour_{n}")) for n in ("src", "dest")]
        core = written(core.join(ends[0], "src").join(ends[1], "dest").where("colour_src = colour_dest").select("src", "dest"), "core")
    parts = [] if found is None else [found.select(F.col("node").alias("id"), "comp")]
    if roots is not None:
        parts.append(roots.where("ring").select("id", F.col("root").alias("comp")))
        if found is not None:  # of an open chain, all nodes lie where its first one lies together with others
            several = found.join(found.groupBy("comp").count().where("count > 1"), "comp", "left_semi")
            parts.append(roots.where("not ring").join(several.withColumnRenamed("node", "root"), "root").select("id", "comp"))
    if not parts:
        return names.select(F.concat(F.lit(prefix), "node").alias("comp"), "node")
    placed = reduce(lambda a, b: a.unionByName(b), parts)
    placed = written(names.join(placed, "id", "left").select("node", F.coalesce("comp", "id").alias("comp")), "placed")
    least = placed.groupBy("comp").agg(F.min("node").alias("least"))
    return placed.join(least, "comp").select(F.concat(F.lit(prefix), "least").alias("comp"), "node")


#: Layers of dead ends that are trimmed before chains are contracted, and hashes tried as numbers.
TRIMS, SEEDS = 2, 8


def _number(name: str, seed: int) -> Column:
    return F.xxhash64(F.col(name), F.lit(seed))


def _numbered(edges: DataFrame) -> tuple[DataFrame, int]:
    """(node, id) of all nodes, and the seed of the hash: the first that gives no two nodes one number."""
    nodes = edges.select(F.explode(F.array("src", "dest")).alias("node")).where("node is not null").distinct()
    for seed in range(SEEDS):
        names = written(nodes.select("node", _number("node", seed).alias("id")), "nodes")
        if names.groupBy("id").count().where("count > 1").isEmpty():
            return names, seed
        nodes = names.select("node")
    raise RuntimeError("no hash tells all nodes apart")


def _inner(edges: DataFrame) -> DataFrame:
    """(id, pred, dead): pred is what leads to a node that has one edge in and one out, else null; dead ends have none of one kind."""
    into = edges.groupBy(F.col("dest").alias("id")).agg(F.min("src").alias("pred"), F.max("src").alias("other"))
    out = edges.groupBy(F.col("src").alias("id")).agg(F.min("dest").alias("next"), F.max("dest").alias("last"))
    return into.join(out, "id", "full").select("id", F.when(F.expr("pred = other and next = last"), F.col("pred")).alias("pred"), F.expr("pred is null or next is null").alias("dead"))


def _contracted(inner: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The links (id, pred) between nodes of one edge in and one out, and (id, root, ring): where each went.

    Every round throws a coin for each node; heads whose predecessor shows tails go into it, a
    quarter of all, and links to them lead on to it. So tables shrink by that, and all rounds
    together move a few times the first one. A node that is its own predecessor was a ring, which
    is a component as nothing else leads to it or away; an open chain ends in its first node.
    """
    first = links = written(inner.join(inner.select(F.col("id").alias("pred")), "pred", "left_semi").select("id", "pred"), "links")
    rounds = []
    while rows := links.count():
        heads = lambda c: F.xxhash64(F.col(c), F.lit(len(rounds))) % 2 == 0
        goes = heads("id") & ~heads("pred")
        gone = links.where(goes).select("id", F.col("pred").alias("root"))
        rounds.append((gone, links.where("id = pred").select("id", F.col("id").alias("root"), F.lit(True).alias("ring")), rows))
        via = sided(gone.select(F.col("id").alias("pred"), "root"), rows, affordable([rows]))
        links = written(links.where(~goes & F.expr("id != pred")).join(via, "pred", "left").select("id", F.coalesce("root", "pred").alias("pred")), "links")
    roots = None
    for (gone, rings, rows), later in zip(reversed(rounds), [0, *(r[2] for r in reversed(rounds))]):
        if roots is None:
            part = gone.withColumn("ring", F.lit(False))
        else:  # no more nodes went on later than there were links
            on = sided(roots.select(F.col("id").alias("root"), F.col("root").alias("on"), F.col("ring")), later, affordable([later]))
            part = gone.join(on, "root", "left").select("id", F.coalesce("on", "root").alias("root"), F.coalesce("ring", F.lit(False)).alias("ring"))
        part = part.unionByName(rings)
        if roots is None or 8 * rows < rounds[0][2]:  # few rows: one table
            roots = written(part if roots is None else roots.unionByName(part), "roots")
        else:
            roots = roots.unionByName(written(part, "roots"))
    return first, roots


def _coloured(edges: DataFrame) -> DataFrame:
    """(node, colour): the least node that reaches each; only what changed last is carried on."""
    colours = written(edges.select(F.explode(F.array("src", "dest")).alias("node")).distinct().withColumn("colour", F.col("node")), "colours")
    changed = colours
    while True:
        offered = edges.join(changed.withColumnRenamed("node", "src"), "src").groupBy(F.col("dest").alias("node")).agg(F.min("colour").alias("offer"))
        changed = written(offered.join(colours, "node").where("offer < colour").select("node", F.col("offer").alias("colour")), "changed")
        if changed.isEmpty():
            return colours
        colours = written(colours.join(changed.withColumnRenamed("colour", "less"), "node", "left").select("node", F.coalesce("less", "colour").alias("colour")), "colours")


def _reaching(edges: DataFrame, colours: DataFrame) -> DataFrame:
    """(node, comp): the nodes that reach the node their colour is named after, itself included."""
    known = frontier = written(colours.where("node = colour").select("node", F.col("colour").alias("comp")), "reaching")
    while True:
        back = edges.join(frontier.withColumnRenamed("node", "dest"), "dest").select(F.col("src").alias("node"), "comp").distinct()
        same = back.join(colours, "node").where("colour = comp").select("node", "comp")
        frontier = written(same.join(known.select("node"), "node", "left_anti"), "reaching")
        if frontier.isEmpty():
            return known
        known = known.unionByName(frontier)
