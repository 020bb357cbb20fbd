"""Closures graph by graph: with one global graph, and along owl:imports.

Every scope sees the statements of its own and of imported graphs, and concludes in an
inferred graph of its own only what none of them states or concludes already.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions.scalars import encode_for_uri
from quadrille.functions.scratch import written
from quadrille.functions.terms import iri, owl, str_
from quadrille.operators.paths import one_or_more
from quadrille.plans.rules import Closure, Ruleset
from quadrille.plans.rulesets import rdfs_ruleset
from quadrille.plans.transforms import strongly_connected


def inferred_graph(graph: Column, prefix: str) -> Column:
    return iri(F.concat(F.lit(prefix), encode_for_uri(str_(graph))))


def scoped_closure(ruleset: Ruleset, quads: DataFrame, scopes: DataFrame, **parameters: str) -> DataFrame:
    """The quads that each scope infers. scopes: (scope, g), the graphs that a scope sees; the
    scope is the graph it concludes in."""
    seen = quads.join(scopes, "g").select("s", "p", "o", F.col("scope").alias("g"))
    return Closure(ruleset, seen, parameters=parameters, scoped=True).run()


def global_import(ruleset: Ruleset, quads: DataFrame, global_graph: str, prefix: str = "urn:inf:", others: dict[str, str] | None = None, **parameters: str) -> DataFrame:
    """Every graph sees the global graph and what that infers; the global graph sees itself only.
    others: parameters that differ in all graphs but the global one."""
    graphs = written(quads.select("g").distinct(), "graphs")
    scopes = graphs.select(inferred_graph(F.col("g"), prefix).alias("scope"), "g")
    first = written(scoped_closure(ruleset, quads, scopes.where(F.col("g") == global_graph), **parameters), "global")
    own = scopes.where(F.col("g") != global_graph)
    above = F.explode(F.array(F.lit(global_graph), inferred_graph(F.lit(global_graph), prefix)))
    more = scoped_closure(ruleset, quads.unionByName(first), own.unionByName(own.select("scope", above.alias("g"))), **(parameters | (others or {})))
    return first.unionByName(more)


def rdfs_separate_global(quads: DataFrame, global_graph: str, prefix: str = "urn:inf:", full: str = "true") -> DataFrame:
    """RDFS in each graph on its own with the global graph: the axioms are stated once, in what the
    global graph infers, and the others see them there."""
    return global_import(rdfs_ruleset(), quads, global_graph, prefix, {"axioms": "false"}, full=full, axioms="true")


def topology(quads: DataFrame, prefix: str = "urn:inf:") -> tuple[DataFrame, DataFrame]:
    """(members, imports): (scope, g) for the graphs of each group that import each other, and
    (scope, imported scope) for all groups that a group reaches."""
    imports = quads.where((F.col("p") == owl("imports")) & (F.col("s") == F.col("g"))).select(F.col("s").alias("src"), F.col("o").alias("dest"))
    every = quads.select(F.col("g").alias("src"), F.lit(None).cast("string").alias("dest")).distinct()
    groups = strongly_connected(imports.unionByName(every))
    members = written(groups.select(inferred_graph(F.col("comp"), prefix).alias("scope"), F.col("node").alias("g")), "members")
    to = members.select(F.col("scope").alias("dst"), F.col("g").alias("dest"))
    edges = imports.join(members.select("scope", F.col("g").alias("src")), "src").join(to, "dest").where("scope != dst")
    return members, one_or_more(edges.select(F.col("scope").alias("src"), "dst").distinct())


def graph_import(ruleset: Ruleset, quads: DataFrame, prefix: str = "urn:inf:", **parameters: str) -> DataFrame:
    """Closures along owl:imports (g owl:imports h, stated in g): groups that import each other
    are one scope, and scopes are closed level by level, imported ones first."""
    members, reach = topology(quads, prefix)
    done, pending, out = None, members.select("scope").distinct(), None
    known = written(quads.select("s", "p", "o", "g"), "quads")
    while True:
        # ready: every scope it imports is done
        waiting = reach.select(F.col("src").alias("scope"), F.col("dst").alias("needs"))
        if done is not None:
            waiting = waiting.join(done.withColumnRenamed("scope", "needs"), "needs", "left_anti")
        ready = written(pending.join(waiting.select("scope").distinct(), "scope", "left_anti"), "ready")
        if ready.isEmpty():
            return out if out is not None else known.limit(0)
        below = reach.select(F.col("src").alias("scope"), F.col("dst").alias("other"))
        graphs_below = below.join(members.withColumnRenamed("scope", "other"), "other").select("scope", "g").unionByName(below.select("scope", F.col("other").alias("g")))
        scopes = ready.join(members.unionByName(graphs_below), "scope").distinct()
        found = written(scoped_closure(ruleset, known, scopes, **parameters), "level")
        known = known.unionByName(found)
        out = found if out is None else out.unionByName(found)
        done = ready if done is None else done.unionByName(ready)
        pending = written(pending.join(ready, "scope", "left_anti"), "pending")
