"""Changes to a set of quads, as functions from DataFrame to DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.operators.patterns import Pattern, bgp, construct
from quadrille.sources.nquads import is_statement

QUAD = ["s", "p", "o", "g"]
NULL_GRAPH = "<urn:g:default>"


def in_graph(quads: DataFrame, null_graph: str = NULL_GRAPH) -> DataFrame:
    """Statements without a graph go to the configured one."""
    return quads.select("s", "p", "o", F.coalesce("g", F.lit(null_graph)).alias("g"))


def add(quads: DataFrame, more: DataFrame) -> DataFrame:
    """Set semantics: what is there already, or repeats in `more`, is added once."""
    return quads.unionByName(_new(more, quads))


def _new(more: DataFrame, quads: DataFrame) -> DataFrame:
    """Each quad of more that is not in quads, once. The join comes first: it deals rows out by the whole
    quad and sorts them, so what repeats lies together and no task hashes all rows that it has scanned."""
    return more.select(*QUAD).join(quads.select(*QUAD).hint("merge"), QUAD, "left_anti").distinct()


def remove(quads: DataFrame, gone: DataFrame) -> DataFrame:
    return quads.join(gone.select(*QUAD), QUAD, "left_anti")


def remove_matching(quads: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None, *graphs: str) -> DataFrame:
    """Takes away what fits; None fits everything, no graphs means all."""
    hit = F.lit(True)
    for c, v in (("s", s), ("p", p), ("o", o)):
        hit = hit & (F.col(c) == v) if v is not None else hit
    return quads.where(~(hit & F.col("g").isin(list(graphs)) if graphs else hit))


def clear(quads: DataFrame, *graphs: str) -> DataFrame:
    return quads.where(~F.col("g").isin(list(graphs))) if graphs else quads.limit(0)


def copy(quads: DataFrame, source: str, target: str) -> DataFrame:
    """The target becomes what the source is."""
    if source == target:
        return quads
    return clear(quads, target).unionByName(quads.where(F.col("g") == source).withColumn("g", F.lit(target)))


def move(quads: DataFrame, source: str, target: str) -> DataFrame:
    return quads if source == target else clear(copy(quads, source, target), source)


def add_graph(quads: DataFrame, source: str, target: str) -> DataFrame:
    return add(quads, quads.where(F.col("g") == source).withColumn("g", F.lit(target)))


def modify(quads: DataFrame, where: Callable[[DataFrame], DataFrame] | Sequence[Pattern], delete: Sequence[Pattern] = (), insert: Sequence[Pattern] = (), graph: str = NULL_GRAPH) -> DataFrame:
    """Deletes, then inserts, both from one set of solutions over the quads as they were.

    where: a function of the quads, or patterns. A single pattern of quads that is also what is
    deleted takes away what it matches, by a filter.
    """
    solutions, out = where(quads) if callable(where) else bgp(quads, where), quads
    if delete and not callable(where) and len(where[0]) == 4 and [tuple(p) for p in delete] == [tuple(p) for p in where]:
        # Only statements are deleted; a row that is none, or has a null, stays.
        out = out.where(~F.coalesce(_fits(where[0]) & is_statement(), F.lit(False)))
    elif delete:
        out = remove(out, construct(solutions, delete, graph))
    if not insert:
        return out
    made = construct(solutions, insert, graph)
    # Only a quad that has the constants of a template can be what the template makes.
    alike = reduce(lambda a, b: a | b, [F.coalesce(_fits((*p, graph)[:4], equal=False), F.lit(False)) for p in insert])
    return out.unionByName(_new(made, out.where(alike)))


def _fits(pattern: Pattern, equal: bool = True):
    """Whether a quad has the pattern's constants and, with equal, equal terms where a variable repeats."""
    hit, first = F.lit(True), {}
    for name, term in zip(QUAD, pattern):
        if not term.startswith("?"):
            hit = hit & (F.col(name) == term)
        elif equal:
            hit = hit & (F.col(first.setdefault(term, name)) == F.col(name))
    return hit


def graphs(quads: DataFrame) -> DataFrame:
    return quads.select("g").distinct()


def visible(quads: DataFrame, inferred_prefix: str, inferred: bool = True) -> DataFrame:
    """With inferred, all quads; else only those outside graphs whose IRI matches the prefix (a trailing * matches any rest)."""
    return quads if inferred else quads.where(~is_inferred(F.col("g"), inferred_prefix))


def is_inferred(g, prefix: str):
    return g.startswith(f"<{prefix[:-1]}") if prefix.endswith("*") else g == f"<{prefix}>"
