"""Patterns over quads and the algebra of solutions, as DataFrame operations.

A pattern is (subject, predicate, object) or (subject, predicate, object, graph); a string
that starts with ? is a variable and becomes a column of that name. Solutions are
DataFrames with one column per variable, null for unbound.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions.scratch import sided, written
from quadrille.functions.terms import is_blank
from quadrille.sources.nquads import valid

Pattern = Sequence[str]


def variables(pattern: Pattern) -> list[str]:
    return [x[1:] for x in pattern if x.startswith("?")]


def default_graph(quads: DataFrame) -> DataFrame:
    """All graphs merged: a statement counts once, however many graphs hold it."""
    return quads.select("s", "p", "o").distinct()


def match(quads: DataFrame, pattern: Pattern) -> DataFrame:
    """The solutions of one pattern: a filter and a projection of the quads."""
    columns: dict[str, Column] = {}
    out = quads
    for name, term in zip("spog", pattern):
        if not term.startswith("?"):
            out = out.where(F.col(name) == term)
        elif term[1:] in columns:
            out = out.where(columns[term[1:]] == F.col(name))
        else:
            columns[term[1:]] = F.col(name)
    return out.select(*(c.alias(v) for v, c in columns.items())) if columns else out.select(F.lit(1).alias("__hit")).limit(1)


def shared(left: DataFrame, right: DataFrame) -> list[str]:
    return [c for c in left.columns if c in right.columns]


def join(left: DataFrame, right: DataFrame, maybe_unbound: Iterable[str] = (), how: str = "inner", on: Column | None = None) -> DataFrame:
    """Joins solutions that agree on their shared variables.

    Variables that either side may leave unbound are named, and agree with anything where
    they are; the rest join by equality. `on` is a further condition over both sides. For
    each set of the former that both sides bind there is a join by equality of its own, so
    that all keys are hashed; only what shares no bound variable at all is paired freely.
    """
    common, loose = shared(left, right), set(maybe_unbound)
    strict = [c for c in common if c not in loose]
    loose = [c for c in common if c in loose]
    if not common and on is None:
        return left.crossJoin(right) if how == "inner" else left.join(right, how=how, on=F.lit(True))
    if not loose and on is None:
        return left.join(right, on=strict, how=how)
    other = right.select(*(F.col(c).alias(f"__{c}") if c in common else F.col(c) for c in right.columns))
    equal = [F.col(c) == F.col(f"__{c}") for c in strict] + ([on] if on is not None else [])
    if not loose:
        return left.join(other, reduce(lambda a, b: a & b, equal), how).drop(*(f"__{c}" for c in common))
    if how == "left":  # rows that nothing agrees with are found by number
        left = written(left.withColumn("__row", F.monotonically_increasing_id()), "left")
    parts = []
    for bound in (set(b) for n in range(len(loose) + 1) for b in combinations(loose, n)):
        tests = equal + [F.col(c) == F.col(f"__{c}") for c in loose if c in bound]
        tests += [F.col(c).isNull() | F.col(f"__{c}").isNull() for c in loose if c not in bound]
        parts.append(left.join(other, reduce(lambda a, b: a & b, tests)))
    out = reduce(lambda a, b: a.unionByName(b), parts)
    if how == "left":
        out = written(out, "agreed")
        out = out.unionByName(left.join(out.select("__row").distinct(), "__row", "left_anti"), allowMissingColumns=True).drop("__row")
    elif how != "inner":
        raise ValueError(f"no {how} join over variables that may be unbound")
    for c in loose:
        out = out.withColumn(c, F.coalesce(c, f"__{c}"))
    return out.drop(*(f"__{c}" for c in common))


def bgp(quads: DataFrame, patterns: Iterable[Pattern], quads_of: dict[int, DataFrame] | None = None, rows: Sequence[int] | None = None, most: int = 0) -> DataFrame:
    """The joined solutions of several patterns, most constants first and connected where possible.

    quads_of gives patterns, by their place, quads of their own. rows: how many rows each pattern
    matches at most; then sides of up to `most` rows are broadcast and no others.
    """
    left = list(enumerate(patterns))
    left.sort(key=lambda x: sum(t.startswith("?") for t in x[1]))
    out, bound, held = None, set(), 1
    while left:
        i = next((i for i, (_, p) in enumerate(left) if bound & set(variables(p))), 0)
        at, p = left.pop(i)
        one = match((quads_of or {}).get(at, quads), p)
        if out is None:
            out = one
        elif rows is None:
            out = join(out, one)
        elif held <= most < rows[at]:
            out = join(sided(out, held, most), one)
        else:
            out = join(out, sided(one, rows[at], most))
        held *= rows[at] if rows else 1
        bound |= set(variables(p))
    return out.drop("__hit")


def optional(left: DataFrame, right: DataFrame, maybe_unbound: Iterable[str] = (), on: Column | None = None) -> DataFrame:
    return join(left, right, maybe_unbound, "left", on)


def union(*solutions: DataFrame) -> DataFrame:
    """All rows of all; variables that one lacks are unbound there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), solutions)


def exists(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right, on=shared(left, right), how="left_semi")


def not_exists(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right, on=shared(left, right), how="left_anti")


def exists_flag(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
    """Whether a solution exists, as a column."""
    keys = shared(left, right)
    return left.join(right.select(*keys).distinct().withColumn(name, F.lit(True)), keys, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def minus(left: DataFrame, right: DataFrame) -> DataFrame:
    """Takes away what agrees with the right side; nothing if no variable is shared."""
    return not_exists(left, right) if shared(left, right) else left


def values(spark: SparkSession, names: Sequence[str], rows: Iterable[Sequence[str | None]]) -> DataFrame:
    """An inline table; None is unbound."""
    return spark.createDataFrame([tuple(r) for r in rows], ", ".join(f"{n} string" for n in names))


def construct(solutions: DataFrame, templates: Sequence[Pattern], graph: str | None = None, emit: Sequence[str | None] = ()) -> DataFrame:
    """(s, p, o, g) of every template for every solution.

    emit names, template by template, a boolean column that must hold. Rows that are no
    statements (a literal as subject, an unbound part) are left out.
    """

    def value(term: str | None) -> Column:
        if term is None:
            return F.lit(graph)
        if not term.startswith("?"):
            return F.lit(term)
        return F.col(term[1:]) if term[1:] in solutions.columns else F.lit(None).cast("string")

    rows = []
    for i, p in enumerate(templates):
        s, pr, o, g = (*p, None)[:4]
        flag = emit[i] if i < len(emit) and emit[i] else None
        keep = F.coalesce(F.col(flag), F.lit(False)) if flag else F.lit(True)
        rows.append(F.struct(keep.alias("keep"), *(value(x).cast("string").alias(n) for n, x in zip("spog", (s, pr, o, g)))))
    if len(rows) == 1:
        out = solutions.select(rows[0].alias("q"))
    else:
        out = solutions.select(F.explode(F.array(*rows)).alias("q"))
    return valid(out.where("q.keep").select("q.s", "q.p", "q.o", "q.g"))


def describe(quads: DataFrame, *resources: str, skolem: str = "<urn:bnode:") -> DataFrame:
    """The statements about the resources, and about the blank nodes that these lead to, step by
    step; IRIs that stand for blank nodes are told by their prefix."""
    blank = is_blank(F.col("o")) | F.col("o").startswith(skolem)
    out = frontier = written(quads.where(F.col("s").isin(list(resources))), "described")
    while True:
        met = frontier.where(blank).select(F.col("o").alias("s")).distinct().join(out.select("s"), "s", "left_anti")
        frontier = written(quads.join(met, "s", "left_semi").select(quads.columns), "described")
        if frontier.isEmpty():
            return out
        out = out.unionByName(frontier)
