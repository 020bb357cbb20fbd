"""Relational tables as quads: a row is a subject, a column a predicate, a foreign key an IRI."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions import terms as t


@dataclass(frozen=True)
class TableMap:
    """key: columns that name the subject; links: column -> table whose subject it names."""

    table: str
    key: tuple[str, ...]
    links: dict[str, str] = field(default_factory=dict)

    @property
    def graph(self) -> str:
        return f"<urn:g:{self.table}>"


def subject(table: str, *keys) -> object:
    return t.iri(F.concat_ws("", F.lit(f"urn:t:{table}/"), F.concat_ws("-", *[F.col(k) if isinstance(k, str) else k for k in keys])))


def predicate(column: str) -> str:
    return f"<urn:c:{column}>"


#: The star schema of the test tables.
MAPS = {
    m.table: m
    for m in (
        TableMap("region", ("r_regionkey",)),
        TableMap("nation", ("n_nationkey",), {"n_regionkey": "region"}),
        TableMap("customer", ("c_custkey",), {"c_nationkey": "nation"}),
        TableMap("supplier", ("s_suppkey",), {"s_nationkey": "nation"}),
        TableMap("part", ("p_partkey",)),
        TableMap("orders", ("o_orderkey",), {"o_custkey": "customer"}),
        TableMap("lineitem", ("l_orderkey", "l_linenumber"), {"l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"}),
    )
}


def table_quads(df: DataFrame, mapping: TableMap, columns: Iterable[str] | None = None, with_type: bool = True) -> DataFrame:
    """(s, p, o, g) of a table: one pass, exploding each row's wanted columns; nulls give no quad.

    Only `columns` are read, so a pattern over one predicate is a scan of two columns.
    """
    wanted = list(df.columns) if columns is None else [c for c in df.columns if c in set(columns)]
    kinds = dict(df.dtypes)
    pairs = [F.struct(F.lit(t.rdf("type")).alias("p"), F.lit(f"<urn:t:{mapping.table}>").alias("o"))] if with_type else []
    for c in wanted:
        value = subject(mapping.links[c], c) if c in mapping.links else t.typed(F.col(c), kinds[c])
        pairs.append(F.struct(F.lit(predicate(c)).alias("p"), F.when(F.col(c).isNotNull(), value).alias("o")))
    exploded = df.select(subject(mapping.table, *mapping.key).alias("s"), F.explode(F.array(*pairs)).alias("x"))
    return exploded.select("s", "x.p", "x.o", F.lit(mapping.graph).alias("g")).where("o is not null")


def star(df: DataFrame, mapping: TableMap, subject_var: str, variables: dict[str, str]) -> DataFrame:
    """The solutions of a star of patterns (?subject, column, ?variable) over one table's quads.

    variables: variable -> column. The table's rows are the solutions, so the star is one scan
    of the columns it names instead of a join of a pattern for each; rows with a null have no
    quad there and so no solution.
    """
    kinds = dict(df.dtypes)
    term = lambda c: subject(mapping.links[c], c) if c in mapping.links else t.typed(F.col(c), kinds[c])
    return df.dropna(subset=list(variables.values())).select(subject(mapping.table, *mapping.key).alias(subject_var), *(term(c).alias(v) for v, c in variables.items()))


def quads(spark: SparkSession, sf_dir: str, tables: Iterable[str], columns: Iterable[str] | None = None, with_type: bool = True) -> DataFrame:
    out = None
    for name in tables:
        part = table_quads(spark.read.parquet(f"{sf_dir}/{name}.parquet"), MAPS[name], columns, with_type)
        out = part if out is None else out.unionByName(part)
    return out
