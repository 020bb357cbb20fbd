"""A store of quads: asserted and inferred parts, closure status and versions on disk."""

from __future__ import annotations

import json
import warnings
from dataclasses import dataclass, field
from enum import Enum

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions.scratch import written
from quadrille.operators import graphs as G
from quadrille.plans.rules import Closure, Ruleset
from quadrille.sources.nquads import read_nquads, valid


class Status(Enum):
    STALE = 0
    POSSIBLY_INCOMPLETE = 1
    CURRENT = 2


@dataclass
class Store:
    """Quads with rules. Reads may include what the rules infer; changes are to asserted quads only.

    Adding to a current closure leaves it possibly incomplete, removing makes it stale; a
    stale closure is computed anew, an incomplete one goes on from what it has. With
    auto_closure the closure is brought up to date before a read that includes it.
    """

    spark: SparkSession
    ruleset: Ruleset | None = None
    prefix: str = "urn:inf:*"
    inference_graph: str = "<urn:inf:main>"
    parameters: dict[str, str] = field(default_factory=dict)
    auto_closure: bool = True
    read_only: bool = False
    status: Status = Status.POSSIBLY_INCOMPLETE
    namespaces: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        self.asserted = self.spark.createDataFrame([], "s string, p string, o string, g string")
        self.inferred = self.asserted

    def _change(self, asserted: DataFrame, status: Status) -> None:
        if self.read_only:
            raise PermissionError("the store is read only")
        self.asserted = written(asserted, "asserted")
        self.status = status

    def _outside(self, quads: DataFrame) -> DataFrame:
        """Statements for inferred graphs are dropped: only rules write there."""
        quads = G.in_graph(valid(quads))
        return quads.where(~G.is_inferred(F.col("g"), self.prefix))

    def add(self, quads: DataFrame) -> None:
        after = Status.POSSIBLY_INCOMPLETE if self.status is Status.CURRENT else self.status
        self._change(G.add(self.asserted, self._outside(quads)), after)

    def load_file(self, path: str, graph: str | None = None, silent: bool = False) -> None:
        """Adds the statements of an N-Quads file; a silent load that fails only warns."""
        try:
            self.add(read_nquads(self.spark, path, graph))
        except (AnalysisException, OSError) as e:
            if not silent:
                raise
            warnings.warn(f"{path} is not loaded: {e}", stacklevel=2)

    def set_namespace(self, prefix: str, name: str) -> None:
        self.namespaces[prefix] = name

    def get_namespace(self, prefix: str) -> str | None:
        return self.namespaces.get(prefix)

    def remove_namespace(self, prefix: str) -> None:
        self.namespaces.pop(prefix, None)

    def clear_namespaces(self) -> None:
        self.namespaces.clear()

    def remove(self, quads: DataFrame) -> None:
        self._change(G.remove(self.asserted, self._outside(quads)), Status.STALE)

    def remove_matching(self, s=None, p=None, o=None, *graphs: str) -> None:
        self._change(G.remove_matching(self.asserted, s, p, o, *graphs), Status.STALE)

    def clear(self, *graphs: str) -> None:
        self._change(G.clear(self.asserted, *graphs), Status.STALE)

    def reset(self) -> None:
        self._change(self.asserted.limit(0), Status.POSSIBLY_INCOMPLETE)
        self.inferred = self.asserted

    def modify(self, where, delete=(), insert=()) -> None:
        """An insert counts as an addition, a delete as a removal."""
        after = Status.STALE if delete else Status.POSSIBLY_INCOMPLETE
        self._change(self._outside(G.modify(self.read(), where, delete, insert)), after)

    def clear_closure(self) -> None:
        self.inferred, self.status = self.asserted.limit(0), Status.POSSIBLY_INCOMPLETE

    def update_closure(self) -> None:
        if self.status is Status.CURRENT or self.ruleset is None:
            return
        if self.status is Status.STALE:
            self.clear_closure()
        start = self.asserted.unionByName(self.inferred)
        found = Closure(self.ruleset, start, self.inference_graph, self.parameters).run()
        found = found.where(G.is_inferred(F.col("g"), self.prefix))
        self.inferred = written(self.inferred.unionByName(found), "inferred")
        self.status = Status.CURRENT

    def read(self, inferred: bool = True) -> DataFrame:
        if not inferred or self.ruleset is None:
            return self.asserted
        if self.auto_closure and not self.read_only:
            self.update_closure()
        return self.asserted.unionByName(self.inferred)

    def has(self, s=None, p=None, o=None, inferred: bool = True) -> bool:
        out = self.read(inferred)
        for c, v in (("s", s), ("p", p), ("o", o)):
            out = out.where(F.col(c) == v) if v is not None else out
        return not out.limit(1).isEmpty()

    def size(self, inferred: bool = True) -> int:
        return self.read(inferred).count()

    def statistics(self) -> DataFrame:
        """The one statement that tells the number of statements, itself included."""
        n = self.asserted.agg((F.count("*") + 1).alias("n"))
        count = F.concat(F.lit('"'), F.col("n").cast("string"), F.lit('"^^<http://www.w3.org/2001/XMLSchema#integer>'))
        return n.select(F.lit("<urn:store>").alias("s"), F.lit("<http://rdfs.org/ns/void#triples>").alias("p"), count.alias("o"), F.lit(self.inference_graph).alias("g"))

    def save(self, path: str) -> None:
        """Quads partitioned by whether they are inferred, and the state beside them."""
        both = self.asserted.withColumn("inferred", F.lit(False)).unionByName(self.inferred.withColumn("inferred", F.lit(True)))
        both.write.mode("overwrite").partitionBy("inferred").parquet(f"{path}/quads")
        state = json.dumps({"status": self.status.name, "namespaces": self.namespaces, "rules": self.ruleset.digest() if self.ruleset else None})
        self.spark.createDataFrame([(state,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/state")

    def load(self, path: str) -> None:
        """A closure that other rules made is stale."""
        quads = self.spark.read.schema("s string, p string, o string, g string, inferred boolean").parquet(f"{path}/quads")
        self.asserted, self.inferred = (quads.where(F.col("inferred") == b).drop("inferred") for b in (False, True))
        state = json.loads(self.spark.read.text(f"{path}/state").first()[0])
        self.namespaces = state["namespaces"]
        same = state["rules"] == (self.ruleset.digest() if self.ruleset else None)
        self.status = Status[state["status"]] if same else Status.STALE
