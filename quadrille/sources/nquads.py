"""N-Quads and N-Triples by Spark's text source and sink; gzip is the sink's and the source's own."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions.scratch import folder
from quadrille.functions.terms import is_iri, is_literal

_TERM = r'(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)'
_LINE = rf"^\s*{_TERM}\s+{_TERM}\s+{_TERM}(?:\s+{_TERM})?\s*\.\s*(?:#.*)?$"


def read_nquads(spark: SparkSession, path: str, graph: str | None = None, skolem: str | None = "urn:bnode:") -> DataFrame:
    """(s, p, o, g); lines that are no statements (comments, errors) are left out.

    graph takes statements without one; skolem, if given, is the IRI prefix that stands for
    blank nodes, so that they join across files.
    """
    lines = spark.read.text(path)
    parts = [F.regexp_extract("value", _LINE, i).alias(c) for i, c in enumerate("spog", 1)]
    out = lines.where(F.col("value").rlike(_LINE)).select(*parts)
    out = out.withColumn("g", F.when(F.col("g") == "", F.lit(graph)).otherwise(F.col("g")))
    if skolem is not None:
        for c in "sog":
            out = out.withColumn(c, F.when(F.col(c).startswith("_:"), F.concat(F.lit(f"<{skolem}"), F.substring(c, 3, 1 << 20), F.lit(">"))).otherwise(F.col(c)))
    return valid(out)


def malformed(spark: SparkSession, path: str) -> DataFrame:
    """(path, value) of the lines that read_nquads leaves out though they are neither empty nor comments."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value")
    statement = F.col("value").rlike(_LINE) & F.col("value").rlike(r"^\s*(<|_:)")
    return lines.where(~statement & ~F.col("value").rlike(r"^\s*(#.*)?$"))


def read_zipped(spark: SparkSession, path: str, **options) -> DataFrame:
    """N-Quads of all members of zip archives, nested ones included: an archive is unpacked by one task
    into text below the shared folder, which is then read as usual."""

    def lines(batches):
        import io
        import zipfile

        import pyarrow as pa

        def members(data: bytes):
            with zipfile.ZipFile(io.BytesIO(data)) as archive:
                for name in archive.namelist():
                    if name.endswith(".zip"):
                        yield from members(archive.read(name))
                    elif not name.endswith("/"):
                        with archive.open(name) as f:
                            yield from io.TextIOWrapper(f, "utf-8", "replace")

        for batch in batches:
            for data in batch.column(0):
                held = []
                for line in members(data.as_py()):
                    held.append(line.rstrip("\r\n"))
                    if len(held) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["value"])
                        held = []
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["value"])

    out = f"{folder(spark)}/unzipped-{uuid.uuid4().hex}"
    spark.read.format("binaryFile").load(path).select("content").mapInArrow(lines, "value string").write.text(out)
    return read_nquads(spark, out, **options)


def write_nquads(quads: DataFrame, path: str, compression: str = "none") -> None:
    line = F.concat_ws(" ", "s", "p", "o", "g", F.lit("."))
    quads.select(line.alias("value")).write.option("compression", compression).text(path)


def valid(quads: DataFrame) -> DataFrame:
    """Rows that are statements: subject an IRI or blank node, predicate an IRI, object bound, graph none or no literal."""
    return quads.where(is_statement())


def is_statement():
    return ~is_literal(F.col("s")) & is_iri(F.col("p")) & F.col("o").isNotNull() & (F.col("g").isNull() | ~is_literal(F.col("g")))


def set_graphs(quads: DataFrame, *graphs: str) -> DataFrame:
    """Each statement in each of the graphs, instead of its own."""
    return quads.drop("g").distinct().withColumn("g", F.explode(F.array(*map(F.lit, graphs)))) if graphs else quads
