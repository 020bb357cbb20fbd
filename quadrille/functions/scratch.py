"""Written intermediate tables, in the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if its written rows, at so many bytes each, stay below the limit.
BROADCAST_BYTES, TRIPLE_BYTES = 16 << 20, 200


def folder(spark: SparkSession) -> str:
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-quadrille-")
        spark.sparkContext.setCheckpointDir(path)
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """df as a Parquet table of its own: the lineage ends here and executors may be lost."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Pile:
    """Written tables that grow round by round: one is merged with the next when that is half as
    large, so a row is written as often as the logarithm of all, and few tables make up the whole."""

    def __init__(self, *tables: DataFrame):
        self.levels: list[tuple[DataFrame, int]] = [(t, t.count()) for t in tables]

    def add(self, table: DataFrame, rows: int | None = None) -> int:
        rows = table.count() if rows is None else rows
        if rows:
            self.levels.append((table, rows))
        while len(self.levels) > 1 and self.levels[-2][1] <= 2 * self.levels[-1][1]:
            (a, x), (b, y) = self.levels[-2:]
            self.levels[-2:] = [(written(a.unionByName(b), "merged"), x + y)]
        return rows

    def table(self) -> DataFrame:
        return reduce(lambda a, b: a.unionByName(b), [t for t, _ in self.levels])


def affordable(sides: Iterable[int], rows: int = BROADCAST_BYTES // TRIPLE_BYTES) -> int:
    """The largest side to broadcast, given the rows of all sides of one job: those up to it hold so many rows in all."""
    most = total = 0
    for n in sorted(sides):
        total += n
        if total > rows:
            return min(most, n - 1)
        most = n
    return most


def sided(df: DataFrame, rows: int, most: int) -> DataFrame:
    """df, of at most so many rows, as a side of a join: broadcast up to `most` rows, else sorted and merged.

    Left to itself, Spark goes by the bytes of compressed files, of which 10 MB may be many
    times that on the driver, and a job of many rules has many such sides at once.
    """
    return F.broadcast(df) if rows <= most else df.hint("merge")


#: Bytes of files, and of a shuffle, that go to one task where tasks are to be lean.
TASK_BYTES = 16 << 20
_UNITS = {"": 1, "b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}


@contextmanager
def lean_tasks(spark: SparkSession) -> Iterator[None]:
    """Within it tasks are given TASK_BYTES at most, if the session gives them more; its settings come back after.

    These bytes are compressed. Terms repeat, so the rows made distinct in a task may take twenty
    times as many, and by Spark's settings a task grows with the input up to 128 MB of files.
    """
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    size = lambda v: int(re.match(r"\d+", v)[0]) * _UNITS[re.sub(r"\d+|(?<=\D)b$", "", v.strip().lower())]
    try:
        for k, v in before.items():
            spark.conf.set(k, str(min(TASK_BYTES, size(v))))
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df, a written table, with a broadcast hint if it is small enough."""
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows * TRIPLE_BYTES <= BROADCAST_BYTES else df
