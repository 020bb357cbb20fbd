"""Repeated passages by level-wise doubling.

Windows that repeat at one length alone are extended to twice that length, here 9, 18 and 35
words (the last step overlaps by a word). At the first level not every window is needed: two
equal 35-word windows also agree on which of their 9-word windows has the least hash, so the
least one of every 35-word window is enough, about one in fourteen. A level counts its
windows over the whole corpus and only those that occur twice or more go on; the last level,
on hashes of 128 bits, tells which windows to remove. Rows with one word sequence, by its
SHA-256, are one text from the start.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import SPACE, lean_batches, materialize, scratch_path, small
from quadrille.llm.minhash import _finish, word_hashes

SEED, TWICE, WINDOW = 9, 18, 35
_BASE, _OTHER_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_MASK = (1 << 64) - 1


def window_hashes(h: np.ndarray, length: int, base: int = _BASE) -> np.ndarray:
    """A 64-bit hash of each window of so many words: a polynomial, put together by doubling."""
    if len(h) < length:
        return np.zeros(0, np.uint64)
    have, out = 0, None
    power, size = h, 1
    rest = length
    while rest:
        if rest & 1:
            if out is None:
                out = power
            else:
                n = min(len(out), len(power) - have)
                out = out[:n] * np.uint64(pow(base, size, _MASK + 1)) + power[have : have + n]
            have += size
        rest >>= 1
        if rest:
            power = power[: len(power) - size] * np.uint64(pow(base, size, _MASK + 1)) + power[size:]
            size *= 2
    return _finish(out[: len(h) - length + 1])


def sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over each window of the width."""
    size = 1
    while 2 * size <= width:
        x = pick(x[: len(x) - size], x[size:])
        size *= 2
    return pick(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def seeds(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the 9-word windows that are least in some 35-word window."""
    g = window_hashes(h, SEED)
    span = WINDOW - SEED + 1
    if len(h) < WINDOW:
        return np.zeros(0, np.int32), g[:0]
    least = np.pad(sliding(g, span, np.minimum), span - 1)
    at = np.flatnonzero(sliding(least, span, np.maximum) == g)
    return at.astype(np.int32), g[at]


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _lists(arrays: list[np.ndarray], kind) -> pa.Array:
    offsets = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(kind, copy=False) if kind is not np.int64 else flat.astype(np.uint64).view(np.int64)))


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, sha, at, hashes = [], [], [], []
        for text in batch.column(1):
            data = (text.as_py() or "").encode("utf-8", "surrogatepass")
            words = data.split()
            n.append(len(words))
            sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
            p, g = seeds(word_hashes(data))
            at.append(p)
            hashes.append(g)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(sha), _lists(at, np.int32), _lists(hashes, np.int64)],
            ["doc_id", "digest", "n_words", "sha", "at", "hash"],
        )


def _double(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each surviving seed, the 18-word windows that start with it or end with it."""
    for batch in batches:
        at, hashes = [], []
        for text, places in zip(batch.column(1), batch.column(2)):
            g = window_hashes(word_hashes((text.as_py() or "").encode("utf-8", "surrogatepass")), TWICE)
            p = np.array(places.as_py(), np.int64)
            p = np.unique(np.concatenate([p, p - (TWICE - SEED)]))
            p = p[(p >= 0) & (p < len(g))]
            at.append(p)
            hashes.append(g[p])
        yield pa.RecordBatch.from_arrays([batch.column(0), _lists(at, np.int32), _lists(hashes, np.int64)], ["key", "at", "hash"])


def _full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The 35-word windows all of whose known parts survive: around a seed, with its half that does."""
    half = TWICE - SEED
    for batch in batches:
        at, hashes, others = [], [], []
        for text, places, twice in zip(batch.column(1), batch.column(2), batch.column(3)):
            h = word_hashes((text.as_py() or "").encode("utf-8", "surrogatepass"))
            g, other = window_hashes(h, WINDOW), window_hashes(_finish(h), WINDOW, _OTHER_BASE)
            p, alive = np.array(places.as_py(), np.int64), np.array(twice.as_py(), np.int64)
            marks = np.zeros(len(g) + 2, np.int64)
            after, before = p[np.isin(p, alive)], p[np.isin(p - half, alive)]
            # A window that starts up to 17 words before the seed holds the 18 words from it on;
            # one that starts 18 to 26 words before holds the 18 words that end with it.
            for first, last in ((after - (WINDOW - TWICE), after), (before - (WINDOW - SEED), before - (WINDOW - TWICE) - 1)):
                np.add.at(marks, np.clip(first, 0, len(g)), 1)
                np.add.at(marks, np.clip(last + 1, 0, len(g)), -1)
            own = np.flatnonzero(np.cumsum(marks)[: len(g)] > 0)
            at.append(own)
            hashes.append(g[own])
            others.append(other[own])
        yield pa.RecordBatch.from_arrays([batch.column(0), _lists(at, np.int32), _lists(hashes, np.int64), _lists(others, np.int64)], ["key", "at", "hash", "other"])


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        removed, sha, kept = [], [], []
        for text, starts in zip(batch.column(1), batch.column(2)):
            words = _words(text.as_py())
            marks = np.zeros(len(words) + 1, np.int64)
            s = np.unique(np.array(starts.as_py(), np.int64))
            marks[s] += 1
            np.add.at(marks, s + WINDOW, -1)
            stay = np.cumsum(marks)[:-1] == 0
            left = b" ".join([w for w, k in zip(words, stay.tolist()) if k])
            removed.append(len(words) - int(stay.sum()))
            sha.append(hashlib.sha256(left).hexdigest())
            kept.append(left.decode("utf-8", "surrogatepass"))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed, pa.int64()), pa.array(sha), pa.array(kept, pa.string())], ["key", "n_removed", "kept_sha256", "kept_text"])


def _survivors(rows: DataFrame, name: str) -> DataFrame:
    """Of (key, at[], and one hash[] or more), the places whose hashes occur twice or more: (key, at[])."""
    hashes = rows.columns[2:]
    each = rows.select("key", F.explode(F.arrays_zip("at", *hashes)).alias("x")).select("key", "x.*")
    often = materialize(each.groupBy(*hashes).agg(F.count("*").alias("n")).where("n > 1").drop("n"), f"{name}-often")
    return materialize(each.join(often, hashes, "left_semi").groupBy("key").agg(F.collect_set("at").alias("at")), name)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row; with_text adds kept_text.

    Words are runs of non-white-space (ASCII). Each word is removed that a window of 35 words
    covers whose sequence also starts anywhere else, in the same row or another; windows are
    judged on the input. Null and empty texts have no words; shorter texts lose none. Rows
    that repeat an id, or an id and its text, or have no id, are each judged as a document.
    An empty table gives no rows.
    """
    spark = docs.sparkSession
    lean_batches(spark)
    text = F.col(text_col)
    own = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)).alias("digest"))
    first = materialize(own.mapInArrow(_first_pass, "doc_id long, digest binary, n_words long, sha string, at array<int>, hash array<long>"), "first")
    # From here on a word sequence is one text, however many rows have it.
    groups = first.groupBy("sha").agg(F.min("digest").alias("digest"), F.count("*").alias("rows"), F.max(F.size("at")).alias("seeds"))
    groups = materialize(groups.withColumn("key", F.monotonically_increasing_id()), "sequences")
    asked = materialize(groups.where("seeds > 0").select("key", "digest"), "asked")
    reps = first.where(F.size("at") > 0).join(small(asked, 64), "digest").dropDuplicates(["key"])
    alive = _survivors(reps.select("key", "at", "hash"), "seeds")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"quadrille_passages_{uuid.uuid4().hex}"
    # The texts still in question, bucketed by key, so that no later level moves a text again.
    wanted = materialize(asked.join(alive.select("key"), "key"), "alive")
    texts = own.join(small(wanted, 64), "digest").dropDuplicates(["key"])
    try:
        texts.select("key", "text").repartition(n, "key").write.bucketBy(n, "key").option("path", scratch_path(spark, "passages")).saveAsTable(name)
        texts = spark.table(name)
        places = alive.select("key", F.col("at").alias("seeds"))
        twice = _survivors(texts.join(places, "key").select("key", "text", "seeds").mapInArrow(_double, "key long, at array<int>, hash array<long>"), "twice")
        both = texts.join(places, "key").join(twice.withColumnRenamed("at", "twice"), "key").select("key", "text", "seeds", "twice")
        windows = materialize(both.mapInArrow(_full, "key long, at array<int>, hash array<long>, other array<long>"), "windows")
        hit = _survivors(windows, "hit")
        cut = texts.join(hit, "key").select("key", "text", "at").mapInArrow(_without, "key long, n_removed long, kept_sha256 string, kept_text string")
        cut = materialize(cut if with_text else cut.drop("kept_text"), "cut")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    by_sequence = groups.select("key", "sha", "rows").join(cut, "key", "left")
    by_sequence = materialize(by_sequence.where("rows > 1 or n_removed is not null"), "results")
    gone = (F.col("rows") > 1) & (F.col("n_words") >= WINDOW)
    out = first.select("doc_id", "n_words", "sha", "digest").join(by_sequence, "sha", "left")
    cols = [
        "doc_id",
        "n_words",
        F.when(gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    ]
    if not with_text:
        return out.select(*cols)
    norm = F.trim(F.regexp_replace(F.coalesce(F.col("own_text"), F.lit("")), SPACE, " "))
    out = out.join(own.select("digest", F.col("text").alias("own_text")).dropDuplicates(["digest"]), "digest")
    return out.select(*cols, F.when(gone, F.lit("")).otherwise(F.coalesce("kept_text", norm)).alias("kept_text"))


ORACLE = rf"""
    WITH d AS (
        SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    windows AS (
        SELECT r, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS seq
        FROM (SELECT r, w, unnest(generate_series(1, len(w) - {WINDOW - 1})) AS i FROM d)),
    hits AS (SELECT r, i FROM windows WHERE seq IN (SELECT seq FROM windows GROUP BY seq HAVING count(*) > 1)),
    gone AS (SELECT DISTINCT r, unnest(generate_series(i, i + {WINDOW - 1})) AS place FROM hits),
    each AS (SELECT r, unnest(w) AS word, unnest(generate_series(1, len(w))) AS place FROM d),
    marked AS (SELECT each.r, each.place, word, gone.place IS NOT NULL AS removed FROM each LEFT JOIN gone ON each.r = gone.r AND each.place = gone.place),
    kept AS (
        SELECT r, count(*) FILTER (removed) AS n_removed, string_agg(word, ' ' ORDER BY place) FILTER (NOT removed) AS left_over
        FROM marked GROUP BY r)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(left_over, '')) AS kept_sha256
    FROM d LEFT JOIN kept ON d.r = kept.r"""
