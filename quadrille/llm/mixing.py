"""Mixing sources to target weights by weighted sampling without replacement.

Efraimidis-Spirakis: a document with quality weight w and a uniform draw u gets the
exponential key -ln(u) / w; the least keys of a source come first. A source whose target is
several times its size is taken in complete epochs; the rest of its target is a prefix of
the sorted documents, by a prefix sum of sizes. All of it is DataFrame functions.

The prefix sum runs in two levels, so that no source, however large, meets in one task: the
keys are cut into slices by a monotone function, slices are summed for each source, and only
then is a window run within a slice. The function is the source's own distribution of keys:
a document of weight w has an exponential key of rate w, so the histogram of weights gives
the share of keys below any value, and slices come out even under any weights.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quadrille.llm.common import WORD, materialize, numbered, small

#: Weights given to the sources in turn, by code point.
WEIGHTS = (5, 2, 1)
#: A target is at most this many times the size of its source.
MOST = 3
#: Documents of one source that share a slice, on average.
SLICE_ROWS = 5_000
#: Classes of weights to a power of ten in the histogram that slices are cut by.
WEIGHT_CLASSES = 128


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """0.1 to 1: the share of letters and digits among what isn't ASCII white space; 0.1 without any.

    Symbols outside letters, digits and common punctuation count against a text.
    """
    text = F.coalesce(text, F.lit(""))
    odd = F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\x20\x09-\x0D.,;:'?-]"))
    length = F.length(text)
    return F.when(length == 0, 0.1).otherwise(F.lit(1.0) - 0.9 * F.least(F.lit(1.0), 4.0 * odd / length))


def uniform(doc_id: Column, text: Column) -> Column:
    """A draw from (0, 1) fixed by the id (of rows without one, by the text), so that reruns agree."""
    named = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.coalesce(text, F.lit(""))))
    return (F.conv(F.substring(F.md5(named), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sizes: (source, source_size), a row for each source; adds the target of each.

    Sources by code point, null last, weigh in turn; the whole mass is shared by weight,
    a target stops at most * source_size, and the excess is reshared by weight until none is
    above. That fixed point is min(cap, level * weight), so it is found by one pass over the
    sources in the order of cap / weight: the first source whose share of what the earlier
    ones leave isn't above its cap sets the level for itself and all after it. The windows
    here run over sources, not documents.
    """
    turn = (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    given = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    given = given.withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    levels = given.withColumn("level", left / weight_left)
    open_ = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    levels = levels.withColumn("level", F.first(open_, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)))
    return levels.select("source", "source_size", F.coalesce(F.least("cap", F.col("level") * F.col("weight")), F.col("cap")).alias("target"))


def _sliced(keyed: DataFrame) -> DataFrame:
    """Adds `slice`: a source's rows cut by key into slices of SLICE_ROWS on average.

    keyed: a written table with source, w and key. The share of keys below k is the sum over
    classes of weights of their share * (1 - exp(-weight * k)); it rises with k, so slices
    follow the order of keys.
    """
    classes = keyed.groupBy("source", F.floor(F.lit(-WEIGHT_CLASSES) * F.log10("w")).alias("class")).agg(F.count("*").alias("rows"), F.avg("w").alias("rate"))
    curves = classes.groupBy(F.col("source").alias("of")).agg(F.sum("rows").alias("all"), F.collect_list(F.struct("rate", "rows")).alias("curve"))
    curves = materialize(curves, "curves")
    below = F.aggregate("curve", F.lit(0.0), lambda acc, x: acc + x["rows"] * (1.0 - F.exp(-x["rate"] * F.col("key"))))
    cuts = F.ceil(F.col("all") / F.lit(SLICE_ROWS))
    held = keyed.join(small(curves, 32 + 16 * 2 * WEIGHT_CLASSES), F.col("source").eqNullSafe(F.col("of")))
    return held.withColumn("slice", F.least(cuts - 1, F.floor(below / F.col("all") * cuts))).drop("of", "all", "curve")


def _mixed(docs: DataFrame) -> DataFrame:
    """docs (row, doc_id, text, source) as (row, doc_id, size, source_size, target, taken)."""
    text = F.col("text")
    key = -F.log(uniform(F.col("doc_id"), text)) / F.col("w")
    keyed = materialize(
        docs.select("row", "doc_id", "source", "text", words(text).alias("size"), quality_weight(text).alias("w")).withColumn("key", key).drop("text"), "keys"
    )
    keyed = _sliced(keyed)
    sums = materialize(keyed.groupBy("source", "slice").agg(F.sum("size").alias("slice_size")), "slices")
    targets = materialize(source_targets(sums.groupBy("source").agg(F.sum("slice_size").alias("source_size"))), "targets")
    upto = W.partitionBy("source").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    slices_before = (
        sums.withColumn("slice_start", F.coalesce(F.sum("slice_size").over(upto), F.lit(0)))
        .join(small(targets, 64), sums["source"].eqNullSafe(targets["source"]))
        .select(sums["source"].alias("in_source"), F.col("slice").alias("in_slice"), "slice_start", "source_size", "target")
    )
    slices_before = materialize(slices_before, "starts")
    joined = keyed.join(
        small(slices_before, 64),
        keyed["source"].eqNullSafe(slices_before["in_source"]) & (keyed["slice"] == slices_before["in_slice"]),
    )
    within = W.partitionBy("source", "slice").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    start = F.col("slice_start") + F.coalesce(F.sum("size").over(within), F.lit(0))
    words_wanted = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(words_wanted / F.col("source_size"))).otherwise(0)
    rest = words_wanted - epochs * F.col("source_size")
    return joined.withColumn("start", start).select(
        "row",
        "doc_id",
        "size",
        "source_size",
        "target",
        (epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start")))).cast("long").alias("taken"),
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row.

    size counts the words (null or empty text: 0); taken counts the words that the mix takes,
    repeats included: complete epochs, then the prefix of the sorted source that fills the
    rest of the target, of whose last document only the missing words are taken. A null
    source is a source of its own. An empty table gives no rows; rows that share an id, or
    have none, are separate documents. Of rows that share an id and thus a key, the shorter
    comes first.
    """
    own = docs.select(F.lit(0).alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
    return _mixed(own).drop("row")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs as the mix takes them: each row as often as it is taken, whole; a document of which
    half or more of the words are taken once more counts, so that texts are never cut. Rows
    that share an id, or have none, each get their own copies; rows without words get none."""
    held = numbered(docs)
    own = held.select("row", F.col("doc")[id_col].alias("doc_id"), F.col("doc")[text_col].alias("text"), F.col("doc")[source_col].alias("source"))
    copies = F.round(F.col("taken") / F.col("size")).cast("int")
    plan = materialize(_mixed(own).where("size > 0").select("row", copies.alias("copies")).where("copies > 0"), "copies")
    out = held.join(small(plan, 16), "row").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select("doc.*")


ORACLE = rf"""
    WITH d AS (
        SELECT doc_id, source, coalesce(text, '') AS t,
               coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size
        FROM documents),
    k AS (
        SELECT doc_id, source, size,
               CASE WHEN length(t) = 0 THEN 0.1::DOUBLE ELSE 1.0::DOUBLE - 0.9::DOUBLE * least(1.0::DOUBLE,
                   4.0::DOUBLE * len(regexp_extract_all(t, '[^\p{{L}}\p{{N}}\x20\x09-\x0D.,;:''?-]')) / length(t)) END AS w,
               (('0x' || substr(md5(doc_id::VARCHAR), 1, 12))::BIGINT::DOUBLE + 0.5::DOUBLE) / 281474976710656::DOUBLE AS u
        FROM d),
    s AS (SELECT source, sum(size)::DOUBLE AS source_size FROM k GROUP BY source),
    g AS (
        SELECT source, source_size, 3.0::DOUBLE * source_size AS cap,
               (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS weight
        FROM s),
    l AS (
        SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level
        FROM g WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    f AS (
        SELECT source, source_size, cap, weight, cap / weight AS r,
               (SELECT x.level FROM l x WHERE x.level * x.weight <= x.cap ORDER BY x.cap / x.weight, x.source NULLS LAST LIMIT 1) AS first_level,
               (SELECT x.cap / x.weight FROM l x WHERE x.level * x.weight <= x.cap ORDER BY x.cap / x.weight, x.source NULLS LAST LIMIT 1) AS first_r
        FROM l),
    t AS (
        SELECT source, source_size, CASE WHEN r < first_r THEN cap ELSE least(cap, first_level * weight) END AS target,
               round(CASE WHEN r < first_r THEN cap ELSE least(cap, first_level * weight) END)::BIGINT AS wanted
        FROM f),
    p AS (
        SELECT k.*, t.source_size, t.target, t.wanted, CASE WHEN t.source_size > 0 THEN (wanted // t.source_size::BIGINT) ELSE 0 END AS epochs,
               coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY -ln(u) / w, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
        FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
    SELECT doc_id, size, source_size::BIGINT AS source_size, target,
           (epochs * size + greatest(0, least(size, wanted - epochs * source_size::BIGINT - start)))::BIGINT AS taken
    FROM p"""
