"""Near duplicates: one-permutation hashing with optimal densification, banded buckets, star edges.

The shingles of a document are hashed once; the hash space is cut into bins and each bin keeps
its least value. An empty bin borrows from a bin drawn by a hash of (bin, attempt), the same
for every document, until one that was filled is met (optimal densification). Bins are
grouped into bands; documents that share a band's value are candidates, and a bucket emits
only a star from its members to one centre. Every candidate edge is verified on the full sets.

A star can miss a link between two members that are both unlike the centre. So buckets whose
members lie in more than one component are starred again from another centre, and the
documents that are still in such buckets are joined exactly, across components, by prefix
filter: of two sets that are as similar as asked, the larger's longer prefix of rarest
shingles meets the smaller's shorter one, no later than the positions leave room for. All of it is tested
in the join, without loss. No bucket or candidate is capped.

To verify edges, members travel to their centre and not the centre to each member; a centre
with many members stands once for each share of them. Edges go first whose sizes, or whose
bitmaps of shingles, differ more than linked sets may.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import lean_batches, materialize, small
from quadrille.llm.graph import connected_components

SHINGLE = 5
BAND_ROWS = 7
BANDS = 36
#: Star rounds before what is left is joined by prefix filter.
STAR_ROUNDS = 2
#: Shingles of the members that travel to one copy of their centre, on average.
SHARE = 1 << 20

_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def word_hashes(data: bytes) -> np.ndarray:
    words = data.split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _STEP
    h = (h ^ (h >> np.uint64(32))) * _STEP
    return h ^ (h >> np.uint64(32))


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; of fewer words, the whole sequence; else empty."""
    h = word_hashes((text or "").encode("utf-8", "surrogatepass").lower())
    if not len(h):
        return h
    size = min(size, len(h))
    out = h[: len(h) - size + 1].copy()
    for i in range(1, size):
        out = out * _MIX + h[i : len(h) - size + 1 + i]
    return np.unique(_finish(out + np.uint64(size)))


def _draws(bins: int, attempts: int = 512) -> np.ndarray:
    """The bins that an empty bin tries, one row for each attempt."""
    i, t = np.meshgrid(np.arange(bins, dtype=np.uint64), np.arange(1, attempts + 1, dtype=np.uint64))
    return (_finish(i * _MIX + t * _STEP) % np.uint64(bins)).astype(np.int64)


def one_permutation(hashes: np.ndarray, bins: int, draws: np.ndarray) -> np.ndarray:
    """The densified signature of a sorted, non-empty set of 64-bit hashes."""
    at = ((hashes >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    filled, first = np.unique(at.astype(np.int64), return_index=True)
    out, full = np.zeros(bins, np.uint64), np.zeros(bins, bool)
    out[filled], full[filled] = hashes[first], True
    empty = np.flatnonzero(~full)
    for row in draws:
        if not len(empty):
            break
        source = row[empty]
        ok = full[source]
        out[empty[ok]] = out[source[ok]]
        empty = empty[~ok]
    if len(empty):  # all draws met empty bins: the next filled one, going round
        out[empty] = out[filled[np.searchsorted(filled, empty) % len(filled)]]
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    grid = signature[: bands * rows].reshape(bands, rows)
    out = np.arange(bands, dtype=np.uint64) * _MIX + np.uint64(1)
    for i in range(rows):
        out = _finish(out * _MIX + grid[:, i])
    return out


def _sketcher(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draws = _draws(bands * rows)
        for batch in batches:
            n, low, high, keys, offsets = [], [], [], [], [0]
            for text in batch.column(2):
                s = shingle_set(text.as_py())
                n.append(len(s))
                if len(s):
                    d = xxhash.xxh3_128_intdigest(s.tobytes())
                    keys.append(band_keys(one_permutation(s, bands * rows, draws), bands, rows))
                    offsets.append(offsets[-1] + bands)
                else:
                    d = 0
                    offsets.append(offsets[-1])
                low.append(d & (1 << 64) - 1)
                high.append(d >> 64)
            flat = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(n, pa.int64()),
                    pa.array(np.array(low, np.uint64).view(np.int64)),
                    pa.array(np.array(high, np.uint64).view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat)),
                ],
                ["doc_id", "sha", "n_shingles", "low", "high", "bands"],
            )

    return run


#: Longs of a set's bitmap: the parity of the shingles that fall on each bit.
BITMAP = 16
_BITS = [f"bits{i}" for i in range(BITMAP)]


def _bitmap(s: np.ndarray) -> np.ndarray:
    parity = np.bincount(s.view(np.int64) & (64 * BITMAP - 1), minlength=64 * BITMAP) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.int64)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            sets = [shingle_set(x.as_py()) for x in part.column(1)]
            offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            grid = np.stack([_bitmap(x) for x in sets])
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets).view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in sets], pa.int64()), lists, *(pa.array(grid[:, i]) for i in range(BITMAP))], ["cls", "n", "shingles", *_BITS])


def _may_link(percent: int, a: str, b: str):
    """What two sets that link surely meet, by their sizes and bitmaps (columns ending in a and b)."""
    na, nb = F.col(f"n{a}"), F.col(f"n{b}")
    apart = sum((F.bit_count(F.col(f"{x}{a}").bitwiseXOR(F.col(f"{x}{b}"))) for x in _BITS[1:]), F.bit_count(F.col(f"{_BITS[0]}{a}").bitwiseXOR(F.col(f"{_BITS[0]}{b}"))))
    # 100 * intersection >= percent * union allows so many shingles that only one of both has.
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & ((100 + percent) * apart <= (100 - percent) * (na + nb))


def _confirmer(percent: int):
    """Rows come sorted by centre and share, a centre before its members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, centre = None, np.zeros(0, np.int64)
        for batch in batches:
            a, b, lists = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            found = []
            for i, (c, m) in enumerate(zip(a, b)):
                own = flat[offsets[i] : offsets[i + 1]]
                if c == m:
                    at, centre = c, own.copy()
                    continue
                assert c == at
                both = len(np.intersect1d(centre, own, assume_unique=True))
                if 100 * both >= percent * (len(centre) + len(own) - both):
                    found.append((c, m))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def _verified(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of candidate edges (centre, member), those with 100 * intersection >= percent * union on the
    full sets, as (a, b). What sizes and bitmaps rule out does not travel."""
    size = 16 + 8 * BITMAP
    of = lambda end: small(sets.select(F.col("cls").alias(end), F.col("n").alias(f"n_{end}"), *(F.col(x).alias(f"{x}_{end}") for x in _BITS)), size)
    likely = edges.join(of("centre"), "centre").join(of("member"), "member").where(_may_link(percent, "_centre", "_member"))
    likely = materialize(likely.select("centre", "member", F.col("n_member").alias("n")), "likely")
    shares = materialize(likely.groupBy("centre").agg(F.ceil(F.sum("n") / F.lit(SHARE)).alias("shares")), "shares")
    share = F.pmod(F.xxhash64("member"), F.col("shares"))
    set_of = sets.select(F.col("cls").alias("member"), "shingles")
    members = small(likely.join(small(shares, 16), "centre").select("centre", "member", share.alias("share")), 24).join(set_of, "member")
    centres = small(shares.select("centre", F.col("centre").alias("member"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share")), 24).join(set_of, "member")
    columns = ["centre", "member", "shingles", "share"]
    rows = members.select(columns).unionByName(centres.select(columns)).repartition("centre", "share")
    rows = rows.sortWithinPartitions("centre", "share", F.col("centre") != F.col("member"))
    return rows.select("centre", "member", "shingles").mapInArrow(_confirmer(percent), "a long, b long")


def _prefix_pairs(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (centre, member) of different components among the sets of open_ that may be similar enough.

    Shingles are ranked from rare to common by their counts over all these sets. Of two linked
    sets of sizes m <= n the intersection is at least w = percent / (100 + percent) * (m + n).
    So a common shingle is among the first m - 2 * percent / (100 + percent) * m + 1 of the
    smaller and the first n - percent / 100 * n + 1 of the larger, and neither has fewer than w
    shingles from the first common one on. What all of a family share stands late in its sets, so the
    smaller's short prefix holds it only where it leaves too little to tell them apart.
    """
    opened = small(materialize(open_.select("cls", "component").distinct(), "opened"), 16)
    each = sets.select("cls", "shingles").join(opened.select("cls"), "cls").select("cls", F.explode("shingles").alias("token"))
    often = materialize(each.groupBy("token").agg(F.count("*").alias("often")).where("often > 1"), "often")
    ranked = each.join(small(often, 16), "token", "left").select("cls", F.struct(F.coalesce("often", F.lit(1)).alias("often"), "token").alias("x"))
    ranked = ranked.groupBy("cls").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    n = F.size("xs").cast("long")
    long_, short = n - F.ceil(n * percent / 100) + 1, n - F.ceil(2 * n * percent / (100 + percent)) + 1
    prefixes = ranked.select("cls", short.alias("short"), F.posexplode(F.slice("xs", F.lit(1), long_.cast("int"))).alias("at", "x")).select("cls", "short", "at", "x.token")
    sizes = sets.select("cls", "n").join(opened, "cls")
    each = materialize(prefixes.join(sizes, "cls"), "prefixes")
    columns = ["cls", "component", "n", "at"]
    less = each.where("at < short").select("token", *(F.col(c).alias(f"{c}_s") for c in columns))
    more = each.select(F.col("token").alias("other"), *(F.col(c).alias(f"{c}_l") for c in columns))
    order = (F.col("n_s") < F.col("n_l")) | ((F.col("n_s") == F.col("n_l")) & (F.col("cls_s") < F.col("cls_l")))
    room = (100 + percent) * F.least(F.col("n_s") - F.col("at_s"), F.col("n_l") - F.col("at_l")) >= percent * (F.col("n_s") + F.col("n_l"))
    apart = F.col("component_s") != F.col("component_l")
    near = 100 * F.col("n_s") >= percent * F.col("n_l")
    joined = less.join(more, (F.col("token") == F.col("other")) & apart & near & order & room)
    return joined.select(F.col("cls_s").alias("centre"), F.col("cls_l").alias("member"))


def _grouped(docs: DataFrame, percent: int, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, sha, n_shingles, component_id) for every row; sha tells its text."""
    lean_batches(docs.sparkSession)
    text = F.col(text_col)
    own = docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)).alias("sha"), text.alias("text"))
    sketches = materialize(own.mapInArrow(_sketcher(bands, rows), "doc_id long, sha binary, n_shingles long, low long, high long, bands array<long>"), "sketches")
    # Equal sets are one class from here on, with a number of its own; the row with the least id stands for it.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id", "sha")).alias("rep")
    same = ["low", "high", "n_shingles"]
    classes = sketches.where("n_shingles > 0").groupBy(*same).agg(first, F.count("*").alias("size"))
    classes = materialize(classes.select(*same, "rep.doc_id", "rep.sha", "size", F.monotonically_increasing_id().alias("cls")), "classes")
    exploded = sketches.where("n_shingles > 0").select(*same, F.explode("bands").alias("key"))
    shared = exploded.groupBy("key").agg(F.min("low").alias("a"), F.max("low").alias("b"), F.min("high").alias("c"), F.max("high").alias("d")).where("a != b or c != d").select("key")
    buckets = exploded.join(shared, "key").distinct().join(classes.select(*same, "cls"), same)
    buckets = materialize(buckets.select("key", "cls"), "buckets")
    members = materialize(buckets.select("cls").distinct().join(classes.select("cls", F.col("doc_id").alias("rep_id"), F.col("sha").alias("rep_sha")), "cls"), "members")
    texts = own.join(small(members, 64), F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.col("sha") == F.col("rep_sha"))).select("cls", "text")
    sets = texts.dropDuplicates(["cls"]).mapInArrow(_sets, "cls long, n long, shingles array<long>, " + ", ".join(f"{x} long" for x in _BITS))
    sets = materialize(sets, "sets")

    labels, links, tested = None, None, None
    open_ = buckets.select("key", "cls", F.col("cls").alias("component"))
    for t in range(STAR_ROUNDS + 1):
        if labels is not None:
            open_ = buckets.join(small(labels, 16), "cls", "left").select("key", "cls", F.coalesce("component", "cls").alias("component"))
            split = open_.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
            open_ = materialize(open_.join(split, "key", "left_semi"), "open")
        if t < STAR_ROUNDS:
            mask = F.lit(0x5DEECE66D1234567 * (t + 1) % (1 << 63))
            mixed = F.xxhash64(F.col("cls").bitwiseXOR(mask))
            centres = open_.groupBy("key").agg(F.min(F.struct(mixed.alias("order"), F.col("cls").alias("centre")))["centre"].alias("centre"))
            pairs = open_.join(centres, "key").select("centre", F.col("cls").alias("member")).where("centre != member")
        else:
            pairs = _prefix_pairs(open_, sets, percent)
        pairs = pairs.distinct()
        if tested is not None:
            turned = tested.select(F.col("member").alias("centre"), F.col("centre").alias("member"))
            pairs = pairs.join(tested.unionByName(turned), ["centre", "member"], "left_anti")
        pairs = materialize(pairs, "pairs")
        if pairs.isEmpty():
            continue
        found = materialize(_verified(pairs, sets, percent), "links")
        tested = pairs if tested is None else tested.unionByName(pairs)
        links = found if links is None else links.unionByName(found)
        labels = connected_components(links).select(F.col("node").alias("cls"), "component")
        labels = materialize(labels, "labels")

    named = classes.select("low", "high", "n_shingles", "doc_id", "size", "cls")
    if labels is not None:
        parts = named.join(small(labels, 16), "cls")
        ids = materialize(parts.groupBy("component").agg(F.min("doc_id").alias("component_id")), "component-ids")
        linked = materialize(parts.select("cls", "component").join(small(ids, 16), "component").select("cls", "component_id"), "linked")
        named = named.join(small(linked, 16), "cls", "left")
        named = named.where("size > 1 or component_id is not null").select("low", "high", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    else:
        named = named.where("size > 1").select("low", "high", "n_shingles", F.col("doc_id").alias("component_id"))
    out = sketches.drop("bands").join(small(materialize(named, "named"), 32), ["low", "high", "n_shingles"], "left")
    return out.select("doc_id", "sha", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def near_duplicates(
    docs: DataFrame, percent: int = 85, bands: int = BANDS, rows: int = BAND_ROWS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row.

    Words are runs of non-white-space (ASCII), A-Z lower-cased; a set holds the distinct
    five-word shingles, or the whole sequence of a shorter text. Texts that are null or
    without words have an empty set and link with nothing. Documents link when
    100 * intersection >= percent * union; component_id is the least id reachable. Rows that
    share an id, or have none, are each judged by their own text; a component without any
    id has a null component_id and all its rows stay. An empty table gives no rows.
    """
    out = _grouped(docs, percent, bands, rows, id_col, text_col)
    return out.select("doc_id", "n_shingles", "component_id", F.col("component_id").eqNullSafe(F.col("doc_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, percent: int = 85, bands: int = BANDS, rows: int = BAND_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the document of the least id of each component, all columns kept; rows that share that
    id all stay. A row goes by its id and its text; see near_duplicates for rows without an id."""
    grouped = _grouped(docs, percent, bands, rows, id_col, text_col)
    gone = grouped.where(~F.col("component_id").eqNullSafe(F.col("doc_id"))).select(F.col("doc_id").alias("gone_id"), F.col("sha").alias("gone_sha"))
    gone = small(materialize(gone.distinct(), "near"), 48)
    sha = F.unhex(F.sha2(F.coalesce(docs[text_col], F.lit("")), 256))
    return docs.join(gone, docs[id_col].eqNullSafe(gone["gone_id"]) & (sha == gone["gone_sha"]), "left_anti")


ORACLE = rf"""
    WITH RECURSIVE d AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
        FROM documents),
    s AS (
        SELECT DISTINCT doc_id, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS shingle
        FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - {SHINGLE - 1}))) AS i FROM d WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL),
    links AS (
        SELECT a, b FROM pairs JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id
        WHERE 100 * common >= 85 * (na.n + nb.n - common)),
    reach(doc_id, other) AS (
        SELECT DISTINCT a, a FROM links UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.other = links.a),
    least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(least.component_id, d.doc_id) AS component_id,
           coalesce(least.component_id, d.doc_id) = d.doc_id AS kept
    FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN least ON d.doc_id = least.doc_id"""
