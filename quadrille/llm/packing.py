"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Bulk-synchronous best fit. Pieces are range-sorted by length and sequences with room by their
gap. In a superstep every piece of a band of lengths looks for its successor, the least gap that
holds it, longest first: prefix sums over the size classes give each piece and each slot of a gap a
depth, and equal depths meet in a shuffle. Conflicts within a class are settled by rank, so
lower ranks are placed first and the rest wait. Then gaps are updated, and the next superstep
begins. Lengths and gaps are whole numbers up to the capacity, so the table of classes has
at most `capacity` rows at any scale; pieces and sequences stay distributed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quadrille.llm.common import lean_batches, materialize, small, spread

CAPACITY = 2048
TOKENIZER = "byte_bpe_50k.json"
#: Rows for each partition of the packing tables, which are a few numbers wide.
ROWS = 200_000
#: Rows of one size class that are ranked together.
RANK_ROWS = 20_000


# --- tokens -----------------------------------------------------------------------------

def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Ids:
    """Token ids as the tokenizers library gives them for a byte-level BPE file.

    The file's own vocabulary and merges are also loaded as ranks into tiktoken, which is
    several times faster and agrees on them; texts with characters outside a plain set, on
    which the two libraries' Unicode tables might differ, go through tokenizers itself.
    """

    PLAIN = "[\\x09\\x0A\\x0D\\x20-\\x7E\\u00A1-\\u00AC\\u00AE-\\u0233\\u2013\\u2014\\u2018-\\u201D\\u2026\\u20AC]*"

    def __init__(self, path: str):
        import json
        import re

        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.special = [t["content"] for t in model["added_tokens"]]
        back = _byte_alphabet()
        special = set(self.special)
        ranks = {bytes(back[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.plain = re.compile(self.PLAIN).fullmatch

    @cached_property
    def slow(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def __call__(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special) or not (text.isascii() or self.plain(text)):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4")
        return np.array(self.fast.encode_ordinary(text), "<u4")


@lru_cache(1)
def _ids(path: str) -> Ids:
    """Loaded once by each Python worker, not by each task."""
    return Ids(path)


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level BPE: printable bytes stand for themselves, others follow from 256."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in keep}
    out |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(keep))}
    return out


_PIECES = "doc_id long, copy long, piece int, start long, length long, ids_crc32 long"


def _pieces(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = _ids(path)
        for batch in batches:
            cols: list[list] = [[], [], [], [], [], []]
            docs, copies = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for doc_id, copy, text in zip(docs, copies, batch.column(2)):
                ids = np.append(ids_of(text.as_py() or ""), np.uint32(0)).astype("<u4")
                first = (len(ids) - 1) % capacity + 1
                bounds = [0, *range(first, len(ids) + 1, capacity)]
                for i in range(len(bounds) - 1):
                    row = (doc_id, copy, i, bounds[i], bounds[i + 1] - bounds[i], zlib.crc32(ids[bounds[i] : bounds[i + 1]].tobytes()))
                    for c, v in zip(cols, row):
                        c.append(v)
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "copy", "piece", "start", "length", "ids_crc32"])

    return run


def tokenised_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: ids of the document, then id 0; only longer documents are cut.

    All pieces but the first have `capacity` tokens; the first holds the remainder. A null
    or empty text has the one id 0. `copy` tells rows with one id apart.
    """
    lean_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("copy"), F.col(text_col).alias("text"))
    return own.mapInArrow(_pieces(path or tokenizer_path(), capacity), _PIECES)


# --- packing ----------------------------------------------------------------------------

def ranked(rows: DataFrame, size: str, total: int, tie: list[str]) -> DataFrame:
    """rows with `rank`, counted from 0 within each value of `size`, without meeting in one task.

    A class is cut into chunks by a hash of the tie-break; chunks are counted, and a row's
    rank is its chunk's start plus its place within the chunk.
    """
    chunks = spread(total, RANK_ROWS)
    cut = rows.withColumn("chunk", F.pmod(F.xxhash64(*tie), F.lit(chunks)))
    place = F.row_number().over(W.partitionBy(size, "chunk").orderBy(*tie)) - 1
    if chunks == 1:
        return cut.withColumn("rank", place.cast("long")).drop("chunk")
    starts = cut.groupBy(size, "chunk").agg(F.count("*").alias("n"))
    before = W.partitionBy(size).orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    starts = materialize(starts.select(size, "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")), "ranks")
    return cut.withColumn("place", place).join(small(starts, 24), [size, "chunk"]).withColumn("rank", (F.col("first") + F.col("place")).cast("long")).drop("chunk", "place", "first")


def sweep(progress: DataFrame, gaps: DataFrame, low: int, high: int) -> DataFrame:
    """The successors of one superstep, by size class: at most `capacity` rows, whatever the input.

    From the largest size down, a gap opens slots and a piece of the band (low, high] takes the
    slot opened last, which is the least gap that holds it. So slots and pieces are brackets, and
    a bracket's partner is the next one at its depth. A gap has as many slots as it holds pieces
    of length `high`, one at the least. `base` is the depth before a class, `lowest` the
    least depth that later pieces reach: slots below it stay free. `take` pieces of the class,
    those of the lowest ranks left, are placed.
    """
    none = F.lit(0).cast("long")
    room = gaps.where(F.col("gap") > low).select(F.col("gap").alias("size"), none.alias("done"), none.alias("left"), F.lit(1).cast("long").alias("held"))
    waiting = progress.select(F.col("length").alias("size"), "done", "left", none.alias("held"))
    down = W.orderBy(F.desc("size"))
    each = F.greatest(F.lit(1), F.floor(F.col("size") / high)).cast("long")
    closes = F.when((F.col("size") > low) & (F.col("size") <= high), F.col("left")).otherwise(0)
    return (
        room.unionByName(waiting)
        .groupBy("size")
        .agg(*(F.sum(c).alias(c) for c in ("done", "left", "held")))
        .withColumns({"each": each, "opens": F.col("held") * each, "closes": closes})
        .withColumn("sum", F.sum(F.col("opens") - F.col("closes")).over(down.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("depth", F.col("sum") - F.least(F.lit(0), F.min("sum").over(down.rowsBetween(W.unboundedPreceding, 0))))
        .withColumns({"base": F.coalesce(F.lag("depth").over(down), F.lit(0)), "lowest": F.min("depth").over(down.rowsBetween(0, W.unboundedFollowing))})
        .withColumn("take", F.least(F.col("closes"), F.col("base") + F.col("opens")))
        .select("size", "done", "left", "held", "each", "opens", "closes", "base", "lowest", "take")
    )


def matches(queue: DataFrame, gaps: DataFrame, classes: DataFrame, held: int, capacity: int) -> DataFrame:
    """(piece_id, length, sequence_id, offset) of a superstep, by its written classes.

    A piece's depth follows from its rank within its length, a slot's from its sequence's rank
    within its gap. At one depth a class has one slot and one piece at most, so no task meets
    more than two rows a class for each depth.
    """
    used = F.col("lowest") < F.col("base") + F.col("opens")
    of = F.broadcast(classes.where("take > 0").select(F.col("size").alias("length"), "done", "take", (F.col("base") + F.col("opens") - 1).alias("top")))
    pieces = queue.join(of, "length").where("rank >= done AND rank < done + take")
    none = F.lit(None).cast("struct<sequence_id: long, gap: long, slot: long>")
    pieces = pieces.select((F.col("top") - F.col("rank") + F.col("done")).alias("depth"), F.col("length").alias("size"), F.lit(1).alias("kind"), "piece_id", none.alias("at"))
    by = F.broadcast(classes.where(used).select(F.col("size").alias("gap"), "each", "base", "lowest"))
    ranks = ranked(gaps.join(by, "gap"), "gap", held, ["sequence_id"])
    slots = ranks.withColumn("first", F.col("base") + F.col("rank") * F.col("each")).where("lowest < first + each")
    slots = slots.withColumn("slot", F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), F.col("lowest") - F.col("first")), F.col("each") - 1)))
    at = F.struct("sequence_id", F.col("gap").cast("long").alias("gap"), "slot")
    slots = slots.select((F.col("first") + F.col("slot")).alias("depth"), F.col("gap").cast("long").alias("size"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("piece_id"), at.alias("at"))
    pairs = slots.unionByName(pieces).withColumn("at", F.lag("at").over(W.partitionBy("depth").orderBy(F.desc("size"), "kind"))).where("kind = 1")
    before = F.coalesce(F.sum("length").over(W.partitionBy("sequence_id").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return pairs.select("piece_id", F.col("size").alias("length"), "at.*").select("piece_id", "length", "sequence_id", (capacity - F.col("gap") + before).alias("offset"))


def bands(capacity: int) -> list[tuple[int, int]]:
    """Bands of lengths (above, up to), each 0.7 of the one before, and half of it where lengths are short."""
    edges = [capacity]
    while edges[-1] > 0:
        edges.append(edges[-1] * 7 // 10 if edges[-1] > capacity // 16 else edges[-1] // 2)
    return list(zip(edges[1:], edges[:-1]))


def best_fit(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """piece_id, sequence_id and offset of pieces (a written table with piece_id and length).

    Pieces of the full capacity fill a sequence each. The others are placed from the longest
    band of lengths to the shortest; a band is done when all its pieces are placed. When no gap
    holds any piece of a band, as many sequences are opened as the remaining tokens need at the
    least; an unused one has the gap of the whole capacity. The driver sees a few sums of a
    superstep, no sizes.
    """
    spark = pieces.sparkSession
    full = pieces.where(F.col("length") == capacity).select("piece_id", (-1 - F.col("piece_id")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.where(F.col("length") < capacity).select("piece_id", "length")
    progress = materialize(rest.groupBy("length").agg(F.lit(0).cast("long").alias("done"), F.count("*").alias("left")).coalesce(1), "progress")
    parts = bands(capacity)
    sums = progress.agg(*(F.coalesce(F.sum(F.when((F.col("length") > low) & (F.col("length") <= high), F.col("left"))), F.lit(0)) for low, high in parts)).first()
    total = sum(sums)
    few = spread(total, ROWS)
    # Range-sorted once: a piece's rank within its length never changes, and lower ranks go first.
    queue = materialize(ranked(rest, "length", total, ["piece_id"]).repartitionByRange(few, "length", "rank"), "queue")
    gaps, opened, out = spark.createDataFrame([], "sequence_id long, gap long"), 0, full
    for (low, high), waiting in zip(parts, sums):
        band = queue.where((F.col("length") > low) & (F.col("length") <= high))
        while waiting:
            classes = materialize(sweep(progress, gaps, low, high).coalesce(1), "classes")
            used = F.col("lowest") < F.col("base") + F.col("opens")
            now = classes.agg(
                F.sum("take").alias("take"),
                F.sum(F.when(used, F.col("held"))).alias("held"),
                F.sum(F.col("size") * F.col("left")).alias("tokens"),
                F.sum(F.when(2 * F.col("size") > capacity, F.col("closes"))).alias("alone"),
            ).first()
            if not now["take"]:
                reserve = max(spread(now["tokens"], capacity), now["alone"] or 0)
                fresh = spark.range(opened, opened + reserve, 1, spread(reserve, ROWS)).select(F.col("id").alias("sequence_id"), F.lit(capacity).cast("long").alias("gap"))
                gaps, opened = gaps.unionByName(fresh), opened + reserve
                continue
            step = materialize(matches(band, gaps, classes, now["held"], capacity).coalesce(few), "placed")
            out = out.unionByName(step.select("piece_id", "sequence_id", "offset"))
            after = step.select("sequence_id", (F.lit(capacity) - F.col("offset") - F.col("length")).alias("gap"))
            gaps = gaps.unionByName(after).groupBy("sequence_id").agg(F.min("gap").alias("gap"))  # gaps only shrink
            gaps = materialize(gaps.where("gap > 0").coalesce(few), "gaps")
            progress = classes.select(F.col("size").alias("length"), (F.col("done") + F.col("take")).alias("done"), (F.col("left") - F.col("take")).alias("left")).where("done + left > 0")
            waiting -= now["take"]
    return out


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset, copy) for every piece of every row.

    Every token of every text lies in exactly one piece. Sequences are gapless from offset 0
    and hold at most `capacity` tokens. Rows that repeat an id are told apart by `copy`. An
    empty table gives no rows; other columns are ignored.
    """
    pieces = materialize(
        tokenised_pieces(docs, path, capacity, id_col, text_col), "tokens"
    )
    pieces = materialize(pieces.withColumn("piece_id", F.monotonically_increasing_id()), "pieces")
    where = best_fit(pieces, capacity)
    return pieces.join(where, "piece_id").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "copy")
