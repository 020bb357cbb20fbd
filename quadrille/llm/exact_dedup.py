"""Exact duplicates by counting quotient filters.

Every partition of fingerprints becomes one filter for each block of quotients: a sorted run
of remainders with counts. Filters of a block merge without loss, as a merge of sorted
remainders that adds counts. Fingerprints that count more than one only route their texts to
verification, which groups whole texts byte by byte; the filter alone decides nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import SPACE, materialize, small, spread

#: Distinct fingerprints that a block of the merged filter holds on average.
BLOCK_ENTRIES = 50_000


class CountingQuotientFilter:
    """A block of quotients: per slot a remainder and its count, sorted within each quotient's run.

    run_ends[i] is the number of slots up to and including quotient i, so quotient i owns
    slots run_ends[i-1]:run_ends[i]; a fingerprint is (quotient << remainder_bits) | remainder.
    """

    def __init__(self, quotient_bits: int, run_ends: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.quotient_bits, self.run_ends, self.remainders, self.counts = quotient_bits, run_ends, remainders, counts

    @classmethod
    def build(cls, fingerprints: np.ndarray, counts: np.ndarray | None, quotient_bits: int) -> CountingQuotientFilter:
        values, at = np.unique(fingerprints.astype(np.uint64), return_inverse=True)
        n = np.bincount(at, weights=counts, minlength=len(values)).astype(np.int64) if len(values) else np.zeros(0, np.int64)
        shift = np.uint64(64 - quotient_bits)
        quotients = (values >> shift).astype(np.int64) if quotient_bits else np.zeros(len(values), np.int64)
        run_ends = np.cumsum(np.bincount(quotients, minlength=1 << quotient_bits)).astype(np.int32)
        remainders = values & np.uint64((1 << (64 - quotient_bits)) - 1)
        return cls(quotient_bits, run_ends, remainders, n)

    def _quotients(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.run_ends)), np.diff(self.run_ends, prepend=0))

    def fingerprints(self) -> np.ndarray:
        if not self.quotient_bits:
            return self.remainders
        return (self._quotients().astype(np.uint64) << np.uint64(64 - self.quotient_bits)) | self.remainders

    def count(self, fingerprint: int) -> int:
        q = fingerprint >> (64 - self.quotient_bits) if self.quotient_bits else 0
        lo, hi = (self.run_ends[q - 1] if q else 0), self.run_ends[q]
        remainder = np.uint64(fingerprint & ((1 << (64 - self.quotient_bits)) - 1))
        at = lo + np.searchsorted(self.remainders[lo:hi], remainder)
        return int(self.counts[at]) if at < hi and self.remainders[at] == remainder else 0

    def _with(self, other: CountingQuotientFilter) -> CountingQuotientFilter:
        """One pass over two filters of the same quotients: where each slot of `other` falls among
        the slots of this one; equal ones add their counts, the others are put in between."""
        mine, theirs = self.fingerprints(), other.fingerprints()
        at = np.searchsorted(mine, theirs)
        same = np.zeros(len(theirs), bool)
        inside = at < len(mine)
        same[inside] = mine[at[inside]] == theirs[inside]
        counts = self.counts.copy()
        counts[at[same]] += other.counts[same]
        new = ~same
        lengths = np.diff(self.run_ends, prepend=0) + np.bincount(other._quotients()[new], minlength=len(self.run_ends))
        return CountingQuotientFilter(
            self.quotient_bits,
            np.cumsum(lengths).astype(np.int32),
            np.insert(self.remainders, at[new], other.remainders[new]),
            np.insert(counts, at[new], other.counts[new]),
        )

    @classmethod
    def merge(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        """Filters merge in pairs, so that a slot is moved as often as the logarithm of their number."""
        while len(filters) > 1:
            filters = [a._with(b) for a, b in zip(filters[::2], filters[1::2])] + filters[len(filters) & ~1 :]
        return filters[0]

    def to_row(self) -> dict:
        """Remainders take the bytes that they need; counts, mostly one, take a byte, and those above
        254 follow in full."""
        width = -(-(64 - self.quotient_bits) // 8)
        packed = self.remainders.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
        large = self.counts > 254
        return {
            "run_ends": self.run_ends.tobytes(),
            "remainders": packed.tobytes(),
            "counts": np.where(large, 255, self.counts).astype(np.uint8).tobytes() + self.counts[large].astype("<i8").tobytes(),
        }

    @classmethod
    def from_row(cls, run_ends: bytes, remainders: bytes, counts: bytes) -> CountingQuotientFilter:
        ends = np.frombuffer(run_ends, np.int32)
        bits = (len(ends) - 1).bit_length()
        width, n = -(-(64 - bits) // 8), int(ends[-1])
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = np.frombuffer(remainders, np.uint8).reshape(n, width)
        own = np.frombuffer(counts, np.uint8, n).astype(np.int64)
        own[own == 255] = np.frombuffer(counts, "<i8", offset=n)
        return cls(bits, ends, wide.view("<u8").ravel().astype(np.uint64), own)


def _blocks_of_partition(block_bits: int, quotient_bits: int):
    """Within a block the leading bits are all equal, so the filter is built on what follows them."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b.column(0).to_numpy(zero_copy_only=False).view(np.uint64) for b in batches]
        if not held:
            return
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        blocks = (values >> np.uint64(64 - block_bits)).astype(np.int64) if block_bits else np.zeros(len(values), np.int64)
        edges = np.flatnonzero(np.diff(blocks, prepend=-1))
        for lo, hi in zip(edges, [*edges[1:], len(values)]):
            f = CountingQuotientFilter.build(values[lo:hi] << np.uint64(block_bits), counts[lo:hi], quotient_bits)
            yield pa.RecordBatch.from_pylist([{"block": int(blocks[lo])} | f.to_row()], _FILTER)

    return build


_FILTER = pa.schema([("block", pa.int64()), ("run_ends", pa.binary()), ("remainders", pa.binary()), ("counts", pa.binary())])
_FILTER_DDL = "block long, run_ends binary, remainders binary, counts binary"


def build_filter(fingerprints: DataFrame, rows: int) -> DataFrame:
    """One filter per block of a one-column table of 64-bit fingerprints: partition filters, merged.

    A fingerprint reaches the merge once from each partition, however many copies it has, so
    a hot one costs no more than any other.
    """
    block_bits = max(0, (spread(rows, BLOCK_ENTRIES) - 1).bit_length())
    quotient_bits = 8

    def merge(key: tuple[pa.Scalar, ...], groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged = None
        for batch in groups:
            filters = [CountingQuotientFilter.from_row(r["run_ends"], r["remainders"], r["counts"]) for r in batch.to_pylist()]
            merged = CountingQuotientFilter.merge(filters + ([merged] if merged else []))
        yield pa.RecordBatch.from_pylist([{"block": key[0].as_py()} | merged.to_row()], _FILTER)

    parts = fingerprints.mapInArrow(_blocks_of_partition(block_bits, quotient_bits), _FILTER_DDL)
    return parts.groupBy("block").applyInArrow(merge, _FILTER_DDL), block_bits


def repeated(filters: DataFrame, block_bits: int) -> DataFrame:
    """The fingerprints that a merged filter counts more than once: (fp, copies)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                f = CountingQuotientFilter.from_row(r["run_ends"], r["remainders"], r["counts"])
                own = f.counts > 1
                fp = f.fingerprints()[own] >> np.uint64(block_bits)
                if block_bits:
                    fp |= np.uint64(r["block"]) << np.uint64(64 - block_bits)
                yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.array(f.counts[own])], ["fp", "copies"])

    return filters.mapInArrow(scan, "fp long, copies long")


def normalised(text):
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row.

    Texts are equal when they are identical after each run of ASCII white space is replaced
    by one space; of equal texts the smallest id stays. A null text counts as empty; an empty
    table gives no rows; other columns are ignored. Rows without an id are counted and go if a
    copy has an id; copies of which none has one are all kept, with a null keep_id. Of rows
    that repeat an id, each is reported, and all that share the kept id and text are kept.
    """
    norm = normalised(F.col(text_col))
    keys = materialize(
        docs.select(F.col(id_col).alias("doc_id"), norm.alias("norm")).select(
            "doc_id", F.xxhash64("norm").alias("fp"), F.sha2("norm", 256).alias("text_sha256")
        ),
        "fingerprints",
    )
    filters, block_bits = build_filter(keys.select("fp"), keys.count())
    hot = materialize(repeated(filters, block_bits).select("fp"), "repeated")
    suspects = materialize(keys.join(small(hot, 8), "fp", "left_semi").select(F.col("doc_id").alias("suspect")).distinct(), "suspects")
    # Byte verification: whole texts are grouped; copies meet in the map-side aggregate first. A row
    # that only shares an id with a suspect, or like one has none, is a group of its own.
    groups = materialize(
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
        .join(small(suspects, 8), F.col("doc_id").eqNullSafe(F.col("suspect")), "left_semi")
        .groupBy(normalised(F.col("text")).alias("norm"))
        .agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .where("group_size > 1")
        .select(F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size"),
        "groups",
    )
    keep = F.coalesce("keep_id", "doc_id")
    return keys.join(small(groups, 100), "text_sha256", "left").select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        keep.eqNullSafe(F.col("doc_id")).alias("kept"),
        "text_sha256",
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the copies, all columns kept. A row goes by its id and its text, so rows that
    share an id with a copy stay; see exact_duplicates for rows without an id."""
    gone = exact_duplicates(docs, id_col, text_col).where("not kept").select(F.col("doc_id").alias("gone_id"), F.col("text_sha256").alias("gone_text")).distinct()
    gone = small(materialize(gone, "copies"), 100)
    same = docs[id_col].eqNullSafe(gone["gone_id"]) & (F.sha2(normalised(docs[text_col]), 256) == gone["gone_text"])
    return docs.join(gone, same, "left_anti")
