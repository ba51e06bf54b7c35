"""Exact deduplication by counting quotient filters, with byte verification.

Each task builds counting quotient filters of the 64-bit fingerprints of its rows, one for each
block of fingerprints (their highest bits). The next bits, the quotient, name a slot; the rest,
the remainder, is stored packed, in a run sorted by remainder. Filters of a block merge without
loss, whatever their sizes: their sorted fingerprints are merged and counters added.
Fingerprints counted once are settled; the others route their texts to a comparison of whole bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lowered, materialize, written

#: Share of the slots that a new filter fills at most.
LOAD = 0.75


def _bits(values: np.ndarray, width: int) -> np.ndarray:
    """The low ``width`` bits of each value, highest first, packed without gaps."""
    wide = values.astype(">u8").view(np.uint8).reshape(-1, 8)
    return np.packbits(np.unpackbits(wide, axis=1)[:, 64 - width :])


def _values(packed: np.ndarray, width: int, n: int) -> np.ndarray:
    bits = np.unpackbits(packed, count=n * width).reshape(n, width)
    wide = np.zeros((n, 64), np.uint8)
    wide[:, 64 - width :] = bits
    return np.packbits(wide, axis=1).view(">u8").ravel().astype(np.uint64)


class CountingQuotientFilter:
    """Slots in linear order, each with a remainder of ``remainder_bits`` and four marks.

    ``occupied``: a run has this slot as its quotient. ``continuation``: the slot goes on with the run before it.
    ``shifted``: its element is not in the slot of its quotient. ``counter``: it holds a digit, base ``2 ** remainder_bits``,
    of the counter (less one) of the remainder before it, lowest digit first; a remainder seen once has none.
    A slot without any mark is empty. Runs that are pushed past the last quotient use slots behind it.
    """

    MARKS = ("occupied", "continuation", "shifted", "counter")

    def __init__(self, quotient_bits: int, remainder_bits: int, marks: np.ndarray, remainders: np.ndarray):
        self.quotient_bits, self.remainder_bits, self.marks, self.remainders = quotient_bits, remainder_bits, marks, remainders

    @classmethod
    def of(cls, fingerprints: np.ndarray, counts: np.ndarray, bits: int) -> CountingQuotientFilter:
        """A filter of distinct sorted fingerprints of ``bits`` bits with their counts."""
        n = len(fingerprints)
        quotient_bits = min(bits - 1, max(1, int(np.ceil(np.log2(max(n, 1) / LOAD)))))
        width = bits - quotient_bits
        digits, left = np.ones(n, np.int64), counts.astype(np.uint64) - np.uint64(1)
        rest = left.copy()
        while rest.any():
            digits += rest > 0
            rest = rest >> np.uint64(width) if width < 64 else np.zeros_like(rest)
        first = np.cumsum(digits) - digits  # of each fingerprint, its place in the sequence of filled slots
        owner = np.repeat(np.arange(n), digits)
        digit = np.arange(len(owner)) - first[owner]
        mask = np.uint64((1 << width) - 1)
        content = np.where(digit == 0, fingerprints[owner], left[owner] >> (np.maximum(digit - 1, 0) * width).astype(np.uint64)) & mask
        quotient = (fingerprints >> np.uint64(width)).astype(np.int64)[owner]
        # An element goes to the slot of its quotient, or the next free one behind all before it.
        at = np.arange(len(owner))
        slot = np.maximum.accumulate(quotient - at) + at if n else at
        size = max(1 << quotient_bits, int(slot[-1]) + 1 if n else 0)
        marks, remainders = np.zeros((4, size), bool), np.zeros(size, np.uint64)
        marks[0][quotient] = True
        marks[1][slot] = np.concatenate([[False], quotient[1:] == quotient[:-1]]) if n else False
        marks[2][slot] = slot != quotient
        marks[3][slot] = digit > 0
        remainders[slot] = content
        return cls(quotient_bits, width, marks, remainders)

    @classmethod
    def build(cls, fingerprints: np.ndarray, bits: int = 64) -> CountingQuotientFilter:
        found, counts = np.unique(fingerprints.astype(np.uint64), return_counts=True)
        return cls.of(found, counts, bits)

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted fingerprints and their counts, read from the slots alone."""
        occupied, continuation, shifted, counter = self.marks
        used = np.flatnonzero(occupied | continuation | shifted)
        starts = ~continuation[used]
        quotient = np.flatnonzero(occupied)[np.cumsum(starts) - 1].astype(np.uint64)  # runs lie in the order of their quotients
        content, digit = self.remainders[used], counter[used]
        own = np.flatnonzero(~digit)
        place = np.arange(len(used)) - own[np.cumsum(~digit) - 1] - 1
        value = np.where(digit, content << (np.maximum(place, 0) * self.remainder_bits).astype(np.uint64), np.uint64(0))
        counts = np.add.reduceat(value, own) + np.uint64(1) if len(own) else np.zeros(0, np.uint64)
        return (quotient[own] << np.uint64(self.remainder_bits)) | content[own], counts.astype(np.int64)

    def count(self, fingerprint: int) -> int:
        """How often one fingerprint was added, by a walk along its cluster."""
        occupied, continuation, shifted, counter = self.marks
        quotient, remainder = fingerprint >> self.remainder_bits, fingerprint & ((1 << self.remainder_bits) - 1)
        if quotient >= len(occupied) or not occupied[quotient]:
            return 0
        start = quotient
        while shifted[start]:
            start -= 1
        at = start
        for _ in range(int(occupied[start:quotient].sum())):  # runs of smaller quotients in the cluster
            at += 1
            while at < len(continuation) and continuation[at]:
                at += 1
        while True:
            n, width, here = 0, 0, int(self.remainders[at])
            at += 1
            while at < len(counter) and counter[at]:
                n |= int(self.remainders[at]) << width
                at, width = at + 1, width + self.remainder_bits
            if here == remainder:
                return n + 1
            if here > remainder or at >= len(continuation) or not continuation[at]:
                return 0

    def to_bytes(self) -> bytes:
        head = np.array([self.quotient_bits, self.remainder_bits, len(self.remainders)], "<i8")
        return head.tobytes() + np.packbits(self.marks).tobytes() + _bits(self.remainders, self.remainder_bits).tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CountingQuotientFilter:
        quotient_bits, width, size = np.frombuffer(data, "<i8", 3).tolist()
        n = -(-4 * size // 8)
        marks = np.unpackbits(np.frombuffer(data, np.uint8, n, 24), count=4 * size).reshape(4, size).astype(bool)
        return cls(quotient_bits, width, marks, _values(np.frombuffer(data, np.uint8, -1, 24 + n), width, size))

    @classmethod
    def merge(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        """One filter of all: sorted fingerprints merged, counters added. All must have fingerprints of the same width."""
        if len({f.quotient_bits + f.remainder_bits for f in filters}) != 1:
            raise ValueError("filters of different fingerprints don't merge")
        parts = [f.entries() for f in filters]
        found, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.argsort(found, kind="stable")  # merges the sorted runs
        found, counts = found[order], counts[order]
        starts = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])) if len(found) else np.zeros(0, np.int64)
        return cls.of(found[starts], np.add.reduceat(counts, starts) if len(starts) else counts, filters[0].quotient_bits + filters[0].remainder_bits)


def _filters(block_bits: int, most: int = 1 << 20):
    """A filter for each block of a task's fingerprints: ``block, filter``."""

    def build(batches):
        held, n = [], 0

        def flush():
            found, counts = np.unique(np.concatenate(held).view(np.uint64), return_counts=True)
            block = (found >> np.uint64(64 - block_bits)).astype(np.int64)
            own = found & np.uint64((1 << (64 - block_bits)) - 1)
            starts = np.flatnonzero(np.diff(block, prepend=-1))
            for i in range(0, len(starts), 256):
                some = range(i, min(i + 256, len(starts)))
                ends = [*starts[1:], len(block)]
                made = [CountingQuotientFilter.of(own[starts[j] : ends[j]], counts[starts[j] : ends[j]], 64 - block_bits).to_bytes() for j in some]
                yield pa.record_batch({"block": pa.array(block[starts[list(some)]], pa.int32()), "filter": pa.array(made, pa.binary())})

        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
            n += len(held[-1])
            if n >= most:
                yield from flush()
                held, n = [], 0
        if n:
            yield from flush()

    return build


def _merged(block_bits: int):
    def merge(table: pa.Table) -> pa.Table:
        """Of one block: the fingerprints that all filters together count more than once."""
        whole = CountingQuotientFilter.merge([CountingQuotientFilter.from_bytes(x) for x in table["filter"].to_pylist()])
        found, counts = whole.entries()
        high = np.uint64(table["block"][0].as_py() << (64 - block_bits))
        return pa.table({"fp": pa.array((found[counts > 1] | high).view(np.int64), pa.int64()), "n": pa.array(counts[counts > 1], pa.int64())})

    return merge


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bits: int | None = None) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts, however long, are equal when identical after lower-casing A-Z; a null text counts as empty and
    ``text_sha256`` is of the lower-cased UTF-8 bytes. Of equal texts the row with the largest id stays (null ids
    lose; of rows repeated under one id, one stays). An empty table gives an empty result. Other columns are
    ignored, whatever their names. Only texts whose fingerprint repeats are compared, folded in each task first.
    """
    spark = docs.sparkSession
    # Blocks grow with the shuffle partitions, so that one block's fingerprints stay small work.
    block_bits = block_bits or max(10, (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))).bit_length())
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), lowered(F.col(text_col)).alias("low"))
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("rid"), F.xxhash64("low").alias("fp"), F.sha2("low", 256).alias("text_sha256"))
    rows = materialize(rows, "rows")
    filters = rows.select("fp").mapInArrow(_filters(block_bits), "block int, filter binary")
    repeated = written(filters.groupBy("block").applyInArrow(_merged(block_bits), "fp long, n long").select("fp"), "repeated")
    texts = docs.select("low", F.xxhash64("low").alias("fp")).join(repeated, "fp").groupBy("fp", "low").agg(F.count("*").alias("n"))
    # A group of one fingerprint with two texts is a collision: each text is its own group, known by its digest.
    verified = texts.where("n > 1").select(F.sha2("low", 256).alias("text_sha256"), F.col("n").alias("group_size"))
    best = rows.join(repeated, "fp").groupBy("text_sha256").agg(F.max(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "rid")).alias("best"))
    groups = materialize(verified.join(best, "text_sha256").select("text_sha256", "group_size", F.col("best.doc_id").alias("keep"), F.col("best.rid").alias("keep_rid")), "groups")
    alone = F.col("keep_rid").isNull()
    return rows.join(groups, "text_sha256", "left").select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("rid") == F.col("keep_rid"))).alias("kept"), "text_sha256",
    )
