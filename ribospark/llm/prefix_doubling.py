"""Repeated byte strings by prefix doubling over all positions, as the method is named.

Every position begins with the rank of its first eight bytes. A round pairs the rank at a position
with the rank at a growing offset, sorts the pairs, and reranks: the new rank is the least position
that has the pair. Positions whose string one document alone has are unique and leave. Rounds end
when strings are as long as asked for, or no position is left.

``suffix_dedup`` gives the same rows with a small part of the shuffle; the README has the figures.
This form is kept as the plain statement of the method, and to hold the other against.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, join_hot, pieces, written
from .suffix_dedup import LAST, removed_rows

#: Bits of a place that count the bytes of one text.
POSITION_BITS = 31


def _first_ranks(width: int):
    def ranks(batches):
        for batch in pieces(batches, 100):
            for rid, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = np.frombuffer((text or "").encode(), np.uint8)
                n = len(raw) - width + 1
                for a in range(0, max(n, 0), 1 << 18):
                    b = min(n, a + (1 << 18))
                    rank = np.zeros(b - a, np.uint64)
                    for j in range(width):
                        rank = (rank << np.uint64(8)) | raw[a + j : b + j].astype(np.uint64)
                    place = (rid << POSITION_BITS) + np.arange(a, b, dtype=np.int64)
                    yield pa.record_batch({"place": place, "doc": np.full(b - a, LAST if doc is None else doc, np.int64), "a": rank.view(np.int64), "b": np.zeros(b - a, np.int64)})

    return ranks


def _reranked(pairs: DataFrame, total: int) -> DataFrame:
    """``place, doc, rank, least`` of the pairs that several documents have: the least place and document of each pair."""
    key = F.xxhash64("a", "b").alias("h")
    groups = pairs.groupBy("a", "b").agg(F.min("place").alias("rank"), F.min("doc").alias("least"), F.max("doc").alias("most"), F.count("*").alias("n")).where("least < most")
    groups = written(groups.select(key, F.col("a").alias("ga"), F.col("b").alias("gb"), "rank", "least", "n"), "groups")
    rows = join_hot(pairs.withColumn("h", key), groups, "h", "n", total, "place").where("a = ga AND b = gb")
    out = written(rows.select("place", "doc", "rank", "least"), "ranks")
    discard(groups)
    return out


def repeats_by_doubling(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``remove_repeats``, with the same rules for nulls, repeated ids and ties; a text holds less than 2 GB."""
    if length < 4:
        raise ValueError("length must be at least 4 bytes")
    texts = written(docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")), "texts")
    number = F.row_number().over(Window.partitionBy("part").orderBy("rid")) - 1  # rows of a partition, numbered without gaps
    texts = written(texts.withColumn("part", F.shiftrightunsigned("rid", 33)).withColumn("at", number), "numbered")
    size = texts.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a partition
    texts = written(texts.join(size.select("part", before.alias("start")), "part").select((F.col("start") + F.col("at")).alias("rid"), "doc", "text"), "texts")
    width = min(8, length)
    pairs = texts.mapInArrow(_first_ranks(width), "place long, doc long, a long, b long")
    total = int(texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])
    now = _reranked(pairs, total)
    while width < length:
        step = min(width, length - width)
        ahead = now.select((F.col("place") - step).alias("place"), F.col("rank").alias("b"))
        after = _reranked(now.select("place", "doc", F.col("rank").alias("a")).join(ahead, "place"), total)
        discard(now)
        now, width = after, width + step
    starts = now.where("doc > least").select(F.shiftrightunsigned("place", POSITION_BITS).alias("rid"), F.col("place").bitwiseAND((1 << POSITION_BITS) - 1).alias("at"))
    gone = starts.groupBy("rid").agg(F.array_sort(F.collect_list("at")).alias("starts"))
    return removed_rows(texts.join(gone, "rid", "left").select("doc", "text", "starts"), length)
