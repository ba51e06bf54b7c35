"""Texts in compressed chunks: one row for some megabytes of text, so that a text moves once and small.

A chunk is a written row, so its base and the places in it stay the same in every later pass.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, pieces, written

CHUNK_DOCS = (1 << 16) - 1
#: Stands for a null id: after every other. A real id of this value is refused.
LAST = (1 << 63) - 1
CHUNK = "base long, bytes long, ids binary, sizes binary, source binary, body binary"


def chunk_bytes(spark: SparkSession) -> int:
    """Text of a chunk: 4 MB, and more (up to 64 MB) with many shuffle partitions, so that what a chunk sends to each stays a block worth sending."""
    return min(1 << 26, max(1 << 22, 640 * int(spark.conf.get("spark.sql.shuffle.partitions"))))


def _packed(most: int):
    return lambda batches: _chunks(batches, most)


def _chunks(batches, most: int):
    base, n = TaskContext.get().partitionId() << 33, 0
    ids: list[int] = []
    texts: list[bytes] = []
    held = 0

    def flush():
        nonlocal n
        order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
        seen: dict[bytes, int] = {}
        source, own = [], []
        for place, i in enumerate(order):
            if texts[i] not in seen:
                seen[texts[i]] = place
                own.append(texts[i])
            source.append(seen[texts[i]])
        start = base + n
        n += len(ids)
        ordered = np.array([ids[i] for i in order], np.int64)
        sizes = np.array([len(texts[i]) for i in order], np.int64)
        return pa.record_batch({
            "base": pa.array([start], pa.int64()), "bytes": pa.array([int(sizes.sum())], pa.int64()), "ids": [ordered.tobytes()], "sizes": [sizes.tobytes()],
            "source": [np.array(source, np.int32).tobytes()], "body": [zstandard.compress(b"".join(own), 3)],
        })

    for batch in pieces(batches):
        for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            data = (x or "").encode()
            if ids and (held + len(data) > most or len(ids) >= CHUNK_DOCS):
                yield flush()
                ids, texts, held = [], [], 0
            if i == LAST:
                raise ValueError(f"the id {LAST} stands for null here")
            ids.append(LAST if i is None else i)
            texts.append(data)
            held += len(data)
    if ids:
        yield flush()


#: Hashes of one range, about: with three bytes of each kept, few meet by chance, and a range is small work.
RANGE_LOAD = 1 << 19


def hash_ranges(chunks: DataFrame, bytes_per_hash: int) -> int:
    """Hash ranges of an exchange between chunks: as many as keep a range near ``RANGE_LOAD`` whatever the input, and several a
    shuffle partition."""
    n = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = chunks.agg(F.sum("bytes")).first()[0] or 0
    return max(4 * n, min(16 * n, 4096), total // (bytes_per_hash * RANGE_LOAD))


def chunked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Written rows ``base, bytes, ids, sizes, source, body``: a chunk's ids in order, its text sizes, the place of the
    copy that stands for each text, and the distinct texts compressed. Null ids are ``LAST``, null texts empty."""
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return written(texts.mapInArrow(_packed(chunk_bytes(docs.sparkSession)), CHUNK), "chunks")


class Chunk:
    """A chunk opened: ``raw`` holds the distinct texts end to end, text j of place ``own[j]`` from ``starts[j]``."""

    def __init__(self, row: dict):
        self.base = row["base"]
        self.ids, self.sizes = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["sizes"], np.int64)
        self.source = np.frombuffer(row["source"], np.int32)
        self.own = np.flatnonzero(self.source == np.arange(len(self.source)))
        self.raw = np.frombuffer(zstandard.decompress(row["body"]), np.uint8)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes[self.own])]).astype(np.int64)

    def texts(self) -> list[bytes]:
        return [self.raw[a:b].tobytes() for a, b in zip(self.starts[:-1].tolist(), self.starts[1:].tolist(), strict=True)]
