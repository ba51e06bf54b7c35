"""Repeated byte strings across documents, by one doubling over winnowed positions.

The plain method, prefix doubling over all positions, is ``prefix_doubling``; it gives the same
rows and shuffles far more (figures in the README), so this form stands in for it.

A rank is the name of the bytes that start at a position; a pair of ranks at an offset names
twice the length. Ranks are 64-bit names of content, so equal strings get equal ranks in
every task, and one round is a shuffle that sorts ranks by range.

Round one ranks strings of half the length, at the positions that winnowing selects: of every
string of the full length, the start of its least half-length rank (leftmost on ties). Equal
strings select the same offset, so nothing is lost. Ranks that one document alone has are
unique and leave. Round two doubles: around the positions left, every full-length string is
ranked by the pair of its half-length ranks at offset zero and at the rest, pairs are sorted
with their documents, and strings that an earlier document has cover their bytes.

Texts travel in chunks, compressed. Copies within a chunk are ranked once, and a text that an
earlier document has as a whole takes no part in round two: all its bytes go.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import LAST, Chunk, chunked, hash_ranges
from .common import discard, materialize, release, written
from .shingles import _table, mix


def half_ranks(raw: np.ndarray, k: int) -> np.ndarray:
    """The rank of the ``k`` bytes from each position."""
    if len(raw) < k:
        return np.zeros(0, np.uint64)
    up, down = _table(len(raw) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], dtype=np.uint64)])
        return mix((sums[k:] - sums[:-k]) * down[: len(raw) - k + 1])


def _sliding_least(values: np.ndarray, w: int) -> np.ndarray:
    n, length = len(values) - w + 1, 1
    least = values
    while length * 2 <= w:
        least = np.minimum(least[:-length], least[length:])
        length *= 2
    return np.minimum(least[:n], least[w - length : w - length + n]) if length < w else least[:n]


def selected(chunk: Chunk, length: int, ranges: int):
    """Of the chunk's full-length strings, grouped by the position they select: ``text, at, lo, hi`` (first and last start
    of the group), with ``range`` and ``residue`` of the selected rank; sorted by range."""
    k = (length + 1) // 2
    none = np.zeros(0, np.int64)
    if len(chunk.raw) < length:
        return none, none, none, none, none, none
    parts = []
    span = 1 << 20
    for a in range(0, len(chunk.raw) - length + 1, span):  # so that positions fit 24 bits, and memory stays small
        raw = chunk.raw[a : a + span + length - 1]
        ranks = half_ranks(raw, k)
        keys = (ranks & ~np.uint64(0xFFFFFF)) | np.arange(len(ranks), dtype=np.uint64)
        at = (_sliding_least(keys, length - k + 1) & np.uint64(0xFFFFFF)).astype(np.int64)
        start = np.arange(len(at)) + a
        text = np.searchsorted(chunk.starts, start, side="right") - 1
        inside = start + length <= chunk.starts[text + 1]
        start, at, text = start[inside], at[inside], text[inside]
        if not len(start):
            continue
        first = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(start, prepend=-2) != 1))
        last = np.append(first[1:], len(start)) - 1
        parts.append((text[first], at[first] + a, start[first], start[last], ranks[at[first]]))
    if not parts:
        return none, none, none, none, none, none
    text, at, lo, hi, rank = (np.concatenate(x) for x in zip(*parts, strict=True))
    rank = mix(rank)  # selected ranks are the least of their neighbours: mixed again, all their bits tell them apart
    where = ((rank & np.uint64((1 << 40) - 1)) % np.uint64(ranges)).astype(np.int64)
    # The same rank selected again and again in one text (a run of one letter) keeps its place in the order.
    order = np.argsort(where, kind="stable")
    return text[order], at[order], lo[order], hi[order], where[order], (rank[order] >> np.uint64(40)).astype(np.int64)


def _cuts(where: np.ndarray):
    first = np.flatnonzero(np.diff(where, prepend=-1))
    return list(zip(first, [*first[1:], len(where)], strict=True))


def _prints(batches):
    """128 bits of each distinct text of a chunk: ``base, place, id, h1, h2``."""
    for batch in batches:
        for row in batch.to_pylist():
            chunk = Chunk(row)
            sums = np.frombuffer(b"".join(hashlib.blake2b(x, digest_size=16).digest() for x in chunk.texts()), np.int64).reshape(-1, 2)
            yield pa.record_batch({"base": np.full(len(chunk.own), chunk.base), "place": chunk.own.astype(np.int32), "id": chunk.ids[chunk.own], "h1": np.ascontiguousarray(sums[:, 0]), "h2": np.ascontiguousarray(sums[:, 1])})


def later_copies(chunks: DataFrame) -> DataFrame:
    """``base, places``: of each chunk the distinct texts that a document with a smaller id, in any chunk, has as a whole."""
    prints = materialize(chunks.mapInArrow(_prints, "base long, place int, id long, h1 long, h2 long"), "prints")
    least = materialize(prints.groupBy("h1", "h2").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n"), "copies")
    later = prints.join(least, ["h1", "h2"]).where("id > least")
    return materialize(later.groupBy("base").agg(F.collect_list("place").alias("places")), "later")


def _sent(length: int, ranges: int):
    def send(batches):
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk(row)
                text, _, _, _, where, residue = selected(chunk, length, ranges)
                packed = residue.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]
                cuts = _cuts(where)
                for i in range(0, len(cuts), 256):
                    some = cuts[i : i + 256]
                    yield pa.record_batch({"range": pa.array([int(where[a]) for a, _ in some], pa.int32()), "base": pa.array([chunk.base] * len(some), pa.int64()), "residues": [np.ascontiguousarray(packed[a:b]).tobytes() for a, b in some], "texts": [text[a:b].astype(np.uint16).tobytes() for a, b in some]})

    return send


def _not_unique(table: pa.Table) -> pa.Table:
    """Of one range: for each chunk one bit a position, set where another document has the rank too."""
    residues = [np.frombuffer(x, np.uint8).reshape(-1, 3) for x in table["residues"].to_pylist()]
    wide = np.zeros((sum(map(len, residues)), 4), np.uint8)
    wide[:, :3] = np.concatenate(residues)
    value = wide.view("<u4").ravel().astype(np.uint64)
    doc = np.concatenate([np.frombuffer(x, np.uint16).astype(np.uint64) + np.uint64(i << 16) for i, x in enumerate(table["texts"].to_pylist())])
    pairs = np.sort((value << np.uint64(40)) | doc)
    head = pairs >> np.uint64(40)
    edge = np.flatnonzero((head[1:] == head[:-1]) & (pairs[1:] != pairs[:-1]))
    known = np.zeros(1 << 24, bool)
    known[head[edge].astype(np.int64)] = True
    bits = np.split(known[value.astype(np.int64)], np.cumsum([len(x) for x in residues])[:-1])
    return pa.table({"base": table["base"], "range": table["range"], "bits": pa.array([np.packbits(b).tobytes() for b in bits], pa.binary())})


def _copied(rows: pa.Table, n: int) -> np.ndarray:
    """Whether each place of a chunk is marked as a copy of an earlier document."""
    marked = np.zeros(n, bool)
    for places in rows["places"].to_pylist():
        if places is not None:
            marked[places] = True
    return marked


def _contexts(length: int, ranges: int):
    def contexts(chunks: pa.Table, bits: pa.Table) -> pa.Table:
        """Of one chunk: the bytes of the full-length strings around the positions left, for each range."""
        out: dict[str, list] = {"range": [], "base": [], "places": [], "bytes": []}
        for row in chunks.to_pylist():
            chunk = Chunk(row)
            text, _, lo, hi, where, _ = selected(chunk, length, ranges)
            marks = {r: b for r, b in zip(bits["range"].to_pylist(), bits["bits"].to_pylist(), strict=True) if b is not None}
            copied = _copied(bits, len(chunk.ids))[chunk.own]
            for a, b in _cuts(where):
                if not (mark := marks.get(int(where[a]))):
                    continue
                left = a + np.flatnonzero(np.unpackbits(np.frombuffer(mark, np.uint8), count=b - a))
                left = left[~copied[text[left]]]
                if not len(left):
                    continue
                places = np.stack([chunk.ids[chunk.own[text[left]]], chunk.own[text[left]], lo[left] - chunk.starts[text[left]], hi[left] - lo[left] + length])
                body = b"".join(chunk.raw[x : y + length].tobytes() for x, y in zip(lo[left].tolist(), hi[left].tolist(), strict=True))
                out["range"].append(int(where[a]))
                out["base"].append(chunk.base)
                out["places"].append(zstandard.compress(places.astype(np.int64).tobytes(), 3))
                out["bytes"].append(zstandard.compress(body, 3))
        return pa.table(out, schema=pa.schema([("range", pa.int32()), ("base", pa.int64()), ("places", pa.binary()), ("bytes", pa.binary())]))

    return contexts


def _ordered(raw: np.ndarray, where: np.ndarray, pair: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions by their rank pairs, and whether each begins a new string: neighbours of one pair are compared byte by byte.

    Where pairs of different strings collide, all are sorted by their bytes instead.
    """
    order = np.argsort(pair, kind="stable").astype(where.dtype)
    sorted_pair = pair[order]
    begins = np.ones(len(order), bool)
    begins[1:] = sorted_pair[1:] != sorted_pair[:-1]
    del sorted_pair
    words = np.lib.stride_tricks.as_strided(raw, (max(len(raw) - 7, 0), 8), (1, 1)) if len(raw) >= 8 else np.zeros((0, 8), np.uint8)
    parts = [*range(0, length - 7, 8), length - 8] if length >= 8 else []
    fine = True
    for a in range(0, len(order) - 1, 1 << 16):
        same = a + np.flatnonzero(~begins[a + 1 : a + 1 + (1 << 16)])
        x, y = where[order[same]].astype(np.int64), where[order[same + 1]].astype(np.int64)
        for at in parts:
            fine &= bool((words[x + at] == words[y + at]).all())
        for at in range(length) if not parts else ():
            fine &= bool((raw[x + at] == raw[y + at]).all())
    if not fine:
        rows = np.lib.stride_tricks.as_strided(raw, (len(raw) - length + 1, length), (1, 1))
        named = np.unique(np.ascontiguousarray(rows[where]).view(f"V{length}").ravel(), return_inverse=True)[1].ravel()
        order = np.argsort(named, kind="stable")
        return order, np.concatenate([[True], named[order][1:] != named[order][:-1]])
    return order, begins


def _doubled(length: int):
    k = (length + 1) // 2

    def covered(table: pa.Table) -> pa.Table:
        """Of one range: rank pairs sorted with their documents; for each chunk the stretches that an earlier document has."""
        places = [np.frombuffer(zstandard.decompress(x), np.int64).reshape(4, -1) for x in table["places"].to_pylist()]
        raw = np.frombuffer(b"".join(zstandard.decompress(x) for x in table["bytes"].to_pylist()), np.uint8)
        owner = np.repeat(np.arange(len(places)), [p.shape[1] for p in places])
        ids, doc, start, size = np.concatenate(places, axis=1)
        ranks = half_ranks(raw, k)
        offset = np.concatenate([[0], np.cumsum(size)[:-1]])
        n = size - length + 1
        short = np.int32 if len(raw) < 1 << 31 else np.int64  # half the memory while positions fit
        item = np.repeat(np.arange(len(n), dtype=short), n)
        at = (np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n)).astype(short)
        where = offset.astype(short)[item] + at
        with np.errstate(over="ignore"):
            pair = ranks[where] * np.uint64(3)
            pair += ranks[where + short(length - k)]
            del ranks
            pair = mix(pair)
        order, begins = _ordered(raw, where, pair, length)
        del pair, where
        first = np.flatnonzero(begins)
        of = ids[item[order]]
        least = np.minimum.reduceat(of, first) if len(first) else np.zeros(0, np.int64)
        earlier = np.zeros(len(order), bool)
        earlier[order] = np.repeat(least, np.diff(np.append(first, len(order)))) < of
        del order, of, least, begins
        hit = np.flatnonzero(earlier)
        begin = hit[(np.diff(hit, prepend=-2) != 1) | (at[hit] == 0)] if len(hit) else hit
        end = np.append(np.flatnonzero((np.diff(hit, prepend=-2) != 1) | (at[hit] == 0))[1:], len(hit)) - 1 if len(hit) else hit
        end = hit[end] if len(hit) else hit
        found = owner[item[begin]]
        out = {"base": [], "spans": []}
        for i, base in enumerate(table["base"].to_pylist()):
            of = found == i
            if of.any():
                b, e = begin[of], end[of]
                spans = np.stack([doc[item[b]], start[item[b]] + at[b], start[item[b]] + at[e] + length])
                out["base"].append(base)
                out["spans"].append(zstandard.compress(spans.astype(np.int64).tobytes(), 1))
        return pa.table(out, schema=pa.schema([("base", pa.int64()), ("spans", pa.binary())]))

    return covered


OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def _removed(length: int, with_kept: bool):
    def remove(chunks: pa.Table, spans: pa.Table) -> pa.Table:
        found = [np.frombuffer(zstandard.decompress(x), np.int64).reshape(3, -1) for x in spans["spans"].to_pylist() if x is not None]
        doc, begin, end = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
        rows = []
        for row in chunks.to_pylist():
            chunk = Chunk(row)
            text_of = np.full(len(chunk.ids), -1)
            text_of[chunk.own] = np.arange(len(chunk.own))
            shift = chunk.starts[text_of[doc]]
            change = np.zeros(len(chunk.raw) + 1, np.int64)
            np.add.at(change, begin + shift, 1)
            np.add.at(change, end + shift, -1)
            gone = np.cumsum(change[:-1]) > 0
            cache, copied = {}, _copied(spans, len(chunk.ids))
            for i, (doc_id, size, source) in enumerate(zip(chunk.ids.tolist(), chunk.sizes.tolist(), chunk.source.tolist(), strict=True)):
                if size >= length and (doc_id != chunk.ids[source] or copied[source]):
                    kept, n_spans = b"", 1  # a copy of an earlier document
                else:
                    if source not in cache:
                        a = chunk.starts[text_of[source]]
                        mine = gone[a : a + size]
                        own = doc_id == chunk.ids[source]
                        cache[source] = (chunk.raw[a : a + size][~mine].tobytes(), int((np.diff(mine.astype(np.int8), prepend=0) == 1).sum())) if own or size < length else None
                    kept, n_spans = cache[source]
                rows.append((None if doc_id == LAST else doc_id, size, size - len(kept), n_spans, hashlib.sha256(kept).hexdigest(), kept if with_kept else None))
        columns = list(zip(*rows, strict=True)) or [[]] * len(OUT)
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, OUT, strict=True)], schema=OUT)

    return remove


def removed_rows(rows: DataFrame, length: int) -> DataFrame:
    """The columns of ``remove_repeats`` for ``rows(doc, text, starts)``: ``starts`` are the places of the strings to remove."""

    def cut(batches):
        for batch in batches:
            out = []
            for doc, text, starts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = np.frombuffer((text or "").encode(), np.uint8)
                change = np.zeros(len(raw) + 1, np.int64)
                np.add.at(change, np.array(starts or [], np.int64), 1)
                np.add.at(change, np.array(starts or [], np.int64) + length, -1)
                gone = np.cumsum(change[:-1]) > 0
                kept = raw[~gone].tobytes()
                out.append((doc, len(raw), len(raw) - len(kept), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest(), kept))
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(list(zip(*out, strict=True)) or [[]] * len(OUT), OUT, strict=True)], schema=OUT)

    return rows.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def remove_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = False) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` (the bytes left, if asked for).

    Removed is each byte of the text's UTF-8 covered by a ``length``-byte string that also starts in a document with a
    smaller id; strings are judged on the input, and never cross documents. A null text is empty. A null id comes after
    every other id; rows repeated under one id don't remove from each other. An empty table gives an empty result.
    Ranks are 64-bit hashes; strings whose ranks agree are compared byte by byte before anything is removed. Very long texts
    are taken whole; an id of 2^63 - 1 raises.
    """
    if length < 4:
        raise ValueError("length must be at least 4 bytes")
    spark = docs.sparkSession
    chunks = chunked(docs, id_col, text_col)
    ranges = hash_ranges(chunks, (length + 1) // 4)  # winnowing selects about two positions in half a length
    later = later_copies(chunks)
    ranks = chunks.mapInArrow(_sent(length, ranges), "range int, base long, residues binary, texts binary")
    bits = ranks.groupBy("range").applyInArrow(_not_unique, "base long, range int, bits binary")
    by_chunk = lambda df: chunks.groupBy("base").cogroup(df.groupBy("base"))
    bits = bits.withColumn("places", F.lit(None).cast("array<int>")).union(later.select("base", F.lit(-1), F.lit(None).cast("binary"), "places"))
    contexts = by_chunk(bits).applyInArrow(_contexts(length, ranges), "range int, base long, places binary, bytes binary")
    spans = materialize(contexts.groupBy("range").applyInArrow(_doubled(length), "base long, spans binary"), "spans")
    del ranks, bits, contexts
    release(spark)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    spans = spans.withColumn("places", F.lit(None).cast("array<int>")).union(later.select("base", F.lit(None).cast("binary"), "places"))
    return by_chunk(spans).applyInArrow(_removed(length, with_kept), schema)
