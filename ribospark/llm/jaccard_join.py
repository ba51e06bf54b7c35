"""N-gram Jaccard self-join by filtering under several global token orders, reported as link components.

1. Repeat filter. A partner at similarity t shares at least t of a text's shingles, so a
   text needs that share of shingles which occur elsewhere. Tasks send packed shingle
   residues to hash ranges; each range finds the repeated ones and sends counts back.
2. Survivors, one for each distinct shingle set, get exact document frequencies. All orders
   begin with shingles of frequency one; then order 0 ranks by frequency, the others each by
   a hash of its own, whatever the frequency. A pair at t shares a shingle of both prefixes
   under every order, so a pair must pass all of them, and the sizes, before it is verified.
3. Texts joined by prefix shingles of order 0 form blocks, cut into bands by size: a text can
   only meet its own band and the two beside it. Bands are verified in tiles of bounded size:
   first each tile in itself; then texts outside a block's largest component against the tiles
   of their bands. Pairs inside one component need no further test, so no link between
   components is missed and a large group of near copies costs one pass.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chunks import LAST, Chunk, chunked, hash_ranges
from .common import components, discard, join_hot, materialize, release, written
from .shingles import fingerprint, mix, shingle_sets

ORDERS = 3
#: Texts, and shingles of texts, that one tile holds about.
TILE, TILE_SHINGLES = 1500, 1 << 19
#: A block of so few tiles, over its bands, is verified as one.
BANDS_OF_A_TILE = 3


def _packed(k: int, ranges: int):
    """Rows ``range, base, directory, residues, docs``: a chunk's directory once, and its residues for each range."""

    def pack(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield from blobs(Chunk(row))

    def blobs(chunk: Chunk):
        sets = shingle_sets(chunk.texts(), k)
        prints = [fingerprint(s) for s in sets]
        seen: dict[tuple, int] = {}
        source = np.array([seen.setdefault(p, i) for i, p in enumerate(prints)], np.int64)
        own = [i for i in range(len(sets)) if source[i] == i and len(sets[i])]
        tokens = np.concatenate([sets[i] for i in own]) if own else np.zeros(0, np.uint64)
        doc = np.repeat(np.array(own, np.uint16), [len(sets[i]) for i in own])
        at = ((tokens & np.uint64((1 << 40) - 1)) % np.uint64(ranges)).astype(np.int32)
        order = np.argsort(at, kind="stable")
        residues = (tokens[order] >> np.uint64(40)).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]
        doc, at = doc[order], at[order]
        of = np.zeros(len(chunk.ids), np.int64)
        of[chunk.own] = np.arange(len(chunk.own))
        text = of[chunk.source]  # of each row, its place among the chunk's distinct texts
        column = lambda values: pa.array(np.array(values, np.int64)[text] if len(text) else [], pa.int64())
        directory = pa.table({
            "doc_id": pa.array(chunk.ids, pa.int64(), mask=chunk.ids == LAST), "rid": pa.array(chunk.base + np.arange(len(chunk.ids)), pa.int64()), "base": pa.array(np.full(len(chunk.ids), chunk.base), pa.int64()),
            "text": pa.array(text, pa.int64()), "n": column([len(s) for s in sets]), "fp1": column([p[0] for p in prints]), "fp2": column([p[1] for p in prints]), "source": column(source),
        })
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, directory.schema) as out:
            out.write_table(directory)
        yield _blobs([-1 - chunk.base % ranges], chunk.base, [sink.getvalue().to_pybytes()], [None], [None])
        cuts = np.flatnonzero(np.diff(at, prepend=-1))
        ends = [*cuts[1:], len(at)]
        for i in range(0, len(cuts), 256):
            some = range(i, min(i + 256, len(cuts)))
            yield _blobs([int(at[cuts[j]]) for j in some], chunk.base, [None] * len(some), [np.ascontiguousarray(residues[cuts[j] : ends[j]]).tobytes() for j in some], [doc[cuts[j] : ends[j]].tobytes() for j in some])

    return pack


def _blobs(at, base, directory, residues, docs) -> pa.RecordBatch:
    return pa.record_batch({"range": pa.array(at, pa.int32()), "base": pa.array([base] * len(at), pa.int64()), "directory": pa.array(directory, pa.binary()), "residues": pa.array(residues, pa.binary()), "docs": pa.array(docs, pa.binary())})


def _repeated(table: pa.Table) -> pa.Table:
    """Of one range: for each chunk, the documents of the residues that occur more than once. Directories pass through."""
    if table["range"][0].as_py() < 0:
        return table.select(["base", "directory", "docs"])
    raw = [np.frombuffer(x, np.uint8).reshape(-1, 3) for x in table["residues"].to_pylist()]
    sizes = [len(x) for x in raw]
    wide = np.zeros((sum(sizes), 4), np.uint8)
    wide[:, :3] = np.concatenate(raw)
    _, inverse, counts = np.unique(wide.view("<u4").ravel(), return_inverse=True, return_counts=True)
    again = np.split(counts[inverse.ravel()] > 1, np.cumsum(sizes)[:-1])
    docs = [np.frombuffer(d, np.uint16)[a].tobytes() for d, a in zip(table["docs"].to_pylist(), again, strict=True)]
    return pa.table({"base": table["base"], "directory": pa.nulls(len(docs), pa.binary()), "docs": pa.array(docs, pa.binary())})


def _counted(table: pa.Table) -> pa.Table:
    """Of one chunk: its directory, each document with the number ``m`` of its shingles that occur elsewhere."""
    directory = pa.ipc.open_stream(next(x for x in table["directory"].to_pylist() if x is not None)).read_all()
    found = [np.frombuffer(x, np.uint16) for x in table["docs"].to_pylist() if x is not None]
    m = np.bincount(np.concatenate(found) if found else np.zeros(0, np.uint16), minlength=directory.num_rows)
    m = m[directory["source"].to_numpy()]
    return directory.drop_columns(["source"]).append_column("m", pa.array(m, pa.int64()))


def repeat_filter(chunks: DataFrame, k: int) -> DataFrame:
    """``doc_id, rid, base, text, n, fp1, fp2, m`` for each row: its chunk and the place of its text there, set size, fingerprint,
    and at most how many of its shingles occur in other texts (residues may collide, which only raises ``m``)."""
    ranges = hash_ranges(chunks, 6)
    blobs = chunks.mapInArrow(_packed(k, ranges), "range int, base long, directory binary, residues binary, docs binary")
    back = blobs.groupBy("range").applyInArrow(_repeated, "base long, directory binary, docs binary")
    return back.groupBy("base").applyInArrow(_counted, "doc_id long, rid long, base long, text long, n long, fp1 long, fp2 long, m long")


def _tokens(k: int):
    def tokens(chunks: pa.Table, wanted: pa.Table) -> pa.Table:
        """The shingle sets of a chunk's wanted texts."""
        sets = []
        for row in chunks.to_pylist() if wanted.num_rows else []:
            texts = Chunk(row).texts()
            sets = shingle_sets([texts[i] for i in wanted["text"].to_pylist()], k)
        return pa.table({"node": wanted["node"], "n": pa.array([len(s) for s in sets], pa.int64()), "tokens": pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))})

    return tokens


def _order_hash(i: int) -> Column:
    return F.xxhash64("token", F.lit(i))


class _Tile:
    """Texts of one tile: row tests by marking one text's shingles and summing marks over all texts."""

    def __init__(self, table: pa.Table, num: int, den: int):
        self.node = table["node"].to_numpy()
        self.n = table["n"].to_numpy()
        self.num, self.den = num, den
        self.lists = [self._coded(table[c].combine_chunks()) for c in ("tokens", *(f"prefix{i}" for i in range(ORDERS)))]
        self.parent = np.arange(len(self.node))

    @staticmethod
    def _coded(column):
        flat = column.flatten().to_numpy(zero_copy_only=False)
        codes = np.unique(flat, return_inverse=True)[1].ravel() if len(flat) else np.zeros(0, np.int64)
        offsets = column.offsets.to_numpy() - column.offsets[0].as_py()
        return codes, offsets, np.zeros(int(codes.max()) + 1 if len(codes) else 1, np.int64)

    def _shared(self, which: int, x: int) -> np.ndarray:
        codes, offsets, mark = self.lists[which]
        own = codes[offsets[x] : offsets[x + 1]]
        mark[own] = 1
        sums = np.concatenate([[0], np.cumsum(mark[codes])])
        mark[own] = 0
        return sums[offsets[1:]] - sums[offsets[:-1]]

    def similar(self, x: int) -> np.ndarray:
        """Texts linked to x: those that pass every order's prefix filter and the sizes, then verified."""
        ok = np.ones(len(self.node), bool)
        for i in range(ORDERS):
            ok &= self._shared(1 + i, x) > 0
        ok &= (self.num * np.maximum(self.n, self.n[x]) <= self.den * np.minimum(self.n, self.n[x]))
        ok[x] = False
        if not ok.any():
            return np.flatnonzero(ok)
        both = self._shared(0, x)
        return np.flatnonzero(ok & (self.den * both >= self.num * (self.n + self.n[x] - both)))

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def test(self, x: int) -> list[tuple[int, int]]:
        edges = []
        for y in self.similar(x):
            a, b = self.root(x), self.root(int(y))
            if a != b:
                self.parent[b] = a
                edges.append((int(self.node[x]), int(self.node[y])))
        return edges

    def roots(self) -> np.ndarray:
        return np.array([self.root(i) for i in range(len(self.parent))])


def _tiled(num: int, den: int):
    def verify(table: pa.Table) -> pa.Table:
        """Edges that join the tile's components. With ``outside`` marked: its texts against all; else all pairs across components."""
        # The text with the commonest shingles first: the likeliest centre of a group of near copies.
        table = table.sort_by([("outside", "descending"), ("weight", "descending"), ("node", "ascending")])
        tile = _Tile(table, num, den)
        edges, marked = [], table["outside"].to_numpy(zero_copy_only=False)
        if marked.any():
            for x in np.flatnonzero(marked):
                edges += tile.test(int(x))
        else:
            tested = np.zeros(len(tile.node), bool)
            while True:
                roots = tile.roots()
                values, counts = np.unique(roots, return_counts=True)
                left = np.flatnonzero(~tested & ((roots != values[np.argmax(counts)]) | ~tested.any()))
                if not len(left):
                    break
                for x in left[:1] if not tested.any() else left[:16]:
                    edges += tile.test(int(x))
                    tested[x] = True
        return pa.table({"u": pa.array([e[0] for e in edges], pa.int64()), "v": pa.array([e[1] for e in edges], pa.int64())})

    return verify


def similarity_edges(tokens: DataFrame, num: int, den: int) -> DataFrame:
    """Edges ``u, v`` that join the same components as all pairs of ``tokens(node, n, tokens)`` with ``den * |a & b| >= num * |a | b|``."""
    total = tokens.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rows = tokens.select("node", "n", F.explode("tokens").alias("token"))
    known = written(rows.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "frequencies")
    rows = join_hot(rows, known, "token", "df", total, "node")
    # A prefix holds n - ceil(t n) + 1 shingles; those of frequency one come first and meet nobody.
    room = F.col("n") - F.ceil(F.col("n") * num / F.lit(den)).cast("long") + 1 - (F.col("n") - F.count("*").over(Window.partitionBy("node")))
    rows = rows.withColumn("room", room).where("room > 0")
    for i in range(ORDERS):
        order = ["df"] * (i == 0) + [_order_hash(i), "token"]
        rows = rows.withColumn(f"in{i}", F.row_number().over(Window.partitionBy("node").orderBy(*order)) <= F.col("room"))
    prefixes = [F.collect_list(F.when(F.col(f"in{i}"), F.col("token"))).alias(f"prefix{i}") for i in range(ORDERS)]
    prefix = materialize(rows.groupBy("node").agg(F.sum("df").alias("weight"), *prefixes), "prefixes")
    discard(known)
    first = prefix.select("node", F.explode("prefix0").alias("token"))
    least = written(first.groupBy("token").agg(F.min("node").alias("u"), F.count("*").alias("k")).where("k > 1"), "least")
    blocks = components(join_hot(first, least, "token", "k", total, "node").select("u", F.col("node").alias("v")))
    blocks = materialize(blocks.withColumnRenamed("component", "block"), "blocks")
    discard(least)
    # Sizes of a linked pair differ by a factor of at most den / num: they lie in one band or in two beside each other.
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(den / num) + 1e-9).cast("int")
    held = blocks.join(tokens.select("node", "n"), "node").withColumn("band", band)
    sizes = held.groupBy("block", "band").agg(F.count("*").alias("size"), F.sum("n").alias("total"))
    sizes = materialize(sizes.select("block", "band", F.greatest(F.ceil(F.col("size") / TILE), F.ceil(F.col("total") / TILE_SHINGLES)).cast("int").alias("tiles")), "sizes")
    spread = materialize(sizes.groupBy("block").agg(F.sum("tiles").alias("all_tiles")), "spread")
    texts = materialize(tokens.join(blocks, "node").join(prefix, "node").withColumn("band", band).join(sizes, ["block", "band"]).join(spread, "block"), "tiles")
    columns = ["node", "n", "weight", "tokens", *[f"prefix{i}" for i in range(ORDERS)]]
    tile = F.pmod(F.xxhash64("node"), F.col("tiles"))
    # A block that fits one tile is one, whatever its bands.
    small = texts.where(F.col("all_tiles") <= BANDS_OF_A_TILE).select("block", F.lit(-1).alias("band"), F.lit(0).cast("long").alias("tile"), F.lit(False).alias("outside"), *columns)
    large = texts.where(F.col("all_tiles") > BANDS_OF_A_TILE)
    inside = large.withColumn("tile", tile.cast("long")).withColumn("outside", F.lit(False)).select("block", "band", "tile", "outside", *columns)
    edges = materialize(small.union(inside).groupBy("block", "band", "tile").applyInArrow(_tiled(num, den), "u long, v long"), "edges")
    if large.limit(1).count() == 0:
        return edges
    # Centres of the tiles of a large block against each other, then whoever is still outside its largest component.
    centre = inside.groupBy("block", "band", "tile").agg(F.max_by(F.struct(*columns), F.struct("weight", "node")).alias("c"))
    centres = centre.select("block", F.floor((F.col("band") * 7 + F.col("tile")) / TILE).alias("part"), F.lit(False).alias("outside"), "c.*")
    edges = materialize(edges.union(centres.groupBy("block", "part").applyInArrow(_tiled(num, den), "u long, v long")), "edges")
    found = large.select("node", "block", "band").join(components(edges), "node", "left").select("node", "block", "band", F.coalesce("component", "node").alias("component"))
    found = materialize(found, "found")
    largest = found.groupBy("block", "component").count().groupBy("block").agg(F.max_by("component", F.struct("count", "component")).alias("largest"))
    outsiders = materialize(found.join(largest, "block").where("component <> largest").select("node", "block", "band"), "outsiders")
    # Chunks of outsiders, as many as their number asks for, meet the tiles of the bands that their sizes can link to.
    chunks = outsiders.join(tokens.select("node", "n"), "node").groupBy("block", "band").agg(F.greatest(F.ceil(F.count("*") / TILE), F.ceil(F.sum("n") / TILE_SHINGLES)).cast("int").alias("chunks"))
    chunks = materialize(chunks, "chunk-numbers")
    near = F.explode(F.array(*[F.col("band") + d for d in (-1, 0, 1)]))
    meets = chunks.select("block", F.col("band").alias("out_band"), near.alias("band"), "chunks").join(sizes, ["block", "band"])
    out = large.drop("tiles", "band").join(outsiders.withColumnRenamed("band", "out_band"), ["node", "block"]).join(meets, ["block", "out_band"]).withColumn("chunk", F.pmod(F.xxhash64(F.lit(1), "node"), F.col("chunks")))
    out = out.withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select("block", "band", "tile", "out_band", "chunk", F.lit(True).alias("outside"), *columns)
    all_ = large.withColumn("tile", tile.cast("int")).join(meets.drop("tiles"), ["block", "band"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    all_ = all_.select("block", "band", "tile", "out_band", F.col("chunk").cast("long").alias("chunk"), F.lit(False).alias("outside"), *columns)
    more = out.union(all_).groupBy("block", "band", "tile", "out_band", "chunk").applyInArrow(_tiled(num, den), "u long, v long")
    return edges.union(materialize(more, "edges"))


def jaccard_components(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id``.

    Words are runs of anything but space and the characters 9 to 13, with A-Z lowered; the set holds the distinct
    ``k``-word shingles, or the whole sequence of a shorter text. Two rows link when ``den * |a & b| >= num * |a | b|``;
    rows without words link with nothing. ``component_id`` is the least id that links reach, the row's own included.
    A row without id has no component, an id of 2^63 - 1 raises; an empty table gives an empty result. Texts of any length are taken whole. Shingles are compared by 64-bit hashes,
    equal sets found by 128-bit fingerprints.
    """
    chunks = chunked(docs, id_col, text_col)
    rows = materialize(repeat_filter(chunks, k), "sets")
    classes = rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("fp1", "fp2").agg(F.min("doc_id").alias("low"), F.min(F.struct("rid", "base", "text")).alias("first"), F.count("*").alias("size"), F.max("m").alias("m"), F.max("n").alias("n"))
    classes = materialize(classes.select("fp1", "fp2", "low", "first.*", "size", "m", "n").withColumnRenamed("rid", "node"), "classes")
    survivors = classes.where(F.col("m") * den >= F.col("n") * num).select("base", "text", "node")
    tokens = chunks.groupBy("base").cogroup(survivors.groupBy("base")).applyInArrow(_tokens(k), "node long, n long, tokens array<long>")
    tokens = materialize(tokens, "tokens")
    release(docs.sparkSession)
    linked = components(similarity_edges(tokens, num, den))
    least = classes.join(linked, "node").groupBy("component").agg(F.min("low").alias("least"))
    least = materialize(linked.join(least, "component").select("node", "least"), "least")
    known = classes.join(least, "node", "left").where("size > 1 OR least IS NOT NULL").select("fp1", "fp2", F.coalesce("least", "low").alias("least"))
    known = materialize(known, "known")
    return rows.join(known, ["fp1", "fp2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.coalesce("least", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
