"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

At each level the children of the node reached draw exponential race times ``-ln(u) / weight``
from a hash of the child's name and the key, weight being that of the child's whole subtree;
the least time wins, and the descent goes on below it. So a row costs one draw for each child
along its path, not one for each leaf. A changed weight alters its own path only: rows move
between that subtree and the rest, and inside it, never among the others.

A shard that opens a region of its own, as shard 24 of 24 does, takes rows only into itself.
One that grows inside a region raises the weights of its rack and region too: what these gain
is raced for again below, and some of it goes to the older shards there.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

Tree = list[list[list[tuple[int, float]]]]


def even_tree(n_shards: int, per_rack: int = 4, racks_per_region: int = 3, weights: dict[int, float] | None = None) -> Tree:
    """Shards 0 to ``n_shards - 1`` in racks of ``per_rack``, racks in regions. Growing appends to the last rack or opens the next."""
    racks = [[(s, float((weights or {}).get(s, 1.0))) for s in range(a, min(a + per_rack, n_shards))] for a in range(0, n_shards, per_rack)]
    return [racks[a : a + racks_per_region] for a in range(0, len(racks), racks_per_region)]


def _race(key: Column, name: Column, weight: Column) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(name, key), 11)
    return -F.log((bits.cast("double") + 0.5) / float(1 << 53)) / weight


def _least(key: Column, name, weights: Column) -> Column:
    """Place, from 0, of the child with the least time; ``name`` gives the name of a place."""
    times = F.transform(weights, lambda w, i: F.struct(_race(key, name(i), w).alias("time"), i.alias("place")))
    return F.array_min(times)["place"].cast("int")


def descend(df: DataFrame, key: Column, tree: Tree, prefix: str = "") -> DataFrame:
    """Add ``{prefix}region, {prefix}rack, {prefix}shard`` (rack and shard numbers are global). Weights must be positive."""
    leaves = [leaf for region in tree for rack in region for leaf in rack]
    if not leaves or min(w for _, w in leaves) <= 0 or not all(region and all(region) for region in tree):
        raise ValueError("a tree needs at least one shard, no empty racks or regions, and positive weights")
    weight = lambda node: float(node[1]) if isinstance(node, tuple) else sum(map(weight, node))
    floats = lambda nodes: F.array(*[F.lit(weight(n)) for n in nodes])
    racks = [rack for region in tree for rack in region]
    before = [sum(map(len, tree[:i])) for i in range(len(tree))]
    region, rack, at = f"{prefix}region", f"{prefix}rack", f"{prefix}_at"
    df = df.withColumn(region, _least(key, lambda i: F.concat(F.lit("region "), i.cast("string")), floats(tree)))
    first = F.get(F.array(*map(F.lit, before)), F.col(region))
    df = df.withColumn(rack, first + _least(key, lambda i: F.concat(F.lit("rack "), (first + i).cast("string")), F.get(F.array(*map(floats, tree)), F.col(region))))
    names = F.get(F.array(*[F.array(*[F.lit(s) for s, _ in r]) for r in racks]), F.col(rack))
    df = df.withColumn(at, _least(key, lambda i: F.concat(F.lit("shard "), F.get(names, i).cast("string")), F.get(F.array(*map(floats, racks)), F.col(rack))))
    return df.withColumn(f"{prefix}shard", F.get(names, F.col(at))).drop(at)


PLACE = ("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "region", "rack")


def _stride(n: int) -> int:
    """A number without a common divisor with ``n``, near the golden section of it."""
    return next(a for a in range(max(1, round(n * 0.6180339887)), n + 2) if math.gcd(a, n) == 1)


def shard_documents(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text", buckets: int = 512, weights: dict[int, float] | None = None, with_rows: bool = False) -> DataFrame:
    """One row per input row: ``doc_id, size, text_crc32, law, shard, slot, grown_shard, region, rack``, and with ``with_rows``
    the other columns of ``docs``; those named like one of these give way.

    The law is ``key``: the id and the tree alone decide, and one more shard takes rows only into itself (see above). A null id
    is a key of its own. ``size`` is the text's UTF-8 bytes plus 8, a null text counts as empty; very long texts are taken whole.
    ``slot`` numbers a shard's rows from 0 without gaps: hash buckets keep any sort small, bucket totals give their offsets, and a
    stride deals neighbours, such as copies, far apart. Rows repeated under one id share the shard and get slots of their own. An
    empty table gives an empty result.
    """
    at, size, crc = F.col(id_col).cast("long"), F.coalesce(F.octet_length(text_col), F.lit(0)) + 8, F.crc32(F.coalesce(F.encode(F.col(text_col), "UTF-8"), F.lit(b"")))
    rest = [c for c in docs.columns if c not in PLACE and c != id_col] if with_rows else []
    rows = docs.select(at.alias("doc_id"), size.cast("long").alias("size"), crc.alias("text_crc32"), F.struct(F.lit(0).alias("_none"), *[F.col(f"`{c}`") for c in rest]).alias("_row"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rows = descend(rows, key, even_tree(n_shards, weights=weights))
    rows = descend(rows, key, even_tree(n_shards + 1, weights=weights), "grown_")
    rows = materialize(rows.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(buckets)).cast("int")), "shards")
    totals = materialize(rows.groupBy("shard", "_bucket").agg(F.count("*").alias("n")), "totals")
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("shard", "_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset"), F.sum("n").over(Window.partitionBy("shard")).alias("_n"))
    held = {r["shard"]: r.n for r in totals.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # a row for each shard
    stride = F.get(F.array(*[F.lit(_stride(held.get(s, 0))).cast("long") for s in range(n_shards)]), F.col("shard"))
    within = Window.partitionBy("shard", "_bucket").orderBy("doc_id", "text_crc32", "size")
    rows = rows.withColumn("_at", F.row_number().over(within) - 1).join(F.broadcast(offsets), ["shard", "_bucket"])  # a row for each shard and bucket
    slot = ((F.col("_offset") + F.col("_at")) * stride) % F.col("_n")
    return rows.withColumn("law", F.lit("key")).withColumn("slot", slot.cast("long")).select(*PLACE, *[F.col("_row")[c].alias(c) for c in rest])


def write_shards(placed: DataFrame, path: str, files_per_shard: int = 1) -> None:
    """Rows of ``shard_documents`` as Parquet, a folder for each shard, in the order of their slots."""
    n = placed.select("shard").distinct().count() * files_per_shard
    placed.repartitionByRange(max(n, 1), "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
