"""Mixing sources to target weights by a low-discrepancy schedule.

Slot t of the mix has the point frac(t * golden ratio); the sources' cumulative target
shares cut [0, 1) into intervals, and the interval a point falls in names the slot's
source. Slots are ranked per source, and rank k takes block k of the source's documents
in shuffled order, laid end to end (and again, up to ``max_repeats`` times) and cut into
blocks of equal token counts. Each source has as many slots as its target has blocks: those
the points leave out are added, those beyond are left, and the last block is cut at the target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize

#: 2^64 divided by the golden ratio, as a signed 64-bit number.
GOLDEN = 0x9E3779B97F4A7C15 - (1 << 64)
CELLS = 4096
CHUNKS = 64


def targets(sizes: DataFrame, total_share: float, max_repeats: int, weights: tuple[float, ...]) -> DataFrame:
    """``source, source_size`` to ``sid, weight, target``: weights repeat along the sources by code point, null last.

    Water-filling: sorted by cap over weight, the first k sources stop at their caps, for the
    least k whose level leaves no other source above its cap.
    """
    by = Window.orderBy(F.col("source").isNull(), "source")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.withColumn("sid", (F.row_number().over(by) - 1).cast("int"))
    s = s.withColumn("weight", F.element_at(cycle, F.pmod("sid", F.lit(len(weights))) + 1)).withColumn("cap", F.col("source_size").cast("double") * max_repeats)
    up = Window.orderBy(F.col("cap") / F.col("weight"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy(F.col("cap") / F.col("weight"), "sid").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    s = s.withColumn("want", F.sum("source_size").over(every).cast("double") * total_share)
    s = s.withColumn("level", (F.col("want") - F.coalesce(F.sum("cap").over(up), F.lit(0.0))) / F.sum("weight").over(rest))
    free = F.col("level") * F.col("weight") <= F.col("cap")
    s = s.withColumn("final", F.min(F.when(free, F.struct(F.col("cap") / F.col("weight"), "sid", "level"))).over(every)["level"])
    return s.select("source", "source_size", "sid", "weight", F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("final") * F.col("weight"))).alias("target"))


def schedule(plan: DataFrame, slots: int, total: int, block_tokens: int) -> DataFrame:
    """``sid, block`` of every slot that a source gets; ``plan`` has ``sid, target``."""
    spark = plan.sparkSession
    n = -(-total // block_tokens) if total else 0
    by = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    unit = float(1 << 53) / max(total, 1)
    cut = plan.where("target > 0").select("sid", F.coalesce(F.sum("target").over(by), F.lit(0.0)).alias("lo"), "target")
    cut = cut.select("sid", F.round(F.col("lo") * unit).cast("long").alias("lo"), F.round((F.col("lo") + F.col("target")) * unit).cast("long").alias("hi"))
    width = (1 << 53) // CELLS
    cells = cut.where("hi > lo").withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    # A product modulo 2^64, taken apart so that no step leaves 64 bits: the low word times both halves.
    low, high = GOLDEN & 0xFFFFFFFF, (GOLDEN >> 32) & 0xFFFFFFFF
    t0, t1 = F.col("id").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("id", 32)
    p0 = t0.bitwiseAND(0xFFFF) * low
    p1 = F.shiftright(t0, 16) * low
    low48 = p0 + F.shiftleft(p1.bitwiseAND(0xFFFF), 16)
    top = (F.shiftrightunsigned(low48, 32) + F.shiftrightunsigned(p1, 16) + (t0.bitwiseAND(0xFFFF) * high) + F.shiftleft((F.shiftright(t0, 16) * high).bitwiseAND(0xFFFF), 16) + t1.bitwiseAND(0xFFFF) * low).bitwiseAND(0xFFFFFFFF)
    point = F.shiftleft(top, 21).bitwiseOR(F.shiftrightunsigned(low48.bitwiseAND(0xFFFFFFFF), 11))
    points = spark.range(n).select(F.col("id").alias("t"), point.alias("point")).withColumn("cell", F.floor(F.col("point") / width))
    hits = points.join(cells, "cell").where("point >= lo AND point < hi").select("sid", "t")
    hits = materialize(hits.withColumn("chunk", F.floor(F.col("t") * CHUNKS / max(n, 1)).cast("int")), "slots")
    totals = hits.groupBy("sid", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("sid", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("t")) - 1
    return hits.withColumn("at", rank).join(offsets, ["sid", "chunk"]).select("sid", "t", (F.col("offset") + F.col("at")).alias("block"))


def _quotas(slots: DataFrame, quotas: DataFrame) -> DataFrame:
    """``sid, block``: the blocks below each source's ``quota``, whether the points gave it too few slots or too many."""
    given = slots.groupBy("sid").agg(F.count("*").alias("given"))
    owed = quotas.join(given, "sid", "left").withColumn("given", F.coalesce("given", F.lit(0))).where("given < quota")
    owed = owed.select("sid", F.explode(F.sequence("given", F.col("quota") - 1)).alias("block"))
    return slots.join(F.broadcast(quotas) if _few(quotas) else quotas, "sid").where("block < quota").select("sid", "block").union(owed)


def _placed(docs: DataFrame, id_col: str, text_col: str, seed: str) -> DataFrame:
    """``docs`` with ``_id, _crc, _place, _bucket``: what fixes the order of a row within its source, but for equal texts under one id."""
    docs = docs.withColumn("_id", F.col(id_col).cast("long")).withColumn("_crc", F.crc32(F.coalesce(F.encode(F.col(text_col), "UTF-8"), F.lit(b""))))
    docs = docs.withColumn("_place", F.xxhash64(F.lit(seed), "_id"))
    return docs.withColumn("_bucket", F.pmod(F.xxhash64("_place", "_crc"), F.lit(CHUNKS * 8)).cast("int"))


ORDER = ("_bucket", "_place", "_id", "_crc")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", total_share: float = 1.0, max_repeats: int = 3, weights: tuple[float, ...] = (5, 2, 1), slots: int = 1 << 18, seed: str = "mix") -> DataFrame:
    """One row per input row: ``doc_id, size, source_size, target, taken, source``.

    ``size`` counts the words of the text (null: 0). ``taken`` is the number of words the mix
    takes from the row, repeats counted, at most ``max_repeats`` times its size. There are
    about ``slots`` blocks in all, whatever the input; each source gets its target, rounded to
    words, however small it is beside a block. A null source is a source of its own, last in order. Sources without words
    get target 0. Order within a source is by a hash of the id, so reruns agree; rows repeated
    under one id are ordered by text checksum. An empty table gives an empty result.
    """
    rows = _mixed(docs, id_col, text_col, source_col, total_share, max_repeats, weights, slots, seed)
    return rows.select(F.col("_id").alias("doc_id"), "size", "source_size", "target", "taken", "source")


def _mixed(docs: DataFrame, id_col: str, text_col: str, source_col: str, total_share: float, max_repeats: int, weights: tuple[float, ...], slots: int, seed: str) -> DataFrame:
    text = F.col(text_col)
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    rows = _placed(docs, id_col, text_col, seed).select(*ORDER, size.alias("size"), F.col(source_col).alias("source"))
    rows = materialize(rows.withColumn("rid", F.monotonically_increasing_id()), "sizes")
    plan = materialize(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), total_share, max_repeats, weights), "plan")
    total = int((plan.agg(F.sum("target")).first()[0] or 0) + 0.5)
    block_tokens = max(1, -(-total // slots))
    b = F.lit(block_tokens)
    plan = plan.withColumn("words", F.round("target").cast("long"))
    taken_blocks = materialize(_quotas(schedule(plan, slots, total, block_tokens), plan.select("sid", F.ceil(F.col("words") / b).alias("quota"))), "blocks")

    rows = rows.join(F.broadcast(plan) if _few(plan) else plan, rows["source"].eqNullSafe(plan["source"])).select(rows["*"], "sid", "source_size", "target", "words")
    totals = rows.groupBy("sid", "_bucket").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("sid").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("sid", "_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("sid", "_bucket").orderBy("_place", "_id", "_crc", "rid").rowsBetween(Window.unboundedPreceding, -1)
    laid = rows.withColumn("start", F.coalesce(F.sum("size").over(within), F.lit(0))).join(offsets, ["sid", "_bucket"]).withColumn("start", F.col("start") + F.col("offset")).drop("offset")
    laid = materialize(laid, "laid")
    spans = laid.where("size > 0").withColumn("start", F.explode(F.transform(F.sequence(F.lit(0), F.lit(max_repeats - 1)), lambda e: F.col("start") + e * F.col("source_size"))))
    spans = spans.where("start < words").withColumn("end", F.least(F.col("start") + F.col("size"), "words"))
    pieces = spans.select("rid", "sid", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / b), F.floor((F.col("end") - 1) / b))).alias("block"))
    got = pieces.join(taken_blocks, ["sid", "block"]).groupBy("rid").agg(F.sum(F.least("end", (F.col("block") + 1) * b) - F.greatest("start", F.col("block") * b)).alias("taken"))
    return laid.join(got, "rid", "left").select(*ORDER, "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", total_share: float = 1.0, max_repeats: int = 3, weights: tuple[float, ...] = (5, 2, 1), slots: int = 1 << 18, seed: str = "mix") -> DataFrame:
    """The rows of ``docs`` as often as the mix takes their words, ``taken / size`` rounded, with their own columns.

    Along a source's order the number only falls, by one: two numbers and the last row of the higher one settle it for every
    row where that row lies, so no text is moved. A row without words appears as often as its neighbours in that order.
    """
    rows = _mixed(docs, id_col, text_col, source_col, total_share, max_repeats, weights, slots, seed).where("size > 0")
    rows = rows.withColumn("copies", F.round(F.col("taken") / F.col("size")).cast("int"))
    by_copies = rows.groupBy("source", "copies").agg(F.max(F.struct(*ORDER)).alias("last"))
    settled = by_copies.groupBy("source").agg(F.max(F.struct("copies", "last")).alias("high"), F.min("copies").alias("low"))
    settled = materialize(settled.select(F.col("source").alias("_source"), "high", "low"), "copies")
    packed = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(source_col).alias("_own"))
    placed = _placed(packed, "i", "t", seed)
    found = placed.join(F.broadcast(settled) if _few(settled) else settled, placed["_own"].eqNullSafe(settled["_source"]))
    copies = F.when(F.struct(*ORDER) <= F.col("high.last"), F.col("high.copies")).otherwise(F.col("low"))
    return found.withColumn("_n", copies).where("_n > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n")))).select("_row.*")


def _few(plan: DataFrame, most: int = 100_000) -> bool:
    """Whether the sources are few enough to send to every task."""
    return plan.limit(most + 1).count() <= most
