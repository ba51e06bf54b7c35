"""Shared pieces of the training-data operators."""

from __future__ import annotations

import gc
import time
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kmers import let
from ..workspace import fresh_path, materialize, remove, workspace

__all__ = ["WORD", "bounded_batches", "components", "discard", "fresh_path", "join_hot", "let", "lowered", "materialize", "pieces", "release", "written", "workspace"]

#: Words of a text: runs of anything but space and the control characters 9 to 13.
WORD = "[^\\x20\\x09-\\x0D]+"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    """A-Z lower-cased, other letters left as they are; null as empty. Pure ASCII takes the fast way."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def pieces(batches: Iterable[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices of at most ``rows``, so that few texts become Python objects at a time. Spark bounds the bytes of a batch."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def bounded_batches(spark: SparkSession, records: int = 2000) -> None:
    """Fewer rows in an Arrow batch than Spark's default, for whole texts: the memory of a task outside the heap follows them.

    It lowers the session's limit and leaves it so, as results are computed after their function has returned.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > records:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(records))


def written(df: DataFrame, name: str) -> DataFrame:
    """``materialize``, for a table that ``discard`` gives back when it has been read."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables of ``written``; nothing may read them any more."""
    for df in tables:
        if path := getattr(df, "_scratch", None):
            remove(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Have the shuffle files of finished steps removed now: Spark's cleaner waits for garbage collection in the driver.

    One collection frees what Python held, the next what those objects held in the JVM.
    """
    for _ in range(3):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.4)


#: Keys that are sent to every task as hot, at most; the parts a hot key is dealt to.
MOST_HOT, SALTS = 100_000, 32


def join_hot(rows: DataFrame, table: DataFrame, key: str, weight: str, total: int, by: str) -> DataFrame:
    """``rows`` joined with ``table``, which has one row a key with the key's number of rows as ``weight``.

    Of ``total`` rows at most ``MOST_HOT`` keys can have more than ``total / MOST_HOT``: those above that, and above 1,000, are
    sent to every task, and their rows dealt to several by column ``by``. So no key ends up in one task.
    """
    hot = F.col(weight) > max(1000, -(-total // MOST_HOT))
    keys = table.where(hot).select(key, F.lit(1).alias("_hot"))
    rows = rows.join(F.broadcast(keys), key, "left").withColumn("_salt", F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).otherwise(0)).drop("_hot")
    salts = F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return rows.join(table.withColumn("_salt", F.explode(salts)), [key, "_salt"]).drop("_salt")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(u, v)`` as ``(node, component)``, component the least node.

    Alternates large-star and small-star steps, O(log n) rounds, every round one written
    table. Only the count and a checksum of a round come to the driver. Nulls and loops are ignored.
    """

    def mark(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first())

    # The least neighbour comes by a sum folded in each task, and back to the edges with hot nodes dealt apart.
    def least(e: DataFrame, total: int) -> DataFrame:
        return join_hot(e, e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "u", "n", total, "v").drop("n")

    def large(e: DataFrame, total: int) -> DataFrame:
        both = least(e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))), 2 * total)
        return both.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))

    def small(e: DataFrame, total: int) -> DataFrame:
        down = least(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), total)
        return down.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))

    first = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u <> v")
    now = written(first.distinct(), "stars")
    seen = mark(now)
    if not seen[0]:
        return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(max_rounds):
        half = written(large(now, seen[0]), "stars")
        before, now = now, written(small(half, seen[0]), "stars")
        discard(before, half)
        was, seen = seen, mark(now)
        if was == seen:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = now.groupBy("u").agg(F.min("v").alias("v"))
    roots = stars.select(F.col("v").alias("u")).distinct().select("u", F.col("u").alias("v"))
    return stars.union(roots).select(F.col("u").alias("node"), F.col("v").alias("component"))
