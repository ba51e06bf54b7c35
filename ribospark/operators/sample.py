"""Sampling: deterministic bootstraps, per-group caps and hold-out splits.

Random numbers are integer hashes of a digest of seed and key, and of counters: they don't
depend on partitions, and numpy, Spark and SQL compute them alike.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kmers import let

#: Constants of the generator: products of two numbers below 2^31 stay within 63 bits.
PRIME, FACTORS, SHIFTS, ADD = 2**31 - 1, (1220703125, 1099087573), (15, 13), 1013904223
BS_STEP, DRAW_STEP = 1000003, 1640531527


def sequence_key(sequence: Column) -> Column:
    """What a sequence is known by wherever no number is given: its MD5. A null one counts as empty."""
    return F.md5(F.coalesce(sequence, F.lit("")))


def _mix(x: Column) -> Column:
    """A scrambled number below 2^31 of another."""

    def shifted(by: int):
        return lambda a: a.bitwiseXOR(F.shiftright(a, by))

    for factor, shift in zip(FACTORS, SHIFTS, strict=True):
        x = let((x * factor + ADD) % PRIME, shifted(shift))
    return x


def seed_words(seed: int, key: Column) -> tuple[Column, Column]:
    """Two 28-bit numbers of seed and key."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))
    return tuple(F.conv(F.substring(digest, a, 7), 16, 10).cast("long") for a in (1, 8))


def random_words(first: Column, second: Column, bs: Column, n: Column) -> Column:
    """An array of ``n`` numbers below 2^31 for bootstrap ``bs``; ``first`` and ``second`` come from ``seed_words``."""
    start = _mix((_mix((first + bs.cast("long") * BS_STEP) % PRIME) + second) % PRIME)
    return let(start, lambda s: F.transform(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1), lambda j: _mix((s + j * DRAW_STEP) % PRIME)))


def _mix_array(x: np.ndarray) -> np.ndarray:
    for factor, shift in zip(FACTORS, SHIFTS, strict=True):
        x = (x * factor + ADD) % PRIME
        x ^= x >> shift
    return x


def draw_positions(seed: int, key: object, num_bs: int, n_draws: int, size: int) -> np.ndarray:
    """The positions that ``bootstraps`` draws: a row for each bootstrap."""
    digest = hashlib.md5(f"{seed}:{key}".encode()).hexdigest()
    first, second = int(digest[:7], 16), int(digest[7:14], 16)
    start = _mix_array((_mix_array((first + np.arange(num_bs, dtype=np.int64) * BS_STEP) % PRIME) + second) % PRIME)
    return _mix_array((start[:, None] + np.arange(n_draws, dtype=np.int64) * DRAW_STEP) % PRIME) % size


def bootstraps(tokens: DataFrame, num_bs: int = 100, divider: int = 8, seed: int = 0, batch_draws: bool = False) -> DataFrame:
    """``seq_no, bs, draw, kmer``: draws with replacement from each sequence's ``kmers``, a ``divider``-th of their number each time.

    ``seq_no``, a number or a string, seeds the draws. ``batch_draws`` takes the number from the longest sequence of the
    table instead, the literal rule of the compatible mode; a sequence without k-mers has no draws either way.
    """
    size = F.size("kmers")
    if batch_draws:
        longest = tokens.agg(F.max(size).alias("longest"))
        tokens, n = tokens.crossJoin(F.broadcast(longest)), F.col("longest")  # one row
    else:
        n = size
    first, second = seed_words(seed, F.col("seq_no"))
    rows = tokens.where(size > 0).withColumn("n_draws", F.floor(n / divider).cast("int")).where("n_draws > 0")
    rows = rows.select("seq_no", "kmers", "n_draws", first.alias("first"), second.alias("second"), F.explode(F.sequence(F.lit(0), F.lit(num_bs - 1))).alias("bs"))
    # Draws are taken before they are exploded: a row must not drag its k-mers along for each draw.
    words = random_words(F.col("first"), F.col("second"), F.col("bs"), F.col("n_draws"))
    rows = rows.select("seq_no", "bs", F.transform(words, lambda x: F.get("kmers", (x % F.size("kmers")).cast("int"))).alias("drawn"))
    return rows.select("seq_no", "bs", F.posexplode("drawn").alias("draw", "kmer"))


def down_sample(df: DataFrame, group: str = "id", n: int = 200, seed: int = 0, key: str = "seq_no") -> DataFrame:
    """At most ``n`` rows of each group, drawn without replacement by hash of ``key``; rows without a group vanish.

    A first cut in every hash bucket of a group bounds what the final ranking of a hot group sees.
    """
    place = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    df = df.where(F.col(group).isNotNull()).withColumn("_place", place).withColumn("_salt", F.substring("_place", 31, 2))
    for by in ([group, "_salt"], [group]):
        df = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy("_place", key))).where(F.col("_rank") <= n)
    return df.drop("_place", "_salt", "_rank")


def hold_out(df: DataFrame, test_size: int = 50, seed: int = 0, key: str = "seq_no") -> tuple[DataFrame, DataFrame]:
    """(rest, held out): ``test_size`` rows by hash order of ``key`` are held out. The key must be a column of the data,
    not numbered on the fly: the table is read twice."""
    place = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    test = df.orderBy(place, key).limit(test_size)
    return df.join(test.select(key), key, "left_anti"), test
