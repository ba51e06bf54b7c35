"""Training: word priors and genus-conditional log probabilities.

The model is sparse: only (k-mer, genus) cells that occur are stored. Tokens are counted in
each task before they are shuffled, once; priors are sums of the cells.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import workspace  # noqa: F401  (its import lets functions travel by value)
from ..functions.kmer_arrays import kmer_array, kmer_set_arrow
from ..functions.kmers import base4, kmer_set
from .encode import encode_labels, label_dictionary


#: Tokens that a task counts at a time.
FOLD = 4_000_000


@dataclass
class KmerModel:
    """``genera(genus_idx, genus, n_seqs)``, ``priors(kmer, cnt, prior)``, ``cells(kmer, genus_idx, cnt, log_p)``, k and the number of sequences.

    ``counts`` are the cells before probabilities, where training has them at hand. ``all_cells`` marks an imported model whose
    cells cover every word of every genus: their ``log_p`` alone scores, and there are no priors.
    """

    genera: DataFrame
    priors: DataFrame | None
    cells: DataFrame
    kmer_size: int
    n_seqs: int
    cached: tuple[DataFrame, ...] = ()
    counts: DataFrame | None = None
    all_cells: bool = False

    def unpersist(self) -> None:
        """Give back what training has cached; the model can still be used, and is then computed again."""
        for df in self.cached:
            df.unpersist()


def tokenise(sequences: DataFrame, kmer_size: int = 8, fold_case: bool = True, sequence_col: str = "sequence", native: bool = False) -> DataFrame:
    """``sequences`` with ``kmers``, the sorted distinct indices. ``native`` stays in the JVM; the default runs in Arrow batches."""
    if native:
        return sequences.withColumn("_digits", base4(F.col(sequence_col), fold_case)).withColumn("kmers", kmer_set(F.col("_digits"), kmer_size)).drop("_digits")
    return sequences.withColumn("kmers", kmer_set_arrow(F.col(sequence_col), kmer_size, fold_case))


def genus_kmer_counts(tokens: DataFrame) -> DataFrame:
    """``kmer, genus_idx, cnt``: sequences of the genus that contain the word."""
    return tokens.select("genus_idx", F.explode("kmers").alias("kmer")).groupBy("kmer", "genus_idx").agg(F.count("*").alias("cnt"))


def folded_counts(labelled: DataFrame, kmer_size: int, fold_case: bool = True) -> DataFrame:
    """The counts of ``genus_kmer_counts`` from ``labelled(genus_idx, sequence)``, each task's tokens counted before the shuffle."""

    def fold(batches):
        held, n = [], 0

        def flush():
            codes = np.sort(np.concatenate(held))
            first = np.flatnonzero(np.diff(codes, prepend=-1))
            cnt = np.diff(np.append(first, len(codes)))
            found = codes[first]
            for a in range(0, len(found), 1 << 18):
                part = found[a : a + (1 << 18)]
                yield pa.record_batch({"kmer": pa.array(part & ((1 << 2 * kmer_size) - 1), pa.int32()), "genus_idx": pa.array(part >> 2 * kmer_size, pa.int32()), "cnt": pa.array(cnt[a : a + (1 << 18)], pa.int64())})

        for batch in batches:
            for genus, sequence in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append(kmer_array(sequence, kmer_size, fold_case).astype(np.int64) | (genus << 2 * kmer_size))
                n += len(held[-1])
                if n >= FOLD:
                    yield from flush()
                    held, n = [], 0
        if n:
            yield from flush()

    parts = labelled.select("genus_idx", "sequence").mapInArrow(fold, "kmer int, genus_idx int, cnt long")
    return parts.groupBy("kmer", "genus_idx").agg(F.sum("cnt").alias("cnt"))


def word_priors(counts: DataFrame, n_seqs: int) -> DataFrame:
    """``kmer, cnt, prior``: prior = (sequences with the word + 0.5) / (all sequences + 1)."""
    per_word = counts.groupBy("kmer").agg(F.sum("cnt").alias("cnt"))
    return per_word.withColumn("prior", (F.col("cnt") + F.lit(0.5)) / (F.lit(float(n_seqs)) + 1))


def dense_priors(priors: DataFrame, kmer_size: int, n_seqs: int) -> DataFrame:
    """Priors of all 4^k words, absent ones included."""
    words = priors.sparkSession.range(4**kmer_size).select(F.col("id").cast("int").alias("kmer"))
    return words.join(priors, "kmer", "left").select("kmer", F.coalesce("cnt", F.lit(0)).alias("cnt"), F.coalesce("prior", F.lit(0.5 / (n_seqs + 1))).alias("prior"))


def conditional_log_prob(counts: DataFrame, priors: DataFrame, genera: DataFrame) -> DataFrame:
    """``kmer, genus_idx, cnt, log_p``: log((sequences of the genus with the word + prior) / (sequences of the genus + 1))."""
    joined = counts.join(priors.select("kmer", "prior"), "kmer").join(genera.select("genus_idx", "n_seqs"), "genus_idx")
    return joined.select("kmer", "genus_idx", "cnt", F.log((F.col("cnt") + F.col("prior")) / (F.col("n_seqs") + 1)).cast("float").alias("log_p"))


def check_schema(df: DataFrame, needed: tuple[str, ...] = ("id", "sequence")) -> None:
    if missing := [c for c in needed if c not in df.columns]:
        raise ValueError(f"the sequence table lacks the columns {missing}; it has {df.columns}")


def train(sequences: DataFrame, kmer_size: int = 8, fold_case: bool = True, native: bool = False, cached: bool = True) -> KmerModel:
    """Model of ``sequences(id, sequence)``, the id being the lineage. ``fold_case=False`` takes upper-case bases only."""
    check_schema(sequences)
    genera = label_dictionary(sequences)
    genera = genera.cache() if cached else genera
    n_seqs = genera.agg(F.coalesce(F.sum("n_seqs"), F.lit(0))).first()[0]
    labelled = encode_labels(sequences.select("id", "sequence"), genera)
    counts = genus_kmer_counts(tokenise(labelled, kmer_size, fold_case, native=True)) if native else folded_counts(labelled, kmer_size, fold_case)
    counts = counts.cache() if cached else counts
    priors = word_priors(counts, n_seqs)
    return KmerModel(genera, priors, conditional_log_prob(counts, priors, genera), kmer_size, n_seqs, (genera, counts) if cached else (), counts)
