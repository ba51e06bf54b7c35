"""The three public calls: make_classifier, classify_sequences, summarize_predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.taxonomy import filter_confidence, format_taxonomy
from ..operators.sample import sequence_key
from ..operators.score import MOST_CELLS, classify_bootstraps, classify_folded
from ..operators.summary import summarize_predictions
from ..operators.train import KmerModel, check_schema, tokenise, train
from ..operators.vote import consensus_by_rank, consensus_cumulative
from ..sources.fasta import read_taxa_fasta

__all__ = ["make_classifier", "classify_sequences", "summarize_predictions"]


def _table(sequences: DataFrame | str) -> DataFrame:
    return read_taxa_fasta(SparkSession.active(), sequences) if isinstance(sequences, str) else sequences


def make_classifier(reference: DataFrame | str, kmer_size: int = 8, **how) -> KmerModel:
    """Train on a table ``id, sequence`` (ids are lineages) or a FASTA path. A missing column raises ValueError."""
    return train(_table(reference), kmer_size, **how)


def classify_sequences(
    sequences: DataFrame | str, model: KmerModel, min_confidence: int = 80, n_levels: int = 6, num_bs: int = 100, divider: int = 8, seed: int = 0,
    compat: bool = False, cumulative: bool = False, most_cells: int = MOST_CELLS, native: bool = False, keep_sequence: bool = False,
) -> DataFrame:
    """``id, classification`` (with ``seq_no`` if given, and ``sequence`` if kept) for every sequence; equal ids are not merged.

    Each distinct sequence is classified once, and its draws are seeded by its own letters: the result doesn't depend on order,
    partitions or file splits, and rows are matched by content, so no row number has to survive a shuffle.
    A sequence without k-mers or draws is ``Unclassified(0)``, padded. ``compat`` takes the literal rules: upper-case bases only,
    and the number of draws from the longest sequence of the table. ``cumulative`` votes on lineage prefixes; its confidences
    are percentages. Else they are numbers of votes, so ``min_confidence`` counts bootstraps out of ``num_bs``.
    """
    df = _table(sequences)
    check_schema(df)
    df = df.select(*(["seq_no"] if "seq_no" in df.columns else []), "id", "sequence", sequence_key(F.col("sequence")).alias("_key"))
    rows = df.select(F.col("_key").alias("seq_no"), "sequence").dropDuplicates(["seq_no"])
    if compat or native:
        tokens = tokenise(rows, model.kmer_size, fold_case=not compat, native=native).drop("sequence")
        votes = classify_bootstraps(tokens, model, num_bs, divider, seed, batch_draws=compat, most_cells=most_cells)
    else:
        votes = classify_folded(rows, model, num_bs, divider, seed, most_cells=most_cells)
    agreed = (consensus_cumulative if cumulative else consensus_by_rank)(votes, model.genera)
    shown = agreed.select(F.col("seq_no").alias("_key"), format_taxonomy(filter_confidence(F.col("taxonomy"), min_confidence), n_levels).alias("classification"))
    none = ";".join(["Unclassified(0)", *["Unclassified_unclassified(0)"] * (n_levels - 1)])
    out = df.join(shown, "_key", "left").withColumn("classification", F.coalesce("classification", F.lit(none)))
    return out.select(*[c for c in df.columns if c not in ("_key", "sequence")], *(["sequence"] if keep_sequence else []), "classification")
