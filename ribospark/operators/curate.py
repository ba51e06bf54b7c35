"""Training-set curation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.taxonomy import incertae_fill, rank_field

#: Marks of lineages that are left out of training sets (fixed values).
REMOVE = ("Incertae", "Sedis", "metagenome", "Eukaryota", "Metagenome", "Candidatus", "culture")


def filter_train_set(df: DataFrame, remove: tuple[str, ...] = REMOVE) -> DataFrame:
    """Rows without a removed mark whose number of ``;`` (``levels``) is the truncated mean of the survivors'."""
    kept = df.where(~F.col("id").rlike("|".join(remove))).withColumn("levels", F.regexp_count("id", F.lit(";")))
    mean = kept.agg(F.floor(F.avg("levels")).cast("int").alias("_mean"))
    return kept.join(F.broadcast(mean), F.col("levels") == F.col("_mean")).drop("_mean")  # one row


def union_reference_sets(*sets: DataFrame) -> DataFrame:
    """All rows of all sets by column name, repeats kept."""
    return reduce(DataFrame.unionByName, sets)


def lineages_from_fields(df: DataFrame, text: str, ranks: tuple[str, ...] = ("domain", "phylum", "class", "order", "family", "genus")) -> DataFrame:
    """``df`` with ``lineage`` from ``rank__value;`` fields, gaps named after their parents."""
    return df.withColumn("lineage", incertae_fill([rank_field(F.col(text), r) for r in ranks]))
