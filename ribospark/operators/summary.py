"""Summary tables of classifications, and small measures over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.taxonomy import RANKS, coded_lineage, strip_confidence


def summarize_predictions(classified: DataFrame, n_levels: int = 6, strict: bool = True, column: str = "classification") -> DataFrame:
    """The input with one column a rank, ``observed`` and ``lineage``. ``strict`` raises where a row has another number of ranks."""
    parts = F.transform(F.split(column, ";"), strip_confidence)
    if strict:
        parts = F.when(F.size(parts) == n_levels, parts).otherwise(F.raise_error(F.concat(F.lit(f"expected {n_levels} ranks in "), F.coalesce(column, F.lit("null")))).cast("array<string>"))
    df = classified.withColumn("_parts", parts)
    df = df.select(*classified.columns, *[F.get("_parts", F.lit(i)).alias(r) for i, r in enumerate(RANKS[:n_levels])], "_parts")
    names = F.slice("_parts", 1, n_levels)
    return df.withColumn("observed", F.array_join(names, ";")).withColumn("lineage", coded_lineage(names, n_levels)).drop("_parts")


def prevalence(df: DataFrame, column: str, threshold: float = 10, by: list[str] | None = None) -> DataFrame:
    """``prevalence``: truncated percentage of values above ``threshold``; nulls and NaN count in the denominator only, no rows give null."""
    above = F.count_if((F.col(column) > threshold) & ~F.isnan(column))
    return df.groupBy(*(by or [])).agg((F.try_divide(above, F.count(F.lit(1))) * 100).cast("int").alias("prevalence"))


def accuracy(predicted: DataFrame, truth: str = "id", observed: str = "observed") -> DataFrame:
    return predicted.agg(F.avg((F.col(truth) == F.col(observed)).cast("double")).alias("accuracy"), F.count("*").alias("n"))
