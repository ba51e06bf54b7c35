"""Consensus of bootstrap votes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.taxonomy import lineage_prefixes, split_lineage


def _lineages(votes: DataFrame, genera: DataFrame) -> DataFrame:
    """``seq_no, genus, cnt, first_bs``: votes folded by genus, unless they already are, before names are joined on."""
    folded = votes if "cnt" in votes.columns else votes.groupBy("seq_no", "genus_idx").agg(F.count("*").alias("cnt"), F.min("bs").alias("first_bs"))
    return folded.join(genera.select("genus_idx", "genus"), "genus_idx")


def consensus_by_rank(votes: DataFrame, genera: DataFrame) -> DataFrame:
    """``seq_no, taxonomy``: each rank voted on its own, confidence the number of votes, first seen on ties.

    ``taxonomy`` is an array of (rank, taxon, confidence). Lineages may differ in length: a rank is voted by those that have it.
    """
    ranks = _lineages(votes, genera).select("seq_no", "cnt", "first_bs", F.posexplode(split_lineage(F.col("genus"))).alias("rank", "taxon"))
    counted = ranks.groupBy("seq_no", "rank", "taxon").agg(F.sum("cnt").cast("int").alias("confidence"), F.min("first_bs").alias("first_bs"))
    top = counted.groupBy("seq_no", "rank").agg(F.max_by(F.struct("taxon", "confidence"), F.struct("confidence", -F.col("first_bs"))).alias("top"))
    return _arrays(top)


def consensus_cumulative(votes: DataFrame, genera: DataFrame) -> DataFrame:
    """``seq_no, taxonomy``: the commonest prefix at each rank, confidence the truncated percentage, smallest label on ties;
    names are those of the deepest winning prefix. Votes without a lineage are left out."""
    paths = _lineages(votes, genera).where(F.col("genus").isNotNull()).select("seq_no", "cnt", F.posexplode(lineage_prefixes(F.col("genus"))).alias("rank", "path"))
    counted = paths.groupBy("seq_no", "rank", "path").agg(F.sum("cnt").alias("n"))
    top = counted.groupBy("seq_no", "rank").agg(F.sum("n").alias("total"), F.min(F.struct((-F.col("n")).alias("neg"), "path")).alias("b"))
    top = top.select("seq_no", "rank", F.struct(F.col("b.path").alias("taxon"), ((-F.col("b.neg")) / F.col("total") * 100).cast("int").alias("confidence")).alias("top"))
    deep = F.split(F.element_at("taxonomy", -1)["taxon"], ";")
    named = F.transform("taxonomy", lambda x: F.struct(x["rank"].alias("rank"), F.get(deep, x["rank"]).alias("taxon"), x["confidence"].alias("confidence")))
    return _arrays(top).withColumn("taxonomy", named)


def _arrays(top: DataFrame) -> DataFrame:
    entry = F.struct("rank", F.col("top.taxon").alias("taxon"), F.col("top.confidence").alias("confidence"))
    return top.groupBy("seq_no").agg(F.array_sort(F.collect_list(entry)).alias("taxonomy"))


def mode_percent(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys, label, percent``: the commonest value with its truncated percentage, smallest label on ties."""
    counted = df.groupBy(*keys, F.col(value).alias("label")).agg(F.count("*").alias("n"))
    best = counted.groupBy(*keys).agg(F.sum("n").alias("total"), F.min(F.struct((-F.col("n")).alias("neg"), "label")).alias("b"))
    return best.select(*keys, F.col("b.label").alias("label"), ((-F.col("b.neg")) / F.col("total") * 100).cast("int").alias("percent"))
