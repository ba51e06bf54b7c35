"""The corpus pipeline: quality, near duplicates, benchmark leaks, mixing, sharding.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept. ``run``
writes each stage's result as Parquet in the shared folder and rereads it for the next one, so
a lost executor never costs more than the stage at hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ribospark.llm.common import materialize
from ribospark.llm.decontaminate import decontaminate
from ribospark.llm.jaccard_join import jaccard_components
from ribospark.llm.mixing import mixed_documents
from ribospark.llm.quality import fit_quality, keep_good
from ribospark.llm.sharding import shard_documents


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, does not reject.

    A null text counts as empty and is scored like any other, a very long one as a whole; equal texts get equal scores, so
    repeated rows stay or go together. Null ids have no label but a score. An empty table stays empty; other columns are
    carried along, whatever their names.
    """
    return keep_good(docs, fit_quality(docs, _table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word shingles at 0.8 (op3's contract has other bounds) the one with the least id.
    Of rows repeated under one id with one text, one stays; documents without words or without id link with nothing and stay.
    Very long texts are compared whole; an empty table stays empty; other columns are carried along, whatever their names.
    """
    found = materialize(jaccard_components(docs, k=5, num=80, den=100), "components")
    dropped = materialize(found.where("component_id <> doc_id").select("doc_id").distinct(), "dropped")
    again = materialize(found.groupBy("doc_id").count().where("count > 1 AND doc_id IS NOT NULL").select("doc_id"), "again")
    kept = docs.join(dropped, "doc_id", "left_anti").select(docs.columns)
    if again.limit(1).count() == 0:
        return kept
    repeated = kept.join(again, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id", "text"])
    return kept.join(again, "doc_id", "left_anti").select(docs.columns).unionByName(repeated)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, not with other numbers, names, units or case either.

    Rows without text or id stay unless their own text holds an item, very long texts are searched whole, repeated rows stay or
    go together, an empty table stays empty, and other columns are carried along, whatever their names.
    """
    return decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents as often as the mix takes their words: ``taken / size`` rounded, so none, or up to three times.

    A null source is a source of its own; a text without words, null or not, comes as often as its neighbours in its source's
    order. Ties in that order are rows that are equal in id and text: they are taken alike. An empty table stays empty; other
    columns are carried along, whatever their names.
    """
    return mixed_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its text and columns, its shard, and its slot there: copies that the mix repeats are dealt apart.

    Columns named like those of the place give way to them. A null id is a key of its own, a null text has size 8, an empty
    table stays empty. ``ribospark.llm.sharding.write_shards`` writes the result as one folder a shard.
    """
    return shard_documents(docs, with_rows=True)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_leaks),
    ("mixing sources", mixture),
    ("sharding", sharding),
]

#: The classifier can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
