"""Dictionary encoding of labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def label_dictionary(df: DataFrame, label: str = "id") -> DataFrame:
    """``genus_idx, genus, n_seqs``: the distinct labels by code point with their counts, codes from 0.

    The numbering sorts the dictionary, not the data: it is as large as the number of labels.
    """
    sizes = df.groupBy(F.col(label).alias("genus")).agg(F.count("*").alias("n_seqs"))
    return sizes.select((F.row_number().over(Window.orderBy("genus")) - 1).cast("int").alias("genus_idx"), "genus", "n_seqs")


def encode_labels(df: DataFrame, dictionary: DataFrame, label: str = "id") -> DataFrame:
    """``df`` with ``genus_idx``. Spark broadcasts the dictionary if it is small enough."""
    return df.join(dictionary.select("genus_idx", F.col("genus").alias(label)), label)
