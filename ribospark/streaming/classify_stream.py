"""Streaming classification: an extension, as the public calls know batches only.

Every micro-batch is classified against a model that stays the same. A stream has no longest
sequence, so the literal draw rule of the compatible mode is refused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.train import KmerModel, check_schema
from ..plans.classify import classify_sequences


def classify_stream(sequences: DataFrame, model: KmerModel, path: str, checkpoint: str, trigger: dict | None = None, **how) -> StreamingQuery:
    """Start a query that writes ``seq_no, id, classification`` of a streaming table ``seq_no, id, sequence`` as Parquet.

    Each batch goes to a folder named by its number, written over on replay, so a restarted query neither loses nor repeats rows.
    """
    check_schema(sequences, ("seq_no", "id", "sequence"))
    if how.get("compat"):
        raise ValueError("compat needs the longest sequence of the table, which a stream does not have")

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            classify_sequences(batch, model, **how).write.mode("overwrite").parquet(f"{path}/batch={number}")
        finally:
            batch.unpersist()

    return sequences.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
