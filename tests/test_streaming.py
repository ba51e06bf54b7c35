import pytest

from ribospark.plans.classify import classify_sequences, make_classifier
from ribospark.streaming.classify_stream import classify_stream

SCHEMA = "seq_no long, id string, sequence string"


def test_stream_gives_what_a_batch_gives(spark, tmp_path):
    import random

    rng = random.Random(2)
    rows = [(i, f"Bacteria;p{i % 4}", "".join(rng.choice("ACGT") for _ in range(90))) for i in range(12)]
    for part in range(3):
        spark.createDataFrame(rows[part * 4 : part * 4 + 4], SCHEMA).write.parquet(str(tmp_path / "in" / f"p={part}"))
    model = make_classifier(spark.createDataFrame(rows, SCHEMA), 4)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 2).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    how = {"n_levels": 2, "num_bs": 10, "min_confidence": 8}
    for _ in range(2):  # a restart finds nothing new
        classify_stream(stream, model, str(tmp_path / "out"), str(tmp_path / "ck"), **how).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("seq_no", "id", "classification")
    want = classify_sequences(spark.createDataFrame(rows, SCHEMA), model, **how)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    with pytest.raises(ValueError, match="longest"):
        classify_stream(stream, model, "x", "y", compat=True)
