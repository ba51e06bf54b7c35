"""Models as parquet folders with JSON metadata, never pickled; and the import of dense float16 matrices."""

from __future__ import annotations

import io
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from ..operators.train import KmerModel
from ..workspace import materialize

_loaded: dict[tuple, KmerModel] = {}


def path_exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(str(path))
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def _parts(all_cells: bool) -> tuple[str, ...]:
    return ("genera", "cells") if all_cells else ("genera", "priors", "cells")


def save_model(model: KmerModel, path: str, compression: str = "snappy") -> None:
    """Tables, then the metadata: a folder with metadata is complete."""
    spark = model.cells.sparkSession
    for name in _parts(model.all_cells):
        getattr(model, name).write.parquet(f"{path}/{name}", compression=compression)
    meta = json.dumps({"kmer_size": model.kmer_size, "n_seqs": model.n_seqs, "all_cells": model.all_cells})
    spark.createDataFrame([(meta,)], "value string").coalesce(1).write.text(f"{path}/metadata")


def load_model(spark: SparkSession, path: str) -> KmerModel:
    if not path_exists(spark, f"{path}/metadata"):
        raise FileNotFoundError(f"no model at {path}")
    meta = json.loads(spark.read.text(f"{path}/metadata").first().value)
    all_cells = meta.get("all_cells", False)
    tables = {"priors": None} | {n: spark.read.parquet(f"{path}/{n}") for n in _parts(all_cells)}
    return KmerModel(**tables, kmer_size=meta["kmer_size"], n_seqs=meta["n_seqs"], all_cells=all_cells)


def _file(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.format("binaryFile").load(path).first().content)


def import_dense(spark: SparkSession, matrix: str, names: str, shape: tuple[int, int]) -> KmerModel:
    """A model of a raw little-endian float16 matrix (words x genera, log probabilities) and an ``.npy`` array of genus names.

    The matrix is read row by row in tasks; only the names come to the driver. Arrays of pickled objects are refused.
    """
    words, n_genera = shape
    size = words.bit_length() // 2
    if words != 4**size:
        raise ValueError(f"{words} rows are no power of four")
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(matrix)
    length = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).getLen()
    if length != words * n_genera * 2:
        raise ValueError(f"{matrix} has {length} bytes, the shape {shape} takes {words * n_genera * 2}")
    labels = [str(x) for x in np.load(io.BytesIO(_file(spark, names)), allow_pickle=False)]
    if len(labels) != n_genera or len(set(labels)) != n_genera:
        raise ValueError(f"{names} must name {n_genera} genera, each once; it has {len(labels)}")
    genera = spark.createDataFrame([(i, x, 1) for i, x in enumerate(labels)], "genus_idx int, genus string, n_seqs long")

    def cells(batches):
        for batch in batches:
            for kmer, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                log_p = np.frombuffer(row, "<f2").astype(np.float32)
                yield pa.record_batch({"kmer": np.full(n_genera, kmer, np.int32), "genus_idx": np.arange(n_genera, dtype=np.int32), "cnt": pa.nulls(n_genera, pa.int64()), "log_p": log_p})

    rows = spark.sparkContext.binaryRecords(matrix, n_genera * 2).zipWithIndex().map(lambda x: (x[1], bytearray(x[0])))
    table = spark.createDataFrame(rows, "kmer long, row binary").mapInArrow(cells, "kmer int, genus_idx int, cnt long, log_p float")
    return KmerModel(genera, None, materialize(table, "imported"), size, n_genera, all_cells=True)


def load_db(spark: SparkSession, config: dict | str, model_dir: str | None = None) -> KmerModel:
    """A model named by a configuration: a dict, or the path of a JSON file, with ``model_dir`` (an argument goes before it) and ``model``.

    With ``genera`` and ``model_shape`` the model is a float16 matrix beside an array of names, else a folder of ``save_model``.
    Missing keys raise ValueError, missing files FileNotFoundError. A model is loaded once a session.
    """
    if not isinstance(config, dict):
        if not path_exists(spark, config):
            raise FileNotFoundError(f"no configuration at {config}")
        config = json.loads(_file(spark, config))
    folder = model_dir or config.get("model_dir")
    needed = ["model"] + (["model_shape"] if "genera" in config else [])
    if missing := [k for k in needed if k not in config] + ([] if folder else ["model_dir"]):
        raise ValueError(f"the configuration lacks {missing}")
    if not path_exists(spark, folder):
        raise FileNotFoundError(f"no folder {folder}")
    paths = [f"{folder.rstrip('/')}/{config[k]}" for k in ("model", "genera") if k in config]
    for path in paths:
        if not path_exists(spark, path):
            raise FileNotFoundError(f"no file {path}")
    key = (spark.sparkContext.applicationId, *paths, *config.get("model_shape", ()))
    if key not in _loaded:
        for old in [k for k in _loaded if k[0] != key[0]]:  # of sessions that have ended
            del _loaded[old]
        _loaded[key] = import_dense(spark, *paths, tuple(config["model_shape"])) if len(paths) == 2 else load_model(spark, paths[0])
    return _loaded[key]
