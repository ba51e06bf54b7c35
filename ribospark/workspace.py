"""Scratch space that driver and executors share.

Tables that are read twice go to the folder of ``spark.checkpoint.dir``, so a lost executor
costs a re-read, not a recomputation.
"""

from __future__ import annotations

import atexit
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

# Functions of this package travel to the executors by value: they need no install there.
cloudpickle.register_pickle_by_value(sys.modules[__name__.split(".")[0]])

_roots: dict[str, str] = {}


def workspace(spark: SparkSession) -> str:
    """A folder of this application under ``spark.checkpoint.dir``.

    Where that is unset, a local master gets a temporary folder; a cluster, whose machines share no such folder, an error.
    """
    context = spark.sparkContext
    app = context.applicationId
    if app not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not base and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        _roots[app] = f"{base or 'file://' + tempfile.mkdtemp(prefix='ribospark-')}/ribospark-{app}"
        atexit.register(remove, spark, _roots[app])
    return _roots[app]


def remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone by now; the folder is only scratch space
        pass


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{workspace(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and gives joins true sizes."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
