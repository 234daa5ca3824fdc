"""Tables and the shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

_own_dir: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; where it is unset a temporary folder of our own, if driver and executors are one machine."""
    global _own_dir
    if set_dir := spark.conf.get("spark.checkpoint.dir", None):
        return set_dir.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="weft-")
        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
    return f"file://{_own_dir}"


def settle(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there and any executor can reread it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weft/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written.settled_at = path
    return written


def shuffled(df: DataFrame) -> DataFrame:
    """df, never broadcast in its next join: files of numbered rows are far smaller than their rows in memory, which Spark can't see."""
    return df.hint("merge")


def columns_of(table: DataFrame, *columns: str) -> list[np.ndarray]:
    """Columns of longs, or of arrays of doubles laid end to end, on the driver: they come as bytes, 8 a number."""
    kinds = ["float64" if kind.startswith("array") else "int64" for _, kind in table.select(*columns).dtypes]

    def run(batches):
        for b in batches:
            if len(b):
                yield pd.DataFrame({c: [(np.concatenate(b[c].tolist()) if k == "float64" else b[c].to_numpy()).astype(k).tobytes()] for c, k in zip(columns, kinds, strict=True)})

    found = table.mapInPandas(run, ", ".join(f"{c} binary" for c in columns)).collect()  # a row a batch
    return [np.concatenate([np.frombuffer(r[c], k) for r in found] or [np.zeros(0, k)]) for c, k in zip(columns, kinds, strict=True)]


def discard(*tables: DataFrame) -> None:
    """Delete what settle() wrote, once nothing that is still to be read depends on it."""
    for t in tables:
        jvm, conf = t.sparkSession._jvm, t.sparkSession._jsparkSession.sessionState().newHadoopConf()
        path = jvm.org.apache.hadoop.fs.Path(t.settled_at)
        path.getFileSystem(conf).delete(path, True)
