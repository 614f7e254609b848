"""Cuts long lineages by tables in the shared checkpoint folder, which are removed when the application ends."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the cluster. A folder of our own only on a local master; elsewhere its lack is an error."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith(("local[", "local")) or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tapeline-"))
        root = sc.getCheckpointDir()
    return root.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the application may be gone already
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def app_folder(spark: SparkSession) -> str:
    """The application's own folder below the shared one."""
    sc = spark.sparkContext
    if not getattr(sc, "_tapeline_folder", None):
        sc._tapeline_folder = f"{scratch_root(spark)}/tapeline-{sc.applicationId}-{uuid.uuid4().hex[:8]}"
        atexit.register(_delete, spark, sc._tapeline_folder)
    return sc._tapeline_folder


def materialize(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    path = f"{app_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._tapeline_path = path
    return back


def discard(*frames: DataFrame) -> None:
    """Removes tables of ``materialize`` before the end; only for those that no later plan reads."""
    for df in frames:
        if path := getattr(df, "_tapeline_path", None):
            _delete(df.sparkSession, path)


def few(df: DataFrame, rows: int = 1_000_000) -> bool:
    """Whether ``df`` has at most ``rows`` rows: the check before a broadcast."""
    return df.limit(rows + 1).count() <= rows
