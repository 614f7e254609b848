"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeline.functions.scratch import discard, few, materialize

__all__ = ["arrow_rows", "discard", "few", "keeps_tables", "make_room", "map_rows", "materialize", "release_memory", "row_identity", "ship", "shuffle_width", "table", "with_index"]


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, where it may not be installed."""
    sc = spark.sparkContext
    if getattr(sc, "_tapeline_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    folder = tempfile.mkdtemp(prefix="tapeline-package-")  # the driver's file server reads it as executors come and go
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.addPyFile(shutil.make_archive(f"{folder}/tapeline_package", "zip", package.parent, package.name))
    sc._tapeline_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def with_index(df: DataFrame, *order: Column | str, name: str = "idx") -> DataFrame:
    """Gapless global number of each row in ``order``, without a single-task window.

    Range-partition and sort, write the rows with (partition, place), count each partition (a few numbers, one per
    partition) and add the partitions' offsets. The order should end in a column with many values, so that no key
    fills one range.
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order)
    placed = materialize(ranged.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = sorted((r["p"], r["n"]) for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    offsets, total = [], 0
    for p, n in counts:
        offsets.append((p, total))
        total += n
    starts = spark.createDataFrame(offsets or [(0, 0)], "_p long, _start long")
    joined = placed.withColumn("_p", part).join(F.broadcast(starts), "_p")
    return joined.withColumn(name, F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_p", "_start", "_at")


def release_memory() -> None:
    """Give what a finished task has freed back to the system: workers live on beside the next stages' ones."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


_DROPS: dict[str, Callable[[], None]] = {}


def keeps_tables(module: str, drop: Callable[[], None]) -> None:
    """``drop`` lets go of what ``module`` keeps in a worker between tasks."""
    _DROPS[module] = drop


def make_room(module: str) -> None:
    """Workers live on from stage to stage: before a task of ``module``, drop what the other operators keep in this one."""
    others = [drop for name, drop in _DROPS.items() if name != module]
    for drop in others:
        drop()
    if others:
        release_memory()


def map_rows(df: DataFrame, columns: list[str], fn: Callable[[Iterator[dict]], Iterator[tuple]], schema: str, chunk: int = 500) -> DataFrame:
    """``fn`` maps column lists to row tuples, over Arrow batches cut to ``chunk`` rows so that memory stays bounded."""
    ship(df.sparkSession)
    fields = df.sparkSession.createDataFrame([], schema).schema
    names = fields.names
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def slices() -> Iterator[dict]:
            for b in batches:
                for at in range(0, b.num_rows, chunk):
                    part = b.slice(at, chunk)
                    yield {c: part.column(i).to_pylist() for i, c in enumerate(columns)}

        make_room(fn.__module__)
        for rows in fn(slices()):
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, arrow, strict=True)], names=names)
        release_memory()

    return df.select(*columns).mapInArrow(run, fields)


def arrow_rows(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with this package sent along and freed memory given back after each task."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room(fn.__module__)
        yield from fn(batches)
        release_memory()

    return df.mapInArrow(run, schema)


def row_identity(docs: DataFrame) -> list[Column]:
    """(row, key): two longs that tell a document's (doc_id, text) apart from others.

    ``row`` is a whole-number id itself, 0 for a null one, and a hash of an id of another type. ``key`` is a hash of the
    text; its lowest bit says that the id is null, so a null id is no value of its own.
    """
    whole = isinstance(docs.schema["doc_id"].dataType, T.IntegralType)
    row = F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")) if whole else F.xxhash64("doc_id")
    key = F.xxhash64("text").bitwiseAND(F.lit(-2)).bitwiseOR(F.col("doc_id").isNull().cast("long"))
    return [row.alias("row"), key.alias("key")]
