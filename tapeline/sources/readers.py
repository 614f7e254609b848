"""Bars, claims and evidence from memory, CSV and Parquet; a missing file is an empty table, never an error."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tapeline.schemas import BARS, CLAIMS, TRUTH, normalise_claims


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _schema(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def bars_from_memory(spark: SparkSession, rows: Mapping[str, Iterable[tuple]]) -> DataFrame:
    """{symbol: [(date, open, high, low, close, volume)]}; a symbol that is not there has no rows."""
    return spark.createDataFrame([(s, *r) for s, rs in rows.items() for r in rs], _schema(BARS))


def claims_from_memory(spark: SparkSession, rows: Iterable[tuple]) -> DataFrame:
    """(symbol, date, ratio_from, ratio_to[, source[, type]]) in order; the order becomes ``rid``."""
    filled = [(*r, *[None] * (6 - len(r)), i) for i, r in enumerate(rows)]
    filled = [(s, d, float(f), float(t), src, kind, i) for s, d, f, t, src, kind, i in filled]
    return spark.createDataFrame(filled, _schema(CLAIMS + ", rid bigint"))


def truth_from_memory(spark: SparkSession, rows: Mapping[tuple, Mapping]) -> DataFrame:
    """{(symbol, date): {"high", "low", "n_bars"}}."""
    return spark.createDataFrame([(s, d, x.get("high"), x.get("low"), int(x.get("n_bars") or 0)) for (s, d), x in rows.items()], _schema(TRUTH))


def _headers(spark: SparkSession, pattern: str) -> dict[str, list[str]]:
    """Header line -> its files. One pass over the lines; a row per file comes to the driver, which lists the files anyway."""
    meta = F.col("_metadata")
    lines = spark.read.text(pattern).select("value", meta["file_path"].alias("path"), meta["file_block_start"].alias("start"), F.monotonically_increasing_id().alias("at"))
    firsts = lines.filter("start = 0").groupBy("path").agg(F.min_by("value", "at").alias("header"))
    out: dict[str, list[str]] = {}
    for r in firsts.select(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))).alias("path"), "header").collect():
        out.setdefault(r["header"], []).append(r["path"])
    return out


def bars_from_csv(spark: SparkSession, directory: str) -> DataFrame:
    """One file per symbol, ``<symbol>.csv`` with a header. Columns are matched by name, whatever their order in each file.

    Files of one header are read together; a header that names a column twice is an error, one without it gives nulls.
    """
    bars = spark.createDataFrame([], _schema(BARS))
    if not _exists(spark, directory):
        return bars
    try:
        headers = _headers(spark, f"{directory.rstrip('/')}/*.csv")
    except AnalysisException:  # no file matches
        return bars
    # the file's name is shown with %-escapes, in which a plus sign stands for itself
    name = F.url_decode(F.replace(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.csv$", 1), F.lit("+"), F.lit("%2B")))
    fields = [f for f in _schema(BARS) if f.name != "symbol"]
    for header, paths in sorted(headers.items()):
        names = [c.strip().strip('"').lower() for c in header.lstrip("\ufeff").split(",")]
        if twice := {c for c in names if c and names.count(c) > 1}:
            raise ValueError(f"{paths[0]} names {sorted(twice)} twice")
        schema = StructType([StructField(c or f"_{i}", StringType()) for i, c in enumerate(names)])
        raw = spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(paths)
        bars = bars.unionByName(raw.select(name.alias("symbol"), *[(F.col(f.name) if f.name in names else F.lit(None)).try_cast(f.dataType).alias(f.name) for f in fields]))
    return bars


def bars_from_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A Hive layout ``symbol=X/*.parquet`` or one file with a symbol column; filters on symbol prune or push down.

    The partition's value is read as text, so a ticker such as 7203 stays one.
    """
    if not _exists(spark, path):
        return spark.createDataFrame([], _schema(BARS))
    # a declared schema keeps partition values as strings without touching the session's settings
    found = spark.read.parquet(path)
    wanted = StructType([f for f in _schema(BARS) if f.name in found.columns])
    return spark.read.schema(wanted).parquet(path)


def claims_from_csv(spark: SparkSession, path: str) -> DataFrame:
    if not _exists(spark, path):
        return normalise_claims(spark.createDataFrame([], _schema(CLAIMS)))
    raw = spark.read.option("header", True).csv(path)
    return normalise_claims(raw)


def claims_from_parquet(spark: SparkSession, path: str) -> DataFrame:
    if not _exists(spark, path):
        return normalise_claims(spark.createDataFrame([], _schema(CLAIMS)))
    return normalise_claims(spark.read.parquet(path))


def symbols_of(bars: DataFrame) -> DataFrame:
    return bars.select("symbol").distinct().orderBy("symbol")


def write_by_symbol(df: DataFrame, path: str) -> None:
    """The Hive layout that ``bars_from_parquet`` prunes; one task writes a symbol's files."""
    df.repartition("symbol").write.mode("overwrite").partitionBy("symbol").parquet(path)
