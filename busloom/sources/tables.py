"""Reading and writing the Parquet tables of the lake."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from busloom.operators.ordered import latest_per_key, lagged
from busloom.schemas import TABLES, conform, empty


def read_raw(
    spark: SparkSession, path: str, start: datetime | None = None, end: datetime | None = None,
    columns: list[str] | None = None, extra: str | None = None, time: str = "ts_coleta", table: str | None = None,
) -> DataFrame:
    """Partitioned raw data in [start, end). With a table's name its declared schema is used, so that planning opens no file.

    `dt` is the day of the flush, so its pruning range is a day wider than the event range.
    """
    reader = spark.read
    if table:
        reader = reader.schema(T.StructType([f for f in TABLES[table].fields if f.name not in ("dt", "h")]).add("dt", "date").add("h", "string"))
    df = reader.parquet(path)
    if start is not None:
        df = df.where(F.col(time) >= F.lit(start))
        if "dt" in df.columns:
            df = df.where(F.col("dt") >= F.lit((start - timedelta(days=1)).date()))
    if end is not None:
        df = df.where(F.col(time) < F.lit(end))
        if "dt" in df.columns:
            df = df.where(F.col("dt") <= F.lit((end + timedelta(days=1)).date()))
    if extra:
        df = df.where(extra)
    return df.select(*columns) if columns else df


def with_partitions(df: DataFrame, time: str = "ts_coleta") -> DataFrame:
    return df.withColumns({"dt": F.to_date(time), "h": F.date_format(time, "HH")})


def append_raw(df: DataFrame, path: str, table: str, files_per_hour: int = 8) -> None:
    """Append under dt=/h=, sorted inside files. The hash salt keeps one busy hour off one task."""
    out = with_partitions(conform(df, table))
    sort = [c for c in ("cl", "prefixo", "ta", "ts_coleta") if c in out.columns]
    salt = F.pmod(F.xxhash64(*sort[:2]), F.lit(files_per_hour))
    (
        out.repartition(F.col("dt"), F.col("h"), salt)
        .sortWithinPartitions("dt", "h", *sort)
        .write.mode("append")
        .partitionBy("dt", "h")
        .option("compression", "zstd")
        .option("parquet.block.size", 128 << 20)
        .option("maxRecordsPerFile", 5_000_000)
        .parquet(path)
    )


def save_derived(df: DataFrame, path: str, table: str, partition: str | None = None) -> None:
    w = conform(df, table).write.mode("overwrite").option("compression", "zstd")
    if partition:
        w = w.partitionBy(partition).option("partitionOverwriteMode", "dynamic")
    w.parquet(path)


def read_derived(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A derived or catalogue table, empty if it was never written."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return empty(spark, table)
        raise


save_catalogue, read_catalogue = save_derived, read_derived


def manifest(df: DataFrame, time: str = "ts_coleta") -> DataFrame:
    """Rows and time range per data file."""
    return df.groupBy(F.col("_metadata.file_path").alias("arquivo")).agg(
        F.count("*").alias("linhas"), F.min(time).alias("ts_min"), F.max(time).alias("ts_max")
    )


def gaps(files: DataFrame, minutes: float = 10.0) -> DataFrame:
    """Silences between consecutive files longer than `minutes`."""
    g = lagged(files.where("ts_min IS NOT NULL"), [], ["ts_min", "arquivo"], {"de": "ts_max"})
    m = (F.unix_micros("ts_min") - F.unix_micros("de")) / 60e6
    return g.withColumn("minutos", m).where(F.col("minutos") > minutes).select("de", F.col("ts_min").alias("ate"), "minutos")


def coverage(df: DataFrame, name: str, time: str) -> DataFrame:
    return df.agg(F.count("*").alias("linhas"), F.min(time).alias("inicio"), F.max(time).alias("fim")).withColumn("conjunto", F.lit(name))


def present_days(spark: SparkSession, path: str) -> DataFrame:
    """Days (column dt) that the table has files of, from the listing of its folders; no file is opened."""
    try:
        return spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select(F.col("dt").cast("date").alias("dt")).distinct()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], "dt date")
        raise


def missing_days(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """Days of `wanted` (column dt) that the table does not hold yet."""
    return wanted.join(present_days(spark, path), "dt", "left_anti")


def build_missing_days(spark, path, table, source: DataFrame, day: str, build, force: bool = False) -> None:
    """Run `build` over the source rows of days not yet present, and write only those partitions."""
    wanted = source.select(F.col(day).alias("dt")).distinct()
    todo = wanted if force else missing_days(spark, path, wanted)
    part = source.join(todo.withColumnRenamed("dt", day), day, "left_semi")
    out = conform(build(part), table)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt").parquet(path)


def register_views(spark: SparkSession, tables: dict[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def upsert(current: DataFrame, fresh: DataFrame, keys: list[str], updated: str) -> DataFrame:
    """Latest row per key; on equal stamps the fresh row."""
    both = current.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return latest_per_key(both, keys, [updated, "_new"]).drop("_new")


def refresh_links(current: DataFrame, fresh: DataFrame) -> DataFrame:
    """Freshly computed link rows, keeping the service's own order where the pair was known, and
    the known pairs that were not recomputed."""
    old = current.select("cl", "cp", F.col("ordem_api").alias("_api"))
    new = fresh.join(old, ["cl", "cp"], "left").withColumn("ordem_api", F.coalesce("_api", "ordem_api")).drop("_api")
    lines = fresh.select("cl").distinct()
    return new.unionByName(current.join(lines, "cl", "left_anti"), allowMissingColumns=True)


def replace_partitions(df: DataFrame, path: str, column: str) -> None:
    """Replace only the partitions present in `df` (say, the algorithms that ran)."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def log_event(spark: SparkSession, path: str, kind: str, metrics: dict) -> None:
    """Append one job summary as a JSON line."""
    row = spark.range(1).select(
        F.current_timestamp().alias("ts"), F.lit(kind).alias("tipo"),
        F.lit("1").alias("versao"),
        F.create_map(*[F.lit(x) for k, v in metrics.items() for x in (k, str(v))]).alias("dados"),
    )
    row.write.mode("append").json(path)
