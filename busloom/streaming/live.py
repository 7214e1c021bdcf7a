"""Continuous jobs: ingest of raw payloads, coverage, headways and trip sessions."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from busloom.config import LOCAL_TZ
from busloom.operators.ingest import choose_zone, flatten_forecasts, flatten_positions
from busloom.schemas import TABLES, conform
from busloom.sources.tables import read_derived, with_partitions


def payload_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """New files of JSON lines {ts_coleta, payload}."""
    return (
        spark.readStream.schema("ts_coleta timestamp, payload string")
        .option("maxFilesPerTrigger", files_per_trigger)
        .json(folder)
    )


def new_positions(rows: DataFrame, keep: str = "2 hours") -> DataFrame:
    """One row per vehicle, line and GPS instant while the watermark remembers it; rows without
    vehicle or instant always pass."""
    keyed = rows.withColumn("_k", F.when(F.col("prefixo").isNotNull() & F.col("ta").isNotNull(), F.concat_ws("|", "prefixo", "cl", "ta")).otherwise(F.expr("uuid()")))
    return keyed.withWatermark("ts_coleta", keep).dropDuplicatesWithinWatermark(["_k"]).drop("_k")


def changed_positions(rows: DataFrame, forget_s: int = 7200) -> DataFrame:
    """Exact rule: a row passes when its instant differs from the last one seen of the vehicle
    and line; the memory of a silent vehicle is dropped after `forget_s`."""
    names = TABLES["posicoes"].names

    def step(key, batches: Iterator, state: GroupState):
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        for pdf in batches:
            pdf = pdf.sort_values("ts_coleta", kind="stable")
            us = pdf["ta"].astype("datetime64[us]").astype("int64")
            before = us.shift(1)
            before.iloc[0] = -1 if last is None else last
            last = int(us.iloc[-1])
            yield pd.DataFrame(pdf.loc[us != before, names])
        state.update((last,))
        state.setTimeoutDuration(forget_s * 1000)

    rows = conform(rows, "posicoes")
    known = F.col("prefixo").isNotNull() & F.col("ta").isNotNull()
    changed = rows.where(known).groupBy("prefixo", "cl").applyInPandasWithState(
        step, TABLES["posicoes"], "ultimo long", "append", GroupStateTimeout.ProcessingTimeTimeout)
    return changed.unionByName(rows.where(~known))  # without a vehicle or instant nothing is known to repeat


def write_raw(rows: DataFrame, path: str, checkpoint: str, every: str | None = None):
    """Append under dt=/h=; the checkpoint holds the resume state. Without `every`, one pass over what is there."""
    out = with_partitions(conform(rows, "posicoes"))
    w = out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).option("compression", "zstd").partitionBy("dt", "h").outputMode("append")
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def ingest(spark: SparkSession, folder: str, path: str, checkpoint: str, every: str | None = None):
    rows = flatten_positions(payload_stream(spark, folder), "payload", "ts_coleta")
    return write_raw(new_positions(rows), path, checkpoint, every)


def mixed_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """New files of JSON lines {ts_coleta, tipo, cl, letreiro, sentido, payload}; tipo is posicao or previsao."""
    return (
        spark.readStream.schema("ts_coleta timestamp, tipo string, cl int, letreiro string, sentido int, payload string")
        .option("maxFilesPerTrigger", files_per_trigger)
        .json(folder)
    )


def write_batch(rows: DataFrame, path: str, table: str, batch: int) -> None:
    """Rows of one batch under dt=/h=/lote=; a replayed batch writes the same folders again, so it adds nothing."""
    out = with_partitions(conform(rows, table)).withColumn("lote", F.lit(batch).cast("long"))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("dt", "h", "lote").parquet(path)


def unseen(rows: DataFrame, path: str, table: str, batch: int, keys: list[str], hours: int = 2) -> DataFrame:
    """One row for each key, without keys that earlier batches wrote in the hours before; rows with a NULL key always pass.

    Only the folders of those hours are read, and only batches before this one, so a replay decides as the first run did.
    """
    full = F.lit(True)
    for k in keys:
        full = full & F.col(k).isNotNull()
    once = rows.where(full).dropDuplicates(keys)
    first = rows.agg(F.min("ts_coleta").alias("t")).first()["t"]
    old = read_derived(rows.sparkSession, path, table)
    if first is not None and "lote" in old.columns:
        since = first - timedelta(hours=hours)
        old = old.where((F.col("lote") < batch) & (F.col("dt") >= F.lit(since.date())) & (F.col("ts_coleta") >= F.lit(since)))
        once = once.join(old.select(*keys).distinct(), keys, "left_anti")
    return once.unionByName(rows.where(~full))


def resolved_forecasts(rows: DataFrame) -> DataFrame:
    """Forecast rows of one batch, their clock texts read in the zone that gives this batch the most plausible horizons."""
    read = lambda tz: flatten_forecasts(rows, "payload", "ts_coleta", "cl", "letreiro", "sentido", tz)
    local = read(LOCAL_TZ)
    best = choose_zone(local.select("t_previsto_str", "ts_coleta"), "t_previsto_str", "ts_coleta").where("escolhido").select("fuso").first()
    return read(None) if best is not None and best["fuso"] == "utc" else local


def store_batch(batch: DataFrame, number: int, positions: str, forecasts: str) -> None:
    """Both kinds of payload of one batch into their tables."""
    rows = batch.persist()
    try:
        pos = flatten_positions(rows.where("tipo = 'posicao'").select("ts_coleta", "payload"), "payload", "ts_coleta")
        write_batch(unseen(conform(pos, "posicoes"), positions, "posicoes", number, ["prefixo", "cl", "ta"]), positions, "posicoes", number)
        fore = resolved_forecasts(rows.where("tipo = 'previsao'").select("ts_coleta", "cl", "letreiro", "sentido", "payload"))
        write_batch(conform(fore, "previsoes"), forecasts, "previsoes", number)
    finally:
        rows.unpersist()


def ingest_all(spark: SparkSession, folder: str, positions: str, forecasts: str, checkpoint: str, every: str | None = None):
    """Positions and forecasts from one stream of payloads."""
    w = mixed_stream(spark, folder).writeStream.option("checkpointLocation", checkpoint)
    w = w.foreachBatch(lambda df, number: store_batch(df, number, positions, forecasts))
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def heartbeat(rows: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Rows, distinct-ish vehicles and lines per minute of collection."""
    return rows.withWatermark("ts_coleta", late).groupBy(F.window("ts_coleta", "1 minute").alias("w")).agg(
        F.count("*").alias("amostras"), F.approx_count_distinct("prefixo").alias("veiculos")).select(F.col("w.start").alias("minuto"), "amostras", "veiculos")


def rolling_delay(passages: DataFrame, late: str = "30 minutes") -> DataFrame:
    """Mean delay per segment over sliding half hours."""
    return passages.withWatermark("t_chegada", late).groupBy(F.window("t_chegada", "30 minutes", "5 minutes").alias("w"), "cl", "ordem_origem").agg(
        F.count("*").alias("n"), F.avg("atraso_s").alias("atraso_medio_s")).select(F.col("w.end").alias("ate"), "cl", "ordem_origem", "n", "atraso_medio_s")


def live_headway(arrivals: DataFrame) -> DataFrame:
    """Seconds since the previous vehicle of the line at the stop; the state is one instant per stop."""

    def step(key, batches: Iterator, state: GroupState):
        import pandas as pd

        last = state.get[0] if state.exists else None
        for pdf in batches:
            us = pdf.sort_values("t_chegada", kind="stable")["t_chegada"].astype("datetime64[us]").astype("int64")
            prev = us.shift(1)
            if last is not None:
                prev.iloc[0] = last
            last = int(us.iloc[-1])
            yield pd.DataFrame({"cl": key[0], "cp": key[1], "t_us": us.to_numpy(), "headway_s": ((us - prev) / 1e6).to_numpy()})
        state.update((last,))

    return arrivals.select("cl", "cp", "t_chegada").groupBy("cl", "cp").applyInPandasWithState(
        step, "cl long, cp long, t_us long, headway_s double", "ultimo long", "append", GroupStateTimeout.NoTimeout)


def trip_sessions(samples: DataFrame, late: str = "30 minutes") -> DataFrame:
    """Trips by silence alone: a session closes after more than 900 s without a sample."""
    return samples.withWatermark("ta", late).groupBy(F.session_window("ta", "15 minutes 1 microsecond").alias("w"), "cl", "prefixo").agg(
        F.count("*").alias("amostras"), F.max("ta").alias("fim")).select("cl", "prefixo", F.col("w.start").alias("inicio"), "fim", "amostras")
