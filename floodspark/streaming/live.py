"""Operators over the live event stream, and a runner that drains a stream into a table."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import schemas as S
from ..operators.results import flow_columns, step_figures, with_cell_speed
from ..session import shared_dir
from .standing import combined, opened, standing_rows

__all__ = ["typed_events", "latest_progress", "instability_alerts", "heartbeats_stream", "stuck_runs_stream",
           "resource_ledger", "phase_peaks_stream", "flow_diagnostics_stream", "run_events", "drain"]


def typed_events(log: DataFrame) -> DataFrame:
    """Log lines as typed rows: kind, key, value, pct, eta_s and the progress figures."""
    m = F.col("message")

    def part(pattern: str, group: int = 1):
        found = F.regexp_extract(m, pattern, group)
        return F.when(found != "", found)

    progress = r"^([0-9.]+)% \| \d+m \d+s \| "
    kind = (F.when(m.startswith("status: "), F.lit("status")).when(m.rlike(r"^metric: [^=]+="), F.lit("metric"))
            .when(m.rlike(r"^file: .+ -> "), F.lit("file")).when(m.rlike(r"^heartbeat: [0-9.]+% complete"), F.lit("heartbeat"))
            .when(m.rlike(progress), F.lit("progress")).otherwise(F.lit("log")))
    k = F.col("kind")
    return (log.withColumn("kind", kind)
            .withColumn("key", F.when(k == "metric", part(r"^metric: ([^=]+)=")).when(k == "file", part(r"^file: (.+?) -> ")))
            .withColumn("value", F.when(k == "status", part(r"^status: (.*)$")).when(k == "metric", part(r"^metric: [^=]+=(.*)$"))
                        .when(k == "file", part(r"^file: .+? -> (.*)$")))
            .withColumn("pct", F.when(k == "heartbeat", part(r"^heartbeat: ([0-9.]+)%")).when(k == "progress", part(progress)).cast("double"))
            .withColumn("eta_s", F.when(k == "heartbeat", part(r"eta=(\d+)s$")).cast("bigint"))
            .withColumn("n_steps", F.when(k == "progress", part(r"steps=(\d+)")).cast("bigint"))
            .withColumn("dt_ms", F.when(k == "progress", part(r"dt=([0-9.]+)ms")).cast("double"))
            .withColumn("vmax", F.when(k == "progress", part(r"vmax=([0-9.]+)m/s")).cast("double"))
            .withColumn("v_impl", F.when(k == "progress", part(r"v_impl=([0-9.]+)m/s")).cast("double"))
            .withColumn("wet_pct", F.when(k == "progress", part(r"wet=([0-9.]+)%")).cast("double"))
            .withColumn("volume", F.when(k == "progress", part(r"vol=([0-9.-]+)m")).cast("double")))


def _order(*columns: str, sign: int = 1) -> list:
    """Times and numbers as ascending (or descending) ranks; null sorts lowest in either."""
    least = F.lit(-(1 << 63)).cast("bigint")
    return [F.coalesce(sign * (F.unix_micros(c) if c == "ts" else F.col(c).cast("bigint")), least) for c in columns]


def latest_progress(events: DataFrame, key: str = "run_id", keep_s: int = 30 * 86400, watermark: str = "1 hour") -> DataFrame:
    """Latest progress and status per run; a run without events for ``keep_s`` is forgotten. Update mode."""
    return standing_rows(events, [key], _order("ts", "seq"), ["ts", "seq", "pct", "status"], keep_s, F.col("ts"), watermark)


def instability_alerts(diagnostics: DataFrame, key: str = "run_id", keep_s: int = 30 * 86400, watermark: str = "1 hour") -> DataFrame:
    """First diagnostics row of each run with an impossible implied speed; update mode.

    A run raises one alert, replaced only by an earlier row that came late, until it shows none for ``keep_s``.
    """
    hot = diagnostics.where(F.col("implied_max_speed_ms") >= S.INSTABILITY_SPEED_MS)
    return standing_rows(hot, [key], _order("ts", "seq", sign=-1), ["ts", "seq", "implied_max_speed_ms"], keep_s, F.col("ts"), watermark)


def heartbeats_stream(events: DataFrame, interval_s: int = S.HEARTBEAT_S, key: str = "run_id") -> DataFrame:
    """Greedy throttle as a stream; the state of a run is the time last emitted."""
    gap = int(interval_s) * 1_000_000
    out = T.StructType([events.schema[key], T.StructField("us", T.LongType()), T.StructField("seq", T.LongType())])

    def fold(run, batches, state: GroupState):
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["us", "seq"])
        us, seq = rows["us"].to_numpy(), rows["seq"].to_numpy()
        kept, k = [], 0 if last is None else int(us.searchsorted(last + gap))
        while k < len(us):  # from one heartbeat straight to the next
            last = int(us[k])
            kept.append((run[0], last, int(seq[k])))
            k = int(us.searchsorted(last + gap))
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(kept, columns=[f.name for f in out.fields])

    slim = events.select(key, F.unix_micros("ts").alias("us"), F.col("seq").cast("bigint").alias("seq"))
    return slim.groupBy(key).applyInPandasWithState(
        fold, out, T.StructType([T.StructField("last", T.LongType())]), "append", GroupStateTimeout.NoTimeout)


def stuck_runs_stream(events: DataFrame, timeout_s: int = S.STUCK_AFTER_S, terminal: Sequence[str] = ("completed", "error"),
                      watermark: str = "10 minutes", key: str = "run_id") -> DataFrame:
    """Every silence longer than the timeout after an event that is not terminal: (run, time of that event).

    A silence that an event ends shows when that event comes; one still open shows by an event-time timer. Events
    older than what a run has shown before count for nothing. Within one span of the timeout no two events are a
    silence apart, so each Arrow batch sends on only the first and last event of a run in a span.
    """
    out = T.StructType([events.schema[key], T.StructField("last_event_us", T.LongType())])
    done = tuple(terminal)

    def watch(run, batches, state: GroupState):
        if state.hasTimedOut:
            last, ended = state.get
            state.remove()
            if not ended:
                yield pd.DataFrame([(run[0], last)], columns=[f.name for f in out.fields])
            return
        last, ended = state.get if state.exists else (-1, True)
        rows = pd.concat(list(batches)).sort_values(["us", "seq"])
        rows = rows[rows["us"] >= last]
        us = np.concatenate([[last], rows["us"].to_numpy(np.int64)])
        over = np.concatenate([[ended], rows["status"].isin(done).to_numpy(bool)])
        silent = np.flatnonzero((np.diff(us) > timeout_s * 1_000_000) & ~over[:-1])
        if len(silent):
            yield pd.DataFrame([(run[0], int(us[k])) for k in silent], columns=[f.name for f in out.fields])
        last, ended = int(us[-1]), bool(over[-1])
        state.update((last, ended))
        due = last // 1000 + timeout_s * 1000
        state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))

    seq = F.col("seq").cast("bigint") if "seq" in events.columns else F.lit(0).cast("bigint")
    slim = events.where(F.col("ts").isNotNull()).select(key, "ts", F.unix_micros("ts").alias("us"), seq.alias("seq"), "status")
    span = int(timeout_s) * 1_000_000

    def ends(batches):
        for pdf in batches:
            pdf = pdf.sort_values(["us", "seq"], kind="stable")
            spans = [pdf[key], pdf["us"] // span]
            inner = pdf.groupby(spans, sort=False, dropna=False).cumcount().gt(0) & pdf.groupby(spans, sort=False, dropna=False).cumcount(ascending=False).gt(0)
            yield pdf[~inner]

    few = slim.drop("ts").mapInPandas(ends, slim.drop("ts").schema)
    few = few.withColumn("ts", F.timestamp_micros("us")).withWatermark("ts", watermark)
    return few.groupBy(key).applyInPandasWithState(
        watch, out, T.StructType([T.StructField("last", T.LongType()), T.StructField("ended", T.BooleanType())]),
        "append", GroupStateTimeout.EventTimeTimeout)


def resource_ledger(rows: DataFrame, job: str = "job_id", keep_s: int = 30 * 86400, watermark: str = "1 hour") -> DataFrame:
    """Standing row per job: a late partial never replaces a final one. Update mode.

    A job without rows for ``keep_s`` is forgotten; rows older than the watermark are dropped.
    """
    kept = rows.where(F.col(job).isNotNull() & (F.col(job).cast("string") != ""))
    final = F.coalesce((~F.col("partial")).cast("bigint"), F.lit(-1).cast("bigint"))
    return standing_rows(kept, [job], [final, *_order("ts", "seq")], [c for c in rows.columns if c != job], keep_s, F.col("ts"), watermark)


def phase_peaks_stream(samples: DataFrame, window: str = "1 day", watermark: str = "1 hour", key: str = "run_id") -> DataFrame:
    """Peak memory per run, phase and event-time window; later rows than the watermark are dropped."""
    tagged = samples.where(F.col("phase").isNotNull()).withWatermark("ts", watermark)
    return tagged.groupBy(F.window("ts", window).alias("_w"), key, "phase").agg(F.max("rss_mib").alias("peak_rss")).select(
        key, "phase", F.col("_w.start").alias("window_start"), "peak_rss")


def flow_diagnostics_stream(cells: DataFrame, cfl: float = 0.9, keys: Sequence[str] = ("run_id", "t"), at: str | None = None,
                            watermark: str = "6 hours") -> DataFrame:
    """Flow figures of each step as its cell-state files land; update mode. A NaN figure counts as missing.

    ``at`` names the time of a step, the same for all its cells; the state of a step ends once the watermark passes
    it. Without such a column a step may always get more cells, and its state stays.
    """
    figures, cells = step_figures(), with_cell_speed(cells)
    fastest = [F.when(~F.isnan("speed"), F.col("speed")), -F.col("cell_id")]
    few = combined(cells, keys, fastest, ["x", "y"], F.col(at) if at else None, figures)
    by = ["key"]
    if at:
        few, by = few.withColumn("event_time", F.timestamp_micros("seen")).withWatermark("event_time", watermark), ["key", "event_time"]
    merge = {"sum": F.sum, "max": F.max, "min": F.min}
    best = F.when(F.col("rank0").isNotNull(), F.struct("rank0", "rank1"))
    steps = few.groupBy(*by).agg(F.max_by("row", best).alias("row"), *[merge[how](n).alias(n) for n, (how, _) in figures.items()])
    return flow_columns(opened(steps, cells.schema, keys, ["x", "y"], list(figures)), keys, cfl)


def run_events(stream: DataFrame, listener: Callable[[DataFrame, int], None], checkpoint: str):
    """Hands every micro-batch to a listener; a failing listener never fails the query."""
    import logging

    log = logging.getLogger(__name__)

    def hook(batch: DataFrame, batch_id: int) -> None:
        try:
            listener(batch, batch_id)
        except Exception:
            log.exception("listener failed on batch %d", batch_id)

    return stream.writeStream.foreachBatch(hook).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(spark: SparkSession, stream: DataFrame, mode: str, keys: Sequence[str] = ()) -> DataFrame:
    """Runs a stream over what is available and returns the result as a table.

    Every micro-batch is written under its number in the shared folder, so a
    repeated batch replaces itself. In update mode the newest row per key stands.
    """
    base = f"{shared_dir(spark).rstrip('/')}/drain-{uuid.uuid4().hex}"
    schema, numbers = stream.schema, []

    def write(batch: DataFrame, batch_id: int) -> None:
        numbers.append(batch_id)
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")

    query = (stream.writeStream.outputMode(mode).foreachBatch(write)
             .option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start())
    query.awaitTermination()
    if not numbers:  # nothing was there to read
        return spark.createDataFrame([], schema)
    written = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{base}/out")
    if mode != "update":
        return written.drop("batch")
    rest = [c for c in schema.fieldNames() if c not in keys]
    return written.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("batch")).alias("_r")).select(*keys, "_r.*")
