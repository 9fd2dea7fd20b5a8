"""Phase logs, resource rows and heartbeats of runs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..session import checkpointed
from .ordered import carry

DAY_US = 86_400_000_000


def phase_stage(phase) -> object:
    """build, solve or publish; null for a phase outside the canonical list."""
    return (F.when(phase.isin(*S.BUILD_PHASES), F.lit("build")).when(phase.isin(*S.SOLVE_PHASES), F.lit("solve"))
            .when(phase.isin(*S.PUBLISH_PHASES), F.lit("publish")))


def phase_spans(events: DataFrame, now: str, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Each event opens a phase that the run's next event ends; the last lasts until ``now``.

    A null phase attributes nothing. Runs are split by day, so a run with very
    many events is no single window.
    """
    us = events.withColumn("_us", F.unix_micros("ts"))
    linked = carry(us, keys, F.floor(F.col("_us") / DAY_US), ["_us", "seq"], {"us": F.col("_us")},
                   after="_end", exclude_current=True)
    end = F.coalesce("_end.us", F.unix_micros(F.lit(now).cast("timestamp")))
    return linked.where(F.col("phase").isNotNull()).select(
        *keys, "phase", "ts", "seq", (end - F.col("_us")).alias("span_us"))


def phase_durations(events: DataFrame, now: str, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Seconds per run and phase, rolled up to stages and runs (``level`` tells which)."""
    spans = phase_spans(events, now, keys).withColumn("stage", phase_stage(F.col("phase")))
    rolled = spans.rollup(*keys, "stage", "phase").agg(
        (F.sum("span_us") / 1e6).alias("seconds"), F.grouping_id().alias("_g")).where(F.col("_g") <= 3)
    level = F.when(F.col("_g") == 0, F.lit("phase")).when(F.col("_g") == 1, F.lit("stage")).otherwise(F.lit("run"))
    return rolled.select(*keys, level.alias("level"), "stage", "phase", "seconds")


def phase_peaks(samples: DataFrame, keys: Sequence[str] = ("run_id",), order: str | None = None) -> DataFrame:
    """Largest memory sample per run and phase; samples without a phase do not count.

    With ``order``, a number that ascends along the run, ``peak_at`` is that of the first sample that large.
    """
    first = [] if order is None else [(-F.max(F.when(F.col("rss_mib").isNotNull(), F.struct("rss_mib", (-F.col(order)).alias("o"))))["o"]).alias("peak_at")]
    return samples.where(F.col("phase").isNotNull()).groupBy(*keys, "phase").agg(F.max("rss_mib").alias("peak_rss"), *first)


def latest_resource_row(rows: DataFrame, job: str = "job_id") -> DataFrame:
    """The row that stands per job: a final one over any partial, then the latest."""
    rest = [c for c in rows.columns if c != job]
    rank = F.struct((~F.col("partial")).alias("final"), F.col("ts"), F.col("seq"))
    return rows.where(F.col(job).isNotNull() & (F.col(job).cast("string") != "")).groupBy(job).agg(
        F.max_by(F.struct(*rest), rank).alias("_r")).select(job, "_r.*")


def _whole_buckets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches of sorted rows, cut between buckets: the last bucket of a batch waits for the next one."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if pdf.empty:
            continue
        last = (pdf["_key"] != pdf["_key"].iloc[-1]) | (pdf["_b"] != pdf["_b"].iloc[-1])
        at = int(np.flatnonzero(last.to_numpy())[-1]) + 1 if last.any() else 0
        same = held and held[0]["_key"].iloc[0] == pdf["_key"].iloc[-1] and held[0]["_b"].iloc[0] == pdf["_b"].iloc[-1]
        if at or (held and not same):
            yield pd.concat([*held, pdf.iloc[:at]])
            held = []
        held.append(pdf.iloc[at:])
    if held:
        yield pd.concat(held)


def _chained(pdf: pd.DataFrame, gap_us: int, width_us: int) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct times of some buckets, their offsets in the bucket, the place after each at least a gap later, and where its bucket ends."""
    pdf = pdf.drop_duplicates(["_key", "_b", "us"]).reset_index(drop=True)
    new = ((pdf["_key"] != pdf["_key"].shift()) | (pdf["_b"] != pdf["_b"].shift())).to_numpy()
    group = np.cumsum(new) - 1
    offset = pdf["us"].to_numpy() % width_us
    place = group * (width_us + gap_us) + offset  # buckets a gap apart, so that no search runs into the next one
    ends = np.append(np.flatnonzero(new)[1:], len(pdf))[group]
    return pdf, offset, np.minimum(np.searchsorted(place, place + gap_us), ends), ends


def _entries(gap_us: int, width_us: int):
    """How buckets answer to what may come in: times at which a chain can start, and what that chain leaves closed.

    Whatever was let through before a bucket closes less than a gap of it, so a chain starts at a time in its first
    gap, or at the first time after that.
    """
    def chains(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in _whole_buckets(batches):
            pdf, offset, after, ends = _chained(some, gap_us, width_us)
            last = np.where(after < ends, after, np.arange(len(pdf)))
            while (last[last] != last).any():
                last = last[last]
            first = np.concatenate([[True], ends[1:] != ends[:-1]])
            can = (offset < gap_us) | first | np.concatenate([[False], offset[:-1] < gap_us])
            times = pdf["us"].to_numpy()
            yield pd.DataFrame({"_key": pdf["_key"][can], "us": times[can], "until": times[last[can]] + gap_us})

    return chains


def _let_through(gap_us: int, width_us: int):
    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in _whole_buckets(batches):
            pdf, _, after, ends = _chained(some, gap_us, width_us)
            kept, at = np.zeros(len(pdf), bool), np.flatnonzero(pdf["_start"].to_numpy())
            while len(at):  # one step of all buckets' chains at a time
                kept[at] = True
                at = after[at][after[at] < ends[at]]
            yield pdf.loc[kept, ["_key", "us"]]

    return emit


def _reached(entries: DataFrame, width_us: int) -> DataFrame:
    """The entries that the chain of each run comes by, followed for all runs at once by doubling jumps from bucket to bucket."""
    nodes = entries.select("_key", "us")
    both = nodes.withColumn("_from", F.lit(None).cast("bigint")).unionByName(
        entries.select("_key", F.col("until").alias("us"), F.col("us").alias("_from")))
    both = both.withColumn("_q", F.col("_from").isNull().cast("int"))
    # A wanted time sorts before an entry of the same time, so that entry counts as next.
    found = carry(both, ["_key"], F.floor(F.col("us") / width_us), ["us", "_q"], {"us": F.col("us")}, F.col("_q") == 1, after="_to")
    jump = checkpointed(found.where("_q = 0 and _to is not null").select("_key", F.col("_from").alias("us"), F.col("_to.us").alias("to")))
    reached = checkpointed(nodes.groupBy("_key").agg(F.min("us").alias("us")))
    size = reached.count()
    while True:
        step = reached.join(jump, ["_key", "us"]).select("_key", F.col("to").alias("us"))
        reached = checkpointed(reached.unionByName(step).distinct())
        grown = reached.count()
        if grown == size:
            return reached
        size = grown
        jump = checkpointed(jump.join(jump.select("_key", F.col("us").alias("to"), F.col("to").alias("far")), ["_key", "to"])
                            .select("_key", "us", F.col("far").alias("to")))


def heartbeats(progress: DataFrame, interval_s: int = S.HEARTBEAT_S, key: str = "run_id", bucket: int = 1024) -> DataFrame:
    """Progress rows a greedy throttle lets through.

    The first row of a run passes, then each first row at least ``interval_s``
    after the last one that passed; of rows at one time the lowest seq stands.
    Rows without a run or time count for nothing. A run is cut into buckets of
    ``bucket`` intervals. Each bucket tells, for every time at which a chain
    may enter it, up to when that chain closes what follows; these answers are
    composed from bucket to bucket, and the buckets then let through what
    follows their entry. So no task holds more than a bucket of a run.
    """
    gap = int(interval_s) * 1_000_000
    width = int(bucket) * gap
    rest = [c for c in progress.columns if c not in (key, "ts")]
    timed = progress.withColumn("us", F.unix_micros("ts")).where(F.col("us").isNotNull() & F.col(key).isNotNull())
    place = F.floor(F.col("us") / width).alias("_b")
    slim = timed.select(F.col(key).alias("_key"), place, "us")
    named = T.StructField("_key", progress.schema[key].dataType)
    times = T.StructType([named, T.StructField("us", T.LongType())])
    dealt = slim.repartition("_key", "_b").sortWithinPartitions("_key", "_b", "us")
    entries = checkpointed(dealt.mapInPandas(_entries(gap, width), T.StructType([*times, T.StructField("until", T.LongType())])))
    starts = _reached(entries, width).select("_key", place, "us", F.lit(True).alias("_start"))
    marked = slim.withColumn("_start", F.lit(False)).unionByName(starts).repartition("_key", "_b")
    # Of equal times the entry sorts first and stands.
    marked = marked.sortWithinPartitions("_key", "_b", "us", F.desc("_start"))
    kept = marked.mapInPandas(_let_through(gap, width), times).withColumnRenamed("_key", key)
    rows = timed.join(kept, [key, "us"]).groupBy(key, "us").agg(F.min_by(F.struct(*rest), F.col("seq")).alias("_row"))
    return rows.select(key, F.timestamp_micros("us").alias("ts"), "_row.*")


def stuck_runs(events: DataFrame, timeout_s: int = S.STUCK_AFTER_S, terminal: Sequence[str] = ("completed", "error"),
               now: str | None = None, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Silences longer than the timeout after an event that is not terminal."""
    us = events.withColumn("_us", F.unix_micros("ts"))
    linked = carry(us, keys, F.floor(F.col("_us") / DAY_US), ["_us", "seq"], {"us": F.col("_us")},
                   after="_next", exclude_current=True)
    end = F.col("_next.us") if now is None else F.coalesce("_next.us", F.unix_micros(F.lit(now).cast("timestamp")))
    return linked.withColumn("silent_us", end - F.col("_us")).where(
        (F.col("silent_us") > timeout_s * 1_000_000) & ~F.col("status").isin(*terminal)).select(
        *keys, "seq", F.col("_us").alias("last_event_us"), "silent_us")


def first_unstable(diagnostics: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """First diagnostics row of each run whose implied speed is impossible."""
    return diagnostics.where(F.col("implied_max_speed_ms") >= S.INSTABILITY_SPEED_MS).groupBy(*keys).agg(
        F.min("t").alias("t"), F.min_by("implied_max_speed_ms", "t").alias("implied_max_speed_ms"))

