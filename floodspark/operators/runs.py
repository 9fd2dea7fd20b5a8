"""Run summaries and questions across many runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S


def run_summary(diagnostics: DataFrame, duration: Column | None = None,
                keys: Sequence[str] = ("run_id",), wall_s: Column | None = None) -> DataFrame:
    """One row per run from its diagnostics rows (t, last_dt_ms, n_steps, …).

    ``duration`` is an aggregate over the run's rows, such as the largest of a
    column; without it a run with any step counts as completed.
    """
    first = lambda v: F.min_by(v, F.col("t"))
    final = lambda v: F.max_by(v, F.col("t"))
    aggs = [
        F.count(F.lit(1)).alias("n_yieldsteps"), F.max("t").cast("double").alias("final_sim_time_s"),
        F.sum("n_steps").alias("total_internal_steps"), F.max("n_steps").alias("max_steps_per_yieldstep"),
        (F.sum(F.col("mean_dt_ms") * F.col("n_steps")) / F.greatest(F.lit(1), F.sum("n_steps"))).alias("mean_dt_ms"),
        first(F.col("last_dt_ms")).alias("first_dt_ms"), F.min("last_dt_ms").alias("min_dt_ms"),
        F.min_by("t", F.struct("last_dt_ms", "t")).cast("double").alias("min_dt_at_sim_s"),
        final(F.col("wet_fraction")).alias("final_wet_fraction"), final(F.col("volume_m3")).alias("final_volume_m3"),
        F.max("max_depth_m").alias("max_depth_m"), F.max("max_speed_ms").alias("max_speed_ms"),
        F.min_by(F.struct("peak_speed_x", "peak_speed_y"), F.struct(-F.col("max_speed_ms"), F.col("t"))).alias("_peak"),
        F.max("implied_max_speed_ms").alias("max_implied_speed_ms"),
        F.min_by("t", F.struct(-F.col("implied_max_speed_ms"), F.col("t"))).cast("double").alias("max_implied_speed_at_sim_s"),
        F.max("mem_mb").alias("peak_mem_mb") if "mem_mb" in diagnostics.columns else F.lit(0.0).alias("peak_mem_mb"),
        (F.lit(None).cast("double") if duration is None else duration.cast("double")).alias("duration_s"),
        (F.lit(None).cast("double") if wall_s is None else wall_s.cast("double")).alias("total_wall_time_s"),
    ]
    s = diagnostics.groupBy(*keys).agg(*aggs)
    done = F.when(F.col("duration_s").isNull(), F.col("n_yieldsteps") > 0).otherwise(
        F.col("final_sim_time_s") >= 0.99 * F.col("duration_s"))
    outcome = (F.when(done, F.lit("completed"))
               .when(F.col("max_implied_speed_ms") >= S.INSTABILITY_SPEED_MS, F.lit("unstable"))
               .otherwise(F.lit("incomplete")))
    return (s.withColumn("peak_speed_x", F.col("_peak.peak_speed_x")).withColumn("peak_speed_y", F.col("_peak.peak_speed_y"))
            .drop("_peak")
            .withColumn("timestep_collapse_ratio", F.when(F.col("first_dt_ms") > 0, F.col("min_dt_ms") / F.col("first_dt_ms")).otherwise(F.lit(1.0)))
            .withColumn("stable", F.col("max_implied_speed_ms") < S.INSTABILITY_SPEED_MS)
            .withColumn("sim_per_wall_ratio", F.coalesce(F.when(F.col("total_wall_time_s") > 0, F.col("final_sim_time_s") / F.col("total_wall_time_s")), F.lit(0.0)))
            .withColumn("outcome", outcome))


def stalled_runs(summaries: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Runs that did not complete, with how far their time step collapsed and when."""
    return summaries.where(F.col("outcome") != "completed").select(
        *keys, "outcome", "timestep_collapse_ratio", "min_dt_at_sim_s", "min_dt_ms")


def throughput_by(summaries: DataFrame, group: str) -> DataFrame:
    """Speed, steps and memory of the runs that share a property."""
    return summaries.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_runs"), F.avg("sim_per_wall_ratio").alias("avg_sim_per_wall"),
        F.sum("total_internal_steps").alias("total_internal_steps"), F.max("peak_mem_mb").alias("peak_mem_mb"))


def throughput_by_resolution(summaries: DataFrame) -> DataFrame:
    return throughput_by(summaries, "resolution")


def compare_hosts(summaries: DataFrame) -> DataFrame:
    return throughput_by(summaries, "cpu_model")


def progress_eta(progress: DataFrame) -> DataFrame:
    """Percent done to one decimal and remaining seconds, unknown at zero percent."""
    pct = F.round(F.col("t") * 100.0 / F.col("duration"), 1)
    eta = F.when(F.col("pct") > 0, (F.col("elapsed") * (100.0 - F.col("pct")) / F.col("pct")).cast("bigint"))
    return progress.withColumn("pct", pct).withColumn("eta_s", eta)


def resource_corpus(features: DataFrame, peaks: DataFrame, durations: DataFrame, outcomes: DataFrame,
                    key: str = "run_id") -> DataFrame:
    """One row per run: mesh features, peak memory, seconds by stage, outcome.

    Of phases with the same peak the one that reached it first counts, given ``peak_at``.
    """
    tie = [(-F.col("peak_at")).alias("first")] if "peak_at" in peaks.columns else []
    known = F.when(F.col("peak_rss").isNotNull(), F.struct("peak_rss", *tie, "phase"))
    peak = peaks.groupBy(key).agg(F.max("peak_rss").alias("peak_rss"), F.max(known)["phase"].alias("peak_phase"))
    seconds = durations.groupBy(key).agg(*[
        F.sum(F.when(F.col("stage") == stage, F.col("seconds"))).alias(f"{stage}_s") for stage in ("build", "solve", "publish")])
    return features.join(peak, key, "left").join(seconds, key, "left").join(outcomes, key, "left")


def feature_value(bag: Column, name: str, kind: str = "double") -> Column:
    """One entry of a run's open feature bag (JSON text), null when absent."""
    return F.try_variant_get(F.try_parse_json(bag), f"$.{name}", kind)
