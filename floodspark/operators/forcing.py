"""Rainfall and inflow series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from .ordered import carry

NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"

#: Grid steps of a window that are handled together.
PIECE = 4096


def classify_forcing(features: DataFrame, data: str = "data") -> DataFrame:
    """Adds kind (missing, constant, series, invalid), constant and series.

    ``data`` is the property's JSON text, or null. A number and a numeric text
    are constants; a series needs rows that all have a time and a number.
    """
    raw = F.col(data)
    parsed = F.try_parse_json(raw)
    rows = F.from_json(raw, "array<struct<timestamp:string,value:string>>")
    plain = F.coalesce(F.try_variant_get(parsed, "$", "string"), raw)
    number = F.when(plain.rlike(NUMBER), F.trim(plain).try_cast("double"))
    series = F.transform(rows, lambda r: F.struct(r["timestamp"].alias("timestamp"), r["value"].try_cast("double").alias("value")))
    is_array = F.substring(F.ltrim(raw), 1, 1) == "["
    whole = (F.size("series") > 0) & F.forall("series", lambda r: r["timestamp"].isNotNull() & r["value"].isNotNull())
    kind = (F.when(raw.isNull() | (F.trim(raw) == "null"), F.lit("missing"))
            .when(F.col("constant").isNotNull(), F.lit("constant"))
            .when(F.coalesce(whole, F.lit(False)), F.lit("series"))
            .otherwise(F.lit("invalid")))
    return (features.withColumn("constant", F.when(~F.coalesce(is_array, F.lit(False)), number))
            .withColumn("series", F.when(is_array, series))
            .withColumn("kind", kind))


def first_feature(features: DataFrame, package: str, index: str) -> DataFrame:
    """The feature with the lowest index of each package."""
    rest = [c for c in features.columns if c != package]
    return features.groupBy(package).agg(F.min_by(F.struct(*rest), F.col(index)).alias("_f")).select(package, "_f.*")


def catchment_conflicts(rainfall: DataFrame, catchments: DataFrame, package: str = "package_id",
                        index: str = "feature_id") -> DataFrame:
    """Packages whose rainfall cannot feed their catchments, one row per reason."""
    rain = classify_forcing(rainfall).groupBy(package).agg(
        F.count(F.lit(1)).alias("n_rain"), F.min_by("kind", index).alias("first_kind"))
    own = catchments.groupBy(package).agg(F.count(F.lit(1)).alias("n_catchments"))
    both = rain.join(own, package)
    reasons = F.array_compact(F.array(
        F.when(F.col("n_rain") > 1, F.lit("multiple rainfall features")),
        F.when(F.col("first_kind") == "missing", F.lit("first rainfall has no value")),
        F.when(F.col("first_kind") == "series", F.lit("first rainfall is a series"))))
    return both.select(package, "n_rain", "n_catchments", F.explode(reasons).alias("reason"))


def duplicate_samples(series: DataFrame, key: str = "series_id") -> DataFrame:
    """Series with more than one sample at a time, as data-quality rows."""
    return (series.groupBy(key, "ts").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
            .groupBy(key).agg(F.count(F.lit(1)).alias("n_times"), F.sum("n").alias("n_samples")))


def forcing_anchors(series: DataFrame, windows: DataFrame, step_s: int = 1, key: str = "series_id") -> DataFrame:
    """Runs of equal value on each window's grid: (key, start_ts, from_step, to_step, value).

    Only samples exactly on a grid time count, the last of equals wins, and a
    sample holds until the next one. A missing lead-in is a run of null.
    """
    step_us = int(step_s) * 1_000_000
    cols = [key, "start_ts", "n_steps"]
    has_constant = "constant" in windows.columns
    bounds = windows.select(*cols, *(["constant"] if has_constant else []))
    offset = F.unix_micros("ts") - F.unix_micros("start_ts")
    order = F.struct("seq", "value") if "seq" in series.columns else F.col("value")
    hits = (series.where(F.col("value").isNotNull()).join(bounds, key).withColumn("_o", offset)
            .where((F.col("_o") % step_us == 0) & (F.col("_o") >= 0))
            .withColumn("from_step", (F.col("_o") / step_us).cast("bigint")).where(F.col("from_step") <= F.col("n_steps"))
            .groupBy(*cols, "from_step").agg(F.max_by("value", order).alias("value")))
    opening = F.col("constant").cast("double") if has_constant else F.lit(None).cast("double")
    starts = bounds.select(*cols, F.lit(0).cast("bigint").alias("from_step"), opening.alias("value"))
    anchors = hits.unionByName(starts).groupBy(*cols, "from_step").agg(F.max("value").alias("value"))
    # One bucket per PIECE grid steps keeps a very long series out of a single task.
    linked = carry(anchors, cols, F.floor(F.col("from_step") / PIECE), ["from_step"], {"step": F.col("from_step")},
                   after="_next", exclude_current=True)
    return linked.select(key, "start_ts", "n_steps", "from_step",
                         F.coalesce(F.col("_next.step") - 1, F.col("n_steps")).alias("to_step"), "value")


def align_forcing(series: DataFrame, windows: DataFrame, step_s: int = 1, key: str = "series_id") -> DataFrame:
    """Value of each series at every grid time of its window, forward filled.

    The grid is generated from the runs of equal value, so grid rows are
    neither joined nor sorted nor shuffled. A run is cut into pieces of
    ``PIECE`` steps that are dealt over the tasks first, so a constant over a
    year of seconds is neither one array nor the work of one task.
    """
    runs = forcing_anchors(series, windows, step_s, key)
    first, last = F.floor(F.col("from_step") / PIECE), F.floor(F.col("to_step") / PIECE)
    # A given number keeps adaptive execution from merging pieces that are small before they are filled.
    tasks = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = runs.withColumn("_p", F.explode(F.sequence(first, last))).repartition(tasks, key, "start_ts", "_p")
    rows = pieces.withColumn("step", F.explode(F.sequence(
        F.greatest(F.col("from_step"), F.col("_p") * PIECE), F.least(F.col("to_step"), F.col("_p") * PIECE + (PIECE - 1)))))
    ts = F.timestamp_micros(F.unix_micros("start_ts") + F.col("step") * F.lit(int(step_s) * 1_000_000))
    return rows.select(key, "step", ts.alias("ts"), "value")


def forcing_at(runs: DataFrame, times: DataFrame, step_s: int = 1, key: str = "series_id") -> DataFrame:
    """Value in force at ``t_s`` seconds after the start: that of the run that covers floor(t).

    ``runs`` are those of ``forcing_anchors``; no grid is made, so the cost
    follows samples and times, not the length of a window. ``times`` with a
    ``start_ts`` ask that window, else every window of their key. The value is
    null before the start, after the end, in a lead-in without samples, for a
    null time and for a key without a window.
    """
    on = [key, "start_ts"]
    windows = runs.where("from_step = 0").select(*on).distinct()
    asked = times.withColumn("step", F.floor(F.col("t_s") / step_s).cast("bigint"))
    if "start_ts" not in times.columns:
        asked = asked.join(windows, key, "left")
    samples = runs.select(*on, F.col("from_step").alias("step"), F.struct("to_step", "value").alias("_run"), F.lit(0).alias("_q"))
    both = asked.withColumn("_q", F.lit(1)).unionByName(samples, allowMissingColumns=True)
    # A run sorts before a question of its own step, so that the question finds it going back.
    found = carry(both, on, F.floor(F.col("step") / PIECE), ["step", "_q"], {"run": F.col("_run")}, F.col("_q") == 0, "_before")
    held = F.col("_before")["run"]
    return found.where("_q = 1").select(
        *[c for c in asked.columns if c != "start_ts" or c in times.columns],
        F.when(F.col("step") <= held["to_step"], held["value"]).alias("value"))


def forcing_gaps(series: DataFrame, windows: DataFrame, step_s: int = 1, key: str = "series_id") -> DataFrame:
    """Series without a single value in their window, with both spans."""
    runs = forcing_anchors(series, windows, step_s, key)
    empty = runs.groupBy(key, "start_ts", "n_steps").agg(F.count("value").alias("_n")).where("_n = 0").drop("_n")
    spans = series.groupBy(key).agg(F.min("ts").alias("series_start"), F.max("ts").alias("series_end"))
    end = F.timestamp_micros(F.unix_micros("start_ts") + F.col("n_steps") * F.lit(int(step_s) * 1_000_000))
    return empty.join(spans, key, "left").select(
        key, "series_start", "series_end", F.col("start_ts").alias("window_start"), end.alias("window_end"))


def interpolate_boundary(series: DataFrame, times: DataFrame, key: str = "series_id",
                         bucket_s: int = 86400) -> DataFrame:
    """Linear value at t seconds after the first sample, held constant beyond both ends.

    ``times`` has (key, t_s). A series without any value is 0. Momentum
    components are zero.
    """
    known = series.where(F.col("value").isNotNull())
    known = known.groupBy(key, "ts").agg(F.max("value").alias("value"))
    start = known.groupBy(key).agg(F.min(F.unix_micros("ts")).alias("_t0"))
    samples = known.join(start, key).select(
        key, ((F.unix_micros("ts") - F.col("_t0")) / 1e6).alias("t_s"), F.col("value").alias("_from"), F.col("value").alias("_to"))
    wanted = times.select(key, F.col("t_s").cast("double").alias("t_s"))
    return _between(samples, wanted, key, bucket_s).select(
        key, "t_s", F.coalesce("stage", F.lit(0.0)).alias("stage"), F.lit(0.0).alias("xmom"), F.lit(0.0).alias("ymom"))


def _between(samples: DataFrame, wanted: DataFrame, key: str, bucket_s: int) -> DataFrame:
    """``wanted`` with its stage between the samples, null for a key without any.

    A sample has the value that the line before it ends at (``_to``) and the
    one that the line after it starts from (``_from``); they differ at a jump.
    """
    both = wanted.withColumn("_q", F.lit(1)).unionByName(samples.withColumn("_q", F.lit(0)), allowMissingColumns=True)
    fields = {"t": F.col("t_s"), "into": F.col("_to"), "out": F.col("_from")}
    # A sample sorts before a question of its own time, so that the question finds it going back.
    both = carry(both, [key], F.floor(F.col("t_s") / bucket_s), ["t_s", "_q"], fields, F.col("_q") == 0, "_before", "_after")
    b, a = F.col("_before"), F.col("_after")
    share = (F.col("t_s") - b["t"]) / F.nullif(a["t"] - b["t"], F.lit(0.0))
    stage = (F.when(b.isNull(), a["into"]).when(a.isNull() | (a["t"] == b["t"]), b["out"])
             .otherwise(b["out"] + (a["into"] - b["out"]) * share))
    return both.where("_q = 1").select(*wanted.columns, stage.alias("stage"))


def _time_features(features: DataFrame, package: str, index: str, data: str) -> DataFrame:
    """The first Time feature of each package: status, constant, samples and the number of its Time features."""
    one = features.select(package, F.col(index).alias("feature_id"), F.col(data).alias("_data"))
    first = one.groupBy(package).agg(
        F.min_by(F.struct("feature_id", "_data"), F.struct(F.col("feature_id").isNull(), "feature_id", "_data")).alias("_f"),
        F.count(F.lit(1)).alias("n_features"))
    told = classify_forcing(first.select(package, "_f.*", "n_features"), "_data")
    samples = F.transform("series", lambda r, i: F.struct(
        i.alias("at"), F.unix_micros(F.try_to_timestamp(r["timestamp"])).alias("us"), r["value"].alias("value")))
    told = told.withColumn("samples", F.when(F.col("kind") == "series", samples))
    listed = F.substring(F.ltrim("_data"), 1, 1) == "["
    status = (F.when(F.col("kind") == "missing", F.lit("no data"))
              .when(F.col("kind") == "constant", F.lit("ok"))
              .when((F.col("kind") == "series") & F.forall("samples", lambda r: r["us"].isNotNull()), F.lit("ok"))
              .when(~listed, F.lit("not a number"))
              .when(F.col("series").isNull() | (F.size("series") == 0), F.lit("no list of samples"))
              .otherwise(F.lit("sample without time or value")))
    return told.withColumn("status", status).drop("series", "_data")


def time_boundary(features: DataFrame, times: DataFrame, package: str = "package_id", index: str = "feature_id",
                  data: str = "data", bucket_s: int = 86400) -> DataFrame:
    """Stage and momentum that the Time boundary of each package imposes at ``t_s`` seconds.

    ``data`` of a feature is JSON text: a number, a numeric text, a list of
    timestamp and value, or null. The feature with the lowest index counts, a
    null index last. Of a list, seconds count from its first sample; the stage
    is linear in between and constant beyond both ends, and at a time listed
    twice it jumps to the later entry. Missing data is a stage of 0; wrong data,
    no feature at all, or a null time in a series give null. ``status`` tells
    which. Columns of ``times`` are kept, one row each.
    """
    told = _time_features(features, package, index, data)
    samples = (told.where("status = 'ok'").select(package, F.element_at("samples", 1)["us"].alias("_t0"), F.explode("samples").alias("_s"))
               .groupBy(package, ((F.col("_s.us") - F.col("_t0")) / 1e6).alias("t_s"))
               .agg(F.min_by("_s.value", "_s.at").alias("_to"), F.max_by("_s.value", "_s.at").alias("_from")))
    told = told.select(package, F.col("kind").alias("_kind"), F.col("constant").alias("_constant"), F.col("status").alias("status"))
    wanted = times.withColumn("t_s", F.col("t_s").cast("double")).join(told, package, "left")
    stage = (F.when(F.col("_kind") == "constant", F.col("_constant")).when(F.col("_kind") == "missing", F.lit(0.0))
             .when(F.col("t_s").isNotNull(), F.col("stage")))
    rest = [c for c in times.columns if c not in (package, "t_s")]
    return (_between(samples, wanted, package, bucket_s).withColumn("stage", stage)
            .withColumn("_m", F.when(F.col("stage").isNotNull(), F.lit(0.0)))
            .select(package, "t_s", *rest, "stage", F.col("_m").alias("xmom"), F.col("_m").alias("ymom"),
                    F.coalesce("status", F.lit("no feature")).alias("status")))


def time_boundary_issues(features: DataFrame, packages: DataFrame, package: str = "package_id", index: str = "feature_id",
                         data: str = "data") -> DataFrame:
    """What is wrong with the Time boundary of each of ``packages``, one row per reason.

    An error leaves the boundary without a value, or at 0 where data is
    missing; several features are a warning, as only the first counts.
    """
    told = packages.select(package).distinct().join(_time_features(features, package, index, data), package, "left")
    status = F.coalesce(F.col("status"), F.lit("no feature"))
    reasons = F.array_compact(F.array(
        F.when(status != "ok", F.struct(F.lit("error").alias("severity"), status.alias("reason"))),
        F.when(F.col("n_features") > 1, F.struct(F.lit("warning").alias("severity"), F.lit("several features").alias("reason")))))
    return told.select(package, "feature_id", F.explode(reasons).alias("_r")).select(package, "feature_id", "_r.*")


def forcing_volume(runs: DataFrame, kind: Column, area: Column, step_s: int = 1, key: str = "series_id") -> DataFrame:
    """Water volume per series from its runs of equal value (see forcing_anchors).

    Rain is a rate in mm/h over an area, inflow a discharge, and a catchment
    takes out the rain that falls on it. The last grid time closes the window.
    """
    steps = F.least(F.col("to_step") + 1, F.col("n_steps")) - F.col("from_step")
    factor = (F.when(kind == "rainfall", area * F.lit(S.RAINFALL_FACTOR))
              .when(kind == "catchment", area * F.lit(-S.RAINFALL_FACTOR)).otherwise(F.lit(1.0)))
    return runs.groupBy(key).agg(
        F.coalesce(F.sum(F.col("value") * steps * step_s * factor), F.lit(0.0)).alias("expected_m3"))


def mass_balance(expected: DataFrame, observed: DataFrame, tolerance: float = 0.02, key: str = "series_id") -> DataFrame:
    """Relative error of the observed volume and whether it stays within tolerance."""
    both = expected.join(observed, key)
    error = F.when(F.col("expected_m3") == 0, F.when(F.col("observed_m3") == 0, F.lit(0.0))).otherwise(
        F.abs(F.col("observed_m3") - F.col("expected_m3")) / F.abs("expected_m3"))
    return both.withColumn("relative_error", error).withColumn(
        "passed", F.coalesce(F.col("relative_error") <= tolerance, F.lit(False)))


def apply_user_forcing(times: DataFrame, value: Column, out: str = "value") -> DataFrame:
    """A user's own forcing: any Column expression, or a pandas UDF, of the times' columns."""
    return times.withColumn(out, value)


