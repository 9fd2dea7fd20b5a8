"""Files of a run: names, packages, archives, catalogues, provenance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import (archive_prefix, file_name, parent_dirs, quantity_of, result_zip_name, run_label,
                         step_of, valid_time, version_sha)

# Directories whose whole subtree stays out of a result package.
# The runner's own source directory is the caller's to name, see ``source_dir``.
EXCLUDED_DIRS = ("checkpoints", "videos")


def with_run_names(df: DataFrame, project: str = "project", scenario: str = "id", run_id: str = "run_id") -> DataFrame:
    ids = (F.col(project), F.col(scenario), F.col(run_id))
    return (df.withColumn("run_label", run_label(*ids))
            .withColumn("output_dir", F.concat_ws("_", F.lit("outputs"), *ids))
            .withColumn("result_zip", result_zip_name(*ids)).withColumn("archive_prefix", archive_prefix(*ids)))


def exclusion_reason(path: Column, result_zip: Column, source_dir: str = "engine") -> Column:
    """Why a file stays out of the result package; null when it goes in."""
    name = file_name(path)
    excluded = (source_dir, *EXCLUDED_DIRS)
    return (F.when(F.arrays_overlap(parent_dirs(path), F.array(*[F.lit(d) for d in excluded])), F.lit("directory"))
            .when((name == "package.zip") | (name == result_zip), F.lit("package"))
            .when(name.endswith(".sww"), F.lit("series")).when(name.endswith(".msh"), F.lit("mesh"))
            .when(name.endswith(".tif") & name.contains("_Time_"), F.lit("step raster")))


def package_members(files: DataFrame, result_zip: Column | None = None, source_dir: str = "engine") -> DataFrame:
    zip_name = F.lit(None).cast("string") if result_zip is None else result_zip
    reason = exclusion_reason(F.col("path"), F.coalesce(zip_name, F.lit("")), source_dir)
    return files.withColumn("reason", reason).withColumn("kept", F.col("reason").isNull())


def package_report(files: DataFrame, keys: Sequence[str] = ("run_id",), result_zip: Column | None = None,
                   source_dir: str = "engine") -> DataFrame:
    """Files and bytes kept and dropped by reason."""
    return package_members(files, result_zip, source_dir).withColumn("reason", F.coalesce("reason", F.lit("kept"))).groupBy(
        *keys, "reason").agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("n_bytes"))


def archive_gaps(runs: DataFrame, inventory: DataFrame, key: str = "run_id") -> DataFrame:
    """Objects a run's archive should hold and does not.

    ``runs`` has (key, run_label), ``inventory`` (key, path). A fixed list of
    six names per run, so the expected table is six times the runs.
    """
    label = F.col("run_label")
    names = F.array(F.concat(label, F.lit(".sww")), F.lit("package.zip"), F.lit("scenario.json"),
                    *[F.concat(label, F.lit(f"_{q}_max.tif")) for q in S.ARCHIVED_MAX_QUANTITIES])
    expected = runs.select(key, F.explode(names).alias("object_name"))
    present = inventory.select(key, file_name(F.col("path")).alias("object_name")).distinct()
    return expected.join(present, [key, "object_name"], "left_anti")


def catalogue_key(files: DataFrame, start: Column | None = None) -> DataFrame:
    """Adds quantity, step, is_max and, with a start time, valid_time of each raster."""
    out = (files.withColumn("quantity", quantity_of(F.col("path"))).withColumn("step", step_of(F.col("path")))
           .withColumn("is_max", F.contains(F.col("path"), F.lit("_max"))))
    return out if start is None else out.withColumn("valid_time", valid_time(start, F.col("step")))


def catalogue_extents(catalogue: DataFrame, key: str = "run_id") -> DataFrame:
    """Bounding box and time span per run and quantity, and per run (quantity null).

    Peak rasters do not count.
    """
    frames = catalogue.where(~F.col("is_max") & F.col("quantity").isNotNull() & F.col("step").isNotNull())
    return frames.rollup(key, "quantity").agg(
        F.count(F.lit(1)).alias("n_items"), F.min("min_x").alias("min_x"), F.min("min_y").alias("min_y"),
        F.max("max_x").alias("max_x"), F.max("max_y").alias("max_y"),
        F.min("valid_time").alias("first_time"), F.max("valid_time").alias("last_time")).where(F.col(key).isNotNull())


def catalogue_skips(runs: DataFrame, catalogue: DataFrame, key: str = "run_id", start: str = "model_start") -> DataFrame:
    """Runs left out of the catalogue, with the reason."""
    listed = catalogue.where(F.col("quantity").isNotNull()).select(key).distinct().withColumn("_has", F.lit(True))
    reason = (F.when(F.col(start).isNull(), F.lit("no start time")).when(F.col("_has").isNull(), F.lit("no quantities")))
    return runs.join(listed, key, "left").withColumn("reason", reason).where(F.col("reason").isNotNull()).select(key, "reason")


def check_provenance(manifests: DataFrame, sha: Column, installed_version: Column) -> DataFrame:
    """Adds provenance: match, mismatch (the manifest's value stands) or not checked."""
    built, here = F.lower(sha), F.lower(version_sha(installed_version))
    same = built.startswith(here) | here.startswith(built)
    return (manifests.withColumn("manifest_sha", sha).withColumn("installed_sha", version_sha(installed_version))
            .withColumn("provenance", F.when(built.isNull() | here.isNull(), F.lit("not checked"))
                        .when(same, F.lit("match")).otherwise(F.lit("mismatch"))))
