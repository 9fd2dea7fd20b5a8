"""Sources and sinks as Spark reads and writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..functions import epsg_code, flatten_line, geometry_point, outer_ring
from ..operators.ordered import number_rows

__all__ = ["read_scenarios", "read_features", "read_feature_files", "with_properties", "read_mesh", "read_vertex_states", "read_diagnostics",
           "diagnostics_stream", "write_diagnostics", "read_run_summaries", "write_run_summaries",
           "nest_run_summary", "read_point_csv", "read_observations", "ring_of_points", "write_features",
           "file_inventory"]

SCENARIO_FIELDS = (
    "format_version", "id", "run_id", "project", "epsg", "boundary", "duration", "name", "description",
    "control_server", "elevation", "friction", "inflow", "rainfall", "structure", "mesh_region",
    "hydrology_status", "catchment", "nodes", "links", "network", "breakline", "store_mesh", "resolution",
    "max_rmse_tolerance", "model_start", "default_near_spacing", "default_raised_height",
)


def read_scenarios(spark: SparkSession, root: str) -> DataFrame:
    """Every ``scenario.json`` below ``root`` as one row.

    Fields stay text, as nothing in a package is trusted yet; ``raw`` keeps
    the file for keys outside the model. A file that is no JSON object is a
    row with ``valid`` false. Spark raises when ``root`` has no such file.
    """
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="scenario.json")
    path = F.col("_metadata.file_path")
    parsed = files.select(F.regexp_extract(path, r"([^/]+)/scenario\.json$", 1).alias("package"),
                          path.alias("path"), F.col("value").alias("raw"), F.try_parse_json("value").alias("_v"))
    kind = F.schema_of_variant("_v")
    fields = [F.try_variant_get("_v", f"$.{name}", "string").alias(name) for name in SCENARIO_FIELDS]
    return parsed.select("package", "path", "raw", F.coalesce(kind.startswith("OBJECT"), F.lit(False)).alias("valid"), *fields)


FEATURE_START = r',?\s*\{\s*"type"\s*:\s*$'
CRS_NAME = r'"crs"\s*:\s*\{[^{}]*"properties"\s*:\s*\{[^{}]*"name"\s*:\s*"([^"]*)"'
NUMBERS = ("raised_height", "mannings", "resolution", "near_spacing")
TEXTS = ("boundary", "location", "method", "data")


def read_feature_files(spark: SparkSession, root: str, glob: str = "*.geojson") -> DataFrame:
    """Features of all feature collections below ``root``: ``path``, ``crs``, ``feature_no`` and what ``with_properties`` adds.

    A file is split by byte range at the word that opens a feature, so one large file is many tasks; a quote inside a
    value is escaped and can't be taken for that word. Files whose features do not start with their type are read
    whole. Files without features give no rows. Geometry and properties stay JSON text beside the decoded columns.
    """
    options = {"recursiveFileLookup": True, "pathGlobFilter": glob}
    path = F.col("_metadata.file_path")
    raw = spark.read.option("lineSep", '"Feature"').text(root, **options).select(
        path.alias("path"), F.col("_metadata.file_block_start").alias("_at"), F.col("value").alias("_v"), F.monotonically_increasing_id().alias("_i"))
    opens = F.col("_v").rlike(FEATURE_START)
    ends = raw.groupBy("path").agg(F.count_if(~opens).alias("_closed"), F.count(F.lit(1)).alias("_n"))
    # Of n pieces all but the last must end where a feature starts.
    odd = [r["path"] for r in ends.where("_n > 1 AND _closed > 1").select("path").toLocalIterator()]
    pieces = number_rows(raw.where(~F.col("path").isin(odd)) if odd else raw, ["path"], F.col("_at"), [F.col("_i")], "_no")
    clean = F.regexp_replace("_v", FEATURE_START, "")
    split = pieces.where("_no > 1").select("path", (F.col("_no") - 2).alias("feature_no"), F.concat(F.lit('{"type":"Feature"'), clean).alias("_f"))
    # The reference system stands before the features, or after the last of them.
    last = F.regexp_extract("_v", r"\]\s*,\s*" + CRS_NAME, 1)
    named = pieces.select("path", F.nullif(F.when(F.col("_no") == 1, F.regexp_extract("_v", CRS_NAME, 1)).when(~opens, last), F.lit("")).alias("crs"))
    crs = named.where("crs IS NOT NULL").groupBy("path").agg(F.min("crs").alias("crs"))
    found = split.join(crs, "path", "left").select("path", "crs", "feature_no", "_f")
    if odd:
        shape = "struct<crs:struct<properties:struct<name:string>>,features:array<string>>"
        whole = spark.read.text(odd, wholetext=True).select(path.alias("path"), F.from_json("value", shape).alias("_c"))
        found = found.unionByName(whole.select("path", F.col("_c.crs.properties.name").alias("crs"), F.posexplode("_c.features").alias("feature_no", "_f")))
    return with_properties(found.withColumn("feature_no", F.col("feature_no").cast("int")))


def with_properties(features: DataFrame, text: str = "_f") -> DataFrame:
    """Columns of a feature's JSON ``text``: id, geometry and properties, the properties that operators use by their type,
    and the geometry as they take it: ``ring`` of a polygon, ``line`` of a line, ``x`` and ``y`` of a point."""
    prop = lambda name: F.get_json_object(text, f"$.properties.{name}")
    out = features.withColumns({
        "epsg_code": epsg_code(F.col("crs")), "feature_id": F.get_json_object(text, "$.id"), "geometry": F.get_json_object(text, "$.geometry"),
        "geom_type": F.get_json_object(text, "$.geometry.type"), "properties": F.get_json_object(text, "$.properties"),
        **{name: prop(name) for name in TEXTS}, **{name: prop(name).try_cast("double") for name in NUMBERS}}).drop(text)
    kind, shape = F.col("geom_type"), F.col("geometry")
    point = F.when(kind == "Point", geometry_point(shape))
    return (out.withColumn("ring", F.when(kind.isin("Polygon", "MultiPolygon"), outer_ring(shape)))
            .withColumn("line", F.when(kind.isin("LineString", "MultiLineString"), flatten_line(shape)))
            .withColumn("x", point["x"]).withColumn("y", point["y"]))


def read_features(spark: SparkSession, root: str, scenarios: DataFrame) -> DataFrame:
    """Features of the layers a scenario names and the package holds.

    The boundary layer is mandatory: a package without one is a row with
    ``status`` set and no feature. Columns are those of ``read_feature_files``.
    """
    features = read_feature_files(spark, root).withColumn("package", F.regexp_extract("path", r"([^/]+)/(?:inputs/)?[^/]+$", 1)).withColumn(
        "file", F.regexp_extract("path", r"([^/]+)$", 1))
    declared = scenarios.select("package", F.explode(F.array(*[
        F.struct(F.lit(layer).alias("layer"), F.col(layer).alias("file"))
        for layer in ("boundary", *S.LAYERS)])).alias("d")).select("package", "d.layer", "d.file").where(
        F.col("file").isNotNull() & (F.col("file") != ""))
    found = declared.join(features, ["package", "file"]).withColumn("status", F.lit("ok")).drop("file", "path")
    held = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.geojson").load(root).select(
        F.regexp_extract("path", r"([^/]+)/(?:inputs/)?[^/]+$", 1).alias("package"), F.regexp_extract("path", r"([^/]+)$", 1).alias("file"))
    named = declared.where("layer = 'boundary'").join(held, ["package", "file"], "left_semi").select("package")
    missing = scenarios.select("package").join(named, "package", "left_anti").withColumn("layer", F.lit("boundary")).withColumn(
        "status", F.lit("error: boundary layer missing"))
    return found.unionByName(missing, allowMissingColumns=True)


def read_mesh(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertex and triangle tables of a mesh store."""
    return spark.read.parquet(f"{path}/vertices"), spark.read.parquet(f"{path}/triangles")


def read_vertex_states(spark: SparkSession, path: str) -> DataFrame:
    """Vertex states over time, partitioned by run and step so both prune."""
    return spark.read.parquet(path)


def _named_batch(df: DataFrame) -> DataFrame:
    path = F.col("_metadata.file_path")
    own = lambda name: [F.col(name)] if name in df.columns else []
    number = F.regexp_extract(path, r"(?:run_diagnostics_|batch_number=)(\d+)", 1).try_cast("bigint")
    run = F.regexp_extract(path, r"(?:outputs_|/run=)([^/]+)/", 1)
    return df.select(*[f.name for f in S.DIAGNOSTICS.fields], F.coalesce(*own("batch_number"), number).alias("batch_number"), F.coalesce(*own("run"), run).alias("run"))


NAMES = "run string, batch_number bigint"


def _csv(reader, schema=S.DIAGNOSTICS):
    return reader.schema(schema).option("header", True).option("comment", "#").option("recursiveFileLookup", True)


def read_diagnostics(spark: SparkSession, path: str) -> DataFrame:
    """Diagnostics files: a comment line with the mesh summary, a header, 14 columns.

    All layouts are read: ``outputs_<run>/run_diagnostics_<batch>`` and what ``write_diagnostics`` leaves, where
    run and batch number are folders or two more columns.
    """
    schema = T.StructType([*S.DIAGNOSTICS.fields, *T.StructType.fromDDL(NAMES).fields])
    return _named_batch(_csv(spark.read, schema).option("pathGlobFilter", "{run_diagnostics_*,part-*.csv}").csv(path))


def diagnostics_stream(spark: SparkSession, path: str) -> DataFrame:
    return _named_batch(_csv(spark.readStream).option("pathGlobFilter", "run_diagnostics_*").csv(path))


def write_diagnostics(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), named: bool = False) -> None:
    """Diagnostics as CSV below ``path``, each file with its header.

    For ``read_diagnostics`` to give ``run`` and ``batch_number`` back, partition by both: a folder and file each, for
    runs that others open one by one. Or let rows be ``named``: both become columns after the others, and the number of
    files follows the size of the table, not the number of runs.
    """
    fields = [f.name for f in S.DIAGNOSTICS.fields] + (["run", "batch_number"] if named else [])
    rows = df.select(*partition_by, *fields)
    # A folder's rows in one task make one file; dealt otherwise, every task would add one to every folder it has rows of.
    rows = rows.repartition(*partition_by) if partition_by else rows
    rows.write.mode("append").partitionBy(*partition_by).option("header", True).csv(path)


def read_run_summaries(spark: SparkSession, path: str) -> DataFrame:
    """Run summaries, nested as written, with ``status``.

    A file holds one document, over as many lines as it likes, or one document a line: it does where the first line that
    is not blank is an object, or another one is and the first opens neither an object nor an array. Every line of such
    a file that is not blank is a row. A document of another schema version, without one, or broken is a row whose
    status says so.
    """
    found = lambda reader: reader.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json")
    name = F.col("_metadata.file_path").alias("_file")
    sound = F.coalesce(F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT"), F.lit(False)) & F.col("value").rlike(r"\}\s*$")
    lines = found(spark.read).text(path).select(
        name, "value", F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq")).alias("_at"),
        sound.alias("_sound")).where(F.col("value").rlike(r"\S"))
    first = F.min_by(F.struct(F.regexp_replace("value", r"^\s+|\s+$", "").alias("text"), "_sound"), "_at")
    by_lines = lines.groupBy("_file").agg(first.alias("_first"), F.max(F.col("_sound") & F.col("value").startswith("{")).alias("_any")).where(
        F.col("_first._sound") | (F.col("_any") & ~F.col("_first.text").startswith("[") & (F.col("_first.text") != "{"))).select("_file")
    by_line = lines.join(by_lines, "_file", "left_semi").select("_file", "_sound", F.from_json("value", S.RUN_SUMMARY).alias("_d")).select(
        "_file", "_sound", "_d.*")
    whole = found(spark.read.schema(S.RUN_SUMMARY).option("multiLine", True)).json(path).select("*", name, F.lit(True).alias("_sound"))
    rows = by_line.unionByName(whole.join(by_lines, "_file", "left_anti"))
    known = F.col("schema_version") == S.SUMMARY_SCHEMA_VERSION
    status = F.when(~F.col("_sound"), F.lit("error: broken JSON")).when(known, F.lit("ok")).otherwise(
        F.concat(F.lit("error: schema version "), F.coalesce("schema_version", F.lit("missing"))))
    return rows.withColumn("status", status).drop("_file", "_sound")


def nest_run_summary(flat: DataFrame) -> DataFrame:
    """Nests flat summary columns into the summary document; absent ones are null."""
    have = set(flat.columns)
    parts = [F.lit(S.SUMMARY_SCHEMA_VERSION).alias("schema_version")]
    for group in S.RUN_SUMMARY.fields[1:]:
        parts.append(F.struct(*[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in group.dataType.fields]).alias(group.name))
    return flat.select(*parts)


def write_run_summaries(summaries: DataFrame, path: str) -> None:
    summaries.write.mode("append").json(path)


def read_point_csv(spark: SparkSession, path: str) -> DataFrame:
    """Two-column CSV without header; rows that are not two numbers are skipped.

    ``block`` and ``seq`` give the order within a file, also of one read in several splits.
    """
    raw = spark.read.option("header", False).option("mode", "PERMISSIVE").schema("a string, b string, c string").csv(path)
    x, y = F.trim("a").try_cast("double"), F.trim("b").try_cast("double")
    return (raw.select(x.alias("x"), y.alias("y"), F.col("_metadata.file_name").alias("file"),
                       F.col("_metadata.file_block_start").alias("block"))
            .withColumn("seq", F.monotonically_increasing_id()).where(F.col("x").isNotNull() & F.col("y").isNotNull()))


def ring_of_points(points: DataFrame, key: str = "file") -> DataFrame:
    """Closed ring per file; one file is one polygon and so one row by the data model."""
    from ..functions import close_ring

    ordered = points.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("block", "seq", "x", "y"))).alias("_p"))
    ring = F.transform("_p", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    return ordered.select(key, close_ring(ring).alias("ring"))


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """Observation CSV whose header names carry padding."""
    raw = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option(
        "ignoreTrailingWhiteSpace", True).csv(path)
    return raw.select(*[F.trim(F.col(f"`{c}`")).try_cast("double").alias(c.strip()) for c in raw.columns])


def write_features(features: DataFrame, path: str, package: str = "package") -> None:
    """GeoJSON features, one text line each, appended under their package's partition."""
    features.select(package, F.col("feature").alias("value")).write.mode("append").partitionBy(package).text(path)


def file_inventory(spark: SparkSession, root: str, run: str | None = None) -> DataFrame:
    """Every file below ``root`` with size and time; contents are not read.

    With ``run``, the folders right below the root are runs: a column of that
    name holds the folder, ``path`` is what follows it, and files beside the
    folders are left out. So the result goes straight into ``package_members``,
    ``package_report`` and ``archive_gaps``.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(
        "path", "length", "modificationTime")
    if run is None:
        return files
    top = root.rstrip("/") + "/"
    at = F.locate(top, F.col("path")) + len(top)
    parts = files.withColumn("_below", F.col("path").substr(at, F.length("path"))).where(F.instr("_below", "/") > 1)
    return parts.select(F.substring_index("_below", "/", 1).alias(run),
                        F.expr("substring(_below, locate('/', _below) + 1)").alias("path"), "length", "modificationTime")
