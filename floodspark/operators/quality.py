"""Rules over scenario packages, one output row per broken rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S


def _whole_number(value: Column) -> Column:
    number = value.cast("string").try_cast("double")
    return number.isNotNull() & (number == F.floor(number))


def validate_scenarios(scenarios: DataFrame, profile: str = "run", key: str = "id",
                       features: DataFrame | None = None, package: str = "package") -> DataFrame:
    """Broken rules per scenario: (key, field, rule).

    A null field means an absent key. Where ``raw`` (the file's JSON text) is
    present, it tells types: a number where text belongs breaks the rule of the
    type, and so does an explicit null where the field may not be null.
    ``profile="report"`` adds what a run that reports back needs.
    """
    have = set(scenarios.columns)
    rules: list[tuple[str, str, Column]] = []

    def rule(field: str, name: str, broken: Column) -> None:
        rules.append((field, name, F.coalesce(broken, F.lit(False))))

    parsed = F.try_parse_json("raw") if "raw" in have else None

    def kind(field: str) -> Column:
        """The JSON type of a field; null where its key is absent or there is no raw text."""
        return F.lit(None).cast("string") if parsed is None else F.schema_of_variant(F.try_variant_get(parsed, f"$.{field}", "variant"))

    for field in ("epsg", "boundary", "duration"):
        rule(field, "required", F.col(field).isNull() if field in have else F.lit(True))
    for field in S.INTEGER_FIELDS:
        if field in have:
            rule(field, "integer", F.col(field).isNotNull() & ~_whole_number(F.col(field)))
    for field in S.OPTIONAL_NUMBER_FIELDS:
        if field in have:
            rule(field, "number", F.col(field).isNotNull() & F.col(field).cast("string").try_cast("double").isNull())
    if "store_mesh" in have:
        rule("store_mesh", "boolean", F.col("store_mesh").isNotNull()
             & F.col("store_mesh").cast("string").try_cast("boolean").isNull())
    if "format_version" in have:
        rule("format_version", "supported", F.col("format_version").isNotNull() & (F.col("format_version") != S.FORMAT_VERSION))
    if parsed is not None:
        nested = lambda k: k.startswith("OBJECT") | k.startswith("ARRAY")
        for fields, name, wrong in (
                (S.TEXT_FIELDS, "text", lambda k: k != "STRING"),
                (S.OPTIONAL_TEXT_FIELDS, "text", lambda k: ~k.isin("STRING", "VOID")),
                (S.INTEGER_FIELDS, "integer", lambda k: nested(k) | (k == "VOID")),
                (S.OPTIONAL_NUMBER_FIELDS, "number", nested),
                (("store_mesh",), "boolean", lambda k: nested(k) | (k == "VOID"))):
            for field in fields:
                rule(field, name, wrong(kind(field)))
    if profile == "report":
        for field in ("run_id", "project", "id"):
            value = F.col(field).cast("string").try_cast("bigint") if field in have else F.lit(None).cast("bigint")
            rule(field, "reportable", F.coalesce(value, F.lit(0)) == 0)
        server = F.col("control_server") if "control_server" in have else F.lit(None).cast("string")
        rule("control_server", "reportable", F.coalesce(server, F.lit("")) == "")
    if features is not None:
        filled = features.where(F.col("layer") == "boundary").select(package).distinct().withColumn("_has", F.lit(True))
        scenarios = scenarios.join(filled, package, "left")
        rule("boundary", "features", F.col("_has").isNull())
    broken = F.array_distinct(F.array_compact(F.array(*[
        F.when(c, F.struct(F.lit(f).alias("field"), F.lit(n).alias("rule"))) for f, n, c in rules])))
    return scenarios.select(key, F.explode(broken).alias("b")).select(key, "b.field", "b.rule")
