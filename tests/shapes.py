"""Rings, lines and points given as Python lists, as tables."""


def ring_rows(spark, rings, key="zone_id"):
    """Rings given as {key: [(x, y), ...]} as a table."""
    rows = [(k, [{"x": float(x), "y": float(y)} for x, y in pts]) for k, pts in rings.items()]
    return spark.createDataFrame(rows, f"{key} long, ring array<struct<x:double,y:double>>")


def line_rows(spark, lines, key="line_id", **extra):
    names = list(extra)
    rows = [(k, [{"x": float(x), "y": float(y)} for x, y in pts], *[extra[n].get(k) for n in names]) for k, pts in lines.items()]
    more = "".join(f", {n} double" for n in names)
    return spark.createDataFrame(rows, f"{key} long, line array<struct<x:double,y:double>>{more}")


def points(spark, rows, key="vid"):
    return spark.createDataFrame([(k, float(x), float(y)) for k, x, y in rows], f"{key} long, x double, y double")
