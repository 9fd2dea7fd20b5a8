"""Domain tables derived from the given tables.

The text of each view runs unchanged in Spark SQL and in the checking engine;
``{name}`` stands for a table or another view. Everything grows with the
tables: more suppliers are more runs, zones and lines over a longer strip of
land, so the density of places stays the same at any scale.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.inputs import diamond

VIEWS: dict[str, str] = {}

VIEWS["p_cell_state"] = """
SELECT l_suppkey AS run_id, CAST(l_linenumber * 60 AS BIGINT) AS t,
       l_partkey AS cell_id,
       l_quantity / CAST(10 AS DOUBLE) AS stage, l_discount * CAST(40 AS DOUBLE) AS elevation,
       l_tax * CAST(10 AS DOUBLE) AS xmom, l_discount * CAST(10 AS DOUBLE) AS ymom,
       CAST(1 + l_partkey % 50 AS DOUBLE) AS area,
       CAST(1 + l_partkey % 20 AS DOUBLE) / CAST(20 AS DOUBLE) AS inradius,
       CAST(l_partkey % 50 * 10 AS DOUBLE) AS x,
       CAST(floor(l_partkey / CAST(50 AS DOUBLE)) * 10 AS DOUBLE) AS y,
       l_returnflag <> 'N' AS is_full,
       CAST(10 + (l_suppkey * 7 + l_linenumber * 60) % 5 AS DOUBLE)
         / CAST(CASE WHEN l_suppkey % 7 = 0 THEN 10000 ELSE 100 END AS DOUBLE) AS dt
FROM {lineitem}"""

VIEWS["p_vertices"] = """
SELECT CAST(floor(p_partkey / CAST(500 AS DOUBLE)) AS BIGINT) AS mesh_id, p_partkey AS vid,
       CAST(p_partkey % 50 * 10 AS DOUBLE) + CAST(p_size % 7 AS DOUBLE) / CAST(2 AS DOUBLE) AS x,
       CAST(floor(p_partkey / CAST(50 AS DOUBLE)) * 10 AS DOUBLE) + CAST(p_size % 5 AS DOUBLE) / CAST(2 AS DOUBLE) AS y,
       CAST(p_size AS DOUBLE) / CAST(10 AS DOUBLE) AS elevation
FROM {part}"""

VIEWS["p_grid"] = """
SELECT p_partkey AS vid, CAST(floor(p_partkey / CAST(500 AS DOUBLE)) AS BIGINT) AS mesh_id,
       CAST(floor(p_partkey / CAST(50 AS DOUBLE)) AS BIGINT) AS grid_row, CAST(p_partkey % 50 AS BIGINT) AS grid_col
FROM {part}"""

VIEWS["p_triangles"] = """
SELECT a.mesh_id, a.vid * 2 AS tid, a.vid AS v0, a.vid + 1 AS v1, a.vid + 50 AS v2
FROM {p_grid} a JOIN {p_grid} d ON d.mesh_id = a.mesh_id AND d.grid_row = a.grid_row + 1 AND d.grid_col = a.grid_col + 1
UNION ALL
SELECT a.mesh_id, a.vid * 2 + 1 AS tid, a.vid + 1 AS v0, a.vid + 51 AS v1, a.vid + 50 AS v2
FROM {p_grid} a JOIN {p_grid} d ON d.mesh_id = a.mesh_id AND d.grid_row = a.grid_row + 1 AND d.grid_col = a.grid_col + 1"""

VIEWS["p_zones"] = """
SELECT s_suppkey AS zone_id, CAST(s_suppkey AS BIGINT) AS package_id,
       CAST(s_suppkey % 5 * 100 + 50 AS DOUBLE) AS cx,
       CAST(floor(s_suppkey / CAST(5 AS DOUBLE)) * 20 + 40 AS DOUBLE) AS cy,
       CAST(25 + s_suppkey % 7 * 7 AS DOUBLE) AS h,
       CASE WHEN s_suppkey % 9 = 8 THEN 'Fenced' WHEN s_suppkey % 4 = 0 THEN 'Mannings' WHEN s_suppkey % 4 = 1 THEN 'Raised'
            WHEN s_suppkey % 4 = 2 THEN 'Reflective' ELSE NULL END AS method,
       CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE CAST(s_suppkey % 25 AS DOUBLE) / CAST(4 AS DOUBLE) END AS raised_height,
       CAST(s_suppkey % 40 + 1 AS DOUBLE) / CAST(100 AS DOUBLE) AS mannings,
       CAST(5 + s_suppkey % 12 AS DOUBLE) AS resolution
FROM {supplier}"""

VIEWS["p_gauges"] = """
SELECT s_suppkey AS gauge_id,
       CAST(s_suppkey * 37 % 490 AS DOUBLE) + CAST(1 AS DOUBLE) / CAST(4 AS DOUBLE) AS x,
       CAST(floor(s_suppkey / CAST(10 AS DOUBLE)) * 40 + s_suppkey * 53 % 40 AS DOUBLE) + CAST(1 AS DOUBLE) / CAST(4 AS DOUBLE) AS y,
       CAST(2 + s_suppkey % 3 AS DOUBLE) AS field_stage, CAST(1 AS DOUBLE) AS tolerance
FROM {supplier}"""

VIEWS["p_lines"] = """
SELECT s_suppkey AS line_id, CAST(floor(s_suppkey / CAST(4 AS DOUBLE)) AS BIGINT) AS package_id,
       CASE WHEN s_suppkey % 11 = 10 THEN 'Internal' ELSE 'External' END AS location,
       concat('side', CAST(s_suppkey % 3 AS STRING)) AS boundary,
       CAST(s_suppkey % 4 AS DOUBLE) AS near_spacing,
       CAST(s_suppkey * 37 % 520 AS DOUBLE) AS x0,
       CAST((s_suppkey * 37 + 40 + s_suppkey % 30) % 520 AS DOUBLE) AS x1,
       CAST((s_suppkey * 37 + 2 * (40 + s_suppkey % 30)) % 520 AS DOUBLE) AS x2,
       CAST(floor(s_suppkey / CAST(10 AS DOUBLE)) * 40 + s_suppkey * 53 % 120 AS DOUBLE) AS y0,
       CAST(floor(s_suppkey / CAST(10 AS DOUBLE)) * 40 + (s_suppkey * 53 + 25 + s_suppkey % 20) % 120 AS DOUBLE) AS y1,
       CAST(floor(s_suppkey / CAST(10 AS DOUBLE)) * 40 + (s_suppkey * 53 + 2 * (25 + s_suppkey % 20)) % 120 AS DOUBLE) AS y2
FROM {supplier}"""

VIEWS["p_series"] = """
SELECT concat('u', CAST(user_id AS STRING)) AS series_id, date_trunc('hour', ts) AS ts, max_by(value, event_id) AS value
FROM {events} GROUP BY user_id, date_trunc('hour', ts)"""

VIEWS["p_windows"] = """
SELECT DISTINCT concat('u', CAST(user_id AS STRING)) AS series_id,
       CASE WHEN user_id % 10 = 3 THEN CAST('2034-01-01 00:00:00' AS TIMESTAMP)
            ELSE CAST('2024-01-02 00:00:00' AS TIMESTAMP) END AS start_ts,
       CAST(480 AS BIGINT) AS n_steps
FROM {events}"""

VIEWS["p_volumes"] = """
SELECT concat('u', CAST(user_id AS STRING)) AS series_id, sum(value) * CAST(36000 AS DOUBLE) AS observed_m3
FROM {events} GROUP BY user_id"""

VIEWS["p_scenarios"] = """
SELECT o_orderkey AS id, o_custkey AS project, CAST(o_orderkey % 7 AS BIGINT) AS run_id,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE concat('EPSG:',
            CASE o_orderkey % 3 WHEN 0 THEN '327' WHEN 1 THEN '326' ELSE '283' END,
            lpad(CAST(1 + o_orderkey % 60 AS STRING), 2, '0')) END AS epsg,
       CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE 'boundary.geojson' END AS boundary,
       CAST(floor(o_totalprice) AS BIGINT) AS duration,
       CASE WHEN o_orderkey % 17 = 0 THEN '2.0' WHEN o_orderkey % 19 = 0 THEN NULL ELSE '1.0' END AS format_version,
       CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(1 + o_orderkey % 20 AS DOUBLE) END AS resolution
FROM {orders}"""

VIEWS["p_files"] = """
SELECT o_custkey AS run_id, CAST(floor(o_totalprice) AS BIGINT) AS length,
       CAST(o_orderkey % 100 AS DOUBLE) AS min_x, CAST(o_orderkey % 90 AS DOUBLE) AS min_y,
       CAST(o_orderkey % 100 + 500 AS DOUBLE) AS max_x, CAST(o_orderkey % 90 + 400 AS DOUBLE) AS max_y,
       concat(CASE o_orderkey % 10 WHEN 0 THEN 'engine/' WHEN 1 THEN 'outputs_1/checkpoints/' WHEN 2 THEN ''
              ELSE 'outputs_1/' END,
              CASE o_orderkey % 9 WHEN 0 THEN 'package.zip' WHEN 1 THEN concat('run_', CAST(o_custkey AS STRING), '.sww')
              WHEN 2 THEN 'run_1.msh'
              WHEN 3 THEN concat('run_1_depth_Time_', lpad(CAST(o_orderkey % 100 * 60 AS STRING), 6, '0'), '.tif')
              WHEN 4 THEN concat('run_1_velocity_', lpad(CAST(o_orderkey % 100 * 60 AS STRING), 6, '0'), '.tif')
              WHEN 5 THEN concat('run_', CAST(o_custkey AS STRING), '_depth_max.tif') WHEN 6 THEN 'run_1_stage_max.tif'
              WHEN 7 THEN 'scenario.json' ELSE 'engine_1.log' END) AS path
FROM {orders}"""

VIEWS["p_phase_events"] = """
SELECT user_id AS run_id, ts, event_id AS seq,
       CASE event_type WHEN 'click' THEN 'mesh-gen' WHEN 'view' THEN 'raster-read' WHEN 'purchase' THEN 'evolve'
            WHEN 'signup' THEN 'cog-export' ELSE NULL END AS phase,
       value AS rss_mib
FROM {events}"""

VIEWS["p_progress"] = """
SELECT user_id AS run_id, ts, event_id AS seq,
       least(value / CAST(5 AS DOUBLE), CAST(100 AS DOUBLE)) AS pct, event_type AS status
FROM {events}"""

VIEWS["p_live_diagnostics"] = """
SELECT user_id AS run_id, ts, event_id AS seq, value / CAST(5 AS DOUBLE) AS implied_max_speed_ms
FROM {events}"""

VIEWS["p_resource_rows"] = """
SELECT CASE WHEN event_type = 'error' THEN NULL ELSE concat('job-', CAST(user_id AS STRING)) END AS job_id,
       event_type <> 'purchase' AS partial, ts, event_id AS seq, value AS peak_mib
FROM {events}"""

VIEWS["p_log"] = """
SELECT run_id, ts, seq,
       CASE seq % 6 WHEN 0 THEN concat('status: ', status)
            WHEN 1 THEN concat('metric: memory_used=', CAST(seq AS STRING))
            WHEN 2 THEN concat('file: raster -> outputs/run_1_1_', CAST(run_id AS STRING), '_depth_max.tif')
            WHEN 3 THEN concat('heartbeat: ', CAST(CAST(floor(pct) AS BIGINT) AS STRING), '.0% complete',
                 CASE WHEN seq % 4 = 1 THEN '' ELSE concat(', eta=', CAST(seq % 1000 AS STRING), 's') END)
            WHEN 4 THEN concat(CAST(CAST(floor(pct) AS BIGINT) AS STRING), '.5% | 1m 20s | mem: 41.2% | disk: 7.0% | 2024-01-01T00:00:00 | steps=',
                 CAST(seq % 900 + 1 AS STRING), ' dt=', CAST(seq % 200 AS STRING), 'ms vmax=2.10m/s v_impl=2.2m/s wet=23% vol=', CAST(seq AS STRING), 'm3')
            ELSE 'Building domain...' END AS message
FROM {p_progress}"""

VIEWS["p_eta"] = """
SELECT o_orderkey AS id, CAST(o_orderkey % 1000 AS DOUBLE) AS t,
       CAST(CASE WHEN o_custkey % 2 = 0 THEN 1009 ELSE 1013 END AS DOUBLE) AS duration, o_totalprice / CAST(16 AS DOUBLE) AS elapsed
FROM {orders}"""

VIEWS["p_raster"] = """
SELECT CASE WHEN l_returnflag = 'R' THEN 'b' ELSE 'a' END AS raster_id,
       l_linenumber * CASE WHEN l_returnflag = 'R' THEN 50 ELSE 60 END AS step,
       CAST(floor(l_partkey / CAST(50 AS DOUBLE)) AS BIGINT) AS row_no, CAST(l_partkey % 50 AS BIGINT) AS col_no,
       max(CASE WHEN l_partkey % 17 = 0 THEN CAST(-9999 AS DOUBLE) WHEN l_partkey % 23 = 0 THEN CAST('NaN' AS DOUBLE)
                ELSE l_quantity END) AS value
FROM {lineitem} GROUP BY CASE WHEN l_returnflag = 'R' THEN 'b' ELSE 'a' END,
       l_linenumber * CASE WHEN l_returnflag = 'R' THEN 50 ELSE 60 END, l_partkey"""

VIEWS["p_manifests"] = """
SELECT c_custkey AS run_id,
       CASE WHEN c_custkey % 7 = 0 THEN '{{}}' WHEN c_custkey % 7 = 1 THEN 'not json'
            ELSE concat('{{"core":{{"git_url":"https://example.org/', c_name, '","sha":"', md5(c_name), '"}},"tool":{{"sha":',
                 CASE WHEN c_custkey % 3 = 0 THEN 'null' ELSE concat('"', md5(c_name), '"') END, '}}}}') END AS manifest,
       CASE WHEN c_custkey % 10 = 9 THEN '3.3.1' ELSE concat('3.3.1.dev1+g',
            CASE WHEN c_custkey % 4 = 0 THEN 'ffffffff' ELSE substr(md5(c_name), 1, 8) END) END AS installed_version
FROM {customer}"""

VIEWS["p_rainfall"] = """
SELECT c_custkey AS feature_id, CAST(floor(c_custkey * 2 / CAST(3 AS DOUBLE)) AS BIGINT) AS package_id,
       CASE c_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '50.0' WHEN 2 THEN '12' WHEN 3 THEN 'heavy' WHEN 4 THEN '[]'
            WHEN 5 THEN '"7.5"'
            ELSE '[{{"timestamp":"2024-01-01T00:00:00Z","value":1.5}},{{"timestamp":"2024-01-01T01:00:00Z","value":2.5}}]' END AS data
FROM {customer}"""

VIEWS["p_time_features"] = """
SELECT c_custkey AS feature_id, CAST(floor(c_custkey * 2 / CAST(3 AS DOUBLE)) AS BIGINT) AS package_id,
       CASE c_custkey % 8 WHEN 0 THEN NULL WHEN 1 THEN '2.5' WHEN 2 THEN '"4.5"' WHEN 3 THEN 'tide' WHEN 4 THEN '[]'
            WHEN 5 THEN '[{{"timestamp":"2024-01-01T00:00:00Z"}}]'
            ELSE concat('[{{"timestamp":"2024-01-01T00:00:00Z","value":', CAST(c_nationkey AS STRING),
                 '}},{{"timestamp":"2024-01-02T00:00:00Z","value":', CAST(c_custkey % 11 AS STRING),
                 '}},{{"timestamp":"2024-01-05T00:00:00Z","value":"', CAST(c_custkey % 13 AS STRING), '.25"}}]') END AS data
FROM {customer}"""

VIEWS["p_boundary_times"] = """
SELECT CAST(user_id AS BIGINT) AS package_id, event_id,
       CAST(event_id * 37 % 518400 - 43200 AS DOUBLE) + CAST(1 AS DOUBLE) / CAST(8 AS DOUBLE) AS t_s
FROM {events}"""

VIEWS["p_features"] = """
SELECT c_custkey AS run_id, concat('{{"triangle_count":', CAST(100 + c_nationkey * 7 AS STRING), ',"min_area":', CAST(c_custkey % 50 AS STRING), '.5}}') AS bag
FROM {customer}"""


def _names(text: str) -> list[str]:
    """Tables and views a view stands on, in order of first use."""
    return list(dict.fromkeys(re.findall(r"(?<!\{)\{(\w+)\}", text)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*[F.col(f.name).cast("timestamp").alias(f.name) if f.dataType.typeName().startswith("timestamp")
                       else F.col(f.name) for f in df.schema.fields])


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    df = spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}*.parquet")
    return df.select(*[F.col(f.name).cast("timestamp").alias(f.name) if f.dataType.typeName().startswith("timestamp")
                       else F.col(f.name) for f in schema.fields])


def view(spark: SparkSession, sf_dir: str, name: str, stream: bool = False) -> DataFrame:
    text = VIEWS[name]
    inputs = {n: view(spark, sf_dir, n, stream) if n in VIEWS else (table_stream if stream else table)(spark, sf_dir, n)
              for n in _names(text)}
    return spark.sql(text, **inputs)


def with_views(names: str, body: str) -> str:
    """Checking SQL: the views the body needs as common table expressions, then the body."""
    order: list[str] = []

    def add(name: str) -> None:
        if name not in VIEWS or name in order:
            return
        for inner in _names(VIEWS[name]):
            add(inner)
        order.append(name)

    for name in names.split():
        add(name)
    parts = []
    for name in order:
        text = VIEWS[name]
        parts.append(f"{name} AS ({text.format(**{n: n for n in _names(text)})})")
    head = "WITH RECURSIVE " + ",\n".join(parts)
    body = body.strip()
    return f"{head},\n{body[5:]}" if body.upper().startswith("WITH ") else f"{head}\n{body}"


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "p_zones").withColumn("ring", diamond(F.col("cx"), F.col("cy"), F.col("h")))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = F.array(*[F.struct(F.col(f"x{i}").alias("x"), F.col(f"y{i}").alias("y")) for i in range(3)])
    raw = view(spark, sf_dir, "p_lines")
    return raw.withColumn("line", points).drop(*[f"{c}{i}" for c in "xy" for i in range(3)])
