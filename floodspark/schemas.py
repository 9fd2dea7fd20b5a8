"""Fixed schemas and constants of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

# Results depend on them.
BURN_HEIGHT_M = 5.0
BUILDING_MANNINGS_N = 10.0
DEFAULT_MANNINGS_N = 0.04
RAINFALL_FACTOR = 1.0 / (1000.0 * 3600.0)
MIN_STORABLE_HEIGHT_M = 0.005
MIN_ALLOWED_HEIGHT_M = 1.0e-5
MAX_YIELD_STEPS = 100
MIN_YIELD_STEP_S = 60
MAX_YIELD_STEP_S = 1800
K_NEAREST = 3
WET_THRESHOLD_M = 1.0e-3
INSTABILITY_SPEED_MS = 20.0
SLIVER_ANGLE_DEG = 10.0
MIN_SEGMENT_M = 0.5
COLLINEAR_FRACTION = 0.25
DEFAULT_NEAR_SPACING_M = 2.0
HEARTBEAT_S = 900
STUCK_AFTER_S = 3600
EDGE_EPS = 1.0e-10
AREA_BINS = 21
AREA_BIN_FLOOR = 1.0e-3
AREA_BIN_TOP = 1.0e7
SUMMARY_SCHEMA_VERSION = "1"
FORMAT_VERSION = "1.0"
DEFAULT_GRID_RESOLUTION_M = 1000.0

OUTPUT_QUANTITIES = ("depth", "velocity", "depthIntegratedVelocity", "stage")
ARCHIVED_MAX_QUANTITIES = ("depth", "velocity", "depthIntegratedVelocity")
LAYERS = (
    "friction", "inflow", "rainfall", "structure", "mesh_region",
    "network", "catchment", "nodes", "links", "breakline",
)
BUILD_PHASES = ("mesh-gen", "partition", "raster-read", "distribute")
SOLVE_PHASES = ("evolve",)
PUBLISH_PHASES = ("cog-export", "archive")

DIAGNOSTICS = T.StructType(
    [
        T.StructField("sim_time_s", T.DoubleType()),
        T.StructField("wall_time_s", T.DoubleType()),
        T.StructField("n_steps", T.LongType()),
        T.StructField("mean_dt_ms", T.DoubleType()),
        T.StructField("last_dt_ms", T.DoubleType()),
        T.StructField("implied_max_speed_ms", T.DoubleType()),
        T.StructField("wet_cells", T.LongType()),
        T.StructField("wet_fraction", T.DoubleType()),
        T.StructField("volume_m3", T.DoubleType()),
        T.StructField("max_depth_m", T.DoubleType()),
        T.StructField("max_speed_ms", T.DoubleType()),
        T.StructField("peak_speed_x", T.DoubleType()),
        T.StructField("peak_speed_y", T.DoubleType()),
        T.StructField("mem_mb", T.DoubleType()),
    ]
)


def _struct(**fields: str) -> T.StructType:
    kinds = {"s": T.StringType(), "l": T.LongType(), "d": T.DoubleType(), "b": T.BooleanType()}
    return T.StructType([T.StructField(k, kinds[v]) for k, v in fields.items()])


RUN_SUMMARY = T.StructType(
    [
        T.StructField("schema_version", T.StringType()),
        T.StructField("run", _struct(
            run_label="s", project="l", scenario="l", run_id="l", name="s", batch_number="l",
            started_at="s", finished_at="s", total_wall_time_s="d", outcome="s")),
        T.StructField("model", _struct(
            duration_s="d", final_sim_time_s="d", n_yieldsteps="l", yieldstep_s="d", epsg="s",
            resolution_m="d", flow_algorithm="s", cfl="d")),
        T.StructField("mesh", _struct(
            n_triangles="l", inradius_min_m="d", inradius_p5_m="d", inradius_median_m="d",
            min_angle_deg="d", worst_triangle_x="d", worst_triangle_y="d")),
        T.StructField("performance", _struct(
            total_wall_time_s="d", sim_per_wall_ratio="d", total_internal_steps="l",
            mean_steps_per_yieldstep="d", max_steps_per_yieldstep="l", mean_dt_ms="d",
            first_dt_ms="d", min_dt_ms="d", min_dt_at_sim_s="d", peak_mem_mb="d")),
        T.StructField("flow", _struct(
            final_wet_fraction="d", final_volume_m3="d", max_depth_m="d", max_speed_ms="d",
            peak_speed_x="d", peak_speed_y="d")),
        T.StructField("stability", _struct(
            stable="b", max_implied_speed_ms="d", max_implied_speed_at_sim_s="d",
            timestep_collapse_ratio="d", instability_threshold_ms="d")),
        T.StructField("environment", _struct(
            hostname="s", os="s", python_version="s", cpu_model="s", cpu_count_logical="l",
            cpu_count_physical="l", cpu_freq_max_mhz="d", total_ram_gb="d")),
    ]
)

# Fields of scenario.json by the JSON type they take.
TEXT_FIELDS = ("format_version", "epsg", "boundary")
OPTIONAL_TEXT_FIELDS = ("name", "description", "control_server", "elevation", "friction", "inflow", "rainfall", "structure",
                        "mesh_region", "hydrology_status", "catchment", "nodes", "links", "model_start", "breakline")
INTEGER_FIELDS = ("duration", "id", "run_id", "project")
OPTIONAL_NUMBER_FIELDS = ("resolution", "max_rmse_tolerance", "default_near_spacing")
