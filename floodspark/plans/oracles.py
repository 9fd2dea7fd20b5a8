"""Checking SQL per registered query: independent formulations over the same tables.

Spatial results use closed forms (every zone is a diamond, so a point is inside
where |x-cx| + |y-cy| < h), brute-force pairs or recursive queries instead of
the operators' bins and tiles.
"""

from __future__ import annotations

from .probes import with_views

ORACLES: dict[str, str] = {}


def oracle(name: str, views: str, body: str) -> None:
    ORACLES[name] = with_views(views, body)


def r6(expr: str, alias: str = "") -> str:
    return f"round({expr}, 6) + 0.0" + (f" AS {alias}" if alias else "")


_SPEED = "sqrt(xmom / greatest(depth, 0.001) * (xmom / greatest(depth, 0.001)) + ymom / greatest(depth, 0.001) * (ymom / greatest(depth, 0.001)))"
_FLOW = f"""
c AS (SELECT *, stage - elevation AS depth, (stage - elevation > 0.001 AND is_full) AS wet FROM p_cell_state),
s AS (SELECT *, CASE WHEN wet THEN {_SPEED} END AS speed FROM c),
flow AS (SELECT run_id, t, count(*) FILTER (WHERE wet) AS wet_cells,
  count(*) FILTER (WHERE wet) / CAST(greatest(1, count(*) FILTER (WHERE is_full)) AS DOUBLE) AS wet_fraction,
  coalesce(sum(depth * area) FILTER (WHERE wet), 0.0) AS volume_m3,
  coalesce(max(depth) FILTER (WHERE is_full), 0.0) AS max_depth_m, coalesce(max(speed), 0.0) AS max_speed_ms,
  coalesce((list(x ORDER BY speed DESC, cell_id) FILTER (WHERE wet))[1], 0.0) AS peak_speed_x,
  coalesce((list(y ORDER BY speed DESC, cell_id) FILTER (WHERE wet))[1], 0.0) AS peak_speed_y,
  coalesce(CAST(0.9 AS DOUBLE) * min(inradius) FILTER (WHERE wet) / greatest(max(dt), CAST(1e-12 AS DOUBLE)), 0.0) AS implied_max_speed_ms,
  max(dt) * 1000.0 AS last_dt_ms
  FROM s GROUP BY run_id, t)"""
_FLOW_OUT = f"""
SELECT run_id, t, wet_cells, {r6('wet_fraction', 'wet_fraction')}, {r6('volume_m3', 'volume_m3')}, {r6('max_depth_m', 'max_depth_m')},
  {r6('max_speed_ms', 'max_speed_ms')}, {r6('peak_speed_x', 'peak_speed_x')}, {r6('peak_speed_y', 'peak_speed_y')},
  {r6('implied_max_speed_ms', 'implied_max_speed_ms')}, {r6('last_dt_ms', 'last_dt_ms')} FROM flow"""
oracle("flow_diagnostics", "p_cell_state", f"WITH {_FLOW} {_FLOW_OUT}")
oracle("diagnostics_files", "p_cell_state", f"""WITH {_FLOW}
SELECT CAST(run_id AS STRING) AS run, CAST(floor(t / 3600) AS BIGINT) AS batch_number, wet_cells, {r6('CAST(t AS DOUBLE)', 'sim_time_s')},
  {r6('wet_fraction', 'wet_fraction')}, {r6('volume_m3', 'volume_m3')} FROM flow""")
ORACLES["diagnostics_sink"] = ORACLES["diagnostics_files"]
oracle("flow_diagnostics_live", "p_cell_state", f"WITH {_FLOW} {_FLOW_OUT}")

# The step counter grows evenly, so a delta is the counter's value less that of the latest earlier step.
_STEPS = f"""{_FLOW},
d AS (SELECT f.*, CAST(f.t / 60 AS BIGINT) * (50 + run_id % 13) AS total_steps FROM flow f),
steps AS (SELECT d.*, greatest(1, total_steps - coalesce((SELECT max(e.total_steps) FROM d e WHERE e.run_id = d.run_id AND e.t < d.t), 0)) AS n_steps FROM d)"""
oracle("step_deltas", "p_cell_state", f"""WITH {_STEPS}
SELECT run_id, t, CAST(total_steps AS BIGINT) AS total_steps, CAST(n_steps AS BIGINT) AS n_steps,
  {r6('60.0 / n_steps * 1000.0', 'mean_dt_ms')} FROM steps""")

_SUM = f"""{_STEPS},
rk AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY t) AS up, row_number() OVER (PARTITION BY run_id ORDER BY t DESC) AS down,
  row_number() OVER (PARTITION BY run_id ORDER BY last_dt_ms, t) AS slow, row_number() OVER (PARTITION BY run_id ORDER BY max_speed_ms DESC, t) AS fast,
  row_number() OVER (PARTITION BY run_id ORDER BY implied_max_speed_ms DESC, t) AS wild FROM steps),
sums AS (SELECT run_id, count(*) AS n_yieldsteps, CAST(max(t) AS DOUBLE) AS final_sim_time_s, CAST(sum(n_steps) AS BIGINT) AS total_internal_steps,
  CAST(max(n_steps) AS BIGINT) AS max_steps_per_yieldstep, sum(60.0 / n_steps * 1000.0 * n_steps) / sum(n_steps) AS mean_dt_ms,
  max(last_dt_ms) FILTER (WHERE up = 1) AS first_dt_ms, min(last_dt_ms) AS min_dt_ms, CAST(max(t) FILTER (WHERE slow = 1) AS DOUBLE) AS min_dt_at_sim_s,
  max(wet_fraction) FILTER (WHERE down = 1) AS final_wet_fraction, max(volume_m3) FILTER (WHERE down = 1) AS final_volume_m3,
  max(max_depth_m) AS max_depth_m, max(max_speed_ms) AS max_speed_ms, max(implied_max_speed_ms) AS max_implied_speed_ms,
  CAST(max(t) FILTER (WHERE wild = 1) AS DOUBLE) AS max_implied_speed_at_sim_s,
  CAST(CASE WHEN run_id % 3 = 0 THEN 420 ELSE 600 END AS DOUBLE) AS duration_s, CAST(sum(n_steps) AS DOUBLE) / 10.0 AS total_wall_time_s,
  max(peak_speed_x) FILTER (WHERE fast = 1) AS peak_speed_x, max(peak_speed_y) FILTER (WHERE fast = 1) AS peak_speed_y
  FROM rk GROUP BY run_id),
summary AS (SELECT *, CASE WHEN first_dt_ms > 0 THEN min_dt_ms / first_dt_ms ELSE 1.0 END AS timestep_collapse_ratio,
  max_implied_speed_ms < 20 AS stable, final_sim_time_s / total_wall_time_s AS sim_per_wall_ratio,
  CASE WHEN final_sim_time_s >= 0.99 * duration_s THEN 'completed' WHEN max_implied_speed_ms >= 20 THEN 'unstable' ELSE 'incomplete' END AS outcome FROM sums)"""
_doubles = ("final_sim_time_s mean_dt_ms first_dt_ms min_dt_ms min_dt_at_sim_s final_wet_fraction final_volume_m3 max_depth_m max_speed_ms "
            "max_implied_speed_ms max_implied_speed_at_sim_s duration_s total_wall_time_s peak_speed_x peak_speed_y timestep_collapse_ratio "
            "sim_per_wall_ratio").split()
oracle("run_summary", "p_cell_state", f"""WITH {_SUM}
SELECT run_id, n_yieldsteps, total_internal_steps, max_steps_per_yieldstep, stable, outcome, {', '.join(r6(c, c) for c in _doubles)} FROM summary""")
oracle("run_summary_documents", "p_cell_state", f"""WITH {_SUM}
SELECT concat('run_', CAST(run_id AS STRING)) AS run_label, outcome, n_yieldsteps, stable, {r6('min_dt_ms', 'min_dt_ms')}, '1' AS schema_version FROM summary""")
oracle("run_summary_files", "p_cell_state", f"""WITH {_SUM}
SELECT concat('run_', CAST(run_id AS STRING)) AS run_label, outcome, n_yieldsteps, stable, {r6('min_dt_ms', 'min_dt_ms')}, '1' AS schema_version, 'ok' AS status FROM summary""")
oracle("stalled_runs", "p_cell_state", f"""WITH {_SUM}
SELECT run_id, outcome, {r6('timestep_collapse_ratio', 'timestep_collapse_ratio')}, {r6('min_dt_at_sim_s', 'min_dt_at_sim_s')}, {r6('min_dt_ms', 'min_dt_ms')}
FROM summary WHERE outcome <> 'completed'""")
for _name, _key in (("throughput_by_resolution", "run_id % 3 AS resolution"),
                    ("compare_hosts", "concat('cpu', CAST(run_id % 2 AS STRING)) AS cpu_model")):
    oracle(_name, "p_cell_state", f"""WITH {_SUM}
SELECT {_key}, count(*) AS n_runs, {r6('avg(sim_per_wall_ratio)', 'avg_sim_per_wall')}, CAST(sum(total_internal_steps) AS BIGINT) AS total_internal_steps
FROM summary GROUP BY 1""")

oracle("clip_dry", "p_cell_state", f"""
SELECT run_id, count(*) FILTER (WHERE stage < elevation) AS n_clipped, {r6('sum(greatest(stage - elevation, 0.0))', 'depth_sum')}, count(*) AS n_cells
FROM p_cell_state GROUP BY run_id""")
_Q = """q AS (SELECT *, stage - elevation AS depth, CASE WHEN stage - elevation >= CAST(1e-5 AS DOUBLE)
  THEN sqrt(power(xmom / (stage - elevation), 2) + power(ymom / (stage - elevation), 2)) ELSE 0.0 END AS velocity FROM p_cell_state)"""
oracle("peak_envelope", "p_cell_state", f"""WITH {_Q}
SELECT run_id, cell_id, {r6('max(depth)', 'max_depth')}, {r6('max(velocity)', 'max_velocity')},
  {r6('max(depth * velocity)', '"max_depthIntegratedVelocity"')}, {r6('max(stage)', 'max_stage')} FROM q GROUP BY run_id, cell_id""")
oracle("output_quantities", "p_cell_state", f"""WITH {_Q}
SELECT run_id, t, {r6('sum(depth)', 'sum_depth')}, {r6('sum(velocity)', 'sum_velocity')}, {r6('sum(depth * velocity)', 'sum_div')},
  count(*) FILTER (WHERE velocity = 0) AS n_still FROM q GROUP BY run_id, t""")
oracle("progress_eta", "p_eta", """WITH e AS (SELECT id, round(t * 100.0 / duration, 1) AS pct, elapsed FROM p_eta)
SELECT id, pct + 0.0 AS pct, CASE WHEN pct > 0 THEN CAST(trunc(elapsed * (100.0 - pct) / pct) AS BIGINT) END AS eta_s FROM e""")

# Meshes
_TRI = """
t AS (SELECT q.mesh_id, q.tid, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1, c.x AS x2, c.y AS y2 FROM p_triangles q
  JOIN p_vertices a ON a.vid = q.v0 JOIN p_vertices b ON b.vid = q.v1 JOIN p_vertices c ON c.vid = q.v2),
m AS (SELECT *, sqrt(power(x1 - x0, 2) + power(y1 - y0, 2)) AS a, sqrt(power(x2 - x1, 2) + power(y2 - y1, 2)) AS b,
  sqrt(power(x0 - x2, 2) + power(y0 - y2, 2)) AS c, abs((x1 - x0) * (y2 - y0) - (x2 - x0) * (y1 - y0)) / 2 AS area FROM t),
g AS (SELECT *, degrees(acos(greatest(-1.0, least(1.0, (c*c + a*a - b*b) / (2*c*a))))) AS g0,
  degrees(acos(greatest(-1.0, least(1.0, (a*a + b*b - c*c) / (2*a*b))))) AS g1,
  degrees(acos(greatest(-1.0, least(1.0, (b*b + c*c - a*a) / (2*b*c))))) AS g2 FROM m)"""
oracle("mesh_qa", "p_vertices p_triangles", f"""WITH {_TRI},
n AS (SELECT mesh_id, count(*) AS node_count, count(*) - count(DISTINCT (round(x, 3), round(y, 3))) AS duplicate_node_count FROM p_vertices GROUP BY mesh_id),
k AS (SELECT mesh_id, count(*) AS triangle_count, min(least(g0, g1, g2)) AS lo, max(greatest(g0, g1, g2)) AS hi,
  count(*) FILTER (WHERE least(g0, g1, g2) < 10) AS sliver_count, max(greatest(a, b, c) / least(a, b, c)) AS ar,
  bool_or(least(a, b, c) < 1e-10) AS deg, min(area) AS mina FROM g GROUP BY mesh_id)
SELECT n.mesh_id, coalesce(triangle_count, 0) AS triangle_count, node_count, round(coalesce(lo, 0.0), 2) + 0.0 AS min_angle_deg,
  round(coalesce(hi, 0.0), 2) + 0.0 AS max_angle_deg, coalesce(sliver_count, 0) AS sliver_count, round(coalesce(ar, 0.0), 2) + 0.0 AS aspect_ratio_max,
  duplicate_node_count, coalesce(deg, false) AS has_degenerate_triangles, round(coalesce(mina, 0.0), 4) + 0.0 AS min_triangle_area
FROM n LEFT JOIN k ON k.mesh_id = n.mesh_id""")
oracle("area_histogram", "p_vertices p_triangles", f"""WITH {_TRI},
lo AS (SELECT mesh_id, greatest(min(area) * 0.1, 0.001) AS lo FROM m GROUP BY mesh_id),
e AS (SELECT mesh_id, CAST(i AS BIGINT) AS bin, power(10.0, log10(lo) + (7.0 - log10(lo)) / 21 * i) AS b0,
  power(10.0, log10(lo) + (7.0 - log10(lo)) / 21 * (i + 1)) AS b1 FROM lo, generate_series(0, 20) AS s(i))
SELECT e.mesh_id, bin, round(b0, 4) + 0.0 AS bin_lo, round(b1, 4) + 0.0 AS bin_hi,
  count(m.tid) AS count FROM e LEFT JOIN m ON m.mesh_id = e.mesh_id AND m.area >= b0 AND m.area < b1 GROUP BY e.mesh_id, bin, b0, b1""")
oracle("mesh_inradius_stats", "p_vertices p_triangles", f"""WITH {_TRI},
r AS (SELECT mesh_id, tid, (x0 + x1 + x2) / 3 AS x, (y0 + y1 + y2) / 3 AS y, 2 * area / (a + b + c) AS r, least(g0, g1, g2) AS ang FROM g),
w AS (SELECT *, row_number() OVER (PARTITION BY mesh_id ORDER BY round(r, 9), tid) AS k FROM r)
SELECT mesh_id, count(*) AS n_triangles, {r6('min(r)', 'inradius_min')}, {r6('quantile_cont(r, 0.05)', 'inradius_p5')},
  {r6('quantile_cont(r, 0.5)', 'inradius_median')}, {r6('min(ang)', 'min_angle_deg')},
  {r6('max(x) FILTER (WHERE k = 1)', 'worst_x')}, {r6('max(y) FILTER (WHERE k = 1)', 'worst_y')} FROM w GROUP BY mesh_id""")
oracle("mesh_wkt", "p_vertices p_triangles", f"""WITH {_TRI}
SELECT mesh_id, tid, format('POLYGON (({{:.1f}} {{:.1f}}, {{:.1f}} {{:.1f}}, {{:.1f}} {{:.1f}}, {{:.1f}} {{:.1f}}))', x0, y0, x1, y1, x2, y2, x0, y0) AS wkt FROM t""")
oracle("mesh_fingerprint", "p_vertices p_triangles", f"""WITH {_TRI},
k AS (SELECT mesh_id, unnest([[CAST(round(x0 * 1e6) AS BIGINT), CAST(round(y0 * 1e6) AS BIGINT)], [CAST(round(x1 * 1e6) AS BIGINT), CAST(round(y1 * 1e6) AS BIGINT)],
   [CAST(round(x2 * 1e6) AS BIGINT), CAST(round(y2 * 1e6) AS BIGINT)]]) AS p, tid FROM t),
h AS (SELECT mesh_id, tid, string_agg(concat(CAST(p[1] AS STRING), ',', CAST(p[2] AS STRING)), ';' ORDER BY p[1], p[2]) AS s FROM k GROUP BY mesh_id, tid),
f AS (SELECT mesh_id, count(*) AS triangle_count, CAST(sum(CAST(concat('0x', substr(md5(s), 1, 15)) AS BIGINT)) AS STRING) AS fp FROM h GROUP BY mesh_id),
n AS (SELECT mesh_id, count(*) AS node_count FROM p_vertices GROUP BY mesh_id)
SELECT n.mesh_id, node_count, coalesce(triangle_count, 0) AS triangle_count, coalesce(fp, '0') AS fingerprint FROM n LEFT JOIN f ON f.mesh_id = n.mesh_id""")
ORACLES["boundary_types"] = """SELECT l_suppkey AS run_id, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS boundary_types
FROM lineitem GROUP BY l_suppkey"""

# Spatial assignment
_IN = "abs(p.x - z.cx) + abs(p.y - z.cy) < z.h"
oracle("points_in_zones", "p_vertices p_zones", f"SELECT p.vid, z.zone_id FROM p_vertices p JOIN p_zones z ON {_IN}")
_LV = "lv AS (SELECT line_id, unnest([{'x': x0, 'y': y0}, {'x': x1, 'y': y1}, {'x': x2, 'y': y2}], recursive := true) FROM p_lines)"
oracle("lines_inside", "p_lines p_zones", f"""WITH {_LV},
h AS (SELECT p.line_id, z.zone_id, count(*) AS n_inside FROM lv p JOIN p_zones z ON {_IN} GROUP BY 1, 2)
SELECT line_id, zone_id, n_inside, n_inside = 3 AS inside, 'ok' AS status FROM h
UNION ALL SELECT line_id, NULL, 0, false, 'ok' FROM p_lines WHERE line_id NOT IN (SELECT line_id FROM h)""")
oracle("route_structures", "p_zones", """SELECT zone_id, method, CASE coalesce(method, '-') WHEN 'Reflective' THEN 'hole' WHEN 'Mannings' THEN 'friction'
  WHEN 'Raised' THEN 'elevation' WHEN '-' THEN 'ignored' ELSE 'unknown' END AS treatment FROM p_zones""")
oracle("assign_friction", "p_vertices p_zones", f"""
SELECT vid, {r6(f'''CASE WHEN EXISTS (SELECT 1 FROM p_zones z WHERE {_IN} AND z.method = 'Mannings') THEN 10.0
  ELSE coalesce((SELECT arg_min(z.mannings, z.zone_id) FROM p_zones z WHERE {_IN}), 0.04) END''', 'mannings')} FROM p_vertices p""")
oracle("assign_friction_raster", "p_vertices p_zones", f"""
SELECT vid, {r6(f'''CASE WHEN EXISTS (SELECT 1 FROM p_zones z WHERE {_IN} AND z.method = 'Mannings') THEN 10.0
  WHEN elevation >= 1 THEN elevation / 100 END''', 'mannings')} FROM p_vertices p""")
oracle("apply_raised", "p_vertices p_zones", f"""
SELECT p.vid, {r6('max(p.elevation) + coalesce(sum(CASE WHEN z.zone_id IS NOT NULL THEN coalesce(z.raised_height, 5.0) END), 0.0)', 'elevation')},
  {r6('coalesce(sum(CASE WHEN z.zone_id IS NOT NULL THEN coalesce(z.raised_height, 5.0) END), 0.0)', 'raised_by')}, count(z.zone_id) AS n_structures
FROM p_vertices p LEFT JOIN p_zones z ON {_IN} AND z.method = 'Raised' GROUP BY p.vid""")
_SAME = "p.vid % 2 = z.zone_id % 2"
oracle("assign_friction_fleet", "p_vertices p_zones", f"""
SELECT vid % 2 AS package_id, vid, {r6(f'''CASE WHEN EXISTS (SELECT 1 FROM p_zones z WHERE {_SAME} AND {_IN} AND z.method = 'Mannings') THEN 10.0
  ELSE coalesce((SELECT arg_min(z.mannings, z.zone_id) FROM p_zones z WHERE {_SAME} AND {_IN}), 0.04) END''', 'mannings')} FROM p_vertices p""")
oracle("apply_raised_fleet", "p_vertices p_zones", f"""
SELECT p.vid % 2 AS package_id, p.vid, {r6('max(p.elevation) + coalesce(sum(CASE WHEN z.zone_id IS NOT NULL THEN coalesce(z.raised_height, 5.0) END), 0.0)', 'elevation')},
  count(z.zone_id) AS n_structures
FROM p_vertices p LEFT JOIN p_zones z ON {_SAME} AND {_IN} AND z.method = 'Raised' GROUP BY p.vid""")
oracle("target_area_fleet", "p_vertices p_zones", f"""
SELECT p.vid % 2 AS package_id, p.vid, {r6('least(12.5, coalesce(min(z.resolution), 12.5))', 'target_area')} FROM p_vertices p LEFT JOIN p_zones z ON {_SAME} AND {_IN} GROUP BY p.vid""")
oracle("nearest_vertex_fleet", "p_gauges p_vertices", f"""
WITH near AS (SELECT g.gauge_id, v.vid, sqrt(power(v.x - g.x, 2) + power(v.y - g.y, 2)) AS distance,
  row_number() OVER (PARTITION BY g.gauge_id ORDER BY power(v.x - g.x, 2) + power(v.y - g.y, 2), v.vid) AS k
  FROM p_gauges g JOIN p_vertices v ON v.vid % 2 = g.gauge_id % 2)
SELECT gauge_id % 2 AS package_id, gauge_id, vid, {r6('distance', 'distance')}, 'ok' AS status FROM near WHERE k = 1""")
oracle("target_area", "p_vertices p_zones", f"""
SELECT p.vid, {r6('least(12.5, coalesce(min(z.resolution), 12.5))', 'target_area')} FROM p_vertices p LEFT JOIN p_zones z ON {_IN} GROUP BY p.vid""")
oracle("assign_nodes", "p_gauges p_zones", f"""
SELECT z.zone_id AS catchment_id, count(p.gauge_id) AS n_nodes, CASE WHEN count(p.gauge_id) = 1 THEN max(p.gauge_id) END AS node_id,
  CASE count(p.gauge_id) WHEN 0 THEN 'skipped: no node' WHEN 1 THEN 'ok' ELSE 'error: more than one node' END AS status
FROM p_zones z LEFT JOIN p_gauges p ON {_IN} GROUP BY z.zone_id""")
_SEG = """seg AS (SELECT line_id, 0 AS seg, near_spacing, x0 AS ax, y0 AS ay, x1 AS bx, y1 AS by_ FROM p_lines
  UNION ALL SELECT line_id, 1, near_spacing, x1, y1, x2, y2 FROM p_lines)"""
oracle("breakline_grading", "p_vertices p_lines", f"""WITH {_SEG},
f AS (SELECT p.vid, CASE WHEN near_spacing > 0 THEN near_spacing ELSE 2.0 END AS h, p.x, p.y, ax, ay, bx - ax AS dx, by_ - ay AS dy,
  greatest(0.0, least(1.0, CASE WHEN bx = ax AND by_ = ay THEN 0.0 ELSE ((p.x - ax) * (bx - ax) + (p.y - ay) * (by_ - ay)) / nullif(power(bx - ax, 2) + power(by_ - ay, 2), 0) END)) AS u
  FROM p_vertices p, seg),
d AS (SELECT vid, h, sqrt(power(x - ax - u * dx, 2) + power(y - ay - u * dy, 2)) AS d FROM f),
b AS (SELECT vid, d, h * power(2.0, k) AS band FROM d, generate_series(0, 6) AS s(k) WHERE h * power(2.0, k) < 20 AND d <= h * power(2.0, k))
SELECT vid, {r6('min(d)', 'distance')}, {r6('min(band) * min(band) * sqrt(3.0) / 4', 'target_area')} FROM b GROUP BY vid""")
# Inside a diamond along a segment: where all four half-planes hold, so one interval of t.
oracle("clip_lines", "p_lines p_zones", f"""WITH {_SEG},
hp AS (SELECT line_id, seg, zone_id, h, sqrt(power(bx - ax, 2) + power(by_ - ay, 2)) AS len,
  sx * (ax - cx) + sy * (ay - cy) AS c, sx * (bx - ax) + sy * (by_ - ay) AS m
  FROM seg, p_zones, (VALUES (1, 1), (1, -1), (-1, 1), (-1, -1)) s(sx, sy)),
iv AS (SELECT line_id, seg, zone_id, max(len) AS len, greatest(0.0, coalesce(max((h - c) / nullif(m, 0)) FILTER (WHERE m < 0), 0.0)) AS lo,
  least(1.0, coalesce(min((h - c) / nullif(m, 0)) FILTER (WHERE m > 0), 1.0)) AS hi,
  bool_and(m <> 0 OR c < h) AS ok FROM hp GROUP BY 1, 2, 3)
SELECT line_id, CAST(seg AS BIGINT) AS seg, zone_id, round(len * (hi - lo), 4) + 0.0 AS inside_length FROM iv
WHERE ok AND round(hi, 12) > round(lo, 12)""")
oracle("node_lines", "p_lines", f"""WITH {_SEG},
x AS (SELECT a.line_id AS al, a.seg AS asg, b.line_id AS bl, b.seg AS bsg, a.ax, a.ay, a.bx - a.ax AS dx, a.by_ - a.ay AS dy,
  ((b.ax - a.ax) * (b.by_ - b.ay) - (b.ay - a.ay) * (b.bx - b.ax)) / nullif((a.bx - a.ax) * (b.by_ - b.ay) - (a.by_ - a.ay) * (b.bx - b.ax), 0) AS t,
  ((b.ax - a.ax) * (a.by_ - a.ay) - (b.ay - a.ay) * (a.bx - a.ax)) / nullif((a.bx - a.ax) * (b.by_ - b.ay) - (a.by_ - a.ay) * (b.bx - b.ax), 0) AS u
  FROM seg a JOIN seg b ON (a.line_id, a.seg) <> (b.line_id, b.seg)),
c AS (SELECT al AS line_id, asg AS seg, count(DISTINCT (round(ax + t * dx, 5), round(ay + t * dy, 5))) AS n FROM x
  WHERE t > 1e-12 AND t < 1 - 1e-12 AND u >= 0 AND u <= 1 GROUP BY 1, 2)
SELECT s.line_id, CAST(s.seg AS BIGINT) AS seg, coalesce(n, 0) + 1 AS n_pieces, round(sqrt(power(bx - ax, 2) + power(by_ - ay, 2)), 4) + 0.0 AS length
FROM seg s LEFT JOIN c ON c.line_id = s.line_id AND c.seg = s.seg""")
oracle("densify_polyline", "p_lines", f"""WITH {_SEG},
n AS (SELECT *, greatest(1, CAST(ceil(sqrt(power(bx - ax, 2) + power(by_ - ay, 2)) / 10.0) AS BIGINT)) AS n FROM seg)
SELECT line_id, CAST(sum(n) + 1 AS BIGINT) AS n_vertices,
  {r6('sum(n * ax + (bx - ax) * (n - 1) / 2.0) + max(bx) FILTER (WHERE seg = 1)', 'sum_x')},
  {r6('sum(n * ay + (by_ - ay) * (n - 1) / 2.0) + max(by_) FILTER (WHERE seg = 1)', 'sum_y')} FROM n GROUP BY line_id""")
_D3 = """d AS (SELECT line_id, sqrt(power(x1 - x0, 2) + power(y1 - y0, 2)) AS a, sqrt(power(x2 - x1, 2) + power(y2 - y1, 2)) AS b,
  sqrt(power(x2 - x0, 2) + power(y2 - y0, 2)) AS c, abs((x2 - x0) * (y1 - y0) - (y2 - y0) * (x1 - x0)) AS cr FROM p_lines)"""
oracle("dedupe_polyline", "p_lines", f"""WITH {_D3},
k AS (SELECT line_id, CASE WHEN a >= 60 AND b >= 60 THEN 3 ELSE 2 END AS n, CASE WHEN a >= 60 AND b >= 60 THEN a + b ELSE c END AS len FROM d)
SELECT line_id, CAST(n AS BIGINT) AS n_vertices, {r6('len', 'length')} FROM k WHERE len >= 60""")
oracle("drop_collinear", "p_lines", f"""WITH {_D3},
k AS (SELECT line_id, a, b, c, CASE WHEN c > 0 THEN cr / nullif(c, 0) ELSE a END > 10 AS keep FROM d)
SELECT line_id, CAST(CASE WHEN keep THEN 3 ELSE 2 END AS BIGINT) AS n_vertices, {r6('CASE WHEN keep THEN a + b ELSE c END', 'length')} FROM k""")
# Two diamonds touch where their centres are no further apart, by |dx| + |dy|, than both half diagonals.
oracle("footprint_clusters", "p_zones", """WITH z AS (SELECT * FROM p_zones WHERE method = 'Reflective'),
e AS (SELECT a.zone_id AS a, b.zone_id AS b FROM z a JOIN z b ON abs(a.cx - b.cx) + abs(a.cy - b.cy) <= a.h + b.h),
reach AS (SELECT zone_id AS n, zone_id AS r FROM z UNION SELECT reach.n, e.b FROM reach JOIN e ON e.a = reach.r)
SELECT n AS zone_id, min(r) AS cluster FROM reach GROUP BY n""")
oracle("footprint_clusters_fleet", "p_zones", """WITH z AS (SELECT *, (zone_id // 4) % 2 AS pkg FROM p_zones WHERE method = 'Reflective'),
e AS (SELECT a.zone_id AS a, b.zone_id AS b FROM z a JOIN z b ON a.pkg = b.pkg AND abs(a.cx - b.cx) + abs(a.cy - b.cy) <= a.h + b.h),
reach AS (SELECT zone_id AS n, zone_id AS r FROM z UNION SELECT reach.n, e.b FROM reach JOIN e ON e.a = reach.r)
SELECT pkg AS package_id, n AS zone_id, min(r) AS cluster FROM reach JOIN z ON z.zone_id = n GROUP BY 1, 2""")
# In x + y and x - y a diamond is an upright square: cells between all their sides are covered or not as a whole.
oracle("merged_outlines", "p_zones", """WITH z AS (SELECT zone_id, (zone_id // 4) % 2 AS pkg, cx + cy - h AS u0, cx + cy + h AS u1, cx - cy - h AS v0, cx - cy + h AS v1
  FROM p_zones WHERE method = 'Reflective'),
e AS (SELECT a.zone_id AS a, b.zone_id AS b, least(a.u1, b.u1) - greatest(a.u0, b.u0) AS du, least(a.v1, b.v1) - greatest(a.v0, b.v0) AS dv FROM z a JOIN z b ON a.pkg = b.pkg),
reach AS (SELECT zone_id AS n, zone_id AS r FROM z UNION SELECT reach.n, e.b FROM reach JOIN e ON e.a = reach.r WHERE du >= 0 AND dv >= 0 AND du + dv > 0),
c AS (SELECT n, min(r) AS c FROM reach GROUP BY n),
us AS (SELECT pkg, u, lead(u) OVER (PARTITION BY pkg ORDER BY u) AS u2 FROM (SELECT pkg, u0 AS u FROM z UNION SELECT pkg, u1 FROM z)),
vs AS (SELECT pkg, v, lead(v) OVER (PARTITION BY pkg ORDER BY v) AS v2 FROM (SELECT pkg, v0 AS v FROM z UNION SELECT pkg, v1 FROM z)),
s AS (SELECT us.pkg, sum((u2 - u) * (v2 - v)) / 2 AS area FROM us JOIN vs ON us.pkg = vs.pkg
      WHERE EXISTS (SELECT 1 FROM z WHERE z.pkg = us.pkg AND u0 <= u AND u1 >= u2 AND v0 <= v AND v1 >= v2) GROUP BY us.pkg)
SELECT z.pkg AS package_id, count(*) AS n_footprints, count(DISTINCT c) AS n_outlines, """ + r6('any_value(area)', 'covered_area') + """
FROM z JOIN c ON c.n = z.zone_id JOIN s ON s.pkg = z.pkg GROUP BY z.pkg""")
oracle("read_feature_files", "p_zones", f"""SELECT zone_id // 50 AS package, row_number() OVER (PARTITION BY zone_id // 50 ORDER BY zone_id) - 1 AS feature_no, zone_id,
  CAST(28356 AS BIGINT) AS epsg_code, method, {r6('raised_height', 'raised_height')}, {r6('mannings', 'mannings')}, {r6('resolution', 'resolution')},
  CAST(4 AS BIGINT) AS n_corners, {r6('2 * h * h', 'area')} FROM p_zones""")
_NEAR = """near AS (SELECT g.gauge_id, v.vid, sqrt(power(v.x - g.x, 2) + power(v.y - g.y, 2)) AS distance,
  row_number() OVER (PARTITION BY g.gauge_id ORDER BY power(v.x - g.x, 2) + power(v.y - g.y, 2), v.vid) AS k FROM p_gauges g, {v} v)"""
oracle("nearest_vertex", "p_gauges p_vertices", f"""WITH {_NEAR.format(v='p_vertices')}
SELECT gauge_id, vid, {r6('distance', 'distance')}, 'ok' AS status FROM near WHERE k = 1""")
_SCORE = f"""pk AS (SELECT v.vid, v.x, v.y, s.peak FROM p_vertices v JOIN (SELECT cell_id, max(stage) AS peak FROM p_cell_state GROUP BY 1) s ON s.cell_id = v.vid),
{_NEAR.format(v='pk')},
sc AS (SELECT n.gauge_id, n.vid, n.distance, pk.peak, pk.peak - g.field_stage AS diff, abs(pk.peak - g.field_stage) <= g.tolerance AS passed, g.field_stage
  FROM near n JOIN pk ON pk.vid = n.vid JOIN p_gauges g ON g.gauge_id = n.gauge_id WHERE n.k = 1)"""
oracle("gauge_scorecard", "p_gauges p_vertices p_cell_state", f"""WITH {_SCORE}
SELECT gauge_id, vid, {r6('distance', 'distance')}, {r6('peak', 'peak_stage')}, {r6('diff', 'diff')}, passed FROM sc""")
oracle("gauge_score_totals", "p_gauges p_vertices p_cell_state", f"""WITH {_SCORE}
SELECT CAST(field_stage AS BIGINT) AS tier, count(*) AS n, count(*) FILTER (WHERE passed) AS n_pass, bool_and(passed) AS all_pass,
  {r6('avg(diff)', 'bias')}, {r6('sqrt(avg(diff * diff))', 'rmse')} FROM sc GROUP BY 1""")
oracle("grid_knn", "p_vertices p_zones", f"""WITH box AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p_vertices),
p AS (SELECT r AS row_no, c AS col_no, x0 + (c + 0.5) * 25 AS x, y1 - (r + 0.5) * 25 AS y
  FROM box, generate_series(0, CAST(greatest(1, ceil((y1 - y0) / 25)) AS BIGINT) - 1) AS a(r), generate_series(0, CAST(greatest(1, ceil((x1 - x0) / 25)) AS BIGINT) - 1) AS b(c)),
d AS (SELECT row_no, col_no, v.elevation, sqrt(power(v.x - p.x, 2) + power(v.y - p.y, 2)) AS dist,
  row_number() OVER (PARTITION BY row_no, col_no ORDER BY power(v.x - p.x, 2) + power(v.y - p.y, 2), v.vid) AS k FROM p, p_vertices v),
w AS (SELECT row_no, col_no, CASE WHEN min(dist) = 0 THEN max(elevation) FILTER (WHERE k = 1) ELSE sum(elevation / nullif(dist, 0)) / sum(1 / nullif(dist, 0)) END AS value
  FROM d WHERE k <= 3 GROUP BY 1, 2)
SELECT p.row_no, p.col_no, {r6(f'''CASE WHEN EXISTS (SELECT 1 FROM p_zones z WHERE {_IN})
  AND NOT EXISTS (SELECT 1 FROM p_zones z WHERE {_IN} AND z.method = 'Reflective') THEN w.value END''', 'value')}
FROM p JOIN w ON w.row_no = p.row_no AND w.col_no = p.col_no""")

# Rasters: a diamond touches a cell where the centre distance, less the half cell per axis, is within h.
oracle("raster_nodata_in_boundary", "p_raster p_zones", """
SELECT raster_id, CAST(step AS BIGINT) AS step, zone_id, count(*) AS n_nodata FROM p_raster, p_zones
WHERE (isnan(value) OR value = -9999)
  AND greatest(0.0, abs(col_no * 10 + 5 - cx) - 5) + greatest(0.0, abs(row_no * 10 + 5 - cy) - 5) <= h GROUP BY 1, 2, 3""")
oracle("compare_runs", "p_raster", f"""WITH f AS (SELECT raster_id, step, row_number() OVER (PARTITION BY raster_id ORDER BY step) AS frame
  FROM (SELECT DISTINCT raster_id, step FROM p_raster)),
a AS (SELECT frame, row_no, col_no, value FROM p_raster JOIN f USING (raster_id, step) WHERE raster_id = 'a'),
b AS (SELECT frame, row_no, col_no, value FROM p_raster JOIN f USING (raster_id, step) WHERE raster_id = 'b'),
j AS (SELECT frame, row_no, col_no, a.value AS va, b.value AS vb, a.frame IS NOT NULL AS ha, b.frame IS NOT NULL AS hb FROM a FULL JOIN b USING (frame, row_no, col_no))
SELECT frame, row_no, col_no, {r6('CASE WHEN NOT isnan(vb - va) THEN abs(vb - va) END', 'diff')},
  CASE WHEN va IS NOT NULL AND vb IS NOT NULL THEN 'ok' ELSE 'error: unmatched' END AS status FROM j""")
oracle("value_range", "p_raster", f"""SELECT raster_id, CAST(step AS BIGINT) AS step, {r6('max(value) FILTER (WHERE NOT isnan(value))', 'max_value')}, CAST(0 AS DOUBLE) AS min_value
FROM p_raster GROUP BY 1, 2""")

# Forcing
_GRID = """g AS (SELECT w.series_id, w.start_ts, w.n_steps, k AS step, w.start_ts + to_hours(k) AS ts FROM p_windows w, generate_series(0, 480) AS s(k)),
al AS (SELECT g.series_id, g.start_ts, g.n_steps, g.step, g.ts, (SELECT arg_max(s.value, s.ts) FROM p_series s
  WHERE s.series_id = g.series_id AND s.ts >= g.start_ts AND s.ts <= g.ts) AS value FROM g)"""
oracle("align_forcing", "p_series p_windows", f"""WITH {_GRID}
SELECT series_id, step, epoch_us(ts) AS ts, {r6('value', 'value')} FROM al""")
oracle("forcing_gaps", "p_series p_windows", """
SELECT w.series_id, epoch_us(min(s.ts)) AS series_start, epoch_us(max(s.ts)) AS series_end, epoch_us(w.start_ts) AS window_start,
  epoch_us(w.start_ts + to_hours(480)) AS window_end FROM p_windows w JOIN p_series s ON s.series_id = w.series_id
GROUP BY w.series_id, w.start_ts HAVING count(*) FILTER (WHERE s.ts BETWEEN w.start_ts AND w.start_ts + to_hours(480)) = 0""")
_TIMES = "q AS (SELECT concat('u', CAST(user_id AS STRING)) AS series_id, event_id, event_id * 37 % 1728000 + CAST(1 AS DOUBLE) / CAST(9973 AS DOUBLE) AS t_s FROM events)"
oracle("forcing_at", "p_series p_windows", f"""WITH {_TIMES}
SELECT q.series_id, q.event_id, {r6('''(SELECT arg_max(s.value, s.ts) FROM p_series s JOIN p_windows w ON w.series_id = s.series_id
  WHERE s.series_id = q.series_id AND s.ts >= w.start_ts AND s.ts <= w.start_ts + to_hours(CAST(floor(q.t_s / 3600) AS BIGINT)))''', 'value')} FROM q""")
oracle("interpolate_boundary", "p_series", f"""WITH {_TIMES},
z AS (SELECT series_id, min(ts) AS t0 FROM p_series GROUP BY 1),
s AS (SELECT p.series_id, epoch_us(p.ts) / 1e6 - epoch_us(t0) / 1e6 AS t, value FROM p_series p JOIN z USING (series_id)),
b AS (SELECT q.series_id, q.t_s, (SELECT max({{'t': s.t, 'v': s.value}}) FROM s WHERE s.series_id = q.series_id AND s.t <= q.t_s) AS lo,
  (SELECT min({{'t': s.t, 'v': s.value}}) FROM s WHERE s.series_id = q.series_id AND s.t >= q.t_s) AS hi FROM (SELECT DISTINCT series_id, t_s FROM q) q)
SELECT series_id, {r6('t_s', 't_s')}, {r6('CASE WHEN lo IS NULL THEN hi.v WHEN hi IS NULL OR hi.t = lo.t THEN lo.v ELSE lo.v + (hi.v - lo.v) * ((t_s - lo.t) / (hi.t - lo.t)) END', 'stage')},
  CAST(0 AS DOUBLE) AS xmom FROM b""")
# Time features: three samples at 0, 1 and 4 days; the parts of the closed form are read from the text.
_BOUNDARY = """f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY package_id ORDER BY feature_id) AS k, count(*) OVER (PARTITION BY package_id) AS n
  FROM p_time_features) WHERE k = 1),
v AS (SELECT *, CASE WHEN data IS NULL THEN 'no data' WHEN data = 'tide' THEN 'not a number' WHEN data = '[]' THEN 'no list of samples'
    WHEN data LIKE '[%' AND data NOT LIKE '%value%' THEN 'sample without time or value' ELSE 'ok' END AS status,
  CASE WHEN data LIKE '[%value%' THEN CAST(json_extract_string(data, '$[0].value') AS DOUBLE) END AS a,
  CASE WHEN data LIKE '[%value%' THEN CAST(json_extract_string(data, '$[1].value') AS DOUBLE) END AS b,
  CASE WHEN data LIKE '[%value%' THEN CAST(json_extract_string(data, '$[2].value') AS DOUBLE) END AS c FROM f)"""
oracle("time_boundary", "p_time_features p_boundary_times", f"""WITH {_BOUNDARY},
s AS (SELECT q.package_id, q.event_id, q.t_s, coalesce(v.status, 'no feature') AS status,
  CASE WHEN v.status = 'no data' THEN 0.0 WHEN v.status <> 'ok' THEN NULL WHEN v.a IS NULL THEN TRY_CAST(trim(v.data, '"') AS DOUBLE)
    WHEN q.t_s <= 0 THEN a WHEN q.t_s <= 86400 THEN a + (b - a) * (q.t_s / 86400) WHEN q.t_s <= 345600 THEN b + (c - b) * ((q.t_s - 86400) / 259200) ELSE c END AS stage
  FROM p_boundary_times q LEFT JOIN v ON v.package_id = q.package_id)
SELECT package_id, event_id, {r6('t_s', 't_s')}, {r6('stage', 'stage')}, CASE WHEN stage IS NOT NULL THEN CAST(0 AS DOUBLE) END AS ymom, status FROM s""")
oracle("time_boundary_issues", "p_time_features p_boundary_times", f"""WITH {_BOUNDARY},
q AS (SELECT p.package_id, v.feature_id, coalesce(v.status, 'no feature') AS status, v.n FROM (SELECT DISTINCT package_id FROM p_boundary_times) p LEFT JOIN v ON v.package_id = p.package_id)
SELECT package_id, feature_id, 'error' AS severity, status AS reason FROM q WHERE status <> 'ok'
UNION ALL SELECT package_id, feature_id, 'warning', 'several features' FROM q WHERE n > 1""")
oracle("mass_balance", "p_series p_windows p_volumes", f"""WITH {_GRID},
e AS (SELECT series_id, coalesce(sum(value) FILTER (WHERE step < 480), 0.0) * 3600
  * CASE right(series_id, 1) WHEN '7' THEN 2.5e6 * 0.001 / 3600 WHEN '8' THEN -1.25e6 * 0.001 / 3600 ELSE 1.0 END AS expected FROM al GROUP BY 1),
j AS (SELECT e.series_id, expected, observed_m3, CASE WHEN expected = 0 THEN CASE WHEN observed_m3 = 0 THEN 0.0 END ELSE abs(observed_m3 - expected) / abs(expected) END AS err
  FROM e JOIN p_volumes v ON v.series_id = e.series_id)
SELECT series_id, round(expected, 3) + 0.0 AS expected_m3, round(err, 5) + 0.0 AS relative_error, coalesce(err <= 0.25, false) AS passed FROM j""")
_KIND = """CASE WHEN data IS NULL THEN 'missing' WHEN data LIKE '[{%' THEN 'series' WHEN data IN ('heavy', '[]') THEN 'invalid' ELSE 'constant' END"""
_CONST = "CASE WHEN data = '\"7.5\"' THEN 7.5 ELSE TRY_CAST(data AS DOUBLE) END"
oracle("classify_forcing", "p_rainfall", f"""SELECT feature_id, {_KIND} AS kind, {r6(_CONST, 'constant')},
  CASE WHEN {_KIND} = 'series' THEN CAST(json_array_length(data) AS BIGINT) END AS n_samples FROM p_rainfall""")
oracle("catchment_conflicts", "p_rainfall p_zones", f"""
WITH r AS (SELECT package_id, count(*) AS n_rain, (list({_KIND} ORDER BY feature_id))[1] AS k FROM p_rainfall GROUP BY 1),
j AS (SELECT r.*, c.n_catchments FROM r JOIN (SELECT package_id, count(*) AS n_catchments FROM p_zones GROUP BY 1) c ON c.package_id = r.package_id)
SELECT package_id, n_rain, n_catchments, 'multiple rainfall features' AS reason FROM j WHERE n_rain > 1
UNION ALL SELECT package_id, n_rain, n_catchments, 'first rainfall has no value' FROM j WHERE k = 'missing'
UNION ALL SELECT package_id, n_rain, n_catchments, 'first rainfall is a series' FROM j WHERE k = 'series'""")
_RUNOFF = f"""f AS (SELECT package_id, {_CONST} AS c FROM p_rainfall r WHERE feature_id = (SELECT min(q.feature_id) FROM p_rainfall q WHERE q.package_id = r.package_id)),
ro AS (SELECT z.zone_id, f.c * 0.001 / 3600 * 2 * z.h * z.h AS flow FROM p_zones z JOIN f ON f.package_id = z.package_id WHERE f.c IS NOT NULL)"""
oracle("catchment_runoff", "p_rainfall p_zones", f"WITH {_RUNOFF} SELECT zone_id AS catchment_id, {r6('flow', 'flow_m3_s')} FROM ro")
oracle("catchment_inflows", "p_rainfall p_zones p_gauges", f"""WITH {_RUNOFF},
n AS (SELECT z.zone_id, count(*) AS n, max(p.gauge_id) AS g, max(p.x) AS x FROM p_zones z JOIN p_gauges p ON {_IN} GROUP BY 1)
SELECT ro.zone_id AS catchment_id, g AS node_id, {r6('flow', 'flow_m3_s')}, concat('inf_16_inflow_01.', CAST(g AS STRING)) AS inflow_id, {r6('x - 10', 'start_x')}
FROM ro JOIN n ON n.zone_id = ro.zone_id WHERE n.n = 1 AND flow > 0""")

# Scenarios
oracle("validate_scenarios", "p_scenarios", """
SELECT id, 'epsg' AS field, 'required' AS rule FROM p_scenarios WHERE epsg IS NULL
UNION ALL SELECT id, 'boundary', 'required' FROM p_scenarios WHERE boundary IS NULL
UNION ALL SELECT id, 'duration', 'required' FROM p_scenarios WHERE duration IS NULL
UNION ALL SELECT id, 'format_version', 'supported' FROM p_scenarios WHERE format_version <> '1.0'
UNION ALL SELECT id, 'run_id', 'reportable' FROM p_scenarios WHERE run_id = 0
UNION ALL SELECT id, 'project', 'reportable' FROM p_scenarios WHERE project = 0
UNION ALL SELECT id, 'id', 'reportable' FROM p_scenarios WHERE id = 0
UNION ALL SELECT id, 'control_server', 'reportable' FROM p_scenarios""")
oracle("run_names", "p_scenarios", """
WITH n AS (SELECT id, concat(CAST(project AS STRING), '_', CAST(id AS STRING), '_', CAST(run_id AS STRING)) AS n FROM p_scenarios)
SELECT id, concat('run_', n) AS run_label, concat('outputs_', n) AS output_dir, concat(n, '_results.zip') AS result_zip, concat('cold-archive/', n, '/') AS archive_prefix FROM n""")
oracle("yieldstep", "p_scenarios", """SELECT id, CASE WHEN duration < 6100 THEN 60 WHEN duration >= 180000 THEN 1800 ELSE duration // 100 END AS yieldstep_s FROM p_scenarios""")
oracle("utm_zone", "p_scenarios", """
WITH c AS (SELECT id, CAST(substr(epsg, 6) AS BIGINT) AS epsg_code FROM p_scenarios),
z AS (SELECT *, CASE WHEN epsg_code // 100 IN (326, 327) AND epsg_code % 100 BETWEEN 1 AND 60 THEN epsg_code % 100
  WHEN epsg_code BETWEEN 28346 AND 28359 THEN epsg_code % 100 END AS zone FROM c)
SELECT id, epsg_code, zone, CASE WHEN zone IS NULL THEN NULL WHEN epsg_code // 100 = 326 THEN 'north' ELSE 'south' END AS hemisphere,
  CASE WHEN zone IS NOT NULL THEN 'ok' WHEN epsg_code IS NULL THEN 'error: no CRS' ELSE 'error: not a UTM zone' END AS zone_status FROM z""")
oracle("grid_resolution", "p_scenarios p_zones", f"""
SELECT s.id, {r6('coalesce((SELECT min(z.resolution) FROM p_zones z WHERE z.package_id = s.id), s.resolution, 1000.0)', 'grid_resolution')} FROM p_scenarios s""")
_EXT = """v AS (SELECT package_id, line_id, boundary, unnest([{'vertex': 0, 'x': x0, 'y': y0}, {'vertex': 1, 'x': x1, 'y': y1}, {'vertex': 2, 'x': x2, 'y': y2}], recursive := true)
  FROM p_lines WHERE location = 'External'),
ext AS (SELECT package_id, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM v GROUP BY 1)"""
oracle("boundary_extent", "p_lines", f"""WITH {_EXT}
SELECT p.package_id, {r6('min_x', 'min_x')}, {r6('max_x', 'max_x')}, {r6('min_y', 'min_y')}, {r6('max_y', 'max_y')},
  {r6('(min_x + max_x) / 2', 'mid_x')}, {r6('(min_y + max_y) / 2', 'mid_y')},
  CASE WHEN min_x IS NULL THEN 'error: no external boundary coordinates' ELSE 'ok' END AS status
FROM (SELECT DISTINCT package_id FROM p_lines) p LEFT JOIN ext ON ext.package_id = p.package_id""")
oracle("boundary_ring", "p_lines", f"""WITH {_EXT},
ce AS (SELECT *, sqrt(power(x1 - x0, 2) + power(y1 - y0, 2)) AS a, sqrt(power(x2 - x1, 2) + power(y2 - y1, 2)) AS b FROM p_lines),
la AS (SELECT ce.line_id, atan2((a * (y0 + y1) / 2 + b * (y1 + y2) / 2) / (a + b) - (min_y + max_y) / 2,
  (a * (x0 + x1) / 2 + b * (x1 + x2) / 2) / (a + b) - (min_x + max_x) / 2) AS la FROM ce JOIN ext USING (package_id)),
o AS (SELECT v.*, row_number() OVER (PARTITION BY v.package_id ORDER BY atan2(v.y - (min_y + max_y) / 2, v.x - (min_x + max_x) / 2) DESC, la.la DESC, v.line_id, v.vertex) - 1 AS ring_seq
  FROM v JOIN ext ON ext.package_id = v.package_id JOIN la ON la.line_id = v.line_id)
SELECT package_id, ring_seq, line_id, CAST(vertex AS BIGINT) AS vertex, boundary, {r6('x', 'x')}, {r6('y', 'y')} FROM o""")

# Artefacts
oracle("package_report", "p_files", """
WITH c AS (SELECT *, CASE WHEN path LIKE 'engine/%' OR path LIKE '%/engine/%' OR path LIKE '%/checkpoints/%' OR path LIKE '%/videos/%' THEN 'directory'
  WHEN path = 'package.zip' OR path LIKE '%/package.zip' THEN 'package' WHEN path LIKE '%.sww' THEN 'series' WHEN path LIKE '%.msh' THEN 'mesh'
  WHEN path LIKE '%.tif' AND contains(path, '_Time_') THEN 'step raster' ELSE 'kept' END AS reason FROM p_files)
SELECT run_id, reason, count(*) AS n_files, CAST(sum(length) AS BIGINT) AS n_bytes FROM c GROUP BY 1, 2""")
oracle("archive_gaps", "p_files", """
WITH r AS (SELECT DISTINCT run_id, concat('run_', CAST(run_id AS STRING)) AS l FROM p_files),
x AS (SELECT run_id, unnest([concat(l, '.sww'), 'package.zip', 'scenario.json', concat(l, '_depth_max.tif'), concat(l, '_velocity_max.tif'),
  concat(l, '_depthIntegratedVelocity_max.tif')]) AS object_name FROM r)
SELECT run_id, object_name FROM x EXCEPT SELECT run_id, regexp_extract(path, '[^/]+$') FROM p_files""")
_CAT = """k AS (SELECT *, regexp_extract(path, '_(depth|velocity|stage)_(Time_)?[0-9]{6}[.]tif$', 1) AS q,
  TRY_CAST(regexp_extract(path, '([0-9]{6})[.]tif$', 1) AS BIGINT) AS step FROM p_files),
i AS (SELECT *, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(step) AS vt FROM k WHERE q <> '')"""
_CAT_AGG = """count(*) AS n_items, min(min_x) AS min_x, min(min_y) AS min_y, max(max_x) AS max_x, max(max_y) AS max_y, epoch_us(min(vt)) AS first_time, epoch_us(max(vt)) AS last_time"""
oracle("raster_catalogue", "p_files", f"""WITH {_CAT}
SELECT run_id, q AS quantity, {_CAT_AGG} FROM i GROUP BY run_id, q
UNION ALL SELECT run_id, NULL, {_CAT_AGG} FROM i GROUP BY run_id""")
oracle("catalogue_skips", "p_files", """
WITH h AS (SELECT run_id, bool_or(regexp_matches(path, '_(depth|velocity|stage)_((Time_)?[0-9]{6}|max)[.]tif$')) AS has FROM p_files GROUP BY 1)
SELECT run_id, CASE WHEN run_id % 4 = 0 THEN 'no start time' ELSE 'no quantities' END AS reason FROM h WHERE run_id % 4 = 0 OR NOT has""")
oracle("check_provenance", "p_manifests", r"""
WITH m AS (SELECT *, CASE WHEN manifest LIKE '{"core"%' THEN manifest END AS j FROM p_manifests),
s AS (SELECT run_id, json_extract_string(j, '$.core.sha') AS sha, json_extract_string(j, '$.core.git_url') AS git_url, j,
  nullif(regexp_extract(installed_version, '[+]g([0-9a-fA-F]+)', 1), '') AS here FROM m)
SELECT run_id, CASE WHEN j IS NOT NULL THEN sha IS NOT NULL AND json_extract_string(j, '$.tool.sha') IS NOT NULL END AS complete, git_url,
  sha AS manifest_sha, here AS installed_sha, CASE WHEN sha IS NULL OR here IS NULL THEN 'not checked'
  WHEN starts_with(lower(sha), lower(here)) OR starts_with(lower(here), lower(sha)) THEN 'match' ELSE 'mismatch' END AS provenance FROM s""")

# Telemetry
oracle("phase_peaks", "p_phase_events", f"SELECT run_id, phase, {r6('max(rss_mib)', 'peak_rss')} FROM p_phase_events WHERE phase IS NOT NULL GROUP BY 1, 2")
_SPANS = """sp AS (SELECT run_id, seq, phase, epoch_us(lead(ts, 1, TIMESTAMP '2024-02-01 00:00:00') OVER (PARTITION BY run_id ORDER BY ts, seq)) - epoch_us(ts) AS span_us FROM p_phase_events),
st AS (SELECT *, CASE phase WHEN 'mesh-gen' THEN 'build' WHEN 'raster-read' THEN 'build' WHEN 'evolve' THEN 'solve' ELSE 'publish' END AS stage FROM sp WHERE phase IS NOT NULL)"""
oracle("phase_spans", "p_phase_events", f"WITH {_SPANS} SELECT run_id, seq, phase, span_us FROM st")
oracle("phase_durations", "p_phase_events", f"""WITH {_SPANS}
SELECT run_id, 'phase' AS level, stage, phase, {r6('sum(span_us) / 1e6', 'seconds')} FROM st GROUP BY 1, 3, 4
UNION ALL SELECT run_id, 'stage', stage, NULL, {r6('sum(span_us) / 1e6')} FROM st GROUP BY 1, 3
UNION ALL SELECT run_id, 'run', NULL, NULL, {r6('sum(span_us) / 1e6')} FROM st GROUP BY 1""")
oracle("phase_peaks_windowed", "p_phase_events", f"""
SELECT run_id, phase, epoch_us(CAST(date_trunc('day', ts) AS TIMESTAMP)) AS window_start, {r6('max(rss_mib)', 'peak_rss')}
FROM p_phase_events WHERE phase IS NOT NULL GROUP BY 1, 2, 3""")
_LEDGER = f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY partial, ts DESC, seq DESC) AS k FROM p_resource_rows WHERE job_id IS NOT NULL)
SELECT job_id, partial, epoch_us(ts) AS ts, seq, {r6('peak_mib', 'peak_mib')} FROM r WHERE k = 1"""
oracle("latest_resource_row", "p_resource_rows", _LEDGER)
oracle("resource_ledger", "p_resource_rows", _LEDGER)
oracle("latest_progress", "p_progress", f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts DESC, seq DESC) AS k FROM p_progress)
SELECT run_id, epoch_us(ts) AS ts, seq, {r6('pct', 'pct')}, status FROM r WHERE k = 1""")
oracle("instability_alerts", "p_live_diagnostics", f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts, seq) AS k FROM p_live_diagnostics WHERE implied_max_speed_ms >= 20)
SELECT run_id, epoch_us(ts) AS ts, seq, {r6('implied_max_speed_ms', 'implied_max_speed_ms')} FROM r WHERE k = 1""")
_BEAT = """e AS (SELECT run_id, ts, min(seq) AS seq FROM p_progress GROUP BY 1, 2),
beat AS (SELECT run_id, min(ts) AS ts FROM e GROUP BY 1
  UNION ALL SELECT e.run_id, min(e.ts) FROM beat JOIN e ON e.run_id = beat.run_id AND e.ts >= beat.ts + INTERVAL 900 SECOND GROUP BY e.run_id)
SELECT e.run_id, e.seq, epoch_us(e.ts) AS {ts} FROM beat JOIN e ON e.run_id = beat.run_id AND e.ts = beat.ts"""
oracle("heartbeats", "p_progress", "WITH " + _BEAT.format(ts="ts"))
oracle("heartbeats_live", "p_progress", "WITH " + _BEAT.format(ts="us"))
oracle("stuck_runs", "p_progress", """
WITH l AS (SELECT *, epoch_us(lead(ts, 1, TIMESTAMP '2024-02-01 00:00:00') OVER (PARTITION BY run_id ORDER BY ts, seq)) - epoch_us(ts) AS silent_us FROM p_progress)
SELECT run_id, seq, epoch_us(ts) AS last_event_us, silent_us FROM l WHERE silent_us > 86400000000 AND status NOT IN ('error', 'purchase')""")
oracle("stuck_runs_live", "p_progress", """
WITH r AS (SELECT *, lead(ts) OVER (PARTITION BY run_id ORDER BY ts, seq) AS next, max(ts) OVER () AS newest FROM p_progress)
SELECT run_id, epoch_us(ts) AS last_event_us FROM r WHERE status NOT IN ('error', 'purchase')
  AND CASE WHEN next IS NULL THEN epoch_us(ts) // 1000 + 3600000 < epoch_us(newest) // 1000 - 600000
           ELSE epoch_us(next) - epoch_us(ts) > 3600000000 END""")
oracle("typed_events", "p_log p_progress", """
SELECT seq, ['status', 'metric', 'file', 'heartbeat', 'progress', 'log'][seq % 6 + 1] AS kind,
  CASE seq % 6 WHEN 1 THEN 'memory_used' WHEN 2 THEN 'raster' END AS key,
  CASE seq % 6 WHEN 0 THEN status WHEN 1 THEN CAST(seq AS STRING) WHEN 2 THEN concat('outputs/run_1_1_', CAST(run_id AS STRING), '_depth_max.tif') END AS value,
  CASE seq % 6 WHEN 3 THEN floor(pct) WHEN 4 THEN floor(pct) + 0.5 END AS pct,
  CASE WHEN seq % 6 = 3 AND seq % 4 <> 1 THEN seq % 1000 END AS eta_s, CASE WHEN seq % 6 = 4 THEN seq % 900 + 1 END AS n_steps,
  CASE WHEN seq % 6 = 4 THEN CAST(seq % 200 AS DOUBLE) END AS dt_ms, CASE WHEN seq % 6 = 4 THEN CAST(2.1 AS DOUBLE) END AS vmax,
  CASE WHEN seq % 6 = 4 THEN CAST(2.2 AS DOUBLE) END AS v_impl, CASE WHEN seq % 6 = 4 THEN CAST(23 AS DOUBLE) END AS wet_pct,
  CASE WHEN seq % 6 = 4 THEN CAST(seq AS DOUBLE) END AS volume FROM p_progress""")
oracle("typed_events_live", "p_progress", """
SELECT run_id, ['status', 'metric', 'file', 'heartbeat', 'progress', 'log'][seq % 6 + 1] AS kind, count(*) AS n_events FROM p_progress GROUP BY 1, 2""")
oracle("resource_corpus", "p_phase_events p_features p_cell_state", f"""WITH {_SUM}, {_SPANS},
pk AS (SELECT run_id, max(rss_mib) AS peak_rss, arg_max(phase, rss_mib) AS peak_phase FROM p_phase_events WHERE phase IS NOT NULL GROUP BY 1),
du AS (SELECT run_id, sum(span_us) FILTER (WHERE stage = 'build') / 1e6 AS build_s, sum(span_us) FILTER (WHERE stage = 'solve') / 1e6 AS solve_s,
  sum(span_us) FILTER (WHERE stage = 'publish') / 1e6 AS publish_s FROM st GROUP BY 1)
SELECT f.run_id, CAST(json_extract_string(bag, '$.triangle_count') AS BIGINT) AS triangle_count, {r6("CAST(json_extract_string(bag, '$.min_area') AS DOUBLE)", 'min_area')},
  {r6('peak_rss', 'peak_rss')}, peak_phase, {r6('build_s', 'build_s')}, {r6('solve_s', 'solve_s')}, {r6('publish_s', 'publish_s')}, outcome
FROM p_features f LEFT JOIN pk USING (run_id) LEFT JOIN du USING (run_id) LEFT JOIN summary USING (run_id)""")
