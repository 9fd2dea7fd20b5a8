"""State of the live operators: what stands per key, and that state ends."""

import pytest
from pyspark.sql import functions as F

from floodspark.streaming import live
from floodspark.streaming.standing import _reduced, combined

HOUR = 3600
SCHEMA = "run_id long, seq long, s long, pct double, status string, implied_max_speed_ms double"


def land(spark, path, batches, schema=SCHEMA):
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("s")).coalesce(1).write.mode("append").parquet(f"{path}/f{n}")
    return (spark.readStream.schema(schema + ", ts timestamp").option("maxFilesPerTrigger", 1)
            .option("recursiveFileLookup", True).parquet(path))


def state_rows(stream, tmp_path, mode="update"):
    """Rows of state after each micro-batch."""
    query = (stream.writeStream.outputMode(mode).foreachBatch(lambda df, n: df.collect())
             .option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start())
    query.awaitTermination()
    return [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]


def row(run, hour, pct=1.0, status="running", speed=0.0):
    return (run, hour, hour * HOUR, pct, status, speed)


def test_progress_state_ends(spark, tmp_path):
    batches = [[row(10 * n + k, 5 * n) for k in range(10)] for n in range(6)]
    stream = land(spark, str(tmp_path / "in"), batches)
    sizes = state_rows(live.latest_progress(stream, keep_s=4 * HOUR), tmp_path)
    # A key holds its row and a timer, and its index by key; sixty runs came by, two batches of ten stand at once.
    assert sizes[-1] < 60 and max(sizes) <= 4 * 10 * 3, sizes


def test_a_run_that_goes_on_stays(spark, tmp_path):
    batches = [[row(1, 3 * n, float(n)), row(100 + n, 3 * n)] for n in range(6)]
    stream = land(spark, str(tmp_path / "in"), batches)
    got = live.drain(spark, live.latest_progress(stream, keep_s=4 * HOUR), "update", ["run_id"])
    assert {r.run_id: r.pct for r in got.collect()}[1] == 5.0


def test_latest_row_of_ties_nulls_and_micros(spark, tmp_path):
    rows = [(1, 1, 10, 1.0, "a", None), (1, 2, 10, 2.0, 'quote " and \n line', None), (None, 1, 5, float("nan"), None, None),
            (None, 9, 4, 9.0, "old", None), (2, None, 7, None, "x", None)]
    stream = land(spark, str(tmp_path / "in"), [rows]).withColumn("ts", F.col("ts") + F.expr("interval 7 microseconds"))
    got = {r.run_id: r for r in live.drain(spark, live.latest_progress(stream), "update", ["run_id"]).collect()}
    assert set(got) == {1, 2, None}
    assert (got[1].seq, got[1].pct, got[1].status, got[1].ts.microsecond) == (2, 2.0, 'quote " and \n line', 7)
    assert got[None].seq == 1 and got[None].pct != got[None].pct and got[2].pct is None


def test_one_alert_a_run_and_an_earlier_late_row_replaces_it(spark, tmp_path):
    batches = [[row(1, 5, speed=500.0), row(2, 5, speed=1.0)], [row(1, 6, speed=900.0)], [row(1, 5, speed=700.0)[:1] + (1, 5 * HOUR - 60, 1.0, "running", 700.0)]]
    alerts = live.instability_alerts(land(spark, str(tmp_path / "in"), batches), watermark="3 hours")
    seen = []
    alerts.writeStream.outputMode("update").foreachBatch(lambda df, n: seen.extend(df.collect())).option(
        "checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    assert [(r.run_id, r.implied_max_speed_ms) for r in seen] == [(1, 500.0), (1, 700.0)]


def test_step_state_ends_with_its_time(spark, tmp_path):
    schema = ("run_id long, t long, cell_id long, stage double, elevation double, xmom double, ymom double, area double, "
              "inradius double, x double, y double, dt double, is_full boolean, s long")
    cell = lambda t, k, xmom: (1, t, k, 2.0, 1.0, xmom, 0.0, 3.0, 0.5, float(k), -float(k), 0.1, True, 9 * HOUR + t * HOUR)
    batches = [[cell(10 * n, k, float(k % 3)) for k in range(9)] for n in range(5)]
    stream = land(spark, str(tmp_path / "in"), batches, schema)
    sizes = state_rows(live.flow_diagnostics_stream(stream, at="ts"), tmp_path)
    assert max(sizes) <= 2, sizes
    got = live.drain(spark, live.flow_diagnostics_stream(stream, at="ts"), "update", ["run_id", "t"]).collect()
    assert {(r.t, r.wet_cells, r.volume_m3, r.max_speed_ms, r.peak_speed_x, r.peak_speed_y) for r in got} == {
        (10 * n, 9, 27.0, 2.0, 2.0, -2.0) for n in range(5)}


def test_silences_of_a_crowded_run_send_few_rows(spark, tmp_path):
    schema = "run_id long, seq long, s long, status string"
    rows = [(1, k, k, "running") for k in range(0, 9000, 3)] + [(1, 10_000, 20_000, "running"), (1, 10_001, 20_000, "completed")]
    stuck = live.stuck_runs_stream(land(spark, str(tmp_path / "in"), [rows], schema), 1800)
    seen = []
    query = stuck.writeStream.foreachBatch(lambda df, n: seen.extend(df.collect())).option(
        "checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert [(r.run_id, r.last_event_us) for r in seen] == [(1, 8_997_000_000)]


@pytest.mark.parametrize("how,expected", [("sum", 6.0), ("max", 4.0), ("min", 2.0)])
def test_figures_leave_nulls_out(how, expected):
    import pandas as pd

    pdf = pd.DataFrame({"key": ["a", "a", "a", "b"], "seen": [1, 3, 2, 1], "rank0": [1.0, None, 5.0, None],
                        "row": ["r1", "r2", "r3", "r4"], "f": [2.0, 4.0, None, None]})
    got = _reduced(pdf, ["rank0"], {"f": how}).set_index("key")
    assert got.loc["a", "f"] == expected and got.loc["a", "row"] == "r3" and got.loc["a", "seen"] == 3
    assert got.loc["b"].isna()[["rank0", "row", "f"]].all()


def test_a_batch_sends_one_row_a_key(spark):
    rows = spark.range(5000).selectExpr("id % 2 as run_id", "id as seq", "timestamp_seconds(id) as ts").coalesce(1)
    few = combined(rows, ["run_id"], [F.col("seq")], ["seq"], F.col("ts"), {"n": ("sum", F.lit(1))}).collect()
    assert sorted((r.key, r.row, r.n) for r in few) == [('{"run_id":0}', '{"seq":4998}', 2500.0), ('{"run_id":1}', '{"seq":4999}', 2500.0)]
