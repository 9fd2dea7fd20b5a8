import glob

import pytest
from pyspark.sql import functions as F

from floodspark import sources
from floodspark.schemas import DIAGNOSTICS


def table(spark, n=200):
    df = spark.range(n, numPartitions=5).select(F.concat(F.lit("1_1_"), F.col("id") % 7).alias("run"), (F.col("id") % 3).alias("batch_number"),
                                                F.when(F.col("id") % 7 != 3, F.concat(F.lit("4 triangles, \"run\" "), F.col("id") % 7)).alias("mesh_summary"), "id")
    fields = [F.when(F.col("id") % 11 == k, None).otherwise(F.col("id") * (k + 1) + (0.25 if f.dataType.typeName() == "double" else 0)).cast(f.dataType).alias(f.name)
              for k, f in enumerate(DIAGNOSTICS.fields)]
    return df.select("run", "batch_number", "mesh_summary", *fields)


def rows(df):
    names = ["run", "batch_number", *DIAGNOSTICS.names]
    return sorted(map(str, (tuple(r) for r in df.select(*names).collect())))


def test_files_come_back(spark, tmp_path):
    df = table(spark)
    sources.write_diagnostics_files(df, str(tmp_path))
    files = sorted(glob.glob(f"{tmp_path}/**/*", recursive=True))
    assert [f for f in files if "_staging" in f] == [] and len([f for f in files if f.endswith(".csv")]) == 21
    first = open(f"{tmp_path}/outputs_1_1_2/run_diagnostics_1.csv").read().splitlines()
    assert first[0] == '# 4 triangles, "run" 2' and first[1] == ",".join(DIAGNOSTICS.names)
    assert open(f"{tmp_path}/outputs_1_1_3/run_diagnostics_1.csv").read().startswith("sim_time_s")
    assert rows(sources.read_diagnostics(spark, str(tmp_path))) == rows(df)
    sources.write_diagnostics_files(df.drop("mesh_summary").where("batch_number = 0"), f"file://{tmp_path}")
    assert rows(sources.read_diagnostics(spark, str(tmp_path))) == rows(df)


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    bad = F.when(F.col("n_steps") > 300, F.raise_error(F.lit("broken row")).cast("double")).otherwise(F.col("wet_fraction"))
    with pytest.raises(Exception, match="broken row"):
        sources.write_diagnostics_files(table(spark).withColumn("wet_fraction", bad), str(tmp_path))
    assert glob.glob(f"{tmp_path}/**/*.csv", recursive=True) == []


def test_stream_adds_files(spark, tmp_path):
    df = table(spark)
    for k in range(2):
        df.where(F.col("batch_number") == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
        query = sources.diagnostics_sink(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    names = {f.rsplit("/", 1)[1] for f in glob.glob(f"{tmp_path}/out/**/*.csv", recursive=True)}
    assert names == {"run_diagnostics_0-0.csv", "run_diagnostics_1-1.csv"}
    assert rows(sources.read_diagnostics(spark, f"{tmp_path}/out")) == rows(df.where("batch_number < 2"))
