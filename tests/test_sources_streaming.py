import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tidewheel.operators import series
from tidewheel.sources import datasets
from tidewheel.streaming import windows


def test_readers(spark, tmp_path):
    (tmp_path / "w.csv").write_text("Wind_turbine_name;Date_time;P_avg;Ws_avg;Ot_avg;Wa_avg\nR1;2014-01-01T01:00:00+01:00;1.5;2;3;4\nR2;2014-01-01T01:00:00+01:00;;2;3;4\n")
    rows = datasets.wind(spark, str(tmp_path / "w.csv")).collect()
    assert [(r.turbine, r.power, r.datetime) for r in rows] == [("R1", 1.5, dt.datetime(2014, 1, 1, 1))]
    (tmp_path / "p.txt").write_text("Date;Time;Global_active_power;Global_reactive_power;Voltage;Global_intensity;Sub_metering_1;Sub_metering_2;Sub_metering_3\n16/12/2006;17:24:00;4.2;0.4;234.8;18.4;0;1;17\n17/12/2006;17:24:00;?;?;?;?;?;?;\n")
    rows = datasets.power(spark, str(tmp_path / "p.txt")).orderBy("datetime").collect()
    assert rows[0].datetime == dt.datetime(2006, 12, 16, 17, 24) and rows[1].Voltage is None
    (tmp_path / "V100_200N_3.txt").write_text("1 2 3 4\n")
    r = datasets.vibration(spark, str(tmp_path / "V100_200N_3.txt")).first()
    assert (r.rpm, r.torque, r.run, r.z) == (100, 200, 3, 3.0)
    (tmp_path / "c.csv").write_text('DATE,TMP\n2007-01-01T00:00:00,"+0123,1"\n')
    assert datasets.climate_years(spark, [str(tmp_path / "c.csv")]).first().temperature == pytest.approx(12.3)


def test_cache_and_sizes(spark, tmp_path):
    calls = []
    make = lambda: (calls.append(1), spark.range(5))[1]
    for force in (False, False, True):
        assert datasets.cached(spark, f"file://{tmp_path}/t", make, force).count() == 5
    assert len(calls) == 2
    assert datasets.written_size(spark.range(1000).select(F.rand(1).alias("x")), f"file://{tmp_path}/csv") > 5000


def stream_of(spark, tmp_path, rows):
    path = f"{tmp_path}/in"
    df = spark.createDataFrame(rows, "k string, ts timestamp, v double")
    df.coalesce(1).write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def drained(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return df.sparkSession.sql(f"SELECT * FROM {name}").collect()


def test_streams(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    v = [0.0, 0.1, 0.0, 0.1, 5.0, 5.1, 5.0, 9.0, 1.0]
    rows = [("a", t0 + dt.timedelta(minutes=k), x) for k, x in enumerate(v)] + [("b", t0 + dt.timedelta(hours=3), 1.0)]
    stream = stream_of(spark, tmp_path, rows)
    out = drained(windows.resampled(stream, "ts", "5 minutes", {"n": F.count("v")}, ["k"]), "bins", "complete")
    assert sorted((r.k, r.n) for r in out) == [("a", 4), ("a", 5), ("b", 1)]
    out = drained(windows.sessions(stream, "ts", "30 minutes", ["k"]), "sess", "append")
    assert [(r.k, r.n) for r in out] in ([], [("a", 9)])
    out = drained(windows.compressed(stream, "k", "ts", "v", 0.3), "door", "append")
    kept = series.swinging_door(__import__("numpy").arange(9.0) * 6e7, __import__("numpy").array(v), 0.3)
    assert sorted(r.v for r in out if r.k == "a") == sorted(v[i] for i in kept)


def test_a_door_without_rows_ends(spark, tmp_path):
    """Key a goes silent at minute 5; rows of b move the watermark past its idle time, so a's last point is kept."""
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    parts = [[("a", at(m), 1.0) for m in range(6)], [("b", at(200), 2.0)], [("b", at(201), 2.0)], [("a", at(202), 9.0), ("b", at(203), 2.0)]]
    schema = "k string, ts timestamp, v double"
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"s{i}"))
        for f in (tmp_path / f"s{i}").glob("part-*.parquet"):
            (tmp_path / "in").mkdir(exist_ok=True)
            f.rename(tmp_path / "in" / f"{i}.parquet")
            os.utime(tmp_path / "in" / f"{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = windows.compressed(stream, "k", "ts", "v", 0.5, idle_seconds=600).writeStream.format("memory").queryName("ended").outputMode("append").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    got = sorted((r.k, (r.t - 1704067200000000) // 60_000_000, r.v) for r in spark.table("ended").collect())
    assert got == [("a", 0, 1.0), ("a", 5, 1.0), ("a", 202, 9.0), ("b", 200, 2.0)]
