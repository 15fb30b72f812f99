"""Edge cases of the operators on hand-made rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from wayfold.functions import geo, parse
from wayfold.operators import aggregates, joins, sequences
from wayfold.sources import sinks, tables
from wayfold.streaming import sessions as streaming


def at(s):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)


def column(df, name):
    return [r[name] for r in df.collect()]


def test_gap_is_strict(spark):
    df = spark.createDataFrame([("a", 1, at(0)), ("a", 2, at(120)), ("a", 3, at(241))], "k string, i int, ts timestamp_ntz")
    out = sequences.gap_sessions(df, ["k"], "ts", ["ts", "i"], 120).orderBy("i")
    assert column(out, "session_id") == [1, 1, 2]


def test_radius_is_inclusive_and_cells_lose_nothing(spark):
    import math

    metres = 1000.0
    lat = math.degrees(metres / geo.EARTH_RADIUS_M)
    p = spark.createDataFrame([(1, lat, 0.0), (2, lat * 1.001, 0.0), (3, 0.0, 0.0), (4, 70.0, 20.0), (5, 70.0, 20.02)], "id int, lat double, lon double")
    s = spark.createDataFrame([(1, 0.0, 0.0, 1000.0 + 1e-6), (2, 70.0, 20.0, 1000.0)], "sid int, s_lat double, s_lon double, r double")
    got = joins.radius_join(p, s, "lat", "lon", "s_lat", "s_lon", "r", 1001.0).select("id", "sid").collect()
    assert sorted(map(tuple, got)) == [(1, 1), (3, 1), (4, 2), (5, 2)]


@pytest.mark.parametrize("tolerance, want", [(10.0, [(1, 1.0, 5.0), (2, None, None)]), (None, [(1, 1.0, 5.0), (2, 3.0, 10.001)])])
def test_asof_ties_duplicates_and_tolerance(spark, tolerance, want):
    left = spark.createDataFrame([("a", 1, at(10)), ("a", 2, at(100))], "k string, i int, ts timestamp_ntz")
    right = spark.createDataFrame([("a", 1, at(5), 0.0), ("a", 2, at(5), 1.0), ("a", 3, at(15), 2.0), ("a", 4, at(110.001), 3.0)], "k string, j int, ts timestamp_ntz, v double")
    got = joins.asof_nearest(left, right, ["k"], "ts", "i", "j", ["v"], tolerance).orderBy("i")
    assert [(r["i"], r["v"], r["delta_s"]) for r in got.collect()] == want


def test_wrapper_needs_two(spark):
    rows = [("a", 1, at(0), at(100)), ("a", 2, at(10), at(20)), ("a", 3, at(30), at(40)), ("b", 4, at(0), at(100)), ("b", 5, at(10), at(20))]
    df = spark.createDataFrame(rows, "k string, i int, s timestamp_ntz, e timestamp_ntz")
    assert [(r["i"], r["held"]) for r in joins.wrappers(df, ["k"], "i", "s", "e").collect()] == [(1, 2)]


def test_prefix_cap_stays_cut(spark):
    df = spark.createDataFrame([("a", i, at(s)) for i, s in enumerate([0, 3600, 3601, 10])], "k string, i int, ts timestamp_ntz")
    assert column(sequences.prefix_cap(df, ["k"], "ts", ["i"], 3600).orderBy("i"), "i") == [0, 1]
    none = spark.createDataFrame([("a", i, None) for i in range(5)], "k string, i int, ts timestamp_ntz")
    assert column(sequences.prefix_cap(none, ["k"], "ts", ["i"], 3600, 3).orderBy("i"), "i") == [0, 1, 2]


def test_trim_keeps_inner_blanks(spark):
    df = spark.createDataFrame([("a", 1, " "), ("a", 2, "x"), ("a", 3, None), ("a", 4, "y"), ("a", 5, "")], "k string, pos int, v string")
    assert column(sequences.trim_empty_ends(df, ["k"], "pos", ["v"]).orderBy("pos"), "pos") == [2, 3, 4]


def test_thinning_compares_with_the_last_kept(spark):
    df = spark.createDataFrame([("a", float(t), 0.0) for t in (0, 14.9, 15, 29, 30)], "k string, t double, x double")
    out = sequences.greedy_thin(df, ["k"], "t", ["x"], lambda a, b: F.abs(a["x"] - b["x"]) >= 10, 15).orderBy("t")
    assert column(out, "t") == [0.0, 15.0, 30.0]


def test_backtracking_tolerance(spark):
    df = spark.createDataFrame([("a", i, c) for i, c in enumerate([100.0, 40.0, 39.9, 160.0])], "k string, i int, c double")
    assert column(sequences.not_backtracking(df, ["k"], ["i"], "c").orderBy("i"), "accepted") == [True, True, False, True]


def test_bins_close_at_the_end(spark):
    df = spark.createDataFrame([("r", 0.0, 1.0), ("r", 39.9, 2.0), ("r", 40.0, 3.0)], "k string, m double, v double")
    out = aggregates.route_bins(df, ["k"], "m", F.lit(40.0), "v").orderBy("segment_index")
    assert [(r["segment_index"], r["n_points"]) for r in out.collect()] == [(0, 1), (1, 2)]


def test_reversed_edges_merge(spark):
    df = spark.createDataFrame([("a", 0.0, 0.0, 36.0, 0.0, 1.0), ("b", 36.0, 0.0, 0.0, 0.0, 3.0)], "r string, x double, y double, xend double, yend double, value double")
    out = aggregates.merged_edges(df, "r").collect()
    assert [(r["n_obs"], r["n_routes"], r["value_mean"]) for r in out] == [(2, 2, 2.0)]
    assert sinks.with_wkt(df).first()["wkt"] == "LINESTRING (0.0 0.0, 36.0 0.0)"


def test_line_ends(spark):
    v = spark.createDataFrame([("a", i, x, 0.0) for i, x in enumerate([0.0, 10.0, 10.0, 30.0])], "k string, pos int, x double, y double")
    e = joins.edges(v, ["k"], "pos", "x", "y")
    w = spark.createDataFrame([("a", d) for d in (-5.0, 0.0, 15.0, 30.0, 99.0)], "k string, d double")
    assert column(joins.at_chainage(e, w, ["k"], "d").orderBy("d"), "x") == [0.0, 0.0, 15.0, 30.0, 30.0]


def test_map_projections(spark):
    df = spark.createDataFrame([(52.52, 13.405)], "lat double, lon double")
    x, y = geo.utm(F.col("lat"), F.col("lon"))
    r = df.select(x.alias("x"), y.alias("y")).first()
    assert abs(r["x"] - 391777.0) < 60 and abs(r["y"] - 5820073.0) < 60
    px, py = geo.to_plane(F.col("lat"), F.col("lon"), 52.5, 13.4)
    lat, lon = geo.from_plane(px, py, 52.5, 13.4)
    r = df.select(lat.alias("a"), lon.alias("b")).first()
    assert abs(r["a"] - 52.52) < 1e-9 and abs(r["b"] - 13.405) < 1e-9


def test_names():
    assert parse.slug("Silberstraße Nord µ") == "silberstrasse_nord_u"
    assert parse.first_present(["Time Stamp", "GPS_Lat"], ["gps lat", "lat"]) == "GPS_Lat"


def test_scans(spark, tmp_path):
    (tmp_path / "log.csv").write_text("﻿timestamp_iso;gps_lat;gps_lon;temp\n2024-01-01T00:00:05;52.5;13.4;20\n2024-01-01T00:00:05;52.5;13.4;21\nbad;x;1;3\n")
    path = str(tmp_path / "log.csv")
    assert tables.sniffed_delimiter(spark, path) == ";"
    assert tables.sensor_fixes(spark, path).count() == 2
    assert column(tables.air_metrics(spark, path), "mobile_aq__temp") == [21.0]
    (tmp_path / "station.csv").write_text('meta;x\n;"Ozon";NO2\nunit;a;b\n01.02.2024 03:00;1,5;2\n')
    got = tables.station_report(spark, str(tmp_path / "station.csv"), "s1").orderBy("component").collect()
    assert [(r["component"], r["value"], r["station_hour_local"]) for r in got] == [("NO2", 2.0, dt.datetime(2024, 2, 1, 3)), ("Ozon", 1.5, dt.datetime(2024, 2, 1, 3))]
    assert tables.files(spark, str(tmp_path)).count() == 2
    with pytest.raises(ValueError):
        tables.required(spark.range(1), ["nope"])


def test_stream_of_sessions(spark, tmp_path):
    rows = [(1, at(0)), (1, at(60)), (1, at(4000)), (2, at(5)), (1, at(90000)), (2, at(90000))]
    spark.createDataFrame(rows, "u int, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("u int, ts timestamp").parquet(str(tmp_path / "in"))
    q = streaming.gap_sessions(stream, "u", "ts", "10 minutes", "1 minute").writeStream.outputMode("append").format("memory").queryName("ses").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["u"], r["n_fixes"]) for r in spark.sql("SELECT * FROM ses").collect()) == [(1, 1), (1, 2), (2, 1)]
