"""Scans and sinks over hand-made files."""

import datetime as dt
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from wayfold.functions import parse
from wayfold.plans.scans import polyline_file
from wayfold.sources import shared, sinks, tables, vectors


def test_delimiters():
    assert [tables.sniffed(x) for x in ("a;b\n1,5;2\n", "a|b\n1|2\n", "a\tb\n", "one\ntwo\n", "  \n", "")] == [";", "|", "\t", ",", ",", ","]
    assert tables.sniffed('"a;b;c",d\n"x;y;z",1\n') == ","
    assert [tables.header_delimiter(x) for x in ("a;b,c", "a;b", "a\tb", "a")] == [",", ";", "\t", ","]


def test_encodings_and_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿Straße;n\nweiß;1\n".encode())
    (tmp_path / "b.csv").write_bytes("Straße;n\n\"groß; \"\"sehr\"\"\";2\n".encode("latin-1"))
    (tmp_path / "c.csv").write_text("n,n,\n3,4,5\n")
    (tmp_path / "empty.csv").write_text("")
    rows = {r["source_file"]: r for r in tables.csv(spark, str(tmp_path)).collect()}
    assert rows["a.csv"]["Straße"] == "weiß" and rows["b.csv"]["Straße"] == 'groß; "sehr"'
    assert (rows["c.csv"]["n"], rows["c.csv"]["n.1"], rows["c.csv"]["Unnamed: 2"]) == ("3", "4", "5")
    with pytest.raises(ValueError):
        tables.csv(spark, str(tmp_path / "empty.csv"))


def test_times_without_and_with_zones(spark):
    texts = ["2024-03-31T01:30:00Z", "2024-03-31T03:30:00+02:00", "2024-03-31 01:30:00", "31.03.2024 01:30", "2024-03-31T01:30:00.250", "nonsense", None]
    for zone in ("UTC", "Asia/Tokyo"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            got = [r[0] for r in spark.createDataFrame([(x,) for x in texts], "t string").select(tables.utc_time(F.col("t"))).collect()]
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        t = dt.datetime(2024, 3, 31, 1, 30)
        assert got == [t, t, t, t, t + dt.timedelta(milliseconds=250), None, None]


def test_logs_with_seconds_only(spark, tmp_path):
    (tmp_path / "x.csv").write_text("unix_time_s,temp,gps_lat\n1704067200,1,5\n1704067200,2,5\n,3,5\n")
    got = tables.raw_metrics(spark, str(tmp_path / "x.csv")).collect()
    assert [(r["ts"], r["temp"], r["unix_time_s"]) for r in got] == [(dt.datetime(2024, 1, 1), "2", "1704067200")]
    assert tables.sensor_fixes(spark, str(tmp_path / "x.csv")).count() == 0
    assert [r["mobile_aq__temp"] for r in tables.air_metrics(spark, str(tmp_path / "x.csv")).collect()] == [2.0]


def test_reports(spark, tmp_path):
    (tmp_path / "s.csv").write_text('Station;X\n\n;"Ozon";;Stickoxide\nEinheit;a;b;c\n01.02.2024 03:00;1,5;-;x\nno date;9;9;9\n')
    r = tables.station_hours(spark, str(tmp_path / "s.csv"), "mitte").collect()
    assert [tuple(x) for x in r] == [(dt.datetime(2024, 2, 1, 3), 1.5, None, None)]
    assert r[0].__fields__ == ["station_hour_local", "mitte__ozon", "mitte__value_2", "mitte__stickoxide"]
    (tmp_path / "one.csv").write_text("only a line\n")
    with pytest.raises(ValueError):
        tables.station_hours(spark, str(tmp_path / "one.csv"), "s")


def test_discovery(spark, tmp_path):
    deep = tmp_path / "logs" / "deep"
    deep.mkdir(parents=True)
    (tmp_path / "logs" / "other.csv").write_text("a\n")
    names = lambda *a: sorted(r["name"] for r in tables.discovered(spark, *a).collect())
    assert names(str(tmp_path / "logs")) == ["other.csv"]
    (deep / "enviro_log_1.csv").write_text("a\n1\n")
    assert names(str(tmp_path / "logs")) == ["enviro_log_1.csv"]
    (tmp_path / "logs" / "enviro_log_1.csv").write_text("a\n1\n")
    (tmp_path / "logs" / "enviro_log_2.csv").write_text("a\n22\n")
    assert names(str(tmp_path / "logs")) == ["enviro_log_1.csv", "enviro_log_2.csv"]
    assert names(str(tmp_path / "nowhere"), [str(tmp_path)]) == ["enviro_log_1.csv", "enviro_log_2.csv"]
    assert names(str(tmp_path / "nowhere")) == []


def test_nested_timelines(spark, tmp_path):
    cell = "[{'startTime': 'a', 'endTime': None, 'visit': {'topCandidate': {'placeLocation': {'latLng': '1°, 2°'}, 'probability': 0.5}}}]"
    (tmp_path / "t.csv").write_text(f'semanticSegments\n"{cell}"\n"not a list"\n')
    r = tables.timeline(spark, str(tmp_path / "t.csv")).collect()
    assert [(x["startTime"], x["endTime"], x["visit_topCandidate_placeLocation_latLng"], x["visit_topCandidate_probability"]) for x in r] == [("a", None, "1°, 2°", "0.5")]
    (tmp_path / "u.csv").write_text("x\n1\n")
    with pytest.raises(ValueError):
        tables.timeline(spark, str(tmp_path / "u.csv"))


def test_log_files_take_over_old_names(spark, tmp_path):
    (tmp_path / "enviro_1700000000.csv").write_text("old\n")
    df = spark.createDataFrame([("enviro_1700000000.csv", 1), ("a b.csv", 2)], "log string, x int")
    assert sinks.log_files(df, str(tmp_path), "log") == ["a b.csv", "enviro_log_2023-11-14_1700000000.csv"]
    assert sorted(p.name for p in tmp_path.iterdir() if p.suffix == ".csv" and not p.name.startswith(".")) == ["a b.csv", "enviro_log_2023-11-14_1700000000.csv"]
    assert (tmp_path / "a b.csv").read_text() == "x\n2\n"


def test_wiping(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "deep" / "x").write_text("x")
    (tmp_path / "in" / "y").write_text("y")
    assert sinks.wipe(spark, str(tmp_path / "in")) == 2 and list((tmp_path / "in").iterdir()) == []
    for unsafe in ("/", "/tmp"):
        with pytest.raises(ValueError):
            sinks.wipe(spark, unsafe)


def test_vector_files(spark, tmp_path):
    import sqlite3

    line = struct.pack("<BII", 1, 2, 2) + struct.pack("<4d", 13.0, 52.0, 13.5, 52.5)
    assert vectors.wkb_points(line) == [(13.0, 52.0), (13.5, 52.5)]
    multi = struct.pack(">BII", 0, 1005, 1) + struct.pack(">BII", 0, 1002, 1) + struct.pack(">3d", 1.0, 2.0, 3.0)
    assert vectors.wkb_points(multi) == [(1.0, 2.0)] and vectors.wkb_points(b"") == []
    assert vectors.shapefile_points(polyline_file([[(1.0, 2.0), (3.0, 4.0)], [(5.0, 6.0)]])) == [[(1.0, 2.0), (3.0, 4.0)], [(5.0, 6.0)]]
    con = sqlite3.connect(tmp_path / "to_uni_opnv.gpkg")
    con.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT)")
    con.execute("INSERT INTO gpkg_geometry_columns VALUES ('legs', 'geom')")
    con.execute("CREATE TABLE legs (id INTEGER PRIMARY KEY, geom BLOB, mode TEXT)")
    con.execute("INSERT INTO legs VALUES (1, ?, 'walk')", (b"GP\x00\x01" + struct.pack("<i", 4326) + line,))
    con.commit()
    con.close()
    (tmp_path / "to_uni_opnv_train.shp").write_bytes(polyline_file([[(0.0, 0.0), (1.0, 1.0)]]))
    got = vectors.vertices(spark, str(tmp_path))
    assert {(r["attributes"], r["x"]) for r in got.collect()} == {('{"id": 1, "mode": "walk"}', 13.0), ('{"id": 1, "mode": "walk"}', 13.5), ("{}", 0.0), ("{}", 1.0)}
    assert [tuple(r) for r in vectors.known_routes(got).orderBy("pos").collect()] == [("to_uni_opnv", 0, 52.0, 13.0), ("to_uni_opnv", 1, 52.5, 13.5)]


def test_unzipping(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "g.zip", "w") as z:
        z.writestr("Feed/Stops.txt", "a,b\n1,2\n")
    top = vectors.unzipped(spark, str(tmp_path / "g.zip"))
    assert [tuple(r) for r in spark.read.csv(f"{top}/stops.txt", header=True).collect()] == [("1", "2")]


def test_scopes_clear_the_shared_folder(spark):
    with shared.scope(spark):
        path = shared.fresh_path(spark, "x")
        spark.range(3).write.parquet(path)
    fs, at = shared.file_system(spark, path)
    assert not fs.exists(at)


def test_columns(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "`PM2.5` int, `PM10 Count` int, pm10_count int, temp int")
    assert parse.without_particles(df).columns == ["pm10_count", "temp"]
    df = spark.createDataFrame([("1,5", None, "x"), ("2", "3", "y")], "a string, b string, c string")
    assert (parse.best_filled(df, ["z", "b", "a"]), parse.best_filled(df, ["c"]), parse.best_filled(df, ["z"])) == ("a", None, None)
    assert parse.first_present(["GPS Lat", "lat"], ["gps_lat"], parse.header_key) == "GPS Lat"
    assert parse.station_column(["S1__Stickoxide NO", "s1__Stickstoffmonoxid", "s2__no2"], "s1", "NO") == "s1__Stickstoffmonoxid"
