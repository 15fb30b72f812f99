"""Cases that projections to larger tables brought up: what one task holds, and tables of very many small files."""

from __future__ import annotations

import datetime as dt
import random
from collections import defaultdict

import pytest
from conftest import SF_DIR, shown
from pyspark.sql import functions as F
from test_scale import _dijkstra

from wayfold.operators import graph, joins, polylines, routes, sequences
from wayfold.plans import routes as plans
from wayfold.plans import scans
from wayfold.sources import sinks, tables


def test_small_files_are_read_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "MANY", 5)
    for i in range(12):
        (tmp_path / f"l{i:02}.csv").write_bytes(f"﻿a;b\r\n{i};x\r\n{i};y\r\n".encode())
    (tmp_path / "empty.csv").write_text("")
    got = tables.scans(spark, str(tmp_path))
    assert [d.columns for d in got] == [["a", "b", "file_row", "source_file"]]
    assert all(f.endswith(".parquet") for f in got[0].inputFiles())
    rows = got[0].orderBy("source_file", "file_row").select("source_file", "a", "b").collect()
    assert [tuple(r) for r in rows] == [(f"l{i:02}.csv", str(i), b) for i in range(12) for b in "xy"]


def test_logs_are_made_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def told(frames):
        for f in frames:
            made.add(len(f))
            yield f

    df = spark.range(40).select(F.concat(F.lit("enviro_"), (1_700_000_000 + F.col("id") % 4).cast("string"), F.lit(".csv")).alias("log"), "id").mapInPandas(told, "log string, id long")
    (tmp_path / "enviro_1700000001.csv").write_text("old\n")
    assert sinks.log_files(df, str(tmp_path), "log", ["id"]) == [f"enviro_log_2023-11-14_{1_700_000_000 + i}.csv" for i in range(4)]
    assert made.value == 40 and not (tmp_path / "enviro_1700000001.csv").exists()
    assert (tmp_path / "enviro_log_2023-11-14_1700000001.csv").read_text().split() == ["id", *map(str, range(1, 40, 4))]


def test_reports_in_several_files(spark, tmp_path):
    for i, names in enumerate((";Ozon", ";Ozon", ";Stickoxide;Ozon")):
        (tmp_path / f"part-{i}").write_text(f"Station;X\n{names}\n0{i + 1}.02.2024 03:00;{i},5;7\n")
    (tmp_path / "part-9").write_text("")
    got = tables.station_hours(spark, str(tmp_path), "s").collect()
    assert sorted((r["station_hour_local"], r["s__ozon"], r["s__stickoxide"]) for r in got[:2]) == [(dt.datetime(2024, 2, i + 1, 3), i + 0.5, None) for i in (0, 1)]
    assert [(r["s__ozon"], r["s__stickoxide"]) for r in got[2:]] == [(7.0, 2.5)]
    assert sorted((r["component"], r["value"]) for r in tables.station_report(spark, str(tmp_path), "s").collect()) == [("Ozon", 0.5), ("Ozon", 1.5), ("Ozon", 7.0), ("Stickoxide", 2.5)]


def test_orders_run_over_files(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        scans._csv(spark.range(400).select((F.col("id") * 7 % 400).alias("k"), (F.col("id") * 7 % 400).alias("v")), str(tmp_path / "x"), "k")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted((tmp_path / "x").glob("part-*"))
    assert len(files) > 1
    assert [int(x) for f in files for x in f.read_text().split()[1:]] == list(range(400))


def test_cells_are_in_files_of_some_rows(spark, monkeypatch):
    paths = []
    own = tables.timeline
    monkeypatch.setattr(tables, "timeline", lambda s, path: paths.append(path) or own(s, path))
    monkeypatch.setattr(scans, "CELLS", 40, raising=False)
    n = spark.read.parquet(f"{SF_DIR}/customer.parquet").count()
    assert scans.scan_timeline(spark, SF_DIR).count() == 3 * n
    for path in paths[0]:
        assert spark.read.text(path).select(F.input_file_name()).distinct().count() >= n // 40


@pytest.mark.parametrize("rows", [1 << 18, 20])
def test_tasks_hold_some_rows(spark, monkeypatch, rows):
    monkeypatch.setattr(sequences, "TASK_ROWS", rows, raising=False)
    s = spark.range(200).select((F.col("id") % 50).alias("k"), "id", F.when(F.col("id") < 100, "walk").otherwise("bus").alias("label"), F.lit(1.0).alias("m"))
    spans = routes.relative_spans(s, ["k"], "id", "label", "m")
    parts = s.select("k", "id", "label", F.col("m").alias("distance_m"), F.lit(2.0).alias("speed_mps"), F.lit(0.0).alias("walk_dwell_after_s"))
    plan = routes.scheduled(parts, ["k"], "id", F.lit(10.0))
    times = spark.range(50).select(F.col("id").alias("k"), F.lit(5.0).alias("t"), F.lit(10.0).alias("dt"), F.lit(4.0).alias("p"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("i"))
    at = routes.distance_on_schedule(times, plan, ["k"], "t", "dt", "p")
    tasks = [x.rdd.getNumPartitions() for x in (spans, plan, at)]
    assert tasks == [11, 11, 21] if rows == 20 else max(tasks) <= 4
    assert spans.groupBy("mode", "start_rel", "end_rel").count().count() == 2 and at.groupBy("distance_here_m").count().collect()[0]["count"] == 400


def test_searches_meet_in_the_middle(spark):
    rng, n = random.Random(3), 1200
    rows = [(i, rng.randrange(n), 100.0 + rng.randint(0, 99)) for i in range(n) for _ in range(3)]
    pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(4)]
    by = defaultdict(list)
    for a, b, w in rows:
        by[a].append((b, w))
        by[b].append((a, w))
    states = graph.explored(spark.createDataFrame(rows, "src long, dst long, weight_m double"), spark.createDataFrame(pairs, "source long, target long")).cache()
    assert {(r["source"], r["target"]): r["distance"] for r in states.where("node = target").collect()} == {(a, b): _dijkstra(by, a)[b] for a, b in pairs}
    assert states.count() < 0.3 * len(pairs) * n


def test_logs_are_dealt_before_they_are_joined(spark, monkeypatch):
    given, own = [], routes.commutes
    monkeypatch.setattr(routes, "commutes", lambda df, *a: given.append(df) or own(df, *a))
    monkeypatch.setattr(sequences, "TASK_ROWS", 500)
    plans.commute_lookup(spark, SF_DIR)
    assert given[0].rdd.getNumPartitions() > spark.read.parquet(f"{SF_DIR}/lineitem.parquet").count() // 500 > 1
    at = lambda m: dt.datetime(2024, 1, 1, 8, m)
    rows = [("a", at(0), 10.0), ("a", at(2), None), ("a", at(4), 20.0), ("a", at(30), None), ("a", None, 90.0), ("b", at(1), None), ("b", at(31), None)]
    got = own(spark.createDataFrame(rows, "log string, ts timestamp_ntz, temp double"), ["log"], "ts", "temp", ["temp"]).collect()
    assert sorted(map(tuple, got)) == [("a", at(0), at(30), "to_uni_opnv"), ("b", at(1), at(31), "from_uni_bike")]


def test_routes_are_chosen_by_ends_and_keep_their_metres(spark, monkeypatch):
    v = spark.createDataFrame([(c, j, 52.0 + i, 13.0 + 0.01 * j) for i, c in enumerate(("to_uni_bike", "from_uni_opnv")) for j in range(6)], "route_class string, j long, lat double, lon double")
    known = polylines.lines(v, ["route_class"], "j", "lat", "lon").union(spark.createDataFrame([("to_uni_opnv", [])], "route_class string, line array<struct<lat:double,lon:double,cum:double>>"))
    at = dt.datetime(2024, 1, 1)
    trip = lambda i, kind, mode, ends, hint=None, time=None: (i, kind, mode, *ends, at, at, hint, time, [])
    rows = [trip(0, "visit_stationary", "CYCLING", (52.0, 13.0, 52.0, 13.0)), trip(1, "t", "CYCLING", (52.0, 13.041, 52.0, 13.011)), trip(2, "t", "", (53.0, 13.0, 53.0, 13.02)),
            trip(3, "t", "IN_BUS", (52.0, 13.0, 52.0, 13.1), "to_uni_bike"), trip(4, "t", "IN_BUS", (52.0, 13.0, 52.0, 13.1), None, "to_uni_opnv"), trip(5, "t", "CYCLING", (52.0, 13.0, 52.0, 13.01), "from_uni_bike", "from_uni_opnv")]
    df = spark.createDataFrame(rows, "segment_id long, kind string, mode string, start_lat double, start_lon double, end_lat double, end_lon double, start_t timestamp_ntz, end_t timestamp_ntz, route_class_hint string, time_class string, points array<struct<lat:double,lon:double>>")
    measured = []
    own = polylines.aligned
    monkeypatch.setattr(polylines, "aligned", lambda *a: measured.append(1) or own(*a))
    got = routes.baseline_paths(df, known, False).orderBy("segment_id").collect()
    assert not measured  # no line is looked at for its ends
    assert [(r["route_class"], r["method"].rpartition(":")[2], [round(p["lon"], 3) for p in r["line"]]) for r in got] == [
        (None, "stationary", [13.0]), ("to_uni_bike", "mode_endpoint_fallback", [13.04, 13.03, 13.02, 13.01]), ("from_uni_opnv", "mode_endpoint_fallback", [13.0, 13.01, 13.02]),
        ("to_uni_bike", "primitive_time_hint", [13.0, 13.01, 13.02, 13.03, 13.04, 13.05]), ("to_uni_opnv", "classification_time_match", []), ("to_uni_bike", "mode_endpoint_fallback", [13.0, 13.01])]
    step = got[3]["line"][1]["cum"]
    assert [round(r["distance_m"] / step, 6) for r in got] == [0, 3, round(got[2]["distance_m"] / step, 6), 5, 0, 1] and got[1]["line"][0]["cum"] == 0


def test_long_logs_are_matched_by_ranges(spark, duck, monkeypatch):
    split, own = [], joins.asof_nearest_split
    monkeypatch.setattr(joins, "asof_nearest_split", lambda *a: split.append(1) or own(*a, ranges=7))
    got = scans.match_files(spark, SF_DIR).toPandas()
    assert split and shown(got) == shown(duck.sql(scans.ORACLES["match_files"]).df())


def test_logs_are_written_some_at_a_time(spark, tmp_path, monkeypatch):
    held, own = [], sinks._matching
    monkeypatch.setattr(sinks, "LOGS", 4, raising=False)
    monkeypatch.setattr(sinks, "_matching", lambda *a: held.append(own(*a)) or held[-1])
    (tmp_path / "enviro_1700000003.csv").write_text("old\n")
    df = spark.range(80).select(F.concat(F.lit("enviro_"), (1_700_000_000 + F.col("id") % 40).cast("string"), F.lit(".csv")).alias("log"), "id")
    names = [f"enviro_log_2023-11-14_{1_700_000_000 + i}.csv" for i in range(40)]
    assert sinks.log_files(df, str(tmp_path), "log", ["id"]) == names
    assert max(map(len, held)) <= 12  # a tenth of the logs, or as many as fall together
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == names
    assert all((tmp_path / x).read_text().split() == ["id", str(i), str(i + 40)] for i, x in enumerate(names))
    both = spark.createDataFrame([("enviro_1700000000.csv",), ("enviro_log_2023-11-14_1700000000.csv",), ("c.csv",)], "log string").withColumn("x", F.lit("new"))
    with pytest.raises(ValueError, match="several parts"):
        sinks.log_files(both, str(tmp_path), "log")
    assert (tmp_path / names[0]).read_text().split() == ["id", "0", "40"] and not (tmp_path / "c.csv").exists()


def test_files_are_scanned_some_at_a_time(spark, tmp_path, monkeypatch):
    for i in range(25):
        (tmp_path / f"l[{i:02}] ä%.csv").write_bytes(f"a;b\n{i};x\n{i};y\n".encode() if i % 5 else f"c,b\n{i},é\n".encode("latin-1"))
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "_hidden.csv").write_text("a;b\n1;2\n")
    (tmp_path / "l.txt").write_text("a;b\n99;x\n99;y\n")
    shown = lambda got: [(d.columns, [tuple(r) for r in d.select("source_file", *d.columns[:2]).orderBy("source_file", "file_row").collect()]) for d in got]
    told = lambda pattern: sorted(tuple(r) for r in tables.discovered(spark, str(tmp_path), pattern=pattern).collect())
    whole, found, some = shown(tables.scans(spark, str(tmp_path))), told("*.csv"), told("l?{00,05}*.csv")
    assert len(whole) == 2 and len(found) == 25 and len(some) == 2
    seen, own = [], tables._kinds
    monkeypatch.setattr(tables, "FILES", 7, raising=False)
    monkeypatch.setattr(tables, "_kinds", lambda s, path, *a: seen.append(path) or own(s, path, *a))
    assert shown(tables.scans(spark, str(tmp_path))) == whole
    assert [len(x) for x in seen] == [7, 7, 7, 6]
    assert told("*.csv") == found and told("l?{00,05}*.csv") == some
