"""Operators that split what one task can't hold, against plain folds and searches."""

from __future__ import annotations

import heapq
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfold.operators import graph, joins, loading, nearest, routes, sequences, thinning
from wayfold.sources import sinks


# Nearest edges


def _all_edges(ax, ay, bx, by, x, y):
    best = (math.inf, 0)
    for i in range(len(ax)):
        dx, dy = bx[i] - ax[i], by[i] - ay[i]
        square = dx * dx + dy * dy
        t = 0.0 if square <= 1e-12 else min(1.0, max(0.0, ((x - ax[i]) * dx + (y - ay[i]) * dy) / square))
        best = min(best, (float(np.sqrt((x - (ax[i] + t * dx)) ** 2 + (y - (ay[i] + t * dy)) ** 2)), i))
    return best


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 64, 65, 500])
def test_trees_find_the_nearest_edge(n):
    rng = np.random.default_rng(n)
    vx, vy = np.round(np.cumsum(rng.normal(size=n + 1)), 1), np.round(np.cumsum(rng.normal(size=n + 1)), 1)
    vx[n // 2] = vx[max(0, n // 2 - 1)]  # ties
    tree = nearest.EdgeTree(vx[:-1], vy[:-1], vx[1:], vy[1:])
    px, py = rng.normal(scale=20, size=60), rng.normal(scale=20, size=60)
    px[:5], py[:5] = vx[:1], vy[:1]
    edge, far, _ = tree.nearest(px, py)
    for i in range(60):
        d, e = _all_edges(vx[:-1], vy[:-1], vx[1:], vy[1:], px[i], py[i])
        assert (edge[i], far[i]) == (e, pytest.approx(d, abs=1e-9))


def test_trees_look_at_few_edges():
    n = 100_000
    rng = np.random.default_rng(1)
    turn = np.cumsum(rng.normal(scale=0.05, size=n + 1))
    vx, vy = np.cumsum(np.cos(turn)) * 20, np.cumsum(np.sin(turn)) * 20
    tree = nearest.EdgeTree(vx[:-1], vy[:-1], vx[1:], vy[1:])
    at = rng.integers(0, n, 400)
    px, py = vx[at] + rng.normal(scale=15, size=400), vy[at] + rng.normal(scale=15, size=400)
    edge, far, _ = tree.nearest(px, py)
    assert tree.visited / 400 < 40 * math.log2(n)
    dx, dy = np.diff(vx), np.diff(vy)
    for i in range(0, 400, 20):
        t = np.clip(((px[i] - vx[:-1]) * dx + (py[i] - vy[:-1]) * dy) / (dx * dx + dy * dy), 0, 1)
        every = np.hypot(px[i] - vx[:-1] - t * dx, py[i] - vy[:-1] - t * dy)
        assert far[i] == pytest.approx(every.min()) and edge[i] == every.argmin()


def test_trees_skip_what_is_not_finite():
    nan = float("nan")
    tree = nearest.EdgeTree(np.array([0.0, nan, 5.0]), np.zeros(3), np.array([1.0, 2.0, 6.0]), np.zeros(3))
    edge, far, _ = tree.nearest(np.array([2.0, nan, 5.5]), np.array([0.0, 0.0, 1.0]))
    assert edge[0] == 0 and far[0] == 1.0 and far[1] == math.inf and (edge[2], far[2]) == (2, 1.0)


@pytest.mark.parametrize("block", [1 << 18, 5])
def test_points_on_lines(spark, monkeypatch, block):
    monkeypatch.setattr(nearest, "BLOCK", block)
    rng = random.Random(2)
    vertices = [(k, j, rng.uniform(0, 50), rng.uniform(0, 50)) for k in ("a", "b", None) for j in range(12)] + [("lone", 0, 1.0, 1.0)]
    points = [(rng.choice(("a", "a", "b", "c", None)), i, rng.choice((rng.uniform(0, 50), None, float("nan"))), rng.uniform(0, 50)) for i in range(80)]
    edges = joins.edges(spark.createDataFrame(vertices, "k string, pos long, x double, y double"), ["k"], "pos", "x", "y")
    got = joins.project_on_lines(spark.createDataFrame(points, "k string, id long, x double, y double"), edges, ["k"], "id", "x", "y")
    assert got.columns == ["k", "id", "distance_m", "chainage_m", "edge", "near_x", "near_y"]
    rows = {r["id"]: r for r in got.collect()}
    assert set(rows) == {i for k, i, _, _ in points if k in ("a", "b")}
    own = defaultdict(list)
    for k, j, x, y in vertices:
        own[k].append((x, y))
    for k, i, x, y in points:
        if i not in rows:
            continue
        if x is None or math.isnan(x):
            assert rows[i]["distance_m"] is None and rows[i]["edge"] is None
            continue
        v = own[k]
        d, e = _all_edges([p[0] for p in v[:-1]], [p[1] for p in v[:-1]], [p[0] for p in v[1:]], [p[1] for p in v[1:]], x, y)
        assert rows[i]["edge"] == e and rows[i]["distance_m"] == pytest.approx(d)
        assert math.hypot(rows[i]["near_x"] - x, rows[i]["near_y"] - y) == pytest.approx(d)


# Thinning


def _fold(rows, far, seconds):
    out = []
    for r in sorted(rows):
        if not out or r[0] - out[-1][0] >= seconds or far(out[-1], r):
            out.append(r)
    return out


@pytest.mark.parametrize("per_range", [1 << 20, 40, 7])
def test_thinning_of_all_rows(spark, per_range):
    rng = random.Random(3)
    rows, t = [], 0
    for i in range(200):
        t += rng.choice((0, 0, 1, 2, 3, 40))
        rows.append((t, i, rng.choice((0.0, 1.0, 2.0, 9.0))))
    df = spark.createDataFrame([*rows, (None, 999, 1.0)], "t long, id long, v double")
    got = thinning.thin_all(df, "t", ["id"], ["v"], lambda a, b: abs(b["v"] - a["v"]) >= 5, 15, rows_of_range=per_range)
    assert sorted(map(tuple, got.collect())) == _fold(rows, lambda a, b: abs(b[2] - a[2]) >= 5, 15)
    assert thinning.thin_all(df.where("t < 0"), "t", ["id"], ["v"], lambda a, b: a["v"] > 9, 15).collect() == []


def test_chains_pass_ranges_that_keep_nothing(spark):
    rows = [(0, 0, 0.0)] + [(1, i, 0.0) for i in range(1, 60)] + [(15, 99, 0.0)]
    df = spark.createDataFrame(rows, "t long, id long, v double")
    got = thinning.thin_all(df, "t", ["id"], ["v"], lambda a, b: abs(b["v"] - a["v"]) >= 5, 15, rows_of_range=5)
    assert sorted(map(tuple, got.collect())) == [rows[0], rows[-1]]


def test_thinning_by_places(spark):
    rng = random.Random(4)
    rows = [(i * 4, i, 52.0 + rng.randint(0, 4) * 5e-5, 13.0, "x") for i in range(100)]
    df = spark.createDataFrame(rows, "t long, id long, lat double, lon double, note string")
    got = thinning.thin_all(df, "t", ["id"], ["lat", "lon"], thinning.places_apart(10.0), 15, ["note"], rows_of_range=9)
    apart = lambda a, b: math.radians(abs(a[2] - b[2])) * 6371000.0 >= 10
    assert sorted(map(tuple, got.collect())) == _fold(rows, apart, 15)


# Paths


def _dijkstra(edges, source):
    out, heap = {}, [(0.0, source)]
    while heap:
        d, u = heapq.heappop(heap)
        if u in out:
            continue
        out[u] = d
        for v, w in edges[u]:
            if v not in out:
                heapq.heappush(heap, (d + w, v))
    return out


def test_paths_between_pairs_stay_near_them(spark):
    rng, side = random.Random(5), 16
    rows = []
    for x in range(side):
        for y in range(side):
            rows += [(x * side + y, nx * side + ny, 100.0 + rng.randint(0, 9)) for nx, ny in ((x + 1, y), (x, y + 1)) if nx < side and ny < side]
    rows += [(1000, 1001, 1.0), (1001, 1002, 0.0)]
    by = defaultdict(list)
    for a, b, w in rows:
        by[a].append((b, w))
        by[b].append((a, w))
    pairs = [(rng.randrange(side * side), rng.randrange(side * side)) for _ in range(12)] + [(1000, 1002), (0, 1002), (7, 7), (5, 4444)]
    edges, wanted = spark.createDataFrame(rows, "src long, dst long, weight_m double"), spark.createDataFrame(pairs, "source long, target long")
    states = graph.explored(edges, wanted).cache()
    got = {(r["source"], r["target"]): r["distance"] for r in states.where("node = target").collect()}
    want = {}
    for a, b in pairs:
        if b in (found := _dijkstra(by, a)) and a in by:
            want[a, b] = found[b]
    assert got.keys() == want.keys() and all(got[p] == pytest.approx(want[p]) for p in want)
    assert states.count() < 0.5 * len(pairs) * side * side


# As-of joins


def test_split_logs_match_as_whole_ones(spark):
    rng = random.Random(6)
    rows = [(rng.choice((1, 1, 1, 2)), rng.choice((rng.randint(0, 3000), None)), i, float(i)) for i in range(600)]
    df = spark.createDataFrame(rows, "k long, s long, id long, v double").select("k", F.timestamp_seconds("s").alias("t"), "id", "v")
    left, right = df.where("id % 3 = 0"), df.where("id % 3 > 0")
    for tolerance in (None, 4.0):
        whole = joins.asof_nearest(left.where("t IS NOT NULL"), right, ["k"], "t", "id", "id", ["v"], tolerance)
        split = joins.asof_nearest_split(left, right, ["k"], "t", "id", "id", ["v"], tolerance, ranges=9)
        assert sorted(map(tuple, split.where("t IS NOT NULL").collect())) == sorted(map(tuple, whole.collect()))
        assert {r["right_v"] for r in split.where("t IS NULL").collect()} == {None}


def test_split_logs_take_many_tasks(spark):
    n = 20_000
    left = spark.range(n).select(F.lit(1).alias("k"), F.timestamp_seconds(F.col("id") * 2).alias("t"), "id")
    right = spark.range(n).select(F.lit(1).alias("k"), F.timestamp_seconds(F.col("id") * 2 + 1).alias("t"), "id", (F.col("id") * 1.0).alias("v"))
    out = joins.asof_nearest_split(left, right, ["k"], "t", "id", "id", ["v"], ranges=8)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(k" in plan and "__range" in plan
    parts = [r["n"] for r in out.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(parts) == n and out.where("v IS NULL").count() == 0


# Days


def test_days_with_nulls_keep_their_ranks(spark):
    rows = [(1, "b", 1), (1, "a", 2), (1, "b", 0), (1, None, 5), (None, "a", 7)]
    got = sequences.day_pass_ids(spark.createDataFrame(rows, "k long, day string, id long"), ["k"], "day", ["id"])
    assert sorted(((r["k"], r["day"], r["id"], r["pass_id"], r["pass_row_index"]) for r in got.collect()), key=str) == sorted(
        [(1, "b", 1, 3, 2), (1, "a", 2, 2, 1), (1, "b", 0, 3, 1), (1, None, 5, 1, 1), (None, "a", 7, 1, 1)], key=str)


# Schedules


def test_schedules_as_values_are_those_of_tables(spark):
    spans = spark.createDataFrame([("r", 1, "walk", 0.0, 0.2), ("r", 2, "bus", 0.2, 0.7), ("r", 3, "foot", 0.7, 0.9), ("r", 4, "tram", 0.9, 1.0)], "route_class string, seq long, mode string, start_rel double, end_rel double")
    rng = random.Random(7)
    rows = [(i, "r", 4000.0, rng.uniform(0, 4000), rng.uniform(0, 4000), rng.uniform(10, 5000), rng.choice((30.0, 130.0, 400.0, 3000.0)), "IN_BUS") for i in range(60)] + [(90, "r", 0.0, 1.0, 2.0, 5.0, 60.0, "IN_BUS"), (91, "none", 9.0, 1.0, 2.0, 5.0, 60.0, "IN_BUS")]
    iv = spark.createDataFrame(rows, "k long, route_class string, baseline_m double, start_chainage_m double, end_chainage_m double, path_m double, dt double, mode string")
    table = routes.scheduled(routes.clipped_spans(iv, spans, ["route_class"]), ["k"], "seq", F.col("dt"))
    times = iv.withColumn("e", F.explode(F.array(*[F.col("dt") * x / 10 for x in range(11)])))
    want = routes.distance_on_schedule(times, table, ["k"], "e", "dt", "path_m").select("k", "e", "distance_here_m").collect()
    held = routes.with_profiles(iv, spans, ["route_class"])
    value = routes.interval_schedule(F.col("profile"), F.col("baseline_m"), F.col("start_chainage_m"), F.col("end_chainage_m"), F.col("path_m"), F.col("mode"), F.col("dt"))
    held = held.withColumn("s", value).withColumn("e", F.explode(F.array(*[F.col("dt") * x / 10 for x in range(11)])))
    got = {(r["k"], r["e"]): r["d"] for r in held.where("s IS NOT NULL").select("k", "e", routes.distance_on_parts(F.col("e"), F.col("dt"), F.col("path_m"), F.col("s")).alias("d")).collect()}
    assert {k for k, _ in got} == {r["k"] for r in table.select("k").distinct().collect()} and len({k for k, _ in got}) > 50
    for k, e, d in want:
        if (k, e) in got:
            assert got[k, e] == pytest.approx(d, abs=1e-6)


# Files


def test_each_file_has_its_reason(spark):
    files = [("a", "a", True, None), ("b", "b", False, None), ("c", "c", True, "bad"), ("d", "d", True, None), ("e", "e", True, None), ("f", "f", True, None), ("g", "g", True, None)]
    at = lambda s: f"2024-01-10 00:00:{s:02d}"
    rows = [("a", 0, at(0), 52.0, 13.0), ("a", 1, at(30), 52.0, 13.0), ("b", 0, at(1), 52.5, 13.0), ("c", 0, at(2), 52.5, 13.0), ("d", 0, at(3), None, 13.0), ("e", 0, None, 52.0, 13.0), ("f", 0, "2025-01-01 00:00:00", 52.0, 13.0), ("g", 0, at(5), 52.0, 13.0)]
    f = spark.createDataFrame(files, "source_file string, source_name string, context_match boolean, error string")
    r = spark.createDataFrame(rows, "source_file string, pos long, ts string, lat double, lon double").withColumn("ts", F.col("ts").cast("timestamp"))
    import datetime as dt

    window = dt.datetime(2024, 1, 9), dt.datetime(2024, 1, 11)
    fixes, report = loading.loaded_fixes(f, r, window)
    got = {x["source_file"]: (x["status"], x["reason"], x["rows_loaded"]) for x in report.collect()}
    out = "sorted_out"
    assert got == {"a": ("loaded_for_fusion", "loaded_for_fusion", 2), "b": (out, "excluded_by_filename_time_hints", 0), "c": (out, "parse_error", 0), "d": ("loaded_for_fusion", "loaded_time_only_no_valid_gps_points", 0),
                   "e": (out, "no_valid_timestamp_or_latlon_rows", 0), "f": (out, "outside_google_time_window", 0), "g": (out, "dropped_during_global_deduplication", 0)}
    assert [(x["source_file"], x["fix_id"]) for x in fixes.orderBy("fix_id").collect()] == [("a", 0), ("a", 1)]
    _, report = loading.loaded_fixes(f.withColumn("context_match", F.lit(False)), r, window)
    assert {x["reason"] for x in report.where("source_file IN ('a', 'b')").collect()} == {"loaded_via_context_fallback"}
    fixes, report = loading.loaded_fixes(f.where("FALSE"), r.where("FALSE"), window)
    assert fixes.collect() == [] and report.collect() == []


def test_logs_are_one_file_each(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 3)
    try:
        df = spark.range(20).select(F.concat(F.lit("log_"), F.col("id") % 2, F.lit(".csv")).alias("log"), "id")
        assert sinks.log_files(df, str(tmp_path), "log", ["id"]) == ["log_0.csv", "log_1.csv"]
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert (tmp_path / "log_1.csv").read_text().split() == ["id", *map(str, range(1, 20, 2))]
