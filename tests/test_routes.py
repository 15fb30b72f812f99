"""Hand-made cases of lines, trips, schedules and networks."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from wayfold.functions import geo, parse
from wayfold.operators import aggregates, graph, joins, polylines, rail, routes, sequences


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def line(*points):
    return polylines.measured(F.array(*[F.struct(F.lit(float(a)).alias("lat"), F.lit(float(b)).alias("lon")) for a, b in points]))


def test_circles_across_the_antimeridian_and_at_a_pole(spark):
    p = spark.createDataFrame([(1, 10.0, 179.9995), (2, 10.0, -179.9995), (3, 89.9999, 10.0), (4, 89.9999, -170.0), (5, 60.0, 0.0), (6, 60.0, 0.9)], "id int, lat double, lon double")
    s = spark.createDataFrame([(1, 10.0, -179.9995, 1000.0), (2, 89.9999, 100.0, 1000.0), (3, 60.0, 0.45, 60_000.0)], "sid int, s_lat double, s_lon double, r double")
    got = joins.radius_join(p, s, "lat", "lon", "s_lat", "s_lon", "r", 1000.0).select("id", "sid").collect()  # a radius above most_m, too
    assert sorted(map(tuple, got)) == [(1, 1), (2, 1), (3, 2), (4, 2), (5, 3), (6, 3)]


def test_radius_join_against_all_pairs(spark):
    import math
    import random

    rng = random.Random(4)
    p = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(400)]
    s = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180), rng.choice((1e5, 1e6, 3e6))) for i in range(30)]
    hav = lambda a, b, c, d: 2 * 6371000 * math.asin(min(1, math.sqrt(math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2)))
    want = sorted((i, j) for i, a, b in p for j, c, d, r in s if hav(a, b, c, d) <= r)
    got = joins.radius_join(spark.createDataFrame(p, "id int, lat double, lon double"), spark.createDataFrame(s, "sid int, s_lat double, s_lon double, r double"), "lat", "lon", "s_lat", "s_lon", "r", 200_000.0)
    assert sorted((r["id"], r["sid"]) for r in got.collect()) == want and len(want) > 200


def test_lines(spark):
    x = line((0, 0), (0, 0.01), (0, 0.02))
    m = 1111.9492664
    r = one(spark, *[polylines.place_at(x, F.lit(d)).alias(n) for d, n in ((-5.0, "a"), (m * 1.5, "b"), (9e9, "c"))], polylines.length(x).alias("n"), polylines.length(polylines.measured(F.array().cast(polylines.PLACES))).alias("none"), polylines.place_at(line((3, 4)), F.lit(7.0)).alias("d"))
    assert [round(r[c]["lon"], 6) for c in "abc"] == [0.0, 0.015, 0.02] and abs(r["n"] - 2 * m) < 1e-3 and r["none"] == 0.0 and tuple(r["d"]) == (3.0, 4.0)
    part = lambda a, b: polylines.sub_line(x, F.lit(a), F.lit(b))
    r = one(spark, part(m * 1.5, m * 0.5).alias("a"), part(m, m).alias("b"), part(-1.0, 9e9).alias("c"), polylines.cropped_to(x, *map(F.lit, (0.0, 0.02, 0.0, 0.011))).alias("d"), polylines.cropped_to(x, *map(F.lit, (0.0, 0.0, 0.0, 0.001))).alias("e"))
    lons = lambda c: [round(p["lon"], 6) for p in r[c]]
    assert lons("a") == [0.005, 0.01, 0.015] and lons("b") == [0.01, 0.01] and lons("c") == [0.0, 0.01, 0.02] and lons("d") == [0.02, 0.01] and lons("e") == [0.0, 0.01, 0.02]
    r = one(spark, polylines.projected(x, F.lit(0.001), F.lit(0.015)).alias("p"), polylines.projected(line((1, 1)), F.lit(1.0), F.lit(1.0)).alias("q"), polylines.aligned(x, *map(F.lit, (0.0, 0.02, 0.0, 0.0))).alias("t"))
    assert r["p"]["edge"] == 1 and abs(r["p"]["chainage_m"] - 1.5 * m) < 2 and r["q"]["distance_m"] == 0.0 and r["t"]["reversed"] and r["t"]["score_m"] == 0.0


def test_schedules_that_are_short_of_time(spark):
    rows = [("a", 1, 140.0, 1.4, 120.0), ("a", 2, 750.0, 7.5, 0.0)]
    parts = spark.createDataFrame([(k + n, i, d, v, w, dt_) for n, dt_ in (("1", 400.0), ("2", 220.0), ("3", 60.0)) for k, i, d, v, w in rows], "k string, seq int, distance_m double, speed_mps double, walk_dwell_after_s double, dt double")
    got = {(r["k"], r["seq"]): (r["move_time_s"], r["dwell_s"], r["starts_s"], r["slack_s"]) for r in routes.scheduled(parts, ["k"], "seq", F.col("dt")).collect()}
    assert got["a1", 1] == (100.0, 120.0, 0.0, 80.0) and got["a1", 2] == (100.0, 0.0, 220.0, 80.0)
    assert got["a2", 1] == (50.0, 120.0, 0.0, 0.0) and got["a2", 2] == (50.0, 0.0, 170.0, 0.0)
    assert got["a3", 1] == (0.0, 60.0, 0.0, 0.0) and got["a3", 2] == (0.0, 0.0, 60.0, 0.0)
    times = spark.createDataFrame([("a1", float(t), 400.0, 890.0) for t in (0, 40, 90, 200, 310, 360, 400)], "k string, el double, dt double, pm double")
    out = routes.distance_on_schedule(times, routes.scheduled(parts, ["k"], "seq", F.col("dt")), ["k"], "el", "dt", "pm").orderBy("el")
    assert [round(r["distance_here_m"], 6) for r in out.collect()] == [0.0, 0.0, 70.0, 140.0, 515.0, 890.0, 890.0]


def test_stops_within_slack(spark):
    spots = F.array(*[F.lit(x) for x in (0.5, 0.501, 0.9)])
    plan = lambda slack, dwell: routes.dwell_plan(spots, F.lit(dwell), F.lit(1000.0), F.lit(0.0), F.lit(1000.0), F.lit(1000.0), F.lit(slack))
    r = one(spark, plan(100.0, 10.0).alias("a"), plan(10.0, 60.0).alias("b"), plan(1.0, 60.0).alias("c"))
    assert r["a"]["distances"] == [500.0, 900.0] and r["a"]["each_s"] == 10.0 and r["b"]["total_s"] == 9.5 and r["c"] is None
    at = lambda t: routes.distance_with_stops(F.lit(float(t)), F.lit(300.0), F.lit(1000.0), F.lit(200.0), F.lit(80.0), plan(100.0, 10.0))
    r = one(spark, *[at(t).alias(f"t{t}") for t in (40, 90, 140, 145, 150, 155, 260, 300)])
    assert list(r) == [0.0, 250.0, 500.0, 500.0, 500.0, 525.0, 1000.0, 1000.0]


def test_segments_of_a_timeline(spark):
    t = lambda h: f"2024-01-01T{h:02d}:00:00Z"
    path = [("1°, 2°", t(5)), ("1°, 2°", t(5)), ("1.5°, 2°", t(4))]
    rows = [
        (0, t(0), t(9), None, None, None, path), (1, t(1), t(2), "3°, 4°", "0.2", None, None), (2, t(1), t(3), "5°, 6°", "0.9", None, None),
        (3, t(3), t(4), None, None, "7°, 8°", None), (4, t(4), t(3), "9°, 9°", None, None, None), (5, "x", t(3), "9°, 9°", None, None, None), (6, t(20), t(21), None, None, None, path)]
    df = spark.createDataFrame(rows, "row int, startTime string, endTime string, visit_topCandidate_placeLocation_latLng string, visit_topCandidate_probability string, activity_start_latLng string, timelinePath array<struct<point:string,time:string>>")
    got = [(r["segment_id"], r["row"], r["kind"], r["start_lat"], len(r["points"])) for r in routes.segments(df, "row").orderBy("row").collect()]
    assert got == [(0, 2, "visit_stationary", 5.0, 2), (1, 3, "single_point_fallback", 7.0, 2), (2, 6, "activity_timeline_segment", 1.5, 2)]


def test_exact_quantiles(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=3000), np.full(5000, 0.25), [np.nan, np.inf]])
    df = spark.createDataFrame([("a", float(v)) for v in x] + [("b", 7.0)], "k string, v double").union(spark.createDataFrame([("c", None)], "k string, v double"))
    shares = [0.0, 0.02, 0.5, 0.98, 1.0]
    for accuracy in (10, 20_000):
        got = {r["k"]: (r["n"], r["q"]) for r in aggregates.quantiles(df, ["k"], "v", shares, accuracy).collect()}
        assert got.keys() == {"a", "b"} and got["b"] == (1, [7.0] * 5) and got["a"][0] == 8000
        assert np.allclose(got["a"][1], np.quantile(x[np.isfinite(x)], shares), atol=1e-12)


def test_ranks_of_whole_tables(spark):
    df = spark.createDataFrame([(i % 7, i) for i in range(1000)], "a int, b int").repartition(5)
    got = {(r["a"], r["b"]): r["n"] for r in sequences.table_rank(df, ["a", "b"], "n").collect()}
    assert got == {x: n + 1 for n, x in enumerate(sorted((i % 7, i) for i in range(1000)))}
    ties = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z"), (2, "z")], "a int, b string")
    assert sequences.systematic_sample(ties, ["a"], 2).count() == 2 and sequences.systematic_sample(ties, ["a"], 9).count() == 4


def test_long_shortest_paths_and_cycles(spark):
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(70)] + [(0, 70, 1000.0), (5, 5, 0.0)], "src int, dst int, weight_m double")
    got = {r["node"]: r["distance"] for r in graph.shortest_paths(edges, spark.createDataFrame([(0,)], "source int")).collect()}
    assert got == {i: float(i) for i in range(71)}


def test_map_systems(spark):
    lat, lon = geo.from_utm(*geo.utm(F.lit(52.52), F.lit(13.405), 32), 32)
    r = one(spark, lat.alias("a"), lon.alias("b"), geo.tile_zoom(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), 1600).alias("none"))
    assert abs(r["a"] - 52.52) < 1e-7 and abs(r["b"] - 13.405) < 1e-7 and r["none"] is None


@pytest.mark.parametrize("text, want", [("from my uni, public", "from_uni_opnv"), ("to_uni_bike.csv", "to_uni_bike"), ("from uni to home by pt", "from_uni_opnv"), ("a/b/uni-to-cycling.x.csv", "to_uni_bike"), ("bike", None), ("", None), (None, None)])
def test_route_classes(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(parse.route_class(F.col("t"))).first()[0] == want


def test_shapes_near_and_far(spark):
    v = spark.createDataFrame([("s", i, 52.0 + 0.01 * i, 13.0) for i in range(5)], "shape_id string, shape_pt_sequence int, shape_pt_lat double, shape_pt_lon double")
    trips, types = spark.createDataFrame([("r", "s")], "route_id string, shape_id string"), spark.createDataFrame([("r", "2.0")], "route_id string, route_type string")
    shapes = rail.rail_shapes(v, trips, types)
    assert shapes.first()["route_type"] == 2
    assert rail.rail_shapes(v, trips, spark.createDataFrame([("r", "700")], "route_id string, route_type string")).count() == 0
    point = "array<struct<lat:double,lon:double>>"
    t = spark.createDataFrame([(1, [(52.03, 13.001), (52.01, 13.001)], "IN_TRAIN"), (2, [(52.03, 13.001), (52.01, 13.001)], "IN_SUBWAY"), (3, [(53.0, 13.0), (52.0, 13.0)], "IN_TRAIN")], f"id int, points {point}, mode string")
    r = rail.matched_shapes(t, shapes, ["id"], **rail.WHOLE).collect()
    assert [x["id"] for x in r] == [1] and [round(p["lat"], 3) for p in r[0]["places"]] == [52.03, 52.02, 52.01]
    assert {(x["id"], x["method"].rsplit("::", 1)[1]) for x in rail.matched_pieces(t, shapes, ["id"]).collect()} == {(1, "pairwise_mode"), (2, "pairwise_relaxed")}


def test_commutes_by_day(spark):
    at = lambda h, m: dt.datetime(2024, 1, 2, h, m)
    rows = [("a", at(6, 0), 20.0), ("a", at(6, 4), 26.0), ("a", at(6, 30), 26.0), ("b", at(16, 0), 20.0), ("b", at(16, 30), 40.0), ("c", at(9, 0), 1.0), ("c", at(10, 0), 1.0)]
    df = spark.createDataFrame(rows, "log string, ts timestamp_ntz, temp double")
    got = {r["log"]: r["route_class_key"] for r in routes.commutes(df, ["log"], "ts", "temp", ["temp"]).collect()}
    assert got == {"a": "to_uni_opnv", "b": "from_uni_bike"}
