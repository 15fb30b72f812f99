"""Cases that the reviewer's larger tables brought up."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from wayfold.functions import parse
from wayfold.operators import fusion, joins, polylines, rail


def line(*points):
    return polylines.measured(F.array(*[F.struct(F.lit(float(a)).alias("lat"), F.lit(float(b)).alias("lon")) for a, b in points]))


def test_mebibytes_round_halves_to_even(spark):
    sizes = [262_144, 786_432, 1_310_720, 1_835_008, 262_145, 1 << 40, 3 << 50]
    got = spark.createDataFrame([(n,) for n in sizes], "n long").select(parse.bytes_text(F.col("n")).alias("t")).collect()
    assert [r["t"] for r in got] == [f"{n / 1048576:.1f} MiB" for n in sizes]


def test_stretches_keep_places_near_their_ends(spark):
    own = line((0, 0), (0, 0.001), (0, 0.002))
    near = polylines.length(own) / 2 - 0.01  # a hundredth of a metre before the middle vertex
    row = spark.range(1).select(
        F.size(polylines.sub_line(own, near, F.lit(1e9))).alias("thin"), F.size(polylines.sub_line(own, F.lit(1e9), near, None)).alias("whole"),
        polylines.stretch(own, F.lit(1e9), F.lit(-5.0)).alias("at"), polylines.length(own).alias("m")).first()
    assert (row["thin"], row["whole"]) == (2, 3)
    assert row["at"]["s"] == 0.0 and row["at"]["e"] == row["m"]


def _shape_table(spark, rows):
    """Straight shapes (shape_id, south, type) eastward, as rows of line and box."""
    v = spark.createDataFrame([(i, j, south, 13.0 + 0.01 * j, kind) for i, south, kind in rows for j in range(3)], "shape_id long, j long, lat double, lon double, route_type int")
    lines = polylines.lines(v, ["shape_id", "route_type"], "j", "lat", "lon")
    return lines.withColumn("box", polylines.box(F.col("line")))


def test_trips_and_shapes_alike_are_matched_once(spark, monkeypatch):
    pairs = []
    near = rail.near_boxes
    monkeypatch.setattr(rail, "near_boxes", lambda *a: pairs.append(near(*a)) or pairs[-1])
    place = lambda y, x: (y, x)
    trips = spark.createDataFrame([(i, [place(52.0, 13.0), place(52.0, 13.02)], "IN_TRAIN") for i in range(40)] + [(99, None, "IN_TRAIN")], "id long, points array<struct<lat:double,lon:double>>, mode string")
    shapes = _shape_table(spark, [(i, 52.0, 2) for i in range(20, 50)] + [(i, 52.001, 2) for i in range(1, 10)] + [(60, 52.0, 1)])
    got = rail.matched_shapes(trips, shapes, ["id"], **rail.WHOLE).collect()
    assert sorted((r["id"], r["shape_id"]) for r in got) == [(i, 20) for i in range(40)]
    assert pairs[0].count() <= 3  # a pair for each place and kind of shape, not 40 times 40
    # Copies take places of the shortlist: the farther kind is the ninth and more.
    short = rail.matched_shapes(trips, shapes.where("shape_id < 28 OR shape_id = 60"), ["id"], False, 900.0, 700.0, 1200.0, 9)
    assert {r["shape_id"] for r in short.collect()} == {20}


def test_places_alike_snap_once(spark, monkeypatch):
    pairs = []
    near = rail.near_boxes
    monkeypatch.setattr(rail, "near_boxes", lambda *a: pairs.append(near(*a)) or pairs[-1])
    t = spark.createDataFrame([(i, 52.001, 13.005, "in_tram", "direct" if i else "osrm", "x", "low", 0.1) for i in range(30)], "id long, lat double, lon double, mode string, path_method string, position_source string, confidence_label string, confidence_score double")
    got = rail.snapped_to_corridors(t, _shape_table(spark, [(i, 52.0, 2) for i in range(30)]), "id").collect()
    assert len(got) == 30 and {(r["id"] > 0, round(r["lat"], 6)) for r in got} == {(True, 52.0), (False, 52.001)}
    assert pairs[0].count() == 1


@pytest.mark.parametrize("least", [1, 2, 3])
def test_holders_are_those_of_all_pairs(spark, least):
    rng = random.Random(least)
    rows = [(i, (s := rng.randrange(60)), s + rng.randrange(-1, 12)) for i in range(120)]
    fine = [r for r in rows if r[1] <= r[2]]
    want = sorted(i for i, s, e in fine if i % 2 and sum(s <= a and b <= e and (a, b) != (s, e) for _, a, b in fine) >= least)
    df = spark.createDataFrame(rows, "i long, s long, e long").where("s <= e")
    assert sorted(r["i"] for r in joins.holders(df.where("i % 2 = 1"), df, "i", "s", "e", least).collect()) == want and want


def test_stations_alike_are_met_once(spark, monkeypatch):
    made = []
    met = joins._met
    monkeypatch.setattr(joins, "_met", lambda *a: made.append(met(*a)) or made[-1])
    p = spark.createDataFrame([(i, 52.0, 13.0, dt.datetime(2024, 1, 1 + i % 2, 5)) for i in range(6)] + [(9, None, 13.0, None)], "id long, lat double, lon double, ts timestamp_ntz")
    s = spark.createDataFrame([(i, 52.0 + (i == 9) * 0.001, 13.0, 500.0) for i in range(10)], "station_id long, s_lat double, s_lon double, radius_m double")
    near = joins.nearest_k(p, s, "id", "station_id", "lat", "lon", "s_lat", "s_lon", 3, 900.0).collect()
    assert sorted((r["id"], r["rank"], r["station_id"]) for r in near) == [(i, k + 1, k) for i in range(6) for k in range(3)]
    hourly = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 5), 7.0)], "station_id long, station_hour timestamp_ntz, pm double")
    got = fusion.matched_passes(p, s, hourly, [], "ts", ["ts", "id"], "lat", "lon", 500.0).collect()
    assert sorted((r["station_id"], r["id"], r["pass_id"], r["pass_row_index"], r["pm"] or 0.0) for r in got) == sorted((k, i, 1 + i % 2, 1 + i // 2, 7.0 if k == 1 and i % 2 == 0 else 0.0) for k in range(10) for i in range(6))
    assert [m.count() for m in made] == [2, 2]  # a place and two circles
