"""Heatmaps of routes in one run: from places in any system to coloured stretches and edges on a plane."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions import geo
from wayfold.functions.parse import finite
from wayfold.operators import aggregates as A
from wayfold.operators import joins as J
from wayfold.operators import sequences as S
from wayfold.operators.fusion import palette_index
from wayfold.operators.stations import SYSTEMS, reference_system
from wayfold.sources.shared import saved

Names = Sequence[str]
#: East and north of a latitude and longitude, by the map's EPSG code.
PLANES = {32633: geo.utm, 3857: geo.web_mercator}


class Heatmap(NamedTuple):
    """Tables of one run, all made of one saved track."""

    points: DataFrame
    bins: DataFrame
    edges: DataFrame
    routes: DataFrame
    overall: DataFrame


def _degrees(epsg: Column, north: Column, east: Column) -> tuple[Column, Column]:
    """Latitude and longitude of coordinates in the systems known."""
    lat, lon = north, east
    for code, made in SYSTEMS.items():
        y, x = made(east, north)
        lat, lon = F.when(epsg == code, y).otherwise(lat), F.when(epsg == code, x).otherwise(lon)
    return lat, lon


def heatmap(track: DataFrame, keys: Names, pos: str, lat: str, lon: str, value: str, epsg: int = 32633, least: int = 2, most: int = 60_000, stretch_m: float = 20.0, snap_m: float = 18.0, gap_m: float = 80.0, colors: int = 256) -> Heatmap:
    """A run over routes: P15, F33, O4, W13, F34, W15, W17, F36, A4 to A8, F38.

    Places that aren't finite go, and routes with fewer than ``least``; each route's system is guessed; long ones are thinned
    evenly to ``most`` points; values are smoothed; places are put on the plane of ``epsg``.  A route breaks at long gaps: its longest
    part is cut into stretches (bins), to which all its points go by the nearest place; neighbouring points of a part make undirected
    edges over all routes.  Bins and edges have a color, the value's place in the range of all bins and of all edges.
    """
    fine = S.placed_routes(track, keys, lat, lon, least)
    systems = reference_system(fine, keys, lat, lon, [pos]).select(*keys, "epsg")
    kept = S.systematic_sample(fine, [pos], most, list(keys))
    kept = S.rolling_median(kept, keys, pos, value, name="smooth").join(systems, list(keys))
    y, x = _degrees(F.col("epsg"), F.col(lat), F.col(lon))
    rows = kept.withColumn("__lat", y).withColumn("__lon", x)
    east, north = PLANES[epsg](F.col("__lat"), F.col("__lon"))
    rows = rows.withColumn("x", east).withColumn("y", north)
    w = S.over(keys, [pos])
    step = F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))
    points = saved(S.subroutes(rows, keys, pos, step, gap_m).drop("__lat", "__lon"), "points")
    parts = [*keys, "subroute_id"]
    edges_of = J.edges(points, parts, pos, "x", "y")
    lengths = edges_of.groupBy(*parts).agg(F.sum("edge_m").alias("route_length_m"))
    longest = S.best_row(lengths, keys, [F.col("route_length_m").desc(), "subroute_id"])
    line = edges_of.join(longest.select(*parts), parts, "left_semi")
    place = J.project_on_lines(points, line, keys, pos, "x", "y").select(*keys, pos, "chainage_m")
    measured = points.join(place, [*keys, pos]).join(longest.select(*keys, "route_length_m"), list(keys))
    bins = saved(A.route_bins(measured, keys, "chainage_m", F.col("route_length_m"), value, stretch_m), "bins")
    pairs = S.pairs(points, parts, pos, "x", "y", "smooth").withColumn("__route", F.to_json(F.struct(*keys)))
    merged = saved(A.merged_edges(pairs, "__route", snap_m), "edges")
    mean = f"{value}_mean"
    overall = bins.agg(F.avg(mean).alias("mean_of_means"), F.count(F.lit(1)).alias("n_bins"), F.countDistinct(*keys).alias("n_routes"))
    routes = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_points"), F.avg(finite(F.col(value))).alias("overall_mean"), F.percentile(finite(F.col(value)), F.lit(0.5)).alias("overall_median"), F.first("epsg").alias("epsg"))
    routes = routes.join(longest.select(*keys, "route_length_m"), list(keys), "left").join(bins.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_bins")), list(keys), "left")
    return Heatmap(points, _colored(bins, mean, colors), _colored(merged, "value_mean", colors), routes, overall)


def _colored(df: DataFrame, value: str, colors: int) -> DataFrame:
    norm = A.color_norm(df, [], value).select(F.col("low").alias("__low"), F.col("high").alias("__high"))
    out = df.join(F.broadcast(norm))  # one row
    return out.withColumn("color", F.when(finite(F.col(value)).isNotNull(), palette_index(F.col(value), F.col("__low"), F.col("__high"), colors))).drop("__low", "__high")
