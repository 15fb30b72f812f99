"""Streaming forms of operators; additions, for the batch operators have no counterpart to match."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.functions.geo import haversine


def gap_sessions(stream: DataFrame, key: str, ts: str, gap: str, late: str) -> DataFrame:
    """W7 on a stream: sessions by a gap, closed once the watermark passes their end.

    A gap of exactly ``gap`` ends a session here and doesn't in the batch form.
    """
    return (
        stream.withWatermark(ts, late)
        .groupBy(key, F.session_window(ts, gap).alias("session"))
        .agg(F.count(F.lit(1)).alias("n_fixes"))
        .select(key, F.col("session.start").alias("start_ts"), F.col("session.end").alias("end_ts"), "n_fixes")
    )


def near_stations(stream: DataFrame, stations: DataFrame, lat: str, lon: str) -> DataFrame:
    """J4 on a stream: fixes within the radius of a station; ``stations`` has the few rows of a network."""
    met = stream.join(stations, haversine(F.col(lat), F.col(lon), F.col("s_lat"), F.col("s_lon")) <= F.col("radius_m"))
    return met.withColumn("distance_m", haversine(F.col(lat), F.col(lon), F.col("s_lat"), F.col("s_lon")))


def hourly(stream: DataFrame, ts: str, value: str, late: str) -> DataFrame:
    """J1's right side on a stream: means by hour."""
    w = F.window(ts, "1 hour")
    return stream.withWatermark(ts, late).groupBy(w.alias("w")).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("hour"), "mean", "n")
