"""Composite operators: cropping logs, matching stations, judging fixes, interpolating tracks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions.geo import haversine
from wayfold.operators import joins as J
from wayfold.operators import sequences as S

Names = Sequence[str]


def cropped_logs(df: DataFrame, keys: Names, pos: str, ts: str, value: str, least_rows: int = 30, streak: int = 10, seconds: float = 3600.0, zone: float = 0.2, zone_rows: int = 600, trimmed: bool = False, every_s: float = 5.0) -> DataFrame:
    """C11: logs of over ``least_rows`` rows, from their first streak of drops to their last rise, ``seconds`` long.

    Rows without a value at the ends go first, unless they are ``trimmed`` already; without times a row counts ``every_s``.
    """
    rows = df if trimmed else S.trim_empty_ends(df, keys, pos, [value])
    rows = rows.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where(F.col("__n") > least_rows).drop("__n")
    starts = S.first_streak(rows, keys, pos, value, streak, zone, most=zone_rows)
    ends = S.tail_rise(rows, keys, pos, value, zone, most=zone_rows)
    rows = rows.join(starts, list(keys)).join(ends, list(keys))  # a row for each log
    rows = S.crop(rows, keys, pos, F.col("streak_start"), F.col("crop_end")).drop("streak_start", "crop_end")
    return S.prefix_cap(rows, keys, ts, [pos], seconds, int(seconds / every_s) + 1)


def matched_passes(track: DataFrame, stations: DataFrame, hourly: DataFrame, keys: Names, ts: str, order: Names, lat: str, lon: str, most_m: float, gap_s: float | None = None) -> DataFrame:
    """Fixes near a station with the station's hour, in passes of a day, or split at gaps.

    ``hourly`` has station_id, station_hour and its values; a fix without an hour there keeps nulls.
    """
    # Passes depend on a circle, not on its station: they are numbered once for stations of one place and radius (named by the
    # first of them), and the stations' rows, as many as fixes times stations at worst, are made last, without a shuffle.
    alike = stations.groupBy("s_lat", "s_lon", "radius_m").agg(F.min("station_id").alias("__circle"))
    near = J.radius_join(track, alike, lat, lon, "s_lat", "s_lon", "radius_m", most_m)
    near = near.withColumn("station_hour", F.date_trunc("hour", ts).cast("timestamp_ntz"))
    own = [*keys, "__circle"]
    if gap_s is not None:
        rows = S.gap_sessions(near, own, ts, order, gap_s, "pass_id")
        rows = rows.withColumn("pass_row_index", F.row_number().over(S.over([*own, "pass_id"], order)).cast("long"))
    else:
        rows = S.day_pass_ids(near.withColumn("day", F.to_date(ts)), own, "day", order).drop("day")
    members = stations.join(alike, ["s_lat", "s_lon", "radius_m"]).select(*stations.columns, "__circle")
    hours = rows.select("__circle", "station_hour").distinct().join(members.select("__circle", "station_id"), "__circle").join(hourly, ["station_id", "station_hour"], "left")
    hours = hours.join(members.drop("__circle", "s_lat", "s_lon", "radius_m"), "station_id").withColumnsRenamed({"__circle": "__of", "station_hour": "__hour"})
    out = rows.join(hours.hint("merge"), (rows["__circle"] == hours["__of"]) & rows["station_hour"].eqNullSafe(hours["__hour"]))
    values = [c for c in hourly.columns if c not in ("station_id", "station_hour")]
    return out.select("station_id", "station_hour", *track.columns, *[c for c in stations.columns if c != "station_id"], "distance_m", *values, "pass_id", "pass_row_index")


def allowed_distance(eph: Column) -> Column:
    """how far from its line a fix may be, by its error estimate."""
    return F.greatest(F.lit(55.0), F.least(F.lit(250.0), 3.5 * F.coalesce(eph, F.lit(120.0))))


def quality_weight(mode: Column, eph: Column) -> Column:
    """how much a fix counts."""
    bonus = F.when(mode >= 3, 1.25).when(mode == 2, 1.0).otherwise(0.0)
    return bonus / (1 + F.greatest(F.coalesce(eph, F.lit(120.0)), F.lit(1.0)) / 25.0)


def judged_fixes(fixes: DataFrame, line_edges: DataFrame, keys: Names, fix_id: str, x: str, y: str, order: Names, mode: str, eph: str, tolerance_m: float = 60.0, near_m: float = 20.0) -> DataFrame:
    """Each fix's place on its line, its status and reason, and the place it is used at.

    The gates come in order; those that pass all are then held against backtracking.  An accepted fix up to ``near_m`` from
    the line stays where it is, any other moves onto it.  Adds distance_m, chainage_m, edge, near_x, near_y, allowed_distance_m,
    quality_weight, status, reason, and adjusted_x, adjusted_y and adjusted_chainage_m, null where the fix is rejected.
    """
    at = J.project_on_lines(fixes, line_edges, keys, fix_id, x, y)
    rows = fixes.join(at, [*keys, fix_id]).withColumn("allowed_distance_m", allowed_distance(F.col(eph))).withColumn("quality_weight", quality_weight(F.col(mode), F.col(eph)))
    gate = (F.when(F.col(mode).isNull() | (F.col(mode) < 2), "gps_mode_below_fix_threshold").when(F.col(eph) > 250, "eph_above_hard_threshold")
            .when(F.col("distance_m") > F.col("allowed_distance_m"), "too_far_from_baseline"))
    rows = rows.withColumn("__gate", gate).withColumn("__open", F.when(F.col("__gate").isNull(), F.col("chainage_m")))
    w = S.over(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    back = F.col("__gate").isNull() & F.coalesce(F.col("chainage_m") + tolerance_m < F.max("__open").over(w), F.lit(False))
    moved = F.col("distance_m") > near_m
    fine = F.when(moved, "accepted_projected_to_baseline").otherwise("accepted_raw")
    rows = rows.withColumn("reason", F.coalesce("__gate", F.when(back, "backtracking_against_segment_direction"), fine))
    used = F.startswith("reason", F.lit("accepted"))
    rows = rows.withColumn("status", F.when(used, "accepted").otherwise("rejected"))
    for c, near, own in (("x", "near_x", x), ("y", "near_y", y)):
        rows = rows.withColumn(f"adjusted_{c}", F.when(used, F.when(moved, F.col(near)).otherwise(F.col(own))))
    return rows.withColumn("adjusted_chainage_m", F.when(used, F.col("chainage_m"))).drop("__gate", "__open")


def collapsed_anchors(anchors: DataFrame, keys: Names, t: str, priority: Column, chainage: str) -> DataFrame:
    """Of anchors at one time the one that ranks highest, then the furthest."""
    return S.best_row(anchors, [*keys, t], [priority.desc(), F.col(chainage).desc_nulls_last()])


def distance_after(elapsed: Column, duration: Column, distance: Column, speed: Column, factor: float = 1.2) -> Column:
    """metres after ``elapsed`` seconds: slack beyond ``factor`` times the expected time is spent half
    before and half after moving."""
    expected = F.when(speed > 0, distance / speed * factor).otherwise(duration)
    moving = F.least(duration, expected)
    slack = (duration - moving) / 2
    share = F.when(moving <= 0, F.when(elapsed >= duration, F.lit(1.0)).otherwise(0.0)).otherwise((elapsed - slack) / moving)
    return distance * F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))


def interpolated(anchors: DataFrame, keys: Names, t: str, chainage: str, speed: Column, every_s: int = 5) -> DataFrame:
    """Chainage on the regular grid between neighbouring anchors (t in whole seconds)."""
    w = S.over(keys, [t])
    a = anchors.withColumn("__t2", F.lead(t).over(w)).withColumn("__c2", F.lead(chainage).over(w)).where("__t2 IS NOT NULL")
    first, last = F.ceil(F.col(t) / every_s).cast("long"), F.floor((F.col("__t2") - 1) / every_s).cast("long")
    grid = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    rows = a.withColumn("__g", F.explode(grid)).withColumn("grid_t", F.col("__g") * every_s)
    run = F.col("__c2") - F.col(chainage)
    moved = distance_after((F.col("grid_t") - F.col(t)).cast("double"), (F.col("__t2") - F.col(t)).cast("double"), F.abs(run), speed)
    return rows.select(*keys, "grid_t", (F.col(chainage) + F.signum(run) * moved).alias("chainage_m"))


def oriented(lines: DataFrame, wanted: DataFrame, keys: Names, margin: float = 1e-6) -> DataFrame:
    """Whether a line (lat1, lon1, lat2, lon2) runs forward from a start to an end, and how far off it is."""
    met = wanted.join(lines, list(keys))
    d = lambda a, b: haversine(F.col(f"{a}_lat"), F.col(f"{a}_lon"), F.col(f"lat{b}"), F.col(f"lon{b}"))
    met = met.withColumn("__along", d("start", 1) + d("end", 2)).withColumn("__against", d("start", 2) + d("end", 1))
    back = F.col("__against") + margin < F.col("__along")
    return met.withColumn("reversed", back).withColumn("score", F.least("__along", "__against")).drop("__along", "__against")


def greedy_clusters(df: DataFrame, keys: Names, at: str, radius: float, least: int = 2) -> DataFrame:
    """Positions in order join the last cluster if within ``radius`` of its running mean.

    A fold over the sorted positions of a key; gives clusters of ``least`` positions or more.
    """
    fresh = lambda x: F.struct(x.alias("total"), F.lit(1).cast("long").alias("n"))
    last = lambda acc: F.element_at(acc, -1)
    clusters = F.aggregate(
        F.array_sort(F.collect_list(F.col(at).cast("double"))), F.array().cast("array<struct<total:double,n:bigint>>"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.abs(x - last(acc)["total"] / last(acc)["n"]) <= radius),
            F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct((last(acc)["total"] + x).alias("total"), (last(acc)["n"] + 1).alias("n")))),
        ).otherwise(F.concat(acc, F.array(fresh(x)))))
    out = df.groupBy(*keys).agg(clusters.alias("__c")).select(*keys, F.posexplode("__c").alias("cluster", "c"))
    return out.select(*keys, F.col("cluster").cast("long").alias("cluster"), (F.col("c.total") / F.col("c.n")).alias("center"), F.col("c.n").alias("n")).where(F.col("n") >= least)


def offset_path(vertices: DataFrame, keys: Names, pos: str, x: str, y: str, metres: float = 3.0) -> DataFrame:
    """vertices moved along their normals, which are those of the mean of the tangents beside them."""
    w = S.over(keys, [pos])
    rows = vertices
    for a, b, name in ((F.lag(x).over(w), F.lag(y).over(w), "in"), (F.lead(x).over(w), F.lead(y).over(w), "out")):
        dx, dy = (F.col(x) - a, F.col(y) - b) if name == "in" else (a - F.col(x), b - F.col(y))
        length = F.sqrt(dx * dx + dy * dy)
        rows = rows.withColumn(f"__{name}x", F.coalesce(F.when(length > 0, dx / length), F.lit(0.0))).withColumn(f"__{name}y", F.coalesce(F.when(length > 0, dy / length), F.lit(0.0)))
    tx, ty = F.col("__inx") + F.col("__outx"), F.col("__iny") + F.col("__outy")
    length = F.sqrt(tx * tx + ty * ty)
    nx, ny = F.when(length > 0, -ty / length).otherwise(0.0), F.when(length > 0, tx / length).otherwise(0.0)
    return rows.withColumn("off_x", F.col(x) + metres * nx).withColumn("off_y", F.col(y) + metres * ny).drop("__inx", "__iny", "__outx", "__outy")


def palette_index(value: Column, low: Column, high: Column, colors: int = 256) -> Column:
    """the place of a value in a palette, clamped at both ends."""
    s = F.when(high > low, (value - low) / (high - low)).otherwise(0.5)
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)) * (colors - 1)).cast("long")


def station_graph(stops: DataFrame, stop_times: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stations as means of their stops, and undirected edges between consecutive ones."""
    named = stops.withColumn("station", F.coalesce(F.when(F.trim("parent_station") != "", F.col("parent_station")), F.col("stop_id")))
    stations = named.groupBy("station").agg(F.avg("stop_lat").alias("lat"), F.avg("stop_lon").alias("lon"), F.min(F.struct("stop_id", "stop_name"))["stop_name"].alias("name"))
    w = Window.partitionBy("trip_id").orderBy("stop_sequence")
    legs = stop_times.join(named.select("stop_id", "station"), "stop_id").withColumn("__next", F.lead("station").over(w)).where("__next IS NOT NULL AND __next <> station")
    pairs = legs.select(F.least("station", "__next").alias("src"), F.greatest("station", "__next").alias("dst"), "route_type")
    a, b = (stations.select(F.col("station").alias(k), F.col("lat").alias(f"{k}_lat"), F.col("lon").alias(f"{k}_lon")) for k in ("src", "dst"))
    met = pairs.join(a, "src").join(b, "dst")
    weight = haversine(F.col("src_lat"), F.col("src_lon"), F.col("dst_lat"), F.col("dst_lon"))
    edges = met.withColumn("weight_m", weight).groupBy("src", "dst").agg(F.min("weight_m").alias("weight_m"), F.array_sort(F.collect_set("route_type")).alias("route_types"))
    return stations, edges
