"""Trips along known routes: segments of a timeline, the route of each, and positions between anchors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions.geo import haversine
from wayfold.functions.parse import classes_of_mode, finite, lat_lng, mode_of_class, mode_speed, route_class, route_mode, to_number, travel_mode
from wayfold.operators import joins as J
from wayfold.operators import polylines as L
from wayfold.operators.sequences import best_row, dealt, micros, over, table_rank, with_extremes
from wayfold.sources.tables import utc_time
from wayfold.sources.shared import saved

Names = Sequence[str]

# Classes of known routes, speeds by label, what a walk waits at its end, and how sources are trusted.
ROUTE_CLASSES = ["to_uni_bike", "from_uni_bike", "to_uni_opnv", "from_uni_opnv"]
LABEL_SPEED = {"walk": 1.4, "bus": 7.5, "train": 18.0}
WALK_DWELL_S, MOST_SLACK, SPEED_FACTOR = 120.0, 0.95, 1.2
COMMUTE_MINUTES, SWING_C, SWING_S = (25.0, 50.0), 5.0, 300.0
ZONE = "Europe/Berlin"
# End of fixed values.


def local(ts: Column, zone: str = ZONE) -> Column:
    """Local wall time of a time in UTC."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts.cast("timestamp_ntz"))


def in_window(start: Column, end: Column, first: Column | None, last: Column | None) -> Column:
    """Whether an interval touches a window; touching counts, and a bound that is missing is open."""
    fine = start.isNotNull() & end.isNotNull() & (end >= start)
    for bound, test in ((first, lambda b: end >= b), (last, lambda b: start <= b)):
        if bound is not None:
            fine = fine & (bound.isNull() | test(bound))
    return F.coalesce(fine, F.lit(False))


def on_dates(start: Column, end: Column, dates: Column, zone: str = ZONE) -> Column:
    """Whether an interval starts or ends on one of the local dates; any does if there are none."""
    day = lambda t: F.array_contains(dates, F.to_date(local(t, zone)))
    return dates.isNull() | (F.size(dates) == 0) | F.coalesce(day(start), F.lit(False)) | F.coalesce(day(end), F.lit(False))


def hint_envelope(hints: Column, padding_h: float = 24.0, zone: str = ZONE) -> Column:
    """From the first hint to the last, padded, and all local dates between; null without hints."""
    pad = F.make_dt_interval(F.lit(0), F.lit(padding_h).cast("int"))
    first, last = F.array_min(hints).cast("timestamp_ntz") - pad, F.array_max(hints).cast("timestamp_ntz") + pad
    dates = F.sequence(F.to_date(local(first, zone)), F.to_date(local(last, zone)))
    return F.when(F.size(hints) > 0, F.struct(first.alias("first"), last.alias("last"), dates.alias("dates")))


def path_of(points: Column) -> Column:
    """A path's places with their times, in order; without those of one time and place (0.5 m)."""
    def read(p: Column) -> Column:
        lat, lon = lat_lng(p["point"])
        return F.struct(utc_time(p["time"]).alias("t"), lat.alias("lat"), lon.alias("lon"))

    found = F.filter(F.transform(points, read), lambda p: p["t"].isNotNull() & p["lat"].isNotNull() & p["lon"].isNotNull())
    found = F.array_sort(F.coalesce(found, F.array().cast("array<struct<t:timestamp_ntz,lat:double,lon:double>>")))
    last = lambda acc: F.element_at(acc, -1)
    new = lambda acc, p: (F.size(acc) == 0) | (p["t"] != last(acc)["t"]) | (haversine(p["lat"], p["lon"], last(acc)["lat"], last(acc)["lon"]) > 0.5)
    return F.aggregate(found, F.array().cast("array<struct<t:timestamp_ntz,lat:double,lon:double>>"), lambda acc, p: F.when(new(acc, p), F.concat(acc, F.array(p))).otherwise(acc))


def segments(timeline: DataFrame, row: str) -> DataFrame:
    """The segments of a timeline's rows, numbered from 0 by ``row``, which orders the rows.

    A row with a visited place is a visit (the likeliest of those that start together, then the longest); one with a
    path of two places or more is that path, unless it has nothing else and wraps two other rows or more; one with
    both ends goes from one to the other; one with a place stays there; any other is left out.
    """
    has = lambda c: F.col(c) if c in timeline.columns else F.lit(None).cast("string")
    v_lat, v_lon = lat_lng(has("visit_topCandidate_placeLocation_latLng"))
    a_lat, a_lon = lat_lng(has("activity_start_latLng"))
    b_lat, b_lon = lat_lng(has("activity_end_latLng"))
    pair = lambda y, x: F.when(y.isNotNull() & x.isNotNull(), F.struct(y.alias("lat"), x.alias("lon")))
    points = F.col("timelinePath") if "timelinePath" in timeline.columns else F.lit(None).cast("array<struct<point:string,time:string>>")
    t = timeline.repartition(row).select(
        F.col(row).alias("row"), utc_time(F.col("startTime")).alias("s"), utc_time(F.col("endTime")).alias("e"),
        has("visit_topCandidate_placeLocation_latLng").isNotNull().alias("named"), F.coalesce(to_number(has("visit_topCandidate_probability")), F.lit(-float("inf"))).alias("likely"),
        travel_mode(has("activity_topCandidate_type")).alias("mode"), to_number(has("activity_distanceMeters")).alias("metres"),
        pair(v_lat, v_lon).alias("visit"), pair(a_lat, a_lon).alias("a"), pair(b_lat, b_lon).alias("b"), path_of(points).alias("path"))
    t = saved(t, "timeline")  # read five times, and its texts take long to parse
    best = best_row(t.where("named AND s IS NOT NULL"), ["s"], [F.col("likely").desc(), F.col("e").desc_nulls_last(), "row"]).select("row", F.lit(True).alias("best"))
    fine = t.where("s IS NOT NULL AND e IS NOT NULL AND e >= s")
    bare = fine.where("size(path) >= 2 AND visit IS NULL AND a IS NULL AND b IS NULL").select(F.col("row").alias("outer"), "s", "e")
    held = J.holders(bare, fine.select("s", "e"), "outer", "s", "e", 2)
    rows = fine.join(held, fine["row"] == held["outer"], "left_anti").join(best, "row", "left")
    first, last = F.get("path", F.lit(0)), F.element_at("path", -1)
    stay = lambda p: (p, p, F.col("s"), F.col("e"))
    end = lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"))
    kinds = (
        (F.col("visit").isNotNull(), "visit_stationary", *stay(F.col("visit"))),
        (F.size("path") >= 2, "activity_timeline_segment", end(first), end(last), first["t"], last["t"]),
        (F.col("a").isNotNull() & F.col("b").isNotNull(), "activity_start_end_segment", F.col("a"), F.col("b"), F.col("s"), F.col("e")),
        (F.col("a").isNotNull() | F.col("b").isNotNull(), "single_point_fallback", *stay(F.coalesce("a", "b"))),
    )

    def chosen(i: int) -> Column:
        out = None
        for k in kinds:
            value = F.lit(k[i]) if isinstance(k[i], str) else k[i]
            out = F.when(k[0], value) if out is None else out.when(k[0], value)
        return out

    is_visit = F.col("visit").isNotNull()
    rows = rows.where(~is_visit | F.coalesce("best", F.lit(False))).withColumn("kind", chosen(1)).where("kind IS NOT NULL")
    two = F.array(*[F.struct(t_.alias("t"), p["lat"].alias("lat"), p["lon"].alias("lon")) for p, t_ in ((chosen(2), F.col("s")), (chosen(3), F.col("e")))])
    rows = rows.select(
        "row", "kind", F.when(~is_visit, F.col("mode")).alias("mode"), chosen(4).alias("start_t"), chosen(5).alias("end_t"),
        chosen(2)["lat"].alias("start_lat"), chosen(2)["lon"].alias("start_lon"), chosen(3)["lat"].alias("end_lat"), chosen(3)["lon"].alias("end_lon"),
        F.when(is_visit, 0.0).otherwise(F.col("metres")).alias("activity_distance_m"), F.when(F.col("kind") == "activity_timeline_segment", F.col("path")).otherwise(two).alias("points"))
    return table_rank(rows, ["row"], "segment_id").withColumn("segment_id", F.col("segment_id").cast("long") - 1).drop("__n")


def day_hints(trips: DataFrame, start: str, kind: Column, keys: Names = ()) -> DataFrame:
    """to_uni for trips that start nearer to the first than to the last of their local day and kind, else from_uni;
    those that all start at once go by the hour.  Adds route_class_hint, null without a kind."""
    by = {**{k: F.col(k) for k in keys}, "day": F.to_date(local(F.col(start))), "kind": kind}
    rows = with_extremes(trips.withColumn("__kind", kind), by, micros(F.col(start)))
    first, last, t = F.col("__first"), F.col("__last"), F.col("__t")
    to = F.when(first == last, F.hour(local(F.col(start))) < 14).otherwise(t - first <= last - t)
    hint = F.concat(F.when(to, "to_uni_").otherwise("from_uni_"), F.col("__kind"))
    return rows.withColumn("route_class_hint", F.when(t.isNotNull(), hint)).drop("__kind", "__t", "__first", "__last", "__count")


def duration_hints(trips: DataFrame, start: str, end: str, kind: str = "bike", keys: Names = ()) -> DataFrame:
    """Of the trips of 25 to 50 minutes of a local day, if there are two or more, those that start up to the middle
    between the first and the last are to_uni, the others from_uni.  Adds route_class_hint, null for the others."""
    t, minutes = micros(F.col(start)), (micros(F.col(end)) - micros(F.col(start))) / 60e6
    fits = F.coalesce(minutes.between(*COMMUTE_MINUTES), F.lit(False))
    by = {**{k: F.col(k) for k in keys}, "day": F.to_date(local(F.col(start)))}
    rows = with_extremes(trips.withColumn("__fits", fits), by, F.when(F.col("__fits"), t), F.col("__fits"))
    early = F.when(F.col("__t") * 2 <= F.col("__first") + F.col("__last"), "to_uni_").otherwise("from_uni_")
    hint = F.when(F.col("__fits") & (F.col("__count") >= 2), F.concat(early, F.lit(kind if kind in ("bike", "opnv") else "bike")))
    return rows.withColumn("route_class_hint", hint).drop("__fits", "__t", "__first", "__last", "__count")


def commutes(rows: DataFrame, keys: Names, ts: str, temperature: str, order: Names) -> DataFrame:
    """Logs of 25 to 50 minutes as trips, with their route class.

    A jump of 5 degrees within 5 minutes tells public transport; of a local day's logs those that start up to the middle
    between the first and the last go to the university, the others from it; a day's only log goes by the hour.
    """
    # Rows without a time or a temperature come last, so that they are no row before; one pass tells both jumps and spans.
    w = over(keys, [F.col(temperature).isNull() | F.col(ts).isNull(), ts, *order])
    apart = micros(F.col(ts)) - F.lag(micros(F.col(ts))).over(w)
    swing = (apart > 0) & (apart <= SWING_S * 1e6) & (F.abs(F.col(temperature) - F.lag(temperature).over(w)) >= SWING_C)
    spans = rows.withColumn("__swing", swing).groupBy(*keys).agg(F.bool_or("__swing").alias("temp_jump"), F.min(ts).alias("trip_start"), F.max(ts).alias("trip_end"))
    minutes = (micros(F.col("trip_end")) - micros(F.col("trip_start"))) / 60e6
    fits = spans.where((F.col("trip_end") > F.col("trip_start")) & minutes.between(*COMMUTE_MINUTES))
    fits = with_extremes(fits, {"day": F.to_date(local(F.col("trip_start")))}, micros(F.col("trip_start")))
    early = F.when(F.col("__count") >= 2, F.col("__t") * 2 <= F.col("__first") + F.col("__last")).otherwise(F.hour(local(F.col("trip_start"))) < 14)
    kind = F.when(F.coalesce("temp_jump", F.lit(False)), "opnv").otherwise("bike")
    out = fits.withColumn("route_class_key", F.concat(F.when(early, "to_uni_").otherwise("from_uni_"), kind))
    return out.select(*keys, "trip_start", "trip_end", "route_class_key")


def chosen_routes(trips: DataFrame, routes: DataFrame, strict: bool = True) -> DataFrame:
    """The known route (route_class, route_line, places) of each trip, and how it was chosen.

    Trips have segment_id, mode, start and end places, route_class_hint, and time_class (the class whose trip overlaps
    theirs most, see ``best_overlap``).  A hint that names a known route gives it whole; then a class by time that the mode
    allows, turned and cropped to the trip; then, unless ``strict``, of the routes that the mode allows the one whose ends
    are nearest.  Trips without a route keep nulls.  ``routes`` has a row for each of a few classes.
    """
    known = routes.where(F.col("route_class").isin(ROUTE_CLASSES)).select("route_class", F.col("line").alias("__known"))
    ends = [F.col(c) for c in ("start_lat", "start_lon", "end_lat", "end_lon")]
    first, last = F.get("__known", F.lit(0)), F.get("__known", F.size("__known") - 1)
    tips = known.select("route_class", *[p[c].alias(f"{c}{i}") for i, p in enumerate((first, last)) for c in ("lat", "lon")]).collect()  # four classes at most
    names = [r["route_class"] for r in tips]
    # The ends tell direction and score, so that lines are met only once they are chosen.
    met = {r["route_class"]: L.ends_aligned(*[(F.lit(r[f"lat{i}"]), F.lit(r[f"lon{i}"])) for i in (0, 1)], *ends) for r in tips if r["lat0"] is not None}
    rows = trips.withColumn("__hint", route_class(F.col("route_class_hint"))).withColumn("__time", route_class(F.col("time_class"))).withColumn("__allowed", classes_of_mode(F.col("mode")))
    rows = rows.withColumns({f"__met_{k}": x for k, x in met.items()})
    scores = [F.when(F.array_contains("__allowed", k), F.struct(F.col(f"__met_{k}.score_m").alias("score_m"), F.lit(k).alias("route_class"))) for k in met]
    fit = F.array_min(F.array(*scores)) if scores and not strict else F.lit(None).cast("struct<score_m:double,route_class:string>")
    timed = F.col("__time").isin(names) & F.array_contains("__allowed", F.col("__time"))
    rows = rows.withColumn("__hint", F.when(F.col("__hint").isin(names), F.col("__hint"))).withColumn("__time", F.when(timed, F.col("__time"))).withColumn("__fit", fit)
    rows = rows.withColumn("route_class", F.coalesce("__hint", "__time", F.col("__fit.route_class")))
    rows = rows.withColumn("selection_method", F.when(F.col("__hint").isNotNull(), "primitive_time_hint").when(F.col("__time").isNotNull(), "classification_time_match").when(F.col("__fit").isNotNull(), "mode_endpoint_fallback"))
    of_class = lambda field, kind: F.coalesce(*[F.when(F.col("route_class") == k, F.col(f"__met_{k}")[field]) for k in met], F.lit(None).cast(kind))
    rows = rows.withColumn("__turned", of_class("reversed", "boolean")).withColumn("endpoint_score_m", F.when(F.col("__hint").isNull(), of_class("score_m", "double")))
    rows = rows.drop(*[f"__met_{k}" for k in met]).join(F.broadcast(known), "route_class", "left")
    fitted = L.cropped_line(F.when(F.col("__turned"), F.reverse("__known")).otherwise(F.col("__known")), *ends)
    rows = rows.withColumn("route_line", F.when(F.col("__hint").isNotNull(), F.col("__known")).when(F.col("route_class").isNotNull(), fitted))
    return rows.withColumn("places", L.places(F.col("route_line"))).drop("__known", "__hint", "__time", "__fit", "__allowed", "__turned")


def baseline_paths(trips: DataFrame, routes: DataFrame, strict: bool = True) -> DataFrame:
    """The path of each trip: one place for a visit, a known route, or else its own points; with method and metres."""
    still = F.col("kind") == "visit_stationary"
    rows = chosen_routes(trips, routes, strict)
    own = L.places(F.col("points"))
    own = F.when(F.size(own) >= 2, own).otherwise(F.array(*[F.struct(F.col(f"{x}_lat").alias("lat"), F.col(f"{x}_lon").alias("lon")) for x in ("start", "end")]))
    here = F.array(F.struct(F.col("start_lat").alias("lat"), F.col("start_lon").alias("lon"), F.lit(0.0).alias("cum")))
    line = F.when(still, here).when(F.col("route_line").isNotNull(), F.col("route_line")).otherwise(L.measured(L.at_least_two(L.thinned(own, 0.05))))
    method = F.when(still, "stationary").when(F.col("route_class").isNotNull(), F.concat(F.lit("uni_route_shape::"), F.col("selection_method"))).otherwise("timeline_polyline_no_route_match")
    rows = rows.withColumn("line", line).withColumn("method", method).withColumn("route_class", F.when(~still, F.col("route_class")))
    duration = (micros(F.col("end_t")) - micros(F.col("start_t"))) / 1e6
    return rows.withColumn("distance_m", L.length(F.col("line"))).withColumn("duration_s", duration).drop("places", "route_line", "selection_method", "endpoint_score_m")


def relative_spans(stretches: DataFrame, keys: Names, pos: str, label: str, metres: str) -> DataFrame:
    """Stretches in order as spans of the whole (0 to 1); neighbours of one mode are one; others' modes and lengths of 0 go."""
    rows = dealt(stretches.withColumn("mode", route_mode(F.col(label))).where(F.col("mode").isNotNull() & (F.col(metres) > 0)), keys)
    w = over(keys, [pos])
    rows = rows.withColumn("__end", F.sum(metres).over(w)).withColumn("__new", F.when(F.coalesce(F.lag("mode").over(w) != F.col("mode"), F.lit(True)), 1).otherwise(0))
    rows = rows.withColumn("__run", F.sum("__new").over(w)).withColumn("__total", F.sum(metres).over(Window.partitionBy(*keys)))
    out = rows.groupBy(*keys, F.col("__run").cast("long").alias("seq")).agg(F.first("mode").alias("mode"), (F.min(F.col("__end") - F.col(metres)) / F.first("__total")).alias("start_rel"), (F.max("__end") / F.first("__total")).alias("end_rel"))
    return out


def reversed_spans(spans: DataFrame, keys: Names) -> DataFrame:
    """The spans of the way back."""
    back = spans.select(*keys, "mode", (1 - F.col("end_rel")).alias("start_rel"), (1 - F.col("start_rel")).alias("end_rel"))
    return back.withColumn("seq", F.row_number().over(over(keys, ["start_rel"])).cast("long"))


def label_speed(label: Column, mode: Column) -> Column:
    """Metres a second of a stretch by its label, or by the trip's mode."""
    k = route_mode(label)
    out = F.when(k == "walk", LABEL_SPEED["walk"]).when(k == "bus", LABEL_SPEED["bus"]).when(k == "train", LABEL_SPEED["train"])
    return out.otherwise(mode_speed(mode))


def clipped_spans(intervals: DataFrame, spans: DataFrame, route: Names) -> DataFrame:
    """the parts of a route's spans that lie in an interval: distance_m, speed_mps, and walk_dwell_after_s.

    Intervals have start_chainage_m, end_chainage_m (in either order), baseline_m (the route's length), path_m (that of
    the interval's path) and mode.  After a walk that ends within the interval, but not at the route's end, there are two minutes.
    """
    low, high = F.least("start_chainage_m", "end_chainage_m"), F.greatest("start_chainage_m", "end_chainage_m")
    met = intervals.withColumn("__low", low).withColumn("__high", high).where("path_m > 0 AND baseline_m > 0 AND __high > __low").join(spans.withColumnRenamed("mode", "label"), list(route))
    a, b, tol = F.col("start_rel") * F.col("baseline_m"), F.col("end_rel") * F.col("baseline_m"), F.col("baseline_m") * 1e-6
    met = met.where((F.col("end_rel") > F.col("start_rel")) & (F.least(b, F.col("__high")) > F.greatest(a, F.col("__low"))))
    inside = F.least(b, F.col("__high")) - F.greatest(a, F.col("__low"))
    walk = F.coalesce(route_mode(F.col("label")) == "walk", F.lit(False))
    ended = walk & (F.abs(b - F.least(b, F.col("__high"))) <= tol) & (b < F.col("__high") - tol) & ~(F.abs(b - F.col("baseline_m")) <= tol)
    out = met.withColumn("distance_m", F.greatest(F.lit(0.0), inside * F.col("path_m") / (F.col("__high") - F.col("__low"))))
    out = out.withColumn("speed_mps", F.greatest(label_speed(F.col("label"), F.col("mode")), F.lit(0.1))).withColumn("walk_dwell_after_s", F.when(ended, WALK_DWELL_S).otherwise(0.0))
    return out.drop("__low", "__high", "start_rel", "end_rel")


def scheduled(parts: DataFrame, keys: Names, order: str, duration_s: Column) -> DataFrame:
    """when each part moves and waits, for all to take the duration: move_time_s, dwell_s, starts_s, slack_s.

    Time to spare is slack; if it is short, moving is sped up; if it doesn't hold the waits, they shrink and nothing moves.
    """
    w = Window.partitionBy(*keys)
    need = F.col("distance_m") / F.greatest(F.col("speed_mps"), F.lit(0.1))
    rows = dealt(parts, keys).withColumn("__dt", duration_s.cast("double")).withColumn("__need", need).withColumn("__move", F.sum(need).over(w)).withColumn("__wait", F.sum("walk_dwell_after_s").over(w))
    enough, some = F.col("__dt") >= F.col("__move") + F.col("__wait"), F.col("__dt") > F.col("__wait")
    faster = F.when(enough, 1.0).when(some, (F.col("__dt") - F.col("__wait")) / F.greatest(F.col("__move"), F.lit(1e-9))).otherwise(0.0)
    shorter = F.when(enough | some, 1.0).when(F.col("__wait") > 0, F.col("__dt") / F.greatest(F.col("__wait"), F.lit(1e-9))).otherwise(0.0)
    rows = rows.withColumn("move_time_s", F.greatest(F.col("__need") * faster, F.lit(0.0))).withColumn("dwell_s", F.greatest(F.col("walk_dwell_after_s") * shorter, F.lit(0.0)))
    rows = rows.withColumn("slack_s", F.when(enough, F.col("__dt") - F.col("__move") - F.col("__wait")).otherwise(0.0))
    before = over(keys, [order]).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("starts_s", F.coalesce(F.sum(F.col("move_time_s") + F.col("dwell_s")).over(before), F.lit(0.0)))
    return rows.drop("__dt", "__need", "__move", "__wait")


def distance_on_schedule(times: DataFrame, schedule: DataFrame, keys: Names, elapsed: str, duration: str, path_m: str) -> DataFrame:
    """F8: metres along a path after ``elapsed`` seconds of an interval; half of the slack is at either end.

    ``schedule`` is that of :func:`scheduled`.  Adds distance_here_m to the times, which must differ within an interval.
    """
    met = dealt(times, keys).join(schedule.select(*keys, "distance_m", "move_time_s", "starts_s", "slack_s"), list(keys), "left")
    t = F.col(elapsed) - F.col("slack_s") / 2
    moved = F.when(F.col("move_time_s") > 0, F.col("distance_m") * F.greatest(F.lit(0.0), F.least(F.lit(1.0), (t - F.col("starts_s")) / F.col("move_time_s")))).otherwise(0.0)
    out = met.withColumn("__moved", moved).groupBy(*times.columns).agg(F.sum("__moved").alias("__moved"), F.coalesce(F.max("slack_s"), F.lit(0.0)).alias("__slack"), F.count("slack_s").alias("__parts"))
    here = F.when((F.col(path_m) <= 0) | (F.col(duration) <= 0) | (F.col(elapsed) <= F.col("__slack") / 2), 0.0)
    here = here.when(F.col(elapsed) >= F.col(duration) - F.col("__slack") / 2, F.col(path_m)).when(F.col("__parts") == 0, 0.0).otherwise(F.col("__moved"))
    return out.withColumn("distance_here_m", here).drop("__moved", "__slack", "__parts")


def interval_speed(mode: Column, speeds: Column, stand: Column | None = None) -> Column:
    """metres a second between two anchors, and where that comes from (speed, source).

    Cycling is fixed; else it is the median of the sensors' speeds (those over ``stand``, on foot), within 0.4 and 2.5 times
    the mode's (6 at least); else the mode's.
    """
    m = travel_mode(mode)
    there = F.filter(speeds, lambda s: s.isNotNull() & ~F.isnan(s) & (s > 0))
    there = F.coalesce(there, F.array().cast("array<double>"))
    used, source = there, F.lit("sensor_median")
    if stand is not None:
        moving = F.filter(there, lambda s: s > stand)
        foot = m.isin("CYCLING", "WALKING", "RUNNING") & finite(stand).isNotNull()
        used = F.when(foot & (F.size(moving) > 0), moving).otherwise(there)
        source = F.when(foot & (F.size(moving) > 0), "sensor_median_moving_only").when(foot, "sensor_median_with_stops").otherwise("sensor_median")
    s, n = F.array_sort(used), F.size(used)
    middle = (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2
    usual = mode_speed_exact(mode)
    held = F.least(F.greatest(middle, F.lit(0.4)), F.greatest(usual * 2.5, F.lit(6.0)))
    pair = lambda v, w: F.struct(v.alias("speed"), w.alias("source"))
    return F.when(m == "CYCLING", pair(F.lit(5.5), F.lit("mode_bike_fixed"))).when(n > 0, pair(held, source)).otherwise(pair(usual, F.lit("mode_default")))


def mode_speed_exact(mode: Column) -> Column:
    """The speed of a mode by its name as it is; 4 where it has none."""
    from wayfold.functions.parse import DEFAULT_SPEED, MODE_SPEED, looked_up

    return looked_up(mode, MODE_SPEED, F.lit(DEFAULT_SPEED))


def dwell_plan(hotspots: Column, dwell_s: Column, baseline_m: Column, start_m: Column, end_m: Column, path_m: Column, slack_s: Column) -> Column:
    """The stops of an interval: distances (over 2 m apart) and seconds each; null if there are none.

    They use up to 95 % of the slack, and are left out if that is under a second.
    """
    low, high = F.least(start_m, end_m), F.greatest(start_m, end_m)
    span = high - low
    at = F.transform(F.filter(hotspots, lambda r: r.isNotNull() & ~F.isnan(r)), lambda r: F.greatest(F.lit(0.0), F.least(F.lit(1.0), r)) * baseline_m)
    on_path = F.transform(F.filter(at, lambda c: (c >= low) & (c <= high)), lambda c: F.greatest(F.lit(0.0), F.least((c - low) / F.greatest(span, F.lit(1e-9)) * path_m, path_m)))
    apart = F.aggregate(F.array_sort(on_path), F.array().cast("array<double>"), lambda acc, x: F.when((F.size(acc) == 0) | (F.abs(x - F.element_at(acc, -1)) > 2.0), F.concat(acc, F.array(x))).otherwise(acc))
    total = F.least(slack_s * MOST_SLACK, dwell_s * F.size(apart))
    fine = (path_m > 0) & (slack_s > 0) & (baseline_m > 0) & (span > 0.5) & (dwell_s > 0) & (F.size(apart) > 0) & (total >= 1.0)
    return F.when(fine, F.struct(apart.alias("distances"), (total / F.size(apart)).alias("each_s"), total.alias("total_s")))


def distance_with_stops(elapsed: Column, duration: Column, path_m: Column, moving_s: Column, slack_s: Column, plan: Column) -> Column:
    """metres after ``elapsed`` seconds: half of the slack at either end, one speed between, and the stops of a plan."""
    speed = path_m / moving_s
    clock = F.greatest(F.lit(0.0), elapsed - slack_s / 2)
    state = F.struct(clock.alias("clock"), F.lit(0.0).alias("at"), F.lit(None).cast("double").alias("found"))

    def step(acc: Column, stop: Column) -> Column:
        here = F.least(F.greatest(stop, acc["at"]), path_m)
        takes = (here - acc["at"]) / F.greatest(speed, F.lit(1e-9))
        left = acc["clock"] - takes
        found = F.when(acc["clock"] <= takes, acc["at"] + speed * acc["clock"]).when(left <= plan["each_s"], here)
        return F.when(acc["found"].isNotNull(), acc).otherwise(F.struct((left - plan["each_s"]).alias("clock"), here.alias("at"), found.alias("found")))

    stops = F.coalesce(plan["distances"], F.array().cast("array<double>"))
    rest = lambda acc: F.coalesce(acc["found"], F.least(acc["at"] + speed * acc["clock"], path_m))
    moved = F.aggregate(stops, state, step, rest)
    out = F.when((path_m <= 0) | (duration <= 0) | (elapsed <= slack_s / 2), 0.0).when(elapsed >= duration - slack_s / 2, path_m)
    return out.when(moving_s <= 1e-9, 0.0).otherwise(moved)


def position_source(at_start: Column, at_end: Column, start_source: Column, end_source: Column, start_reason: Column, end_reason: Column, method: Column) -> Column:
    """what a position rests on."""
    fix = lambda r: F.when(r.contains("snapped"), "snapped_sensor_anchor").when(r.contains("projected"), "projected_sensor_anchor").otherwise("raw_sensor_anchor")
    reason = lambda r: F.coalesce(r, F.lit("accepted_raw"))
    return (F.when(at_start & (start_source == "sensor_fix"), fix(reason(start_reason))).when(at_end & (end_source == "sensor_fix"), fix(reason(end_reason)))
            .when(at_start | at_end, "google_anchor").when(method.contains("osrm_route"), "routed_interpolation")
            .when(F.startswith(method, F.lit("baseline_subpath::")), "baseline_interpolation").otherwise("direct_interpolation"))


def confidence(source: Column, mode: Column, method: Column) -> Column:
    """(label, score) of a position."""
    pair = lambda a, b: F.struct(F.lit(a).alias("label"), F.lit(b).alias("score"))
    weak_rail = F.coalesce(mode.isin("IN_TRAIN", "IN_SUBWAY", "IN_TRAM"), F.lit(False)) & method.contains("direct")
    return (F.when(source.isin("raw_sensor_anchor", "snapped_sensor_anchor"), pair("high", 0.9)).when(source == "projected_sensor_anchor", pair("medium", 0.75))
            .when(source == "routed_interpolation", pair("medium", 0.7)).when(method.contains("gtfs_rail_shape"), pair("high", 0.82))
            .when((source == "baseline_interpolation") & weak_rail, pair("low", 0.4)).when(source.isin("baseline_interpolation", "google_anchor"), pair("medium", 0.6)).otherwise(pair("low", 0.35)))


def grid(start: Column, end: Column, every_s: int = 5) -> Column:
    """the seconds since 1970 that are multiples of ``every_s`` in an interval (of microseconds), ends included."""
    first, last = F.ceil(start / (every_s * 1_000_000)).cast("long"), F.floor(end / (every_s * 1_000_000)).cast("long")
    return F.transform(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>")), lambda g: g * every_s)


def _total(xs: Column, field: str) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x[field])


def interval_schedule(profile: Column, baseline_m: Column, start_m: Column, end_m: Column, path_m: Column, mode: Column, duration_s: Column) -> Column:
    """F9, F10 as a value: parts (metres, move_s, dwell_s) of an interval, with move_s, dwell_s and slack_s; null without parts.

    ``profile`` has a route's spans in order (mode, start_rel, end_rel); the rules are those of :func:`clipped_spans` and
    :func:`scheduled`.
    """

    def clipped(v: Column) -> Column:
        low, high, line, tol = v["low"], v["high"], v["line_m"], v["line_m"] * 1e-6

        def part(s: Column) -> Column:
            first, last = s["start_rel"] * line, s["end_rel"] * line
            until = F.least(last, high)
            ended = F.coalesce(route_mode(s["mode"]) == "walk", F.lit(False)) & (F.abs(last - until) <= tol) & (last < high - tol) & ~(F.abs(last - line) <= tol)
            metres = F.greatest(F.lit(0.0), (until - F.greatest(first, low)) * v["path_m"] / (high - low))
            speed = F.greatest(label_speed(s["mode"], v["mode"]), F.lit(0.1))
            return F.struct(metres.alias("metres"), speed.alias("speed"), F.when(ended, WALK_DWELL_S).otherwise(0.0).alias("wait_s"))

        there = F.filter(v["profile"], lambda s: (s["end_rel"] > s["start_rel"]) & (F.least(s["end_rel"] * line, high) > F.greatest(s["start_rel"] * line, low)))
        return F.struct(F.when((v["path_m"] > 0) & (line > 0) & (high > low), F.transform(there, part)).alias("parts"), v["dt"].alias("dt"))

    def needed(v: Column) -> Column:
        parts = F.transform(v["parts"], lambda p: F.struct(p["metres"].alias("metres"), (p["metres"] / p["speed"]).alias("need_s"), p["wait_s"].alias("wait_s")))
        return L.bound(parts, lambda x: F.struct(x.alias("parts"), _total(x, "need_s").alias("move"), _total(x, "wait_s").alias("wait"), v["dt"].alias("dt")))

    def fitted(v: Column) -> Column:
        enough, some = v["dt"] >= v["move"] + v["wait"], v["dt"] > v["wait"]
        faster = F.when(enough, 1.0).when(some, (v["dt"] - v["wait"]) / F.greatest(v["move"], F.lit(1e-9))).otherwise(0.0)
        shorter = F.when(enough | some, 1.0).when(v["wait"] > 0, v["dt"] / F.greatest(v["wait"], F.lit(1e-9))).otherwise(0.0)
        slack = F.when(enough, v["dt"] - v["move"] - v["wait"]).otherwise(0.0)
        return F.struct(v["parts"].alias("parts"), faster.alias("faster"), shorter.alias("shorter"), slack.alias("slack"))

    def timed(v: Column) -> Column:
        parts = F.transform(v["parts"], lambda p: F.struct(p["metres"].alias("metres"), F.greatest(p["need_s"] * v["faster"], F.lit(0.0)).alias("move_s"), F.greatest(p["wait_s"] * v["shorter"], F.lit(0.0)).alias("dwell_s")))
        return L.bound(parts, lambda x: F.struct(x.alias("parts"), _total(x, "move_s").alias("move_s"), _total(x, "dwell_s").alias("dwell_s"), v["slack"].alias("slack_s")))

    given = F.struct(F.least(start_m, end_m).alias("low"), F.greatest(start_m, end_m).alias("high"), baseline_m.alias("line_m"), path_m.alias("path_m"), mode.alias("mode"), duration_s.cast("double").alias("dt"), profile.alias("profile"))
    found = L.bound(given, clipped)
    return L.bound(found, lambda v: F.when(F.size(v["parts"]) > 0, L.bound(L.bound(L.bound(v, needed), fitted), timed)))


def distance_on_parts(elapsed: Column, duration: Column, path_m: Column, schedule: Column) -> Column:
    """F8 as a fold over the parts of :func:`interval_schedule`; half of the slack is at either end."""
    half = schedule["slack_s"] / 2
    state = F.struct(F.greatest(F.lit(0.0), elapsed - half).alias("clock"), F.lit(0.0).alias("at"), F.lit(None).cast("double").alias("found"))

    def step(acc: Column, p: Column) -> Column:
        moves = p["move_s"] > 0
        after = F.when(moves, acc["clock"] - p["move_s"]).otherwise(acc["clock"])
        there = F.when(moves, acc["at"] + p["metres"]).otherwise(acc["at"])
        found = F.when(moves & (acc["clock"] <= p["move_s"]), acc["at"] + p["metres"] * acc["clock"] / p["move_s"]).when((p["dwell_s"] > 0) & (after <= p["dwell_s"]), there)
        return F.when(acc["found"].isNotNull(), acc).otherwise(F.struct((after - p["dwell_s"]).alias("clock"), there.alias("at"), found.alias("found")))

    moved = F.aggregate(schedule["parts"], state, step, lambda acc: acc["found"])
    out = F.when((path_m <= 0) | (duration <= 0) | (elapsed <= half), 0.0).when(elapsed >= duration - half, path_m)
    return out.otherwise(F.coalesce(moved, path_m))


def with_profiles(paths: DataFrame, spans: DataFrame, route: Names) -> DataFrame:
    """The spans of each path's route (mode, start_rel and end_rel, by seq) as a value, ``profile``; null without any."""
    own = F.array_sort(F.collect_list(F.struct("seq", "mode", "start_rel", "end_rel")))
    bare = F.transform(own, lambda s: F.struct(s["mode"].alias("mode"), s["start_rel"].alias("start_rel"), s["end_rel"].alias("end_rel")))
    return paths.join(spans.groupBy(*route).agg(bare.alias("profile")), list(route), "left")


def interpolated_track(anchors: DataFrame, paths: DataFrame, keys: Names, every_s: int = 5, profiles: DataFrame | None = None, route: Names = ("route_class",), stand_mps: float | Column | None = None) -> DataFrame:
    """C4: positions on the regular grid between neighbouring anchors of a trip, along the trip's path.

    Anchors have t, chainage_m, lat, lon, source, fix_id, reason and speed_mps; paths have line, mode, method and, for
    stops, hotspots and dwell_s.  Between two anchors the path is the stretch between their chainages.  Where the path's route has
    spans of modes in ``profiles`` (see :func:`with_profiles`) that reach into it, it is walked by their schedule; else at the
    interval's speed (of anchors over ``stand_mps``, see :func:`interval_speed`) with 1.2 times its time, slack at both ends and stops
    in between.  ``correction_used`` goes on from the paths' column of that name, if there is one.
    """
    if profiles is not None:
        paths = with_profiles(paths, profiles, route)
    elif "profile" not in paths.columns:
        paths = paths.withColumn("profile", F.lit(None).cast("array<struct<mode:string,start_rel:double,end_rel:double>>"))
    correction = F.coalesce("correction_used", F.lit("")) if "correction_used" in paths.columns else F.lit("")
    paths = paths.withColumn("correction_used", correction)
    stand = F.lit(float(stand_mps)) if isinstance(stand_mps, (int, float)) else stand_mps
    w = over(keys, ["t"])
    a = anchors.withColumn("__next", F.lead(F.struct(*[F.col(c) for c in ("t", "chainage_m", "source", "fix_id", "reason", "speed_mps")])).over(w)).where("__next IS NOT NULL")
    a = a.withColumn("subsegment_id", F.row_number().over(w).cast("long") - 1).join(paths, list(keys))
    forward = L.sub_line(F.col("line"), F.col("chainage_m"), F.col("__next.chainage_m"))
    turned = L.bound(forward, lambda p: F.when(F.col("__next.chainage_m") < F.col("chainage_m"), F.reverse(p)).otherwise(p))
    a = a.withColumn("__path", L.measured(turned))
    a = a.withColumn("path_length_m", L.length(F.col("__path"))).withColumn("__s", micros(F.col("t"))).withColumn("__e", micros(F.col("__next.t")))
    a = a.withColumn("observed_duration_s", (F.col("__e") - F.col("__s")) / 1e6).withColumn("__speed", interval_speed(F.col("mode"), F.array(F.col("speed_mps"), F.col("__next.speed_mps")), stand))
    a = a.withColumn("__modes", interval_schedule(F.col("profile"), L.length(F.col("line")), F.col("chainage_m"), F.col("__next.chainage_m"), F.col("path_length_m"), F.col("mode"), F.col("observed_duration_s")))
    by_mode = F.col("__modes").isNotNull()
    plain_move = F.when(F.col("path_length_m") > 0, F.col("path_length_m") / F.greatest(F.col("__speed.speed"), F.lit(0.1))).otherwise(0.0)
    a = a.withColumn("expected_move_duration_s", F.when(by_mode, F.col("__modes.move_s")).otherwise(plain_move))
    moving = F.when(F.col("observed_duration_s") > 0, F.least("observed_duration_s", F.col("expected_move_duration_s") * SPEED_FACTOR)).otherwise(0.0)
    a = a.withColumn("__moving", moving).withColumn("__slack", F.greatest(F.lit(0.0), F.col("observed_duration_s") - F.col("__moving")))
    plan = dwell_plan(F.col("hotspots"), F.col("dwell_s"), L.length(F.col("line")), F.col("chainage_m"), F.col("__next.chainage_m"), F.col("path_length_m"), F.col("__slack"))
    a = a.withColumn("__plan", F.when(~by_mode, plan))
    a = a.withColumn("intersection_dwell_s", F.coalesce("__modes.dwell_s", "__plan.total_s", F.lit(0.0)))
    a = a.withColumn("slack_duration_s", F.coalesce("__modes.slack_s", F.greatest(F.lit(0.0), F.col("__slack") - F.col("intersection_dwell_s"))))
    mode_speed_mps = F.when(F.col("__modes.move_s") > 0, F.col("path_length_m") / F.greatest("__modes.move_s", F.lit(1e-9))).otherwise(0.0)
    a = a.withColumn("speed_basis_mps", F.when(by_mode, mode_speed_mps).otherwise(F.col("__speed.speed")))
    stops = F.col("__plan").isNotNull()
    told = lambda c, mode, stop: F.when(by_mode, F.concat(c, F.lit(mode))).when(stops, F.concat(c, F.lit(stop))).otherwise(c)
    a = a.withColumn("speed_basis_source", told(F.when(by_mode, "opnv_mode_profile").otherwise(F.col("__speed.source")), "+walk_dwell_120s", "+training_intersection_profile"))
    a = a.withColumn("path_method", told(F.col("method"), "::mode_profile", "::intersection_dwell"))
    mark = F.when(by_mode, "opnv_mode_profile").when(stops, "training_intersection_model")
    known_mark = mark.isNull() | F.contains("correction_used", mark)
    a = a.withColumn("correction_used", F.when(known_mark, F.col("correction_used")).when(F.col("correction_used") == "", mark).otherwise(F.concat_ws("+", "correction_used", mark)))
    rows = a.withColumn("grid_s", F.explode(grid(F.col("__s"), F.col("__e"), every_s)))
    elapsed = (F.col("grid_s") * 1_000_000 - F.col("__s")) / 1e6
    plain = distance_with_stops(elapsed, F.col("observed_duration_s"), F.col("path_length_m"), F.col("__moving"), F.col("slack_duration_s"), F.col("__plan"))
    rows = rows.withColumn("distance_here_m", F.when(by_mode, distance_on_parts(elapsed, F.col("observed_duration_s"), F.col("path_length_m"), F.col("__modes"))).otherwise(plain))
    rows = rows.withColumn("__at", L.place_at(F.col("__path"), F.col("distance_here_m")))
    # A fix numbered 0 counts as one without a number, so its reason isn't looked up.
    known = lambda fix, reason: F.when(F.coalesce(fix, F.lit(0)) != 0, reason)
    source = position_source(F.col("grid_s") * 1_000_000 == F.col("__s"), F.col("grid_s") * 1_000_000 == F.col("__e"), F.col("source"), F.col("__next.source"), known(F.col("fix_id"), F.col("reason")), known(F.col("__next.fix_id"), F.col("__next.reason")), F.col("path_method"))
    rows = rows.withColumn("position_source", source).withColumn("__sure", confidence(F.col("position_source"), F.col("mode"), F.col("path_method")))
    return rows.select(
        *keys, "subsegment_id", F.timestamp_seconds("grid_s").alias("ts"), F.col("__at.lat").alias("lat"), F.col("__at.lon").alias("lon"), "mode",
        F.col("source").alias("anchor_start_source"), F.col("__next.source").alias("anchor_end_source"), "path_method", "correction_used", "path_length_m", "observed_duration_s",
        "speed_basis_mps", "speed_basis_source", "expected_move_duration_s", "slack_duration_s",
        "intersection_dwell_s", "distance_here_m", "position_source", F.col("__sure.label").alias("confidence_label"), F.col("__sure.score").alias("confidence_score"))


def stretched(windows: DataFrame, routes: DataFrame, start: str, end: str, every_s: int = 5) -> DataFrame:
    """A route drawn evenly over a window of time, on the regular grid; where that holds no time, at the one before the start.

    Windows have route_class; those of unknown classes, or that end before they start, give nothing.
    """
    known = F.broadcast(routes.where(F.col("route_class").isin(ROUTE_CLASSES)).select("route_class", "line"))  # four classes at most
    rows = windows.withColumn("route_class", route_class(F.col("route_class"))).join(known, "route_class").where(F.col(end) >= F.col(start))
    s, e = micros(F.col(start)), micros(F.col(end))
    times = grid(s, e, every_s)
    rows = rows.withColumn("__times", F.when(F.size(times) > 0, times).otherwise(F.array(F.floor(s / (every_s * 1_000_000)).cast("long") * every_s)))
    rows = rows.withColumn("path_length_m", L.length(F.col("line"))).withColumn("observed_duration_s", F.greatest((e - s) / 1e6, F.lit(float(every_s)))).withColumn("__n", F.size("__times"))
    rows = rows.select("*", F.posexplode("__times").alias("__i", "grid_s"))
    share = F.when(F.col("__n") > 1, F.col("__i") / (F.col("__n") - 1)).otherwise(0.0)
    rows = rows.withColumn("__at", L.place_at(F.col("line"), share * F.col("path_length_m"))).withColumn("mode", mode_of_class(F.col("route_class")))
    rows = rows.withColumn("speed_basis_mps", F.col("path_length_m") / F.col("observed_duration_s")).withColumn("position_source", F.lit("synthetic_route_shape")).withColumn("confidence_label", F.lit("low")).withColumn("confidence_score", F.lit(0.35))
    return rows.withColumn("ts", F.timestamp_seconds("grid_s")).withColumn("lat", F.col("__at.lat")).withColumn("lon", F.col("__at.lon")).drop("line", "__times", "__n", "__i", "__at", "grid_s")


def refined_stay(base_lat: Column, base_lon: Column, lat: Column, lon: Column, limit_m: float = 60.0) -> Column:
    """F16: where a stay is: the centroid of its fixes, up to ``limit_m`` from its own place; (lat, lon, source)."""
    away = haversine(base_lat, base_lon, lat, lon)
    share = F.least(F.lit(1.0), limit_m / F.greatest(away, F.lit(1e-9)))
    place = lambda y, x, s: F.struct(y.alias("lat"), x.alias("lon"), F.lit(s).alias("source"))
    return (F.when(lat.isNull(), place(base_lat, base_lon, "google_stationary_only")).when(away <= limit_m, place(lat, lon, "sensor_stationary_centroid"))
            .otherwise(place(base_lat + share * (lat - base_lat), base_lon + share * (lon - base_lon), "google_sensor_blend")))


def stop_model(hotspots: DataFrame, keys: Names = ()) -> DataFrame:
    """Stops of bike routes (route_class, hotspots, dwell_s) completed: the missing way mirrored, and public
    transport like the bike of its way with 0.6 of its waits.  A model for each key."""
    cols = [*keys, "route_class"]
    bikes = hotspots.where(F.col("route_class").isin("to_uni_bike", "from_uni_bike")).select(*cols, F.array_sort("hotspots").alias("hotspots"), "dwell_s", F.lit("training_route_specific").alias("source"))
    clip = lambda r: F.greatest(F.lit(0.0), F.least(F.lit(1.0), r))
    mirrored = F.array_sort(F.transform(F.filter("hotspots", lambda r: r.isNotNull() & ~F.isnan(r)), lambda r: 1 - clip(r)))
    other = F.when(F.col("route_class") == "to_uni_bike", "from_uni_bike").otherwise("to_uni_bike")
    back = bikes.select(*keys, other.alias("route_class"), mirrored.alias("hotspots"), "dwell_s", F.concat(F.lit("training_mirrored_from_"), "route_class").alias("source"))
    both = bikes.unionByName(back.join(bikes.select(*cols), cols, "left_anti"))
    public = both.where(F.size("hotspots") > 0).select(
        *keys, F.replace("route_class", F.lit("_bike"), F.lit("_opnv")).alias("route_class"), F.transform("hotspots", clip).alias("hotspots"),
        F.greatest(F.lit(0.0), F.col("dwell_s") * 0.6).alias("dwell_s"), F.lit("bike_template_for_opnv").alias("source"))
    return both.unionByName(public)
