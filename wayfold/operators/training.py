"""Stops of known bike routes, learnt from traces: where on the way one stands, and for how long."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions.geo import haversine
from wayfold.functions.parse import finite, route_class
from wayfold.operators import aggregates as A
from wayfold.operators.fusion import greedy_clusters
from wayfold.operators.routes import stop_model
from wayfold.operators.sequences import best_row, micros, over, rolling_median, systematic_sample
from wayfold.sources.shared import saved

Names = Sequence[str]

# What traces are learnt from, what counts as a stop, and how stops are put together.
LEAST_MODE, LEAST_POINTS, LEAST_M, LEAST_RANGE = 2, 15, 800.0, 0.2
STOP_S, STOP_PLACE, STAND_SMOOTH = (8.0, 240.0), (0.03, 0.97), 0.8
SMOOTH_S, SMOOTH_ROWS, USUAL_STEP_S = 5.0, (21, 401), 0.25
TOGETHER, LEAST_EVENTS, SPARSE, MOST_SPOTS = 0.035, 2, 4, 18
MOST_SPEED = 35.0
# End of fixed values.


def progress(rows: DataFrame, keys: Names, pos: str) -> DataFrame:
    """How far each row is on its trace (0 to 1), and its speed: the sensor's if it is likely, else that of the step.

    Rows have ts, lat, lon and speed; of rows at one time the first by ``pos`` counts.
    """
    own = best_row(rows.where(F.col("ts").isNotNull()), [*keys, "ts"], [pos])
    w = over(keys, ["ts"])
    step = haversine(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    own = own.withColumn("__step", step).withColumn("__s", (micros(F.col("ts")) - F.lag(micros(F.col("ts"))).over(w)) / 1e6)
    own = own.withColumn("__cum", F.sum(F.coalesce("__step", F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    total = F.max("__cum").over(Window.partitionBy(*keys))
    likely = finite(F.col("speed"))
    measured = F.when(likely.between(0.0, MOST_SPEED), likely)
    out = own.withColumn("progress_rel", F.when(total > 0, F.col("__cum") / total).otherwise(0.0)).withColumn("speed_m_s", F.coalesce(measured, F.col("__step") / F.col("__s")))
    return out.drop("__step", "__s", "__cum")


def training_traces(traces: DataFrame, keys: Names, pos: str) -> DataFrame:
    """The rows that stops are learnt from, with route_class, progress_rel and speed_m_s.

    Traces are of bike routes, told by ``route`` (any text); rows have a fix of two dimensions; a trace has 15 of them or
    more, also at different times, reaches over a fifth of its way, and is 800 m long in the order of ``pos``.
    """
    rows = traces.withColumn("route_class", route_class(F.col("route"))).where(F.contains("route_class", F.lit("bike")) & (F.coalesce("gps_mode", F.lit(-1)) >= LEAST_MODE))
    w = over(keys, [pos])
    rows = rows.withColumn("__leg", haversine(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon")))
    whole = Window.partitionBy(*keys)
    rows = rows.withColumn("__n", F.count(F.lit(1)).over(whole)).withColumn("__m", F.sum("__leg").over(whole)).where((F.col("__n") >= LEAST_POINTS) & (F.col("__m") >= LEAST_M))
    out = progress(rows.drop("__leg", "__n", "__m"), keys, pos)
    out = out.withColumn("__n", F.count(F.lit(1)).over(whole)).withColumn("__reach", F.max("progress_rel").over(whole) - F.min("progress_rel").over(whole))
    return out.where((F.col("__n") >= LEAST_POINTS) & (F.col("__reach") >= LEAST_RANGE)).drop("__n", "__reach")


def smoothed(rows: DataFrame, keys: Names) -> DataFrame:
    """The median speed around each row, over as many rows as five seconds have (21 to 401, odd), a sixth of them at least."""
    w = over(keys, ["ts"])
    step = (micros(F.col("ts")) - F.lag(micros(F.col("ts"))).over(w)) / 1e6
    usual = rows.withColumn("__s", step).groupBy(*keys).agg(F.percentile(F.when(F.col("__s") > 0, F.col("__s")), F.lit(0.5)).alias("__s"))
    wide = F.rint(SMOOTH_S / F.greatest(F.coalesce("__s", F.lit(USUAL_STEP_S)), F.lit(1e-3))).cast("int")
    wide = F.greatest(F.lit(SMOOTH_ROWS[0]), F.least(wide, F.lit(SMOOTH_ROWS[1])))
    sizes = usual.select(*keys, (wide + F.when(wide % 2 == 0, 1).otherwise(0)).alias("__wide"))
    met = saved(rows.join(sizes, list(keys)), "traces")
    out = None
    for r in met.select("__wide").distinct().orderBy("__wide").collect():  # frames are constants; there are 191 widths at most
        part = rolling_median(met.where(F.col("__wide") == r["__wide"]), keys, "ts", "speed_m_s", r["__wide"], max(7, r["__wide"] // 6), "smooth_m_s")
        out = part if out is None else out.unionByName(part)
    return (met.withColumn("smooth_m_s", F.lit(None).cast("double")) if out is None else out).drop("__wide")


def stop_events(rows: DataFrame, keys: Names, stand_mps: Column) -> DataFrame:
    """Runs of standing of 8 to 240 s, not at the ends of the way: center_rel (the median) and dwell_s."""
    w = over(keys, ["ts"])
    valid = finite(F.col("speed_m_s")).isNotNull() & F.col("progress_rel").isNotNull()
    whole = Window.partitionBy(*keys)
    stands = valid & (F.coalesce(F.col("smooth_m_s") <= F.greatest(stand_mps, F.lit(STAND_SMOOTH)), F.lit(False)) | (F.col("speed_m_s") <= stand_mps))
    rows = rows.withColumn("__fine", F.count_if(valid).over(whole)).where("__fine >= 3").withColumn("__stands", stands)
    turn = F.when(F.coalesce(F.lag("__stands").over(w) != F.col("__stands"), F.lit(True)), 1).otherwise(0)
    runs = rows.withColumn("__turn", turn).withColumn("__run", F.sum("__turn").over(w)).where("__stands")
    dwell = (F.max(micros(F.col("ts"))) - F.min(micros(F.col("ts")))) / 1e6
    out = runs.groupBy(*keys, "__run").agg(F.first("route_class").alias("route_class"), F.percentile("progress_rel", F.lit(0.5)).alias("center_rel"), dwell.alias("dwell_s"))
    return out.where(F.col("dwell_s").between(*STOP_S) & F.col("center_rel").between(*STOP_PLACE)).drop("__run")


def hotspots(events: DataFrame, route: Names = ("route_class",)) -> DataFrame:
    """Places of stops of each route that belong together: hotspots and dwell_s (the median of theirs), raw_stop_events_n.

    Where no two events are together, the four longest are taken as they are; of many places 18 are kept, evenly spaced.
    """
    order = over(route, ["center_rel", "dwell_s"])
    own = saved(events.withColumn("__nth", F.row_number().over(order)).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*route))), "events")
    groups = greedy_clusters(own, route, "center_rel", TOGETHER, 1)  # a fold over the events of a route
    upto = F.sum("n").over(over(route, ["cluster"]))
    groups = groups.withColumn("__to", upto).withColumn("__nth", F.explode(F.sequence(F.col("__to") - F.col("n") + 1, F.col("__to")))).drop("__to")
    met = own.join(groups.select(*route, "__nth", "cluster", "center", F.col("n").alias("__size")), [*route, "__nth"])
    spots = met.where(F.col("__size") >= LEAST_EVENTS).groupBy(*route, "cluster").agg(F.first("center").alias("at"), F.percentile("dwell_s", F.lit(0.5)).alias("dwell_s"))
    longest = over(route, [F.col("dwell_s").desc(), "__nth"])
    few = own.join(spots.select(*route).distinct(), list(route), "left_anti").withColumn("__k", F.row_number().over(longest)).where(F.col("__k") <= SPARSE)
    few = few.select(*route, F.col("__nth").cast("long").alias("cluster"), F.col("center_rel").alias("at"), F.percentile("dwell_s", F.lit(0.5)).over(Window.partitionBy(*route)).alias("dwell_s"))
    kept = systematic_sample(spots.select(*route, "cluster", "at", "dwell_s").unionByName(few), ["at", "cluster"], MOST_SPOTS, list(route))
    out = kept.groupBy(*route).agg(F.array_sort(F.collect_list(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("at"))))).alias("hotspots"), F.greatest(F.lit(0.0), F.percentile("dwell_s", F.lit(0.5))).alias("dwell_s"))
    return out.join(own.groupBy(*route).agg(F.count(F.lit(1)).alias("raw_stop_events_n")), list(route))


def trained_stops(traces: DataFrame, keys: Names, pos: str) -> tuple[DataFrame, DataFrame]:
    """The stop model of all routes (see :func:`routes.stop_model`) from traces, and its speeds of standing and moving.

    Traces have ``keys``, ``pos``, route (any text that tells it), ts, lat, lon, gps_mode and speed.  The model feeds
    ``routes.interpolated_track``: its hotspots and dwell_s by route class, and stand_mps.
    """
    rows = saved(training_traces(traces, keys, pos), "training")
    speeds = saved(A.stop_speed(rows, "speed_m_s"), "speeds")
    held = smoothed(rows, keys).join(F.broadcast(speeds.select("stand_mps")))  # one row
    found = hotspots(stop_events(held, keys, F.col("stand_mps")))
    used = rows.select("route_class", *keys).distinct().groupBy("route_class").agg(F.count(F.lit(1)).alias("files_n"))
    model = stop_model(saved(found, "hotspots"))
    told = found.select("route_class", "raw_stop_events_n").join(used, "route_class")
    out = model.join(told.withColumn("source", F.lit("training_route_specific")), ["route_class", "source"], "left")
    return out.fillna(0, ["raw_stop_events_n", "files_n"]), speeds
