"""Joins by time, interval, distance and shape.

None plans a nested loop: as-of joins are a union and two windows, range joins are equi-joins on
buckets with the range as a residual, radius joins meet in grid cells, and points meet only near
edges of their own line (see ``nearest``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions.geo import DEGREE_M, EARTH_RADIUS_M, haversine
from wayfold.operators.nearest import project_on_lines  # noqa: F401
from wayfold.operators.sequences import best_row, micros
from wayfold.sources.shared import saved

Names = Sequence[str]


def _neighbours(w: Window, ts: str) -> tuple[Column, Column]:
    """The right row before each row of a union, and the one after it.

    Both are running values: one that looked ahead to the end of its key would be computed anew for each row.
    """
    so_far = lambda *order: F.last("__r", ignorenulls=True).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    down = lambda c: F.col(c).desc()
    return so_far(ts, down("__side"), "__id"), so_far(down(ts), down("__side"), down("__id"))


def asof_nearest(left: DataFrame, right: DataFrame, keys: Names, ts: str, left_id: str, right_id: str, columns: Names, tolerance_s: float | None = None) -> DataFrame:
    """The row of ``right`` nearest in time to each row of ``left``.

    Ties go backward; of equal times the last (by ``right_id``) counts backward, the first forward.
    Beyond the tolerance, which is inclusive, the right side is null.  Adds delta_s.
    """
    taken = F.struct(F.col(ts).alias("t"), *[F.col(c) for c in columns])
    kind = right.select(taken.alias("r")).schema["r"].dataType.simpleString()
    a = left.withColumn("__side", F.lit(0)).withColumn("__id", F.col(left_id).cast("long")).withColumn("__r", F.lit(None).cast(kind))
    b = right.select(*keys, ts, F.lit(1).alias("__side"), F.col(right_id).cast("long").alias("__id"), taken.alias("__r"))
    both = a.unionByName(b, allowMissingColumns=True)
    back, forth = _neighbours(Window.partitionBy(*keys), ts)
    both = both.withColumn("__back", back).withColumn("__forth", forth).where("__side = 0")
    return _nearer(both, left.columns, ts, columns, tolerance_s)


def asof_nearest_split(left: DataFrame, right: DataFrame, keys: Names, ts: str, left_id: str, right_id: str, columns: Names, tolerance_s: float | None = None, ranges: int | None = None) -> DataFrame:
    """J2, J3 as :func:`asof_nearest`, for keys whose rows one task can't hold.

    Both sides are dealt by ranges of key and time, so that a long log lies in several.  Within a range the windows are those of
    one task; what lies before and after it is carried over from the ranges' last and first rows, one of each for a key and a range.
    Rows without a time match nothing.
    """
    taken = F.struct(F.col(ts).alias("t"), *[F.col(c) for c in columns])
    kind = right.select(taken.alias("r")).schema["r"].dataType.simpleString()
    a = left.withColumn("__side", F.lit(0)).withColumn("__id", F.col(left_id).cast("long")).withColumn("__r", F.lit(None).cast(kind))
    b = right.where(F.col(ts).isNotNull()).select(*keys, ts, F.lit(1).alias("__side"), F.col(right_id).cast("long").alias("__id"), taken.alias("__r"))
    both = a.unionByName(b, allowMissingColumns=True)
    by = [*keys, ts]
    dealt = both.repartitionByRange(*by) if ranges is None else both.repartitionByRange(ranges, *by)  # equal times stay together
    rows = saved(dealt.withColumn("__range", F.spark_partition_id()), "ranges")
    own = [*keys, "__range"]
    first_of, last_of = F.struct(ts, "__id"), F.struct(ts, "__id")
    ends = rows.where("__side = 1").groupBy(*own).agg(F.max_by("__r", last_of).alias("__last"), F.min_by("__r", first_of).alias("__first"))
    # Every range of a key that has rows gets what the nearest ranges with a right row carry.
    met = rows.select(*own).distinct().join(ends, own, "left")
    carry = lambda c, order: F.last(c, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))  # noqa: E731  a row for each range
    carry_back, carry_forth = carry("__last", F.col("__range")), carry("__first", F.col("__range").desc())
    carried = met.select(*own, carry_back.alias("__from"), carry_forth.alias("__to"))
    back, forth = _neighbours(Window.partitionBy(*own), ts)
    found = rows.withColumn("__b", back).withColumn("__f", forth).where("__side = 0").join(carried, own, "left")
    timed = F.col(ts).isNotNull()
    found = found.withColumn("__back", F.when(timed, F.coalesce("__b", "__from"))).withColumn("__forth", F.when(timed, F.coalesce("__f", "__to")))
    return _nearer(found, left.columns, ts, columns, tolerance_s)


def _nearer(both: DataFrame, left_columns: Names, ts: str, columns: Names, tolerance_s: float | None) -> DataFrame:
    """Of the row before (__back) and the one after (__forth) the nearer one, with delta_s."""
    before = (micros(F.col(ts)) - micros(F.col("__back.t"))) / 1e6
    after = (micros(F.col("__forth.t")) - micros(F.col(ts))) / 1e6
    both = both.withColumn("__before", before).withColumn("__after", after)
    use_back = F.col("__back").isNotNull() & (F.col("__forth").isNull() | (F.col("__before") <= F.col("__after")))
    both = both.withColumn("__hit", F.when(use_back, F.col("__back")).otherwise(F.col("__forth")))
    both = both.withColumn("delta_s", F.when(use_back, F.col("__before")).otherwise(F.col("__after")))
    if tolerance_s is not None:
        fine = F.col("delta_s") <= tolerance_s
        both = both.withColumn("__hit", F.when(fine, F.col("__hit"))).withColumn("delta_s", F.when(fine, F.col("delta_s")))
    got = [F.col(f"__hit.{c}").alias(f"right_{c}" if c in left_columns else c) for c in columns]
    return both.select(*left_columns, *got, "delta_s")


def _buckets(first: Column, last: Column, width: int) -> Column:
    """The buckets of microseconds that an interval touches; none if it ends before it starts."""
    a, b = F.floor(first / width).cast("long"), F.floor(last / width).cast("long")
    return F.explode(F.when(b >= a, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>")))


def fitting_width(intervals: DataFrame, start: str, end: str, least_s: int = 60) -> int:
    """Microseconds of a bucket that nine of ten intervals fit into, so that an interval touches two or three."""
    length = micros(F.col(end)) - micros(F.col(start))
    found = intervals.where(length >= 0).agg(F.percentile_approx(length, 0.9, 100)).first()[0]
    return max(least_s * 1_000_000, int(found or 0))


def points_in_intervals(points: DataFrame, intervals: DataFrame, keys: Names, ts: str, start: str, end: str, bucket_s: int | None = None) -> DataFrame:
    """Every pair of a point and an interval of its key that holds it, ends included.

    They meet in buckets of time, by default as wide as most intervals are long.
    """
    width = bucket_s * 1_000_000 if bucket_s else fitting_width(intervals, start, end)
    p = points.withColumn("__bucket", F.floor(micros(F.col(ts)) / width).cast("long"))
    i = intervals.withColumn("__bucket", _buckets(micros(F.col(start)), micros(F.col(end)), width))
    return p.join(i, [*keys, "__bucket"]).where(F.col(ts).between(F.col(start), F.col(end))).drop("__bucket")


def overlaps(a: DataFrame, b: DataFrame, keys: Names, a_ends: tuple[str, str], b_ends: tuple[str, str], bucket_s: int | None = None) -> DataFrame:
    """Pairs of intervals of one key that touch, each once, with overlap_s."""
    (a0, a1), (b0, b1) = a_ends, b_ends
    width = bucket_s * 1_000_000 if bucket_s else max(fitting_width(a, a0, a1), fitting_width(b, b0, b1))
    left = a.withColumn("__bucket", _buckets(micros(F.col(a0)), micros(F.col(a1)), width))
    right = b.withColumn("__bucket", _buckets(micros(F.col(b0)), micros(F.col(b1)), width))
    met = left.join(right, [*keys, "__bucket"]).where((F.col(a0) <= F.col(b1)) & (F.col(b0) <= F.col(a1)))
    # Of the buckets that both touch, the pair counts in the first.
    met = met.where(F.col("__bucket") == F.floor(micros(F.greatest(a0, b0)) / width).cast("long")).drop("__bucket")
    return met.withColumn("overlap_s", (micros(F.least(a1, b1)) - micros(F.greatest(a0, b0))) / 1e6)


def best_overlap(segments: DataFrame, spans: DataFrame, keys: Names, segment_id: str, ends: tuple[str, str], span_ends: tuple[str, str], span_id: str, bucket_s: int | None = None) -> DataFrame:
    """The span that overlaps a segment longest (over 0 s); ties: the shorter, then the earlier."""
    met = overlaps(segments, spans, keys, ends, span_ends, bucket_s).where("overlap_s > 0")
    length = micros(F.col(span_ends[1])) - micros(F.col(span_ends[0]))
    return best_row(met, [*keys, segment_id], [F.col("overlap_s").desc(), length, span_ends[0], span_ends[1], span_id])


def wrappers(df: DataFrame, keys: Names, row_id: str, start: str, end: str, least: int = 2, bucket_s: int | None = None) -> DataFrame:
    """Ids of intervals that strictly hold ``least`` others or more, with their number."""
    outer = df.select(*keys, F.col(row_id).alias("__outer"), F.col(start).alias("__s"), F.col(end).alias("__e"))
    inner = df.select(*keys, F.col(row_id).alias("__inner"), F.col(start).alias("__s2"), F.col(end).alias("__e2"))
    met = overlaps(outer, inner, keys, ("__s", "__e"), ("__s2", "__e2"), bucket_s)
    held = (F.col("__s") <= F.col("__s2")) & (F.col("__e2") <= F.col("__e")) & ((F.col("__s") < F.col("__s2")) | (F.col("__e2") < F.col("__e")))
    counts = met.where((F.col("__outer") != F.col("__inner")) & held).groupBy(*keys, "__outer").agg(F.count(F.lit(1)).alias("held"))
    return counts.where(F.col("held") >= least).withColumnRenamed("__outer", row_id)


def holders(outer: DataFrame, inner: DataFrame, row_id: str, start: str, end: str, least: int = 2) -> DataFrame:
    """J6 without counts: ids of intervals of ``outer``, which are among ``inner``, that strictly hold ``least`` of it or more.

    No pairs are made.  Of the intervals that start with one, or after it, only the ``least`` smallest ends matter: for each start
    they are running minima, back from the last start, within ranges of it, and each range gets those of the ranges after it.
    """
    at = inner.select(F.col(start).alias("__s"), F.col(end).alias("__e")).where("__s IS NOT NULL AND __e IS NOT NULL AND __s <= __e")
    few = at.withColumn("__nth", F.row_number().over(Window.partitionBy("__s").orderBy("__e"))).where(F.col("__nth") <= least).drop("__nth")
    rows = saved(few.repartitionByRange("__s").withColumn("__range", F.spark_partition_id()), "starts")
    w = Window.partitionBy("__range").orderBy(F.col("__s").desc(), "__e")
    lows, rows = [f"__low{i}" for i in range(least)], rows.withColumn("__v", F.col("__e"))
    for low in lows:  # what isn't the least so far, or is displaced by it, stands for the next least
        before = F.min("__v").over(w.rowsBetween(Window.unboundedPreceding, -1))
        rows = rows.withColumn(low, F.min("__v").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__v", F.when(before.isNotNull(), F.greatest("__v", before)))
    starts = saved(rows.groupBy("__range", "__s").agg(F.collect_list("__e").alias("__same"), *[F.min(c).alias(c) for c in lows]), "ends")
    of_range = starts.groupBy("__range").agg(*[F.min(c).alias(c) for c in lows])
    after = F.flatten(F.collect_list(F.array(*lows)).over(Window.orderBy(F.col("__range").desc()).rowsBetween(Window.unboundedPreceding, -1)))  # a row for each range
    carried = of_range.select("__range", F.slice(F.array_sort(F.array_compact(after)), 1, least).alias("__carried"))
    later = F.array(*[F.lag(c).over(Window.partitionBy("__range").orderBy(F.col("__s").desc())) for c in lows])
    known = starts.select("__range", "__s", "__same", F.array_compact(later).alias("__later")).join(F.broadcast(carried), "__range")
    met = outer.join(known, outer[start] == known["__s"])
    count = lambda a, fits: F.size(F.filter(a, fits))
    held = count(F.concat("__later", "__carried"), lambda x: x <= F.col(end)) + count(F.col("__same"), lambda x: x < F.col(end))
    return met.where(held >= least).select(row_id)


def radius_join(points: DataFrame, stations: DataFrame, lat: str, lon: str, s_lat: str, s_lon: str, radius_m: str, most_m: float) -> DataFrame:
    """Every pair of a point and a station within the station's radius, with distance_m.

    Points and stations meet in cells: a station goes to all cells that the box around its circle touches, so the join
    is an equi-join whatever the number of stations.  Cells are ``most_m`` high; a larger radius takes more of them and
    loses nothing.  Within a band of latitudes all cells are equally wide, and a whole number of them goes around, so that
    those on both sides of the antimeridian are neighbours; a band that a circle around a pole reaches is taken whole.

    Places meet circles once, however many points and stations share them; the rows of both come last, so that of the
    result, which may have as many rows as points times stations, nothing is shuffled.
    """
    places = points.select(F.col(lat).alias("__at_lat"), F.col(lon).alias("__at_lon")).distinct()
    circles = stations.select(F.col(s_lat).alias("__at_s_lat"), F.col(s_lon).alias("__at_s_lon"), F.col(radius_m).alias("__at_radius")).distinct()
    near = _met(places, circles, "__at_lat", "__at_lon", "__at_s_lat", "__at_s_lon", "__at_radius", most_m)
    near = near.join(stations, (stations[s_lat] == near["__at_s_lat"]) & (stations[s_lon] == near["__at_s_lon"]) & (stations[radius_m] == near["__at_radius"]))
    near = near.hint("merge")  # a task of the larger side alone would make all rows
    met = points.join(near, (points[lat] == near["__at_lat"]) & (points[lon] == near["__at_lon"]))
    return met.drop("__at_lat", "__at_lon", "__at_s_lat", "__at_s_lon", "__at_radius").select(*points.columns, *stations.columns, "distance_m")


def _met(points: DataFrame, stations: DataFrame, lat: str, lon: str, s_lat: str, s_lon: str, radius_m: str, most_m: float) -> DataFrame:
    """The pairs of :func:`radius_join` as they meet in cells."""
    size = most_m / DEGREE_M
    band = lambda c: F.floor(F.col(c) / size).cast("long")
    # A degree of longitude is shortest at the band's end nearer a pole.
    shrink = lambda b: F.cos(F.radians(F.least(F.lit(89.9), F.greatest(F.abs(b * size), F.abs((b + 1) * size)))))
    around = lambda b: F.greatest(F.lit(1), F.floor(360 * shrink(b) / size)).cast("long")
    turned = lambda c: F.pmod(c + 180.0, F.lit(360.0))
    p = points.withColumn("__row", band(lat))
    p = p.withColumn("__cell", F.least(F.floor(turned(F.col(lon)) / 360 * around(F.col("__row"))).cast("long"), around(F.col("__row")) - 1))
    # The angle that the radius takes, a little more; and how far east or west the circle goes.
    angle = F.col(radius_m) / EARTH_RADIUS_M * 1.000001 + 1e-9
    up = F.degrees(angle)
    wide = F.when(F.abs(F.col(s_lat)) + up >= 89.9, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.least(angle, F.lit(1.5))) / F.cos(F.radians(s_lat))))))
    rows = F.sequence(F.floor(F.greatest(F.lit(-90.0), F.col(s_lat) - up) / size).cast("long"), F.floor(F.least(F.lit(90.0), F.col(s_lat) + up) / size).cast("long"))
    s = stations.where(F.col(radius_m) >= 0).withColumn("__wide", wide).withColumn("__row", F.explode(rows)).withColumn("__n", around(F.col("__row")))
    edge = lambda d: F.floor((F.col(s_lon) + 180.0 + d * F.col("__wide")) / 360 * F.col("__n")).cast("long")
    first, last = edge(-1), F.least(edge(1), edge(-1) + F.col("__n") - 1)
    s = s.withColumn("__cell", F.explode(F.sequence(first, last))).withColumn("__cell", F.pmod("__cell", "__n")).drop("__wide", "__n")
    met = p.join(s, ["__row", "__cell"]).drop("__row", "__cell")
    met = met.withColumn("distance_m", haversine(F.col(lat), F.col(lon), F.col(s_lat), F.col(s_lon)))
    return met.where(F.col("distance_m") <= F.col(radius_m))


def nearest_k(points: DataFrame, stations: DataFrame, point_id: str, station_id: str, lat: str, lon: str, s_lat: str, s_lon: str, k: int, within_m: float) -> DataFrame:
    """The k nearest stations of each point within a distance; ties by id."""
    places = points.select(F.col(lat).alias("__place_lat"), F.col(lon).alias("__place_lon")).distinct()
    # Of the stations at one place the first k may be among a point's nearest, and each place asks once.
    alike = Window.partitionBy(s_lat, s_lon).orderBy(station_id)
    few = stations.withColumn("__nth", F.row_number().over(alike)).where(F.col("__nth") <= k).drop("__nth")
    near = radius_join(places, few.withColumn("__most", F.lit(float(within_m))), "__place_lat", "__place_lon", s_lat, s_lon, "__most", within_m).drop("__most")
    near = near.withColumn("__nth", F.row_number().over(Window.partitionBy("__place_lat", "__place_lon").orderBy("distance_m", station_id))).where(F.col("__nth") <= k).drop("__nth")
    near = points.join(near, (points[lat] == near["__place_lat"]) & (points[lon] == near["__place_lon"])).drop("__place_lat", "__place_lon")
    w = Window.partitionBy(point_id).orderBy("distance_m", station_id)
    return near.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def edges(vertices: DataFrame, keys: Names, pos: str, x: str, y: str) -> DataFrame:
    """A polyline's edges: from each vertex to the next, with the length before it (cum_m)."""
    w = Window.partitionBy(*keys).orderBy(pos)
    nxt = lambda c: F.lead(c).over(w)
    e = vertices.select(*keys, F.col(pos).alias("edge"), F.col(x).alias("ax"), F.col(y).alias("ay"), nxt(x).alias("bx"), nxt(y).alias("by")).where("bx IS NOT NULL")
    e = e.withColumn("edge_m", F.sqrt((F.col("bx") - F.col("ax")) ** 2 + (F.col("by") - F.col("ay")) ** 2))
    before = Window.partitionBy(*keys).orderBy("edge").rowsBetween(Window.unboundedPreceding, -1)
    return e.withColumn("cum_m", F.coalesce(F.sum("edge_m").over(before), F.lit(0.0)))


def at_chainage(line_edges: DataFrame, wanted: DataFrame, keys: Names, chainage: str) -> DataFrame:
    """the place at a distance along a line; beyond its ends, the ends."""
    total = F.max(F.col("cum_m") + F.col("edge_m")).over(Window.partitionBy(*keys))
    last = F.max("edge").over(Window.partitionBy(*keys))
    e = line_edges.withColumn("__total", total).withColumn("__last", last)
    met = wanted.join(e, list(keys))
    d = F.greatest(F.lit(0.0), F.least(F.col(chainage), F.col("__total")))
    inside = (d >= F.col("cum_m")) & ((d < F.col("cum_m") + F.col("edge_m")) | (F.col("edge") == F.col("__last")))
    met = met.where(inside)
    t = F.when(F.col("edge_m") > 0, F.least(F.lit(1.0), (d - F.col("cum_m")) / F.col("edge_m"))).otherwise(F.lit(0.0))
    return met.select(*wanted.columns, (F.col("ax") + t * (F.col("bx") - F.col("ax"))).alias("x"), (F.col("ay") + t * (F.col("by") - F.col("ay"))).alias("y"))


