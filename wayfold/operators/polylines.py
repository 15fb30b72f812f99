"""Lines held as arrays of (lat, lon, cum): the place, and the metres along the line up to there.

A line is one value, so it should be of a size that a row can hold (a route, a trip); tables of
edges (``joins.edges``) serve for longer ones.  All are expressions, evaluated where the row is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions.geo import from_plane, haversine, to_plane

Names = Sequence[str]
PLACES = "array<struct<lat:double,lon:double>>"


def lines(vertices: DataFrame, keys: Names, pos: str, lat: str, lon: str, name: str = "line") -> DataFrame:
    """A line for each key, its vertices by ``pos``."""
    w = Window.partitionBy(*keys).orderBy(pos)
    step = F.coalesce(haversine(F.lag(lat).over(w), F.lag(lon).over(w), F.col(lat), F.col(lon)), F.lit(0.0))
    rows = vertices.withColumn("__step", step).withColumn("__cum", F.sum("__step").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    points = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("pos"), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"), F.col("__cum").alias("cum"))))
    bare = F.transform(points, lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"), p["cum"].alias("cum")))
    return rows.groupBy(*keys).agg(bare.alias(name))


def bound(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once, however often ``body`` refers to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def measured(places: Column) -> Column:
    """A line from places in order."""
    last = lambda acc: F.element_at(acc, -1)

    def grown(acc: Column, p: Column) -> Column:
        step = lambda e: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"), (e["cum"] + haversine(e["lat"], e["lon"], p["lat"], p["lon"])).alias("cum"))
        return F.concat(acc, F.array(bound(last(acc), step)))

    def whole(p: Column) -> Column:
        first = F.transform(F.slice(p, 1, 1), lambda x: F.struct(x["lat"].alias("lat"), x["lon"].alias("lon"), F.lit(0.0).alias("cum")))
        return F.aggregate(_rest(p), first, grown)

    return bound(places, whole)


def _rest(p: Column) -> Column:
    """All but the first."""
    return F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0)))


def length(line: Column) -> Column:
    """Metres; 0 for a line of no vertices."""
    return F.coalesce(F.get(line, F.size(line) - 1)["cum"], F.lit(0.0))


def place_at(line: Column, metres: Column) -> Column:
    """(lat, lon) at a distance along a line; beyond its ends, the ends."""
    here = lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"))

    def between(v: Column) -> Column:
        a, b = v["a"], v["b"]
        share = (v["x"] - a["cum"]) / (b["cum"] - a["cum"])
        within = F.struct((a["lat"] + share * (b["lat"] - a["lat"])).alias("lat"), (a["lon"] + share * (b["lon"] - a["lon"])).alias("lon"))
        return F.when(b["cum"] <= a["cum"], here(b)).otherwise(within)

    def on(v: Column) -> Column:
        own, n = v["line"], F.size(v["line"])
        x = F.greatest(F.lit(0.0), F.least(v["metres"], length(own)))

        def at(u: Column) -> Column:
            before = F.size(F.filter(own, lambda p: p["cum"] <= u))
            i = F.greatest(F.lit(0), F.least(before - 1, n - 2))
            return bound(F.struct(u.alias("x"), F.get(own, i).alias("a"), F.get(own, i + 1).alias("b")), between)

        return F.when(n == 1, here(F.get(own, F.lit(0)))).when(length(own) <= 0, here(F.get(own, n - 1))).otherwise(bound(x, at))

    return bound(F.struct(line.alias("line"), metres.cast("double").alias("metres")), on)


def thinned(places: Column, metres: float) -> Column:
    """Places over ``metres`` from the last one that is kept; the first is kept."""
    far = lambda acc, p: bound(F.element_at(acc, -1), lambda e: haversine(e["lat"], e["lon"], p["lat"], p["lon"])) > metres
    return bound(places, lambda v: F.aggregate(_rest(v), F.slice(v, 1, 1), lambda acc, p: F.when(far(acc, p), F.concat(acc, F.array(p))).otherwise(acc)))


def places(line: Column) -> Column:
    return F.transform(line, lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon")))


def at_least_two(p: Column) -> Column:
    """The places, the only one twice."""
    return bound(p, lambda v: F.when(F.size(v) == 1, F.concat(v, v)).otherwise(v))


def stretch(line: Column, start_m: Column, end_m: Column) -> Column:
    """two distances in order, cut to the line: s and e."""

    def ordered(v: Column) -> Column:
        return F.struct(F.least(v["a"], v["b"]).alias("s"), F.greatest(v["a"], v["b"]).alias("e"))

    clipped = lambda x: F.least(F.greatest(x.cast("double"), F.lit(0.0)), length(line))
    return bound(F.struct(clipped(start_m).alias("a"), clipped(end_m).alias("b")), ordered)


def sub_line(line: Column, start_m: Column, end_m: Column, gap_m: float | None = 0.05) -> Column:
    """the places of a line between two distances, in the line's direction; those strictly within, and both ends.

    Places within ``gap_m`` of the last one are left out; none are where it is None.
    """

    def cut(v: Column) -> Column:
        own = v["line"]
        inside = places(F.filter(own, lambda p: (p["cum"] > v["s"]) & (p["cum"] < v["e"])))
        return F.concat(F.array(place_at(own, v["s"])), inside, F.array(place_at(own, v["e"])))

    def whole(v: Column) -> Column:
        ends = F.concat(F.slice(places(v["line"]), 1, 1), F.slice(places(v["line"]), -1, 1))
        return F.when(length(v["line"]) <= 0, ends).otherwise(cut(v) if gap_m is None else at_least_two(thinned(cut(v), gap_m)))

    def between(v: Column) -> Column:
        at = stretch(v["line"], v["a"], v["b"])
        return bound(bound(at, lambda x: F.struct(v["line"].alias("line"), x["s"].alias("s"), x["e"].alias("e"))), whole)

    return bound(F.struct(line.alias("line"), start_m.cast("double").alias("a"), end_m.cast("double").alias("b")), between)


def nearest_vertex(line: Column, lat: Column, lon: Column) -> Column:
    """The place (from 0) of the vertex nearest to a point, the first of those that tie."""
    away = F.transform(line, lambda p: haversine(lat, lon, p["lat"], p["lon"]))
    return bound(away, lambda v: (F.array_position(v, F.array_min(v)) - 1).cast("int"))


def cropped_to(line: Column, start_lat: Column, start_lon: Column, end_lat: Column, end_lon: Column) -> Column:
    """The places of a line from the vertex nearest to a start to that nearest to an end, backwards if need be."""

    def cut(v: Column) -> Column:
        i, j, p = v["i"], v["j"], v["p"]
        part = F.when(i <= j, F.slice(p, i + 1, j - i + 1)).otherwise(F.reverse(F.slice(p, j + 1, i - j + 1)))
        return bound(part, lambda c: F.when((F.size(p) < 2) | (F.size(c) < 2), p).otherwise(c))

    def found(own: Column) -> Column:
        i, j = nearest_vertex(own, start_lat, start_lon), nearest_vertex(own, end_lat, end_lon)
        return bound(F.struct(i.alias("i"), j.alias("j"), places(own).alias("p")), cut)

    return bound(line, found)


def cropped_line(line: Column, start_lat: Column, start_lon: Column, end_lat: Column, end_lon: Column) -> Column:
    """:func:`cropped_to` as a line: metres are those that the line, or one turned around, has already."""

    def told(c: Column) -> Column:
        return F.transform(c, lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"), F.abs(p["cum"] - F.get(c, F.lit(0))["cum"]).alias("cum")))

    def cut(v: Column) -> Column:
        i, j, own = v["i"], v["j"], v["own"]
        part = F.when(i <= j, F.slice(own, i + 1, j - i + 1)).otherwise(F.reverse(F.slice(own, j + 1, i - j + 1)))
        return bound(bound(part, lambda c: F.when((F.size(own) < 2) | (F.size(c) < 2), own).otherwise(c)), told)

    def found(own: Column) -> Column:
        i, j = nearest_vertex(own, start_lat, start_lon), nearest_vertex(own, end_lat, end_lon)
        return bound(F.struct(i.alias("i"), j.alias("j"), own.alias("own")), cut)

    return bound(line, found)


def projected(line: Column, lat: Column, lon: Column) -> Column:
    """The nearest place on a line: distance_m, edge, chainage_m, lat, lon; the first edge wins ties."""

    def on(v: Column, i: Column) -> Column:
        def met(e: Column) -> Column:
            a, b = e["a"], e["b"]
            (px, py), (ax, ay), (bx, by) = (to_plane(y, x, e["lat0"], e["lon0"]) for y, x in ((v["lat"], v["lon"]), (a["lat"], a["lon"]), (b["lat"], b["lon"])))
            plane = F.struct(*[c.alias(n) for n, c in (("px", px), ("py", py), ("ax", ax), ("ay", ay), ("dx", bx - ax), ("dy", by - ay), ("lat0", e["lat0"]), ("lon0", e["lon0"]), ("cum", a["cum"]))])
            return bound(plane, share)

        def share(e: Column) -> Column:
            square = e["dx"] * e["dx"] + e["dy"] * e["dy"]
            t = F.when(square <= 1e-12, F.lit(0.0)).otherwise(((e["px"] - e["ax"]) * e["dx"] + (e["py"] - e["ay"]) * e["dy"]) / square)
            return bound(F.struct(e.alias("e"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)).alias("t")), place)

        def place(u: Column) -> Column:
            e, t = u["e"], u["t"]
            x, y = e["ax"] + t * e["dx"], e["ay"] + t * e["dy"]
            at_lat, at_lon = from_plane(x, y, e["lat0"], e["lon0"])
            return F.struct(F.hypot(e["px"] - x, e["py"] - y).alias("distance_m"), i.alias("edge"), (e["cum"] + t * F.hypot(e["dx"], e["dy"])).alias("chainage_m"), at_lat.alias("lat"), at_lon.alias("lon"))

        a, b = F.get(v["line"], i), F.get(v["line"], i + 1)
        mid = F.struct(a.alias("a"), b.alias("b"), ((a["lat"] + b["lat"] + v["lat"]) / 3).alias("lat0"), ((a["lon"] + b["lon"] + v["lon"]) / 3).alias("lon0"))
        return bound(mid, met)

    def nearest(v: Column) -> Column:
        only, n = F.get(v["line"], F.lit(0)), F.size(v["line"])
        alone = F.struct(haversine(v["lat"], v["lon"], only["lat"], only["lon"]).alias("distance_m"), F.lit(0).alias("edge"), F.lit(0.0).alias("chainage_m"), only["lat"].alias("lat"), only["lon"].alias("lon"))
        return F.when(n == 1, alone).when(n > 1, F.array_min(F.transform(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), lambda i: on(v, i))))

    return bound(F.struct(line.alias("line"), lat.cast("double").alias("lat"), lon.cast("double").alias("lon")), nearest)


def box(line: Column) -> Column:
    """The box around a line: south, west, north, east."""
    lat, lon = F.transform(line, lambda p: p["lat"]), F.transform(line, lambda p: p["lon"])
    return F.struct(F.array_min(lat).alias("south"), F.array_min(lon).alias("west"), F.array_max(lat).alias("north"), F.array_max(lon).alias("east"))


def aligned(line: Column, start_lat: Column, start_lon: Column, end_lat: Column, end_lon: Column) -> Column:
    """Whether a line runs against a start and an end (by over 1e-6 m), and how far its ends are: start_m, end_m, score_m."""
    d = lambda y, x, p: haversine(y, x, p["lat"], p["lon"])

    def chosen(v: Column) -> Column:
        one = lambda back, a, b: F.struct(F.lit(back).alias("reversed"), a.alias("start_m"), b.alias("end_m"), (a + b).alias("score_m"))
        return F.when(v["c"] + v["e"] + 1e-6 < v["a"] + v["b"], one(True, v["c"], v["e"])).otherwise(one(False, v["a"], v["b"]))

    def ends(own: Column) -> Column:
        first, last = F.get(own, F.lit(0)), F.get(own, F.size(own) - 1)
        far = F.struct(d(start_lat, start_lon, first).alias("a"), d(end_lat, end_lon, last).alias("b"), d(start_lat, start_lon, last).alias("c"), d(end_lat, end_lon, first).alias("e"))
        return F.when(F.size(own) > 0, bound(far, chosen))

    return bound(line, ends)


def ends_aligned(first: tuple[Column, Column], last: tuple[Column, Column], start_lat: Column, start_lon: Column, end_lat: Column, end_lon: Column) -> Column:
    """:func:`aligned` from a line's two ends (lat, lon) alone: reversed and score_m."""
    along = haversine(start_lat, start_lon, *first) + haversine(end_lat, end_lon, *last)
    against = haversine(start_lat, start_lon, *last) + haversine(end_lat, end_lon, *first)
    turned = against + 1e-6 < along
    return F.struct(turned.alias("reversed"), F.when(turned, against).otherwise(along).alias("score_m"))
