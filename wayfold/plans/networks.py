"""Queries of rail networks and of stations that passes are held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold.functions import geo
from wayfold.operators import aggregates as A
from wayfold.operators import graph as G
from wayfold.operators import polylines as L
from wayfold.operators import rail as R
from wayfold.operators import stations as T
from wayfold.plans.adapters import PTS, TRK, hav, pts, table, trk

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _one_of(values, i):
    return F.get(F.array(*[F.lit(x) for x in values]), i.cast("int"))


SHAPES = f"""sv AS (SELECT s_suppkey AS sid, j, 52.3::DOUBLE + (s_suppkey * 6007 % 1000) / 2500.0::DOUBLE + 0.004::DOUBLE * j AS lat, 13.1::DOUBLE + (s_suppkey * 50021 % 1000) / 1500.0::DOUBLE + 0.006::DOUBLE * j + 0.001::DOUBLE * (j * j % 3) AS lon FROM supplier, range(4) r(j)),
 ss AS (SELECT *, CASE WHEN lag(lat) OVER w IS NULL THEN 0 ELSE {hav('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} END AS step FROM sv WINDOW w AS (PARTITION BY sid ORDER BY j)), sc AS (SELECT *, sum(step) OVER (PARTITION BY sid ORDER BY j) AS cum FROM ss),
 se AS (SELECT *, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM sc WINDOW w AS (PARTITION BY sid ORDER BY j)), sb AS (SELECT sid, CASE sid % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 END AS type, min(lat) AS s, max(lat) AS n, min(lon) AS w, max(lon) AS e FROM sv GROUP BY sid)"""


def _shapes(spark, d):
    k, j = F.col("s_suppkey"), F.col("j")
    v = table(spark, d, "supplier").select("s_suppkey", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("j"))
    v = v.select(k.alias("shape_id"), "j", (52.3 + (k * 6007 % 1000) / 2500.0 + 0.004 * j).alias("lat"), (13.1 + (k * 50021 % 1000) / 1500.0 + 0.006 * j + 0.001 * (j * j % 3)).alias("lon"))
    out = L.lines(v, ["shape_id"], "j", "lat", "lon")
    return out.withColumn("route_type", F.when(F.col("shape_id") % 3 == 0, 1).when(F.col("shape_id") % 3 == 1, 2)).withColumn("box", L.box(F.col("line")))


def _projection(y: str, x: str, key: str, source: str, name: str) -> str:
    """SQL: for pairs (key, sid) of ``source`` with a point, its nearest place on the shape."""
    return f"""{name}0 AS (SELECT q.*, se.j, se.cum, ({x} - (se.lon + se.lon2 + {x}) / 3) * k AS px, ({y} - (se.lat + se.lat2 + {y}) / 3) * 111320 AS py, (se.lon - (se.lon + se.lon2 + {x}) / 3) * k AS ax, (se.lat - (se.lat + se.lat2 + {y}) / 3) * 111320 AS ay, (se.lon2 - (se.lon + se.lon2 + {x}) / 3) * k AS bx, (se.lat2 - (se.lat + se.lat2 + {y}) / 3) * 111320 AS by_,
 (se.lat + se.lat2 + {y}) / 3 AS la0, (se.lon + se.lon2 + {x}) / 3 AS lo0, k FROM (SELECT q0.*, sid AS s_ FROM {source} q0) q JOIN (SELECT *, 0 AS z FROM se WHERE lat2 IS NOT NULL) se ON se.sid = q.s_, LATERAL (SELECT 111320 * cos(radians((se.lat + se.lat2 + {y}) / 3)) AS k)),
 {name}1 AS (SELECT *, greatest(0, least(1, ((px - ax) * (bx - ax) + (py - ay) * (by_ - ay)) / (pow(bx - ax, 2) + pow(by_ - ay, 2)))) AS t FROM {name}0), {name}2 AS (SELECT *, sqrt(pow(px - ax - t * (bx - ax), 2) + pow(py - ay - t * (by_ - ay), 2)) AS dist, cum + t * sqrt(pow(bx - ax, 2) + pow(by_ - ay, 2)) AS ch FROM {name}1),
 {name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key}, sid ORDER BY dist, j) AS rn FROM {name}2) WHERE rn = 1)"""


def _box(y: str, x: str) -> str:
    return hav(y, x, f"CASE WHEN {y} < s THEN s WHEN {y} > n THEN n ELSE {y} END", f"CASE WHEN {x} < w THEN w WHEN {x} > e THEN e ELSE {x} END")


PIECES = f"""{PTS}, pc AS (SELECT id, lat AS y1, lon AS x1, lat + 0.008 * (1 - 2 * (id % 2))::DOUBLE AS y2, lon + 0.012 * (1 - 2 * (id % 2))::DOUBLE AS x2, CASE id % 3 WHEN 0 THEN 'IN_SUBWAY' WHEN 1 THEN 'IN_TRAIN' ELSE 'IN_BUS' END AS mode FROM pts)"""


def _match_sql(ends: float, mean: float, cap: float, most: int) -> str:
    return f"""WITH {SHAPES}, {PIECES}, cd AS (SELECT pc.*, sid, type, {_box('y1', 'x1')} AS b1, {_box('y2', 'x2')} AS b2 FROM pc CROSS JOIN sb), nr AS (SELECT *, CASE WHEN type IS NULL THEN true WHEN mode = 'IN_SUBWAY' THEN type = 1 ELSE type = 2 END AS fits FROM cd WHERE b1 <= {4 * ends} AND b2 <= {4 * ends}),
 {_projection('q.y1', 'q.x1', 'id', 'nr', 'p')}, {_projection('q.y2', 'q.x2', 'id', 'nr', 'r')},
 m AS (SELECT p.id, p.sid, p.fits, p.b1 + p.b2 AS boxes, p.dist AS d1, r.dist AS d2, p.ch AS c1, r.ch AS c2 FROM p JOIN r ON r.id = p.id AND r.sid = p.sid),
 sx AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY boxes, sid) AS nth, row_number() OVER (PARTITION BY id, fits ORDER BY boxes, sid) AS fnth FROM m), ok AS (SELECT *, (least(d1, {cap}) + least(d2, {cap})) / 2 + CASE WHEN c2 + 60 < c1 THEN 200 ELSE 0 END AS score FROM sx WHERE d1 <= {ends} AND d2 <= {ends} AND (d1 + d2) / 2 <= {mean}),
 st AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score, fnth) AS rn FROM ok WHERE fits AND fnth <= {most} QUALIFY rn = 1), sf AS (SELECT * FROM st WHERE abs(c2 - c1) > 0.5), rx AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score, nth) AS rn FROM ok WHERE nth <= {most} AND id NOT IN (SELECT id FROM sf) QUALIFY rn = 1), rf AS (SELECT * FROM rx WHERE abs(c2 - c1) > 0.5)"""


@query(_match_sql(900, 700, 1200, 180) + " SELECT id, sid AS shape_id, round(score, 3) AS score FROM sf")
def shape_match(spark, d):
    """Trips on the shapes that fit them best, by boxes, projections and steps back."""
    p = _pieces(spark, d)
    return R.matched_shapes(p, _shapes(spark, d), ["id"], **R.WHOLE).select("id", "shape_id", F.round("score", 3).alias("score"))


@query(_match_sql(1800, 1400, 2200, 300) + " SELECT id, sid AS shape_id, round(score, 3) AS score, 'gtfs_rail_shape_' || sid || '::pairwise_mode' AS method FROM sf UNION ALL SELECT id, sid, round(score, 3), 'gtfs_rail_shape_' || sid || '::pairwise_relaxed' FROM rf")
def piece_match(spark, d):
    """Pieces on shapes of their mode, else on any."""
    return R.matched_pieces(_pieces(spark, d), _shapes(spark, d), ["id"]).select("id", "shape_id", F.round("score", 3).alias("score"), "method")


def _pieces(spark, d):
    way = 1 - 2 * (F.col("id") % 2)
    place = lambda y, x: F.struct(y.alias("lat"), x.alias("lon"))
    points = F.array(place(F.col("lat"), F.col("lon")), place(F.col("lat") + 0.008 * way, F.col("lon") + 0.012 * way))
    return pts(spark, d).select("id", points.alias("points"), F.when(F.col("id") % 3 == 0, "IN_SUBWAY").when(F.col("id") % 3 == 1, "IN_TRAIN").otherwise("IN_BUS").alias("mode"))


@query(f"""WITH {PIECES}, w AS MATERIALIZED (SELECT id, 'gtfs_rail_shape_' || sid AS method FROM ({_match_sql(900, 700, 1200, 180)} SELECT id, sid FROM sf)), p AS MATERIALIZED (SELECT * FROM ({_match_sql(1800, 1400, 2200, 300)} SELECT id, 'gtfs_rail_shape_' || sid || '::pairwise_mode' AS method FROM sf UNION ALL SELECT id, 'gtfs_rail_shape_' || sid || '::pairwise_relaxed' FROM rf))
 SELECT pc.id, CASE WHEN mode = 'IN_BUS' THEN 'timeline_polyline_no_route_match' ELSE coalesce(w.method, p.method, 'direct_polyline') END AS method, round(CASE WHEN mode = 'IN_BUS' OR coalesce(w.method, p.method) IS NULL THEN {hav('y1', 'x1', 'y2', 'x2')} END, 3) AS straight_m FROM pc LEFT JOIN w ON w.id = pc.id LEFT JOIN p ON p.id = pc.id""")
def rail_baselines(spark, d):
    """Trains without a known route along the shape that fits the whole trip, or piece by piece."""
    t = _pieces(spark, d)
    line = L.measured(F.col("points"))
    paths = t.withColumn("line", line).withColumn("distance_m", L.length(line)).withColumn("method", F.lit("timeline_polyline_no_route_match"))
    out = R.rail_baselines(paths, _shapes(spark, d), ["id"])
    straight = F.col("method").isin("timeline_polyline_no_route_match", "direct_polyline")
    return out.select("id", "method", F.when(straight, F.round("distance_m", 3)).alias("straight_m"))


@query(f"""WITH {SHAPES}, {PTS}, tk AS (SELECT id, lat AS y1, lon AS x1, CASE WHEN id % 4 = 0 THEN 'WALKING' ELSE 'in_tram' END AS mode, CASE WHEN id % 5 = 0 THEN 'osrm' ELSE 'direct_polyline' END AS pm, (id % 9) / 10.0::DOUBLE AS cs FROM pts), c AS (SELECT tk.*, sid, {_box('y1', 'x1')} AS b1 FROM tk CROSS JOIN sb WHERE id % 4 <> 0 AND id % 5 <> 0),
 b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY b1, sid) AS rk FROM c WHERE b1 <= 6000) WHERE rk = 1), {_projection('q.y1', 'q.x1', 'id', 'b', 'p')}, h AS (SELECT id, la0 + (ay + t * (by_ - ay)) / 111320 AS la, lo0 + (ax + t * (bx - ax)) / k AS lo FROM p WHERE dist <= 1500)
 SELECT tk.id, round(coalesce(la, y1), 6) AS lat, round(coalesce(lo, x1), 6) AS lon, CASE WHEN la IS NOT NULL THEN pm || '::corridor_snap' ELSE pm END AS path_method, CASE WHEN la IS NOT NULL THEN 'rail_corridor_snap' ELSE 'x' END AS position_source, CASE WHEN la IS NOT NULL THEN greatest(cs, 0.58) ELSE cs END AS confidence_score FROM tk LEFT JOIN h USING (id)""")
def corridor_snap(spark, d):
    """Direct rail positions on the shape with the nearest box."""
    k = F.col("id")
    t = pts(spark, d).select("id", "lat", "lon", F.when(k % 4 == 0, "WALKING").otherwise("in_tram").alias("mode"), F.when(k % 5 == 0, "osrm").otherwise("direct_polyline").alias("path_method"), F.lit("x").alias("position_source"), F.lit("low").alias("confidence_label"), ((k % 9) / 10.0).alias("confidence_score"))
    out = R.snapped_to_corridors(t, _shapes(spark, d), "id")
    return out.select("id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "path_method", "position_source", "confidence_score")


@query(f"""WITH RECURSIVE {PTS}, sn AS (SELECT CAST(n_nationkey AS BIGINT) AS k, 52.3::DOUBLE + 0.08::DOUBLE * (n_nationkey % 5) AS lat, 13.1::DOUBLE + 0.13::DOUBLE * (n_nationkey // 5) AS lon FROM nation), ed AS (SELECT k AS src, (k + 1) % 25 AS dst, 100.0::DOUBLE + 10 * k AS w FROM sn WHERE k <> 12 UNION ALL SELECT k, (k + 7) % 25, 450.0::DOUBLE + 3 * k FROM sn WHERE k % 3 = 0),
 bo AS (SELECT src, dst, w FROM ed UNION ALL SELECT dst, src, w FROM ed), pa AS (SELECT k AS source, k AS node, 0.0::DOUBLE AS d, 0 AS hops FROM sn UNION SELECT source, node, d, hops FROM (SELECT pa.source, bo.dst AS node, min(pa.d + bo.w) AS d, min(pa.hops + 1) AS hops FROM pa JOIN bo ON pa.node = bo.src WHERE pa.hops < 24 GROUP BY pa.source, bo.dst)), sp AS (SELECT source, node, min(d) AS d FROM pa GROUP BY ALL),
 tp AS (SELECT id, lat AS y1, lon AS x1, 52.3::DOUBLE + (id * 31 % 400) / 1000.0::DOUBLE AS y2, 13.1::DOUBLE + (id * 17 % 600) / 1000.0::DOUBLE AS x2 FROM pts), a AS (SELECT * FROM (SELECT id, k, {hav('y1', 'x1', 'sn.lat', 'sn.lon')} AS m, row_number() OVER (PARTITION BY id ORDER BY {hav('y1', 'x1', 'sn.lat', 'sn.lon')}, k) AS rn FROM tp CROSS JOIN sn WHERE {hav('y1', 'x1', 'sn.lat', 'sn.lon')} <= 9000) WHERE rn <= 4),
 b AS (SELECT * FROM (SELECT id, k, {hav('y2', 'x2', 'sn.lat', 'sn.lon')} AS m, row_number() OVER (PARTITION BY id ORDER BY {hav('y2', 'x2', 'sn.lat', 'sn.lon')}, k) AS rn FROM tp CROSS JOIN sn WHERE {hav('y2', 'x2', 'sn.lat', 'sn.lon')} <= 9000) WHERE rn <= 4),
 z AS (SELECT a.id, a.k AS s, b.k AS e, d, a.m + d + b.m AS cost, row_number() OVER (PARTITION BY a.id ORDER BY a.m + d + b.m, a.k, b.k) AS rn FROM a JOIN b ON a.id = b.id AND a.k <> b.k JOIN sp ON sp.source = a.k AND sp.node = b.k) SELECT id, s AS start_station, e AS end_station, round(d, 3) AS station_path_m, round(cost, 3) AS cost_m FROM z WHERE rn = 1""")
def station_path(spark, d):
    """The stations between which trips are shortest, over edges that go with the mode."""
    k = F.col("n_nationkey").cast("long")
    n = table(spark, d, "nation").select(k.alias("station"), (52.3 + 0.08 * (k % 5)).alias("lat"), (13.1 + 0.13 * F.floor(k / 5)).alias("lon"))
    s = F.col("station")
    types = lambda *t: F.array(*[F.lit(x) for x in t]).cast("array<int>")
    ring = n.select(s.alias("src"), ((s + 1) % 25).alias("dst"), (100.0 + 10 * s).alias("weight_m"), F.when(s == 12, types(3)).when(s % 2 == 0, types()).otherwise(types(3, 1)).alias("route_types"))
    chord = n.where("station % 3 = 0").select(s.alias("src"), ((s + 7) % 25).alias("dst"), (450.0 + 3 * s).alias("weight_m"), types(109).alias("route_types"))
    i = F.col("id")
    trips = pts(spark, d).select("id", F.col("lat").alias("start_lat"), F.col("lon").alias("start_lon"), (52.3 + (i * 31 % 400) / 1000.0).alias("end_lat"), (13.1 + (i * 17 % 600) / 1000.0).alias("end_lon"))
    out = R.station_paths(trips, n, ring.union(chord), "IN_SUBWAY", ["id"], 4, 9000.0)
    return out.select("id", "start_station", "end_station", F.round("station_path_m", 3).alias("station_path_m"), F.round("cost_m", 3).alias("cost_m"))


COMPARED = f"""{TRK}, x AS (SELECT 's' || k % 3 AS sid, log_id AS pass, date_trunc('hour', ts) AS hr, ts, CASE WHEN fix_id % 4 <> 0 THEN v END AS mob, CASE WHEN fix_id % 5 <> 0 THEN CAST(k AS DOUBLE) / 2 END AS sta FROM trk WHERE k % 3 < 2),
 ps AS (SELECT sid, pass, hr, min(ts) AS t, avg(mob) AS m, avg(sta) AS s, count(mob) AS n FROM x WHERE mob IS NOT NULL GROUP BY ALL HAVING avg(sta) IS NOT NULL), ax AS (SELECT sid, least(min(m), min(s)) AS lo, greatest(max(m), max(s)) AS hi, min(m) AS a, max(m) AS b, min(s) AS c, max(s) AS d FROM ps GROUP BY sid)"""


def _matched(spark, d):
    t, k = trk(spark, d), F.col("k")
    value = F.replace(F.col("v").cast("string"), F.lit("."), F.lit("."))
    half = F.when(F.col("fix_id") % 5 != 0, (k.cast("double") / 2).cast("string")).otherwise("n/a")
    return t.select(
        F.concat(F.lit("s"), k % 3).alias("station_id"), F.lit("").alias("station_label"), F.date_trunc("hour", "ts").cast("string").alias("station_hour_local"), F.col("log_id").alias("pass_id"), F.col("ts").cast("string").alias("mobile_timestamp_local"),
        F.when(F.col("fix_id") % 4 != 0, value).alias("mobile_aq__pm2_5_count"), F.when(F.col("fix_id") % 9 == 0, value).alias("pm2_5_count"), half.alias("s0__feinstaub_pm2_5"), half.alias("S1__PM25"), half.alias("s2__ozon"))


def _compared(spark, d):
    return T.compared(_matched(spark, d), "PM2.5", ["s0", "s1", "s2", "s3"])


@query(f"""WITH {COMPARED}, pd AS (SELECT *, CASE WHEN lo = hi THEN greatest(1, 0.1 * abs(lo)) ELSE 0.05 * (hi - lo) END AS pad, CASE WHEN a = b THEN greatest(abs(a) * 0.05, 1) ELSE 0 END AS w FROM ax)
 SELECT ps.sid AS station_id, ps.sid AS station_label, pass AS pass_id, hr AS station_hour, t AS pass_timestamp, round(m, 6) AS mobile_value, round(s, 6) AS station_value, n AS mobile_points, 'mobile_aq__pm2_5_count' AS mobile_column, CASE ps.sid WHEN 's0' THEN 's0__feinstaub_pm2_5' ELSE 'S1__PM25' END AS station_column, round(lo - pad, 6) AS axis_low, round(hi + pad, 6) AS axis_high,
 round(c + (m - (a - w)) / ((b + w) - (a - w)) * (d - c), 6) AS mobile_scaled FROM ps JOIN pd USING (sid)""")
def station_comparison(spark, d):
    """Passes held against stations."""
    out = _compared(spark, d)
    rounded = ("mobile_value", "station_value", "axis_low", "axis_high", "mobile_scaled")
    return out.select(*[F.round(c, 6).alias(c) if c in rounded else F.col(c) for c in out.columns])


@query(f"WITH {COMPARED} SELECT sid AS station_id, CAST(t AS DATE) + INTERVAL 12 HOUR AS pass_timestamp, round(avg(s), 6) AS station_daily_mean, round(avg(m), 6) AS mobile_daily_mean, count(*) AS n_passes FROM ps WHERE t >= TIMESTAMP '2024-01-05 00:00:00' AND t <= TIMESTAMP '2024-01-20 23:59:59' GROUP BY sid, CAST(t AS DATE)")
def station_days(spark, d):
    """Daily means of the passes of some days."""
    rows = _compared(spark, d).where(T.in_days(F.col("pass_timestamp"), "2024-01-05", "2024-01-20"))
    return T.daily(rows).select("station_id", "pass_timestamp", F.round("station_daily_mean", 6).alias("station_daily_mean"), F.round("mobile_daily_mean", 6).alias("mobile_daily_mean"), "n_passes")


@query(f"WITH {COMPARED} SELECT sid AS station_id, sid AS station_label, 'mobile_aq__pm2_5_count' AS mobile_column, CASE sid WHEN 's0' THEN 's0__feinstaub_pm2_5' ELSE 'S1__PM25' END AS station_columns, count(*) AS compared_passes, 'pm2.5' AS plot_type FROM ps GROUP BY sid")
def station_manifest(spark, d):
    """C14, K9: what was compared."""
    return T.compared_manifest(_compared(spark, d), "PM2.5")


@query(f"""WITH {TRK} SELECT log_id AS pass_id, date_trunc('hour', ts) AS hour, min(ts) AS pass_ts, round(avg(v), 6) AS mobile_mean, round(avg(CAST(k AS DOUBLE)), 6) AS s0, round(avg(CASE WHEN k % 2 = 0 THEN k * 2.0::DOUBLE END), 6) AS s1, count(*) AS mobile_points FROM trk GROUP BY ALL""")
def many_stations(spark, d):
    """A1, A2: passes in an hour across several station columns, of which one isn't always finite."""
    t = trk(spark, d).withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz")).withColumn("s0", F.col("k").cast("double")).withColumn("s1", F.when(F.col("k") % 2 == 0, F.col("k") * 2.0).when(F.col("k") % 3 == 0, F.lit(float("inf"))))
    out = A.passes(t.withColumnRenamed("log_id", "pass_id"), ["pass_id"], "ts", "hour", "v", ["s0", "s1"])
    return out.select("pass_id", "hour", "pass_ts", *[F.round(c, 6).alias(c) for c in ("mobile_mean", "s0", "s1")], "mobile_points")


@query(f"""WITH {TRK}, g AS (SELECT log_id, min(v) AS a, max(v) AS b, min(k) AS x0, max(k) AS x1, count(*) AS n FROM trk GROUP BY log_id), c AS (SELECT *, CASE WHEN abs(b - a) <= 1.5e-8 * abs(a) THEN greatest(1, 0.1 * abs(a)) ELSE 0.05 * (b - a) END AS pad, CASE WHEN x1 > x0 THEN 0 ELSE 0.5 END AS hx, CASE WHEN b > a THEN 0 ELSE 0.5 END AS hy FROM g)
 SELECT log_id, round(a - pad, 6) AS low, round(b + pad, 6) AS high, round(x0 - hx - greatest((x1 - x0 + 2 * hx) * 0.08, 1), 6) AS x_low, round(x1 + hx + greatest((x1 - x0 + 2 * hx) * 0.08, 1), 6) AS x_high, round(a - hy - greatest((b - a + 2 * hy) * 0.08, 1), 6) AS y_low, round(b + hy + greatest((b - a + 2 * hy) * 0.08, 1), 6) AS y_high FROM c""")
def padded_limits(spark, d):
    """limits of axes and of maps."""
    t = trk(spark, d)
    out = A.padded_limits(t, ["log_id"], ["v"]).join(A.padded_box(t, ["log_id"], ["k"], ["v"]), "log_id")
    return out.select("log_id", *[F.round(c, 6).alias(c) for c in out.columns if c != "log_id"])


@query(f"""WITH {PTS}, b AS (SELECT id, lat AS s, lon AS w, lat + (id % 50 + 1) / 400.0::DOUBLE AS n, lon + (id % 20) / 90.0::DOUBLE AS e FROM pts), m AS (SELECT *, greatest(6378137.0 * radians(e - w), 6378137.0 * (ln(tan(pi() / 4 + radians(n) / 2)) - ln(tan(pi() / 4 + radians(s) / 2)))) AS span FROM b)
 SELECT id, CAST(least(19, greatest(1, floor(log2(156543.03392804097 * cos(radians((s + n) / 2)) * 1600 / span)))) AS INTEGER) AS zoom FROM m""")
def tile_zoom(spark, d):
    """F43, F34."""
    k = F.col("id")
    return pts(spark, d).select("id", geo.tile_zoom(F.col("lat"), F.col("lon"), F.col("lat") + (k % 50 + 1) / 400.0, F.col("lon") + (k % 20) / 90.0, 1600).alias("zoom"))


@query(f"WITH {PTS} SELECT id % 25 AS grp, CASE WHEN id % 25 % 3 = 1 THEN 32633 ELSE 4326 END AS epsg FROM pts GROUP BY id % 25")
def reference_systems(spark, d):
    """Groups of points in degrees, and in metres of UTM zone 33."""
    p = pts(spark, d).withColumn("grp", F.col("id") % 25)
    x, y = geo.utm(F.col("lat"), F.col("lon"), 33)
    metres = F.col("grp") % 3 == 1
    p = p.select("grp", "id", F.when(metres, y).otherwise(F.col("lat")).alias("north"), F.when(metres, x).otherwise(F.col("lon")).alias("east"))
    return T.reference_system(p, ["grp"], "north", "east", ["id"]).select("grp", "epsg")


@query(f"WITH {PTS} SELECT id, round(lat, 6) AS lat, round(lon, 6) AS lon, round(lat, 6) AS m_lat, round(lon, 6) AS m_lon FROM pts")
def map_round_trip(spark, d):
    """to UTM and to web Mercator, and back."""
    u, m = geo.utm(F.col("lat"), F.col("lon"), 33), geo.web_mercator(F.col("lat"), F.col("lon"))
    a, b = geo.from_utm(*u, 33), geo.from_web_mercator(*m)
    return pts(spark, d).select("id", *[F.round(c, 6).alias(n) for c, n in zip((*a, *b), ("lat", "lon", "m_lat", "m_lon"), strict=True)])


SUPPLY = """ed AS (SELECT 2 * c_custkey AS src, 2 * (1 + (c_custkey * m + c_custkey // 10) % (SELECT count(*) FROM supplier)) + 1 AS dst, 100.0::DOUBLE + (c_custkey * 31 * m + 7) % 900 AS w FROM customer, (VALUES (7), (13), (29)) v(m)),
 bo AS (SELECT src, dst, min(w) AS w FROM (SELECT src, dst, w FROM ed UNION ALL SELECT dst, src, w FROM ed) GROUP BY ALL), pr AS (SELECT 2 * min(c_custkey) AS source, 2 * max(c_custkey) AS target FROM customer GROUP BY c_nationkey)"""


@query(f"""WITH RECURSIVE {SUPPLY}, pa AS (SELECT DISTINCT source, source AS node, 0.0::DOUBLE AS d, 0 AS hops FROM pr UNION ALL SELECT source, node, d, hops FROM (SELECT pa.source, bo.dst AS node, min(pa.d + bo.w) AS d, min(pa.hops) + 1 AS hops FROM pa JOIN bo ON pa.node = bo.src WHERE pa.hops < 16 GROUP BY pa.source, bo.dst))
 SELECT pr.source, pr.target, round(min(d), 3) AS distance FROM pr JOIN pa ON pa.source = pr.source AND pa.node = pr.target GROUP BY ALL""")
def pair_paths(spark, d):
    """The shortest ways over suppliers between the first and the last customer of each nation."""
    k, n = F.col("c_custkey"), table(spark, d, "supplier").count()
    own = table(spark, d, "customer").select("c_custkey", "c_nationkey").withColumn("m", F.explode(F.array(F.lit(7), F.lit(13), F.lit(29))))
    m = F.col("m")
    edges = own.select((2 * k).alias("src"), (2 * (1 + (k * m + F.floor(k / 10)) % n) + 1).alias("dst"), (100.0 + (k * 31 * m + 7) % 900).alias("weight_m"))
    pairs = own.groupBy("c_nationkey").agg((2 * F.min("c_custkey")).alias("source"), (2 * F.max("c_custkey")).alias("target"))
    return G.pair_paths(edges, pairs).select("source", "target", F.round("distance", 3).alias("distance"))
