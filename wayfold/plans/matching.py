"""Queries of joins, aggregates, reshaping and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold.functions import geo
from wayfold.operators import aggregates as A
from wayfold.operators import graph
from wayfold.operators import joins as J
from wayfold.operators import sequences as S
from wayfold.plans.adapters import PLANE, PTS, SEG, SIG, STN, TRK, hav, plane, pts, seg, sig, stn, table, trk
from wayfold.plans.tracks import POS, SEGS, SESSION_SQL, _pairs, placed, sessions

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


NEAR = f"{PTS}, {STN}, near AS (SELECT id, station_id, radius_m, {hav('lat', 'lon', 's_lat', 's_lon')} AS m FROM pts CROSS JOIN stn)"


@query(f"WITH {NEAR} SELECT id, station_id, round(m, 4) AS distance_m FROM near WHERE m <= radius_m")
def radius_join(spark, d):
    """J4, F1."""
    out = J.radius_join(pts(spark, d), stn(spark, d), "lat", "lon", "s_lat", "s_lon", "radius_m", 3000.0)
    return out.select("id", "station_id", F.round("distance_m", 4).alias("distance_m"))


@query(f"WITH {NEAR}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY m, station_id) AS rank FROM near WHERE m <= 5000) SELECT id, CAST(rank AS BIGINT) AS rank, station_id, round(m, 4) AS distance_m FROM r WHERE rank <= 4")
def nearest_station(spark, d):
    """J19, O3."""
    out = J.nearest_k(pts(spark, d), stn(spark, d), "id", "station_id", "lat", "lon", "s_lat", "s_lon", 4, 5000.0)
    return out.select("id", "rank", "station_id", F.round("distance_m", 4).alias("distance_m"))


ASOF = f"""{TRK}, h AS (SELECT *, date_trunc('hour', ts) AS th FROM trk), l AS (SELECT * FROM h WHERE fix_id % 2 = 0), r AS (SELECT * FROM h WHERE fix_id % 2 = 1),
 rb AS (SELECT log_id, th, max(fix_id) AS rid, arg_max(v, fix_id) AS rv FROM r GROUP BY ALL), rf AS (SELECT log_id, th, min(fix_id) AS rid, arg_min(v, fix_id) AS rv FROM r GROUP BY ALL),
 b AS (SELECT l.log_id, l.fix_id, (epoch_us(l.th) - epoch_us(rb.th)) / 1e6 AS db, rb.rv AS vb, rb.rid AS ib FROM l ASOF LEFT JOIN rb ON l.log_id = rb.log_id AND l.th >= rb.th),
 f AS (SELECT l.log_id, l.fix_id, (epoch_us(rf.th) - epoch_us(l.th)) / 1e6 AS df, rf.rv AS vf, rf.rid AS if_ FROM l ASOF LEFT JOIN rf ON l.log_id = rf.log_id AND l.th <= rf.th),
 j AS (SELECT b.log_id, b.fix_id, CASE WHEN db IS NOT NULL AND (df IS NULL OR db <= df) THEN db ELSE df END AS delta_s, CASE WHEN db IS NOT NULL AND (df IS NULL OR db <= df) THEN vb ELSE vf END AS rv FROM b JOIN f USING (log_id, fix_id))"""


def _asof(spark, d, tolerance, join=J.asof_nearest, **more):
    h = trk(spark, d).withColumn("th", F.date_trunc("hour", "ts").cast("timestamp_ntz")).select("log_id", "fix_id", "th", "v")
    left, right = h.where("fix_id % 2 = 0").select("log_id", "fix_id", "th"), h.where("fix_id % 2 = 1").withColumnRenamed("v", "rv")
    out = join(left, right, ["log_id"], "th", "fix_id", "fix_id", ["rv"], tolerance, **more)
    return out.select("log_id", "fix_id", F.round("delta_s", 3).alias("delta_s"), F.round("rv", 6).alias("rv"))


@query(f"WITH {ASOF} SELECT log_id, fix_id, round(CASE WHEN delta_s <= 10800 THEN delta_s END, 3) AS delta_s, round(CASE WHEN delta_s <= 10800 THEN rv END, 6) AS rv FROM j")
def asof_nearest_split(spark, d):
    """Tolerance three hours, logs dealt over ranges of time."""
    return _asof(spark, d, 10800.0, J.asof_nearest_split)


@query(f"WITH {ASOF} SELECT log_id, fix_id, round(CASE WHEN delta_s <= 10800 THEN delta_s END, 3) AS delta_s, round(CASE WHEN delta_s <= 10800 THEN rv END, 6) AS rv FROM j")
def asof_nearest_tol(spark, d):
    """Tolerance three hours."""
    return _asof(spark, d, 10800.0)


@query(f"WITH {ASOF} SELECT log_id, fix_id, round(delta_s, 3) AS delta_s, round(rv, 6) AS rv FROM j")
def asof_nearest(spark, d):
    """J3."""
    return _asof(spark, d, None)


@query(f"""WITH {TRK}, h AS (SELECT date_trunc('hour', ts) AS hour, round(avg(v), 6) AS hour_mean, count(*) AS hour_n FROM trk WHERE k < 50 GROUP BY 1) SELECT log_id, fix_id, hour_mean, coalesce(hour_n, 0) AS hour_n FROM trk LEFT JOIN h ON date_trunc('hour', ts) = hour""")
def hour_left_join(spark, d):
    """J1, J9, J10, J12."""
    t = trk(spark, d).withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    h = t.where("k < 50").groupBy("hour").agg(F.round(F.avg("v"), 6).alias("hour_mean"), F.count(F.lit(1)).alias("hour_n"))
    return t.join(h, "hour", "left").select("log_id", "fix_id", "hour_mean", F.coalesce("hour_n", F.lit(0).cast("long")).alias("hour_n"))


BEST = f"""{SEG}, o AS (SELECT a.cust, a.seg_id, b.seg_id AS span_id, (epoch_us(least(a.e, b.e)) - epoch_us(greatest(a.s, b.s))) / 1e6 AS overlap_s, epoch_us(b.e) - epoch_us(b.s) AS len, b.s AS bs, b.e AS be
 FROM seg a JOIN seg b ON a.cust = b.cust AND a.seg_id <> b.seg_id AND a.s <= b.e AND b.s <= a.e)"""


@query(f"WITH {BEST}, r AS (SELECT *, row_number() OVER (PARTITION BY cust, seg_id ORDER BY overlap_s DESC, len, bs, be, span_id) AS rn FROM o WHERE overlap_s > 0) SELECT cust, seg_id, span_id, round(overlap_s, 3) AS overlap_s FROM r WHERE rn = 1")
def interval_best(spark, d):
    """J5."""
    s = seg(spark, d)
    spans = s.select("cust", F.col("seg_id").alias("span_id"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    met = J.overlaps(s, spans, ["cust"], ("s", "e"), ("s2", "e2")).where("seg_id <> span_id AND overlap_s > 0")
    out = J.best_row(met, ["cust", "seg_id"], [F.col("overlap_s").desc(), J.micros(F.col("e2")) - J.micros(F.col("s2")), "s2", "e2", "span_id"])
    return out.select("cust", "seg_id", "span_id", F.round("overlap_s", 3).alias("overlap_s"))


@query(f"""WITH {SEG} SELECT a.cust, a.seg_id, count(*) AS held FROM seg a JOIN seg b ON a.cust = b.cust AND a.seg_id <> b.seg_id AND a.s <= b.s AND b.e <= a.e AND (a.s < b.s OR b.e < a.e) AND a.s <= a.e AND b.s <= b.e GROUP BY ALL HAVING count(*) >= 1""")
def interval_contain(spark, d):
    """J6."""
    return J.wrappers(seg(spark, d), ["cust"], "seg_id", "s", "e", least=1)


@query(f"""WITH {SEG}, p AS (SELECT o_custkey AS cust, l_orderkey, l_linenumber, l_shipdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey) SELECT p.l_orderkey, CAST(p.l_linenumber AS BIGINT) AS l_linenumber, seg.seg_id FROM p JOIN seg ON p.cust = seg.cust AND l_shipdate BETWEEN s AND e""")
def point_in_interval(spark, d):
    """J7."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("cust"))
    li = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_shipdate")
    p = li.join(o, li["l_orderkey"] == o["o_orderkey"]).drop("o_orderkey")
    return J.points_in_intervals(p, seg(spark, d), ["cust"], "l_shipdate", "s", "e").select("l_orderkey", "l_linenumber", "seg_id")


@query(f"""WITH {SESSION_SQL}, w AS (SELECT log_id, session_id, min(ts) - INTERVAL 2 HOUR AS a, max(ts) + INTERVAL 2 HOUR AS b FROM ses GROUP BY ALL) SELECT w.log_id, w.session_id, count(*) AS n_rows, min(t.fix_id) AS first_fix FROM w JOIN trk t ON t.log_id = w.log_id AND t.ts BETWEEN w.a AND w.b GROUP BY ALL""")
def range_window(spark, d):
    """J8, A11, P7."""
    w = sessions(spark, d).groupBy("log_id", "session_id").agg(F.expr("min(ts) - interval 2 hours").alias("a"), F.expr("max(ts) + interval 2 hours").alias("b"))
    return J.points_in_intervals(trk(spark, d), w, ["log_id"], "ts", "a", "b").groupBy("log_id", "session_id").agg(F.count(F.lit(1)).alias("n_rows"), F.min("fix_id").alias("first_fix"))


PROJ = f"""{PLANE}, e0 AS (SELECT log_id, pos AS edge, x AS ax, y AS ay, lead(x) OVER w AS bx, lead(y) OVER w AS by_ FROM plane WINDOW w AS (PARTITION BY log_id ORDER BY pos)),
 e1 AS (SELECT *, sqrt(pow(bx - ax, 2) + pow(by_ - ay, 2)) AS edge_m FROM e0 WHERE bx IS NOT NULL), ed AS (SELECT *, coalesce(sum(edge_m) OVER (PARTITION BY log_id ORDER BY edge ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum_m FROM e1)"""
PROJECTED = f"""{PROJ}, {TRK}, q AS (SELECT log_id, fix_id, 63.0 * k AS px, 25.0 * (k % 7) - 60.0 AS py FROM trk),
 c AS (SELECT q.log_id, fix_id, edge, ax, ay, bx, by_, px, py, edge_m, cum_m, CASE WHEN pow(bx - ax, 2) + pow(by_ - ay, 2) <= 1e-12 THEN 0 ELSE least(1, greatest(0, ((px - ax) * (bx - ax) + (py - ay) * (by_ - ay)) / (pow(bx - ax, 2) + pow(by_ - ay, 2)))) END AS t FROM q JOIN ed USING (log_id)),
 m AS (SELECT log_id, fix_id, edge, sqrt(pow(px - ax - t * (bx - ax), 2) + pow(py - ay - t * (by_ - ay), 2)) AS dist, cum_m + t * edge_m AS chain, ax + t * (bx - ax) AS nx, ay + t * (by_ - ay) AS ny, px, py FROM c),
 pr AS (SELECT log_id, fix_id, dist, chain, nx, ny, px, py FROM (SELECT *, row_number() OVER (PARTITION BY log_id, fix_id ORDER BY dist, edge) AS rn FROM m) WHERE rn = 1)"""


def _edges(spark, d):
    return J.edges(plane(spark, d), ["log_id"], "pos", "x", "y")


def _projected(spark, d):
    t = trk(spark, d).select("log_id", "fix_id", (63.0 * F.col("k")).alias("px"), (25.0 * (F.col("k") % 7) - 60.0).alias("py"))
    return J.project_on_lines(t, _edges(spark, d), ["log_id"], "fix_id", "px", "py")


@query(f"WITH {PROJECTED} SELECT log_id, fix_id, round(dist, 4) AS distance_m, round(chain, 4) AS chainage_m FROM pr")
def project_polyline(spark, d):
    """J15, F3, F35."""
    return _projected(spark, d).select("log_id", "fix_id", F.round("distance_m", 4).alias("distance_m"), F.round("chainage_m", 4).alias("chainage_m"))


@query(f"""WITH {PROJ}, ln AS (SELECT log_id, max(cum_m + edge_m) AS total FROM ed GROUP BY log_id), g AS (SELECT log_id, total, i, total * i / 20.0 AS dd FROM ln, range(21) r(i)),
 p AS (SELECT g.log_id, i, row_number() OVER (PARTITION BY g.log_id, i ORDER BY edge DESC) AS rn, ax + CASE WHEN edge_m > 0 THEN least(1, (dd - cum_m) / edge_m) ELSE 0 END * (bx - ax) AS x, ay + CASE WHEN edge_m > 0 THEN least(1, (dd - cum_m) / edge_m) ELSE 0 END * (by_ - ay) AS y FROM g JOIN ed ON ed.log_id = g.log_id AND ed.cum_m <= g.dd)
 SELECT log_id, i, round(x, 2) AS x, round(y, 2) AS y FROM p WHERE rn = 1""")
def interp_grid(spark, d):
    """twenty-one places evenly along each line."""
    e = _edges(spark, d)
    total = e.groupBy("log_id").agg(F.max(F.col("cum_m") + F.col("edge_m")).alias("total"))
    g = total.select("log_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(20).cast("long"))).alias("i"), "total").withColumn("dd", F.col("total") * F.col("i") / 20.0)
    return J.at_chainage(e, g, ["log_id"], "dd").select("log_id", "i", F.round("x", 2).alias("x"), F.round("y", 2).alias("y"))


@query(f"""WITH {SESSION_SQL}, w AS (SELECT log_id, session_id, epoch_us(min(ts)) AS a, epoch_us(max(ts)) AS b FROM ses GROUP BY ALL), u AS (SELECT log_id, session_id, CAST(ceil(a / 900000000.0) AS BIGINT) AS f, CAST(floor(b / 900000000.0) AS BIGINT) AS l FROM w)
 SELECT log_id, session_id, make_timestamp(g * 900000000) AS grid_ts FROM (SELECT log_id, session_id, unnest(range(f, l + 1)) AS g FROM u WHERE f <= l)""")
def grid_expand(spark, d):
    """quarters of an hour within sessions; none where no quarter falls in."""
    w = sessions(spark, d).groupBy("log_id", "session_id").agg(F.min(J.micros(F.col("ts"))).alias("a"), F.max(J.micros(F.col("ts"))).alias("b"))
    f, last = F.ceil(F.col("a") / 900000000).cast("long"), F.floor(F.col("b") / 900000000).cast("long")
    g = w.withColumn("f", f).withColumn("l", last).where("f <= l").select("log_id", "session_id", F.explode(F.sequence("f", "l")).alias("g"))
    return g.select("log_id", "session_id", F.timestamp_micros(F.col("g") * 900000000).cast("timestamp_ntz").alias("grid_ts"))


BINS = f"""{PROJECTED}, ln AS (SELECT log_id, max(cum_m + edge_m) AS total FROM ed GROUP BY log_id),
 bi AS (SELECT pr.log_id, CAST(least(floor(chain / 200.0), greatest(ceil(total / 200.0), 1) - 1) AS BIGINT) AS segment_index, t.v FROM pr JOIN ln USING (log_id) JOIN trk t USING (log_id, fix_id)),
 bins AS (SELECT log_id, segment_index, count(*) AS n_points, avg(v) AS mean, quantile_cont(v, 0.5) AS med, min(v) AS lo, max(v) AS hi FROM bi GROUP BY ALL)"""


def _bins(spark, d):
    total = _edges(spark, d).groupBy("log_id").agg(F.max(F.col("cum_m") + F.col("edge_m")).alias("total"))
    rows = _projected(spark, d).join(trk(spark, d).select("log_id", "fix_id", "v"), ["log_id", "fix_id"]).join(total, "log_id")
    return A.route_bins(rows, ["log_id"], "chainage_m", F.col("total"), "v", 200.0)


@query(f"WITH {BINS} SELECT log_id, segment_index, n_points, round(mean, 6) AS v_mean, round(med, 6) AS v_median, round(lo, 6) AS v_min, round(hi, 6) AS v_max, 200.0 * segment_index AS m_start, 200.0 * (segment_index + 0.5) AS m_mid FROM bins")
def route_bins(spark, d):
    """A4, F36."""
    return _bins(spark, d).select("log_id", "segment_index", "n_points", *[F.round(c, 6).alias(c) for c in ("v_mean", "v_median", "v_min", "v_max")], "m_start", "m_mid")


@query(f"WITH {BINS} SELECT round(avg(mean), 6) AS mean_of_means, round(quantile_cont(mean, 0.5), 6) AS median_of_means, count(DISTINCT log_id) AS n_routes FROM bins")
def bin_global_avg(spark, d):
    """A6, A7."""
    b = _bins(spark, d).select("log_id", "v_mean")
    q = A.quantiles(b, [], "v_mean", [0.5]).select(F.round(F.get("q", F.lit(0)), 6).alias("median_of_means"))
    return b.agg(F.round(F.avg("v_mean"), 6).alias("mean_of_means"), F.countDistinct("log_id").alias("n_routes")).join(F.broadcast(q))  # one row each


@query(f"""WITH {SEGS}, r AS (SELECT log_id, value, round_even(x / 18.0, 0) * 18.0 AS x, round_even(y / 18.0, 0) * 18.0 AS y, round_even(xend / 18.0, 0) * 18.0 AS xend, round_even(yend / 18.0, 0) * 18.0 AS yend FROM segs),
 c AS (SELECT log_id, value, CASE WHEN x < xend OR (x = xend AND y <= yend) THEN x ELSE xend END AS x, CASE WHEN x < xend OR (x = xend AND y <= yend) THEN y ELSE yend END AS y, CASE WHEN x < xend OR (x = xend AND y <= yend) THEN xend ELSE x END AS xend, CASE WHEN x < xend OR (x = xend AND y <= yend) THEN yend ELSE y END AS yend FROM r WHERE x <> xend OR y <> yend)
 SELECT x + 0.0 AS x, y + 0.0 AS y, xend + 0.0 AS xend, yend + 0.0 AS yend, count(*) AS n_obs, count(DISTINCT log_id) AS n_routes, round(avg(value), 6) AS value_mean, round(quantile_cont(value, 0.5), 6) AS value_median, round(min(value), 6) AS value_min, round(max(value), 6) AS value_max FROM c GROUP BY 1, 2, 3, 4""")
def merged_edges(spark, d):
    """A5, W16."""
    out = A.merged_edges(_pairs(spark, d), "log_id")
    return out.select(*[(F.col(c) + 0.0).alias(c) for c in ("x", "y", "xend", "yend")], "n_obs", "n_routes", *[F.round(c, 6).alias(c) for c in ("value_mean", "value_median", "value_min", "value_max")])


@query(f"""WITH {TRK}, a AS (SELECT mode, min(v) AS lo, max(v) AS hi, quantile_cont(v, 0.5) AS md, stddev_samp(v) AS sd FROM trk GROUP BY mode) SELECT mode, round(CASE WHEN lo = hi THEN md - CASE WHEN coalesce(sd, 0) > 0 THEN sd ELSE 1 END ELSE lo END, 6) AS low, round(CASE WHEN lo = hi THEN md + CASE WHEN coalesce(sd, 0) > 0 THEN sd ELSE 1 END ELSE hi END, 6) AS high FROM a""")
def global_norm(spark, d):
    """A8."""
    return A.color_norm(trk(spark, d), ["mode"], "v").select("mode", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query(f"""WITH {SESSION_SQL}, p AS (SELECT log_id, session_id, min(ts) AS t, avg(v) AS m FROM ses GROUP BY ALL) SELECT CAST(t AS DATE) + INTERVAL 12 HOUR AS ts, round(avg(m), 6) AS daily_mean, count(*) AS n_passes FROM p GROUP BY CAST(t AS DATE)""")
def daily_means(spark, d):
    """A3."""
    p = sessions(spark, d).groupBy("log_id", "session_id").agg(F.min("ts").alias("t"), F.avg("v").alias("m"))
    out = p.groupBy(F.to_date("t").alias("day")).agg(F.round(F.avg("m"), 6).alias("daily_mean"), F.count(F.lit(1)).alias("n_passes"))
    return out.select(F.expr("cast(day AS timestamp_ntz) + interval 12 hours").alias("ts"), "daily_mean", "n_passes")


@query(f"""WITH {TRK}, r AS (SELECT mode, min(v) AS lo, max(v) AS hi FROM trk GROUP BY mode), b AS (SELECT min(k) AS l, max(k) AS h FROM trk) SELECT fix_id, round(l + (v - lo) / (hi - lo) * (h - l), 6) AS scaled, round(abs(l + (v - lo) / (hi - lo) * (h - l) - k), 6) AS diff FROM trk JOIN r USING (mode) CROSS JOIN b""")
def linear_rescale(spark, d):
    """W26, A21."""
    t = trk(spark, d)
    r = t.groupBy("mode").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    b = t.agg(F.min("k").cast("double").alias("l"), F.max("k").cast("double").alias("h"))
    t = t.join(F.broadcast(r), "mode").join(F.broadcast(b))  # a row for each mode, and one row
    x = A.rescale(F.col("v"), F.col("lo"), F.col("hi"), F.col("l"), F.col("h"))
    return t.select("fix_id", F.round(x, 6).alias("scaled"), F.round(F.abs(x - F.col("k")), 6).alias("diff"))


@query(f"""WITH {TRK}, q AS (SELECT mode, quantile_cont(v, 0.15) AS q15, min(v) AS lo FROM trk GROUP BY mode) SELECT fix_id, mode, round(v, 6) AS v FROM trk JOIN q USING (mode) WHERE v BETWEEN lo AND q15""")
def low_focus(spark, d):
    """A14, P21."""
    t = trk(spark, d)
    low = t.groupBy("mode").agg(F.min("v").alias("lo"))
    q = A.quantiles(t, ["mode"], "v", [0.15]).select("mode", F.get("q", F.lit(0)).alias("q15")).join(low, "mode")
    return t.join(F.broadcast(q), "mode").where(F.col("v").between(F.col("lo"), F.col("q15"))).select("fix_id", "mode", F.round("v", 6).alias("v"))


GATE = f"""{TRK}, g AS (SELECT log_id, fix_id, CASE WHEN k % 11 = 0 THEN NULL ELSE k % 4 END AS gm, k * 3.0::DOUBLE AS eph, v AS dist FROM trk),
 gate AS (SELECT *, CASE WHEN gm IS NULL OR gm < 2 THEN 'mode_below_2' WHEN eph > 250 THEN 'eph_above_limit' WHEN dist > greatest(55, least(250, 3.5 * coalesce(eph, 120))) THEN 'too_far' ELSE 'accepted' END AS reason,
 CASE WHEN gm >= 3 THEN 1.25 WHEN gm = 2 THEN 1.0 ELSE 0.0 END / (1 + greatest(coalesce(eph, 120), 1) / 25.0) AS weight FROM g)"""


def _gate(spark, d):
    g = trk(spark, d).select("log_id", "fix_id", F.when(F.col("k") % 11 != 0, F.col("k") % 4).alias("gm"), (F.col("k") * 3.0).alias("eph"), F.col("v").alias("dist"))
    allowed = F.greatest(F.lit(55.0), F.least(F.lit(250.0), 3.5 * F.coalesce("eph", F.lit(120.0))))
    reason = F.when(F.col("gm").isNull() | (F.col("gm") < 2), "mode_below_2").when(F.col("eph") > 250, "eph_above_limit").when(F.col("dist") > allowed, "too_far").otherwise("accepted")
    bonus = F.when(F.col("gm") >= 3, 1.25).when(F.col("gm") == 2, 1.0).otherwise(0.0)
    return g.withColumn("reason", reason).withColumn("weight", bonus / (1 + F.greatest(F.coalesce("eph", F.lit(120.0)), F.lit(1.0)) / 25.0))


@query(f"WITH {GATE} SELECT log_id, fix_id, reason, round(weight, 6) AS weight FROM gate")
def quality_gate(spark, d):
    """P14, F13, F14."""
    return _gate(spark, d).select("log_id", "fix_id", "reason", F.round("weight", 6).alias("weight"))


@query(f"""WITH {GATE}, c AS (SELECT log_id, count(*) AS considered, count(CASE WHEN reason = 'accepted' THEN 1 END) AS accepted, count(CASE WHEN reason <> 'accepted' THEN 1 END) AS rejected FROM gate GROUP BY log_id),
 n AS (SELECT log_id, reason, count(*) AS n FROM gate WHERE reason <> 'accepted' GROUP BY ALL), t AS (SELECT log_id, reason FROM (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY n DESC, reason) AS rn FROM n) WHERE rn = 1) SELECT c.*, t.reason AS top_reason FROM c LEFT JOIN t USING (log_id)""")
def top_reason(spark, d):
    """A9, A10, A19, J12, C7."""
    return A.top_reason(_gate(spark, d).withColumn("ok", F.col("reason") == "accepted"), ["log_id"], "ok", "reason")


@query(f"""WITH {TRK}, b AS (SELECT log_id, mode, count(*) * 5 AS s FROM trk GROUP BY ALL) SELECT log_id, CASE WHEN max(s) >= 60 THEN min(CASE WHEN s = mx THEN mode END) END AS dominant, '{{' || string_agg('"' || mode || '":' || s, ',' ORDER BY mode) || '}}' AS durations FROM (SELECT *, max(s) OVER (PARTITION BY log_id) AS mx FROM b) GROUP BY log_id""")
def class_duration(spark, d):
    """A12, A22, P20."""
    return A.class_durations(trk(spark, d), ["log_id"], "mode", 5, 60)


@query(f"""WITH {POS}, m AS (SELECT log_id, avg(lat) AS lat0, avg(lon) AS lon0 FROM p GROUP BY log_id), xy AS (SELECT log_id, lat0, lon0, sum(w * (lon - lon0)) / sum(w) AS dx, sum(w * (lat - lat0)) / sum(w) AS dy FROM (SELECT *, 1.0 + k AS w FROM p) JOIN m USING (log_id) GROUP BY ALL) SELECT log_id, round(lat0 + dy, 6) AS lat, round(lon0 + dx, 6) AS lon FROM xy""")
def centroid(spark, d):
    """A15, F2."""
    out = A.centroid(placed(spark, d).withColumn("w", 1.0 + F.col("k")), ["log_id"], "lat", "lon", "w")
    return out.select("log_id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query("""SELECT l_returnflag AS flag, measure, count(*) AS n, round(sum(val), 2) AS total FROM (SELECT l_returnflag, 'quantity' AS measure, l_quantity AS val FROM lineitem UNION ALL SELECT l_returnflag, 'price', l_extendedprice FROM lineitem UNION ALL SELECT l_returnflag, 'tax', l_tax FROM lineitem) GROUP BY ALL""")
def wide_to_long(spark, d):
    """U3, P16."""
    li = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_tax").alias("tax"))
    return li.unpivot(["flag"], ["quantity", "price", "tax"], "measure", "val").groupBy("flag", "measure").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("val"), 2).alias("total"))


@query("""SELECT l_linestatus AS status, round(avg(CASE WHEN l_returnflag = 'A' THEN l_quantity END), 6) AS A, round(avg(CASE WHEN l_returnflag = 'N' THEN l_quantity END), 6) AS N, round(avg(CASE WHEN l_returnflag = 'R' THEN l_quantity END), 6) AS R FROM lineitem GROUP BY 1""")
def long_to_wide(spark, d):
    """U4."""
    li = table(spark, d, "lineitem").select(F.col("l_linestatus").alias("status"), "l_returnflag", "l_quantity")
    return li.groupBy("status").pivot("l_returnflag", ["A", "N", "R"]).agg(F.round(F.avg("l_quantity"), 6))


@query("""SELECT CAST(n_nationkey AS BIGINT) AS key, n_name AS name, CAST(n_regionkey AS BIGINT) AS region, 'nation' AS series FROM nation UNION ALL SELECT CAST(r_regionkey AS BIGINT), r_name, -1, 'region' FROM region""")
def union_by_name(spark, d):
    """U1, U7."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("region"), F.lit("nation").alias("series"))
    r = table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("key"), F.col("r_name").alias("name"), F.lit("region").alias("series"))
    return n.unionByName(r, allowMissingColumns=True).fillna({"region": -1})


@query("""SELECT c.c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000) AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')""")
def semi_anti_split(spark, d):
    """J13, U5, U6."""
    c, o = table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders")
    big, pending = o.where("o_totalprice > 200000").select("o_custkey"), o.where("o_orderstatus = 'P'").select("o_custkey")
    return c.join(big, c["c_custkey"] == big["o_custkey"], "left_semi").join(pending, F.col("c_custkey") == pending["o_custkey"], "left_anti")


@query(f"""WITH {TRK}, x AS (SELECT DISTINCT log_id, mode FROM trk) SELECT log_id, string_agg(mode, '+' ORDER BY mode) AS modes FROM x GROUP BY log_id""")
def label_concat(spark, d):
    """A20."""
    return trk(spark, d).groupBy("log_id").agg(F.array_join(F.array_sort(F.collect_set("mode")), "+").alias("modes"))


@query(f"""WITH {TRK}, u AS (SELECT *, row_number() OVER (PARTITION BY log_id, mode, k ORDER BY ts, fix_id) AS rn FROM trk) SELECT log_id, mode, k, fix_id FROM u WHERE rn = 1""")
def subset_dedupe(spark, d):
    """U2, O1, O7."""
    return S.best_row(trk(spark, d), ["log_id", "mode", "k"], ["ts", "fix_id"]).select("log_id", "mode", "k", "fix_id")


@query(f"""WITH RECURSIVE e AS (SELECT CAST(n_nationkey AS BIGINT) AS src, CAST((n_nationkey + 1) % 25 AS BIGINT) AS dst, 100.0::DOUBLE + 10 * n_nationkey AS w FROM nation UNION ALL SELECT n_nationkey, (n_nationkey + 7) % 25, 450.0::DOUBLE + 3 * n_nationkey FROM nation WHERE n_nationkey % 3 = 0),
 b AS (SELECT src, dst, w FROM e UNION ALL SELECT dst, src, w FROM e), p AS (SELECT CAST(n_nationkey AS BIGINT) AS source, CAST(n_nationkey AS BIGINT) AS node, 0.0::DOUBLE AS d, 0 AS hops FROM nation WHERE n_nationkey % 5 = 0
 UNION SELECT source, node, d, hops FROM (SELECT p.source, b.dst AS node, min(p.d + b.w) AS d, min(p.hops + 1) AS hops FROM p JOIN b ON p.node = b.src WHERE p.hops < 24 GROUP BY p.source, b.dst)) SELECT source, node, min(d) AS distance FROM p GROUP BY ALL""")
def shortest_path(spark, d):
    """Distances between stations."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"))
    ring = n.select(F.col("k").alias("src"), ((F.col("k") + 1) % 25).alias("dst"), (100.0 + 10 * F.col("k")).alias("weight_m"))
    chord = n.where("k % 3 = 0").select(F.col("k").alias("src"), ((F.col("k") + 7) % 25).alias("dst"), (450.0 + 3 * F.col("k")).alias("weight_m"))
    return graph.shortest_paths(ring.union(chord), n.where("k % 5 = 0").select(F.col("k").alias("source")))


@query(f"""WITH {PTS} SELECT id, round(6378137.0 * radians(lon), 3) AS x, round(6378137.0 * ln(tan(pi() / 4 + radians(lat) / 2)), 3) AS y FROM pts""")
def web_mercator(spark, d):
    """F34."""
    x, y = geo.web_mercator(F.col("lat"), F.col("lon"))
    return pts(spark, d).select("id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query(f"""WITH {SIG}, t AS (SELECT log_id, sum(CASE WHEN abs(v) > 0.05 THEN 1 ELSE 0 END) AS n, quantile_cont(abs(v), 0.98) AS q98 FROM sig GROUP BY log_id) SELECT log_id, CAST(n AS BIGINT) AS n, round(q98, 6) AS q98, CASE WHEN q98 <= 0.3 THEN 'geographic' ELSE 'projected' END AS crs FROM t""")
def crs_guess(spark, d):
    """By the quantile rule."""
    q = sig(spark, d).groupBy("log_id").agg(F.count_if(F.abs("v") > 0.05).alias("n"), F.percentile(F.abs("v"), F.lit(0.98)).alias("q98"))
    return q.select("log_id", "n", F.round("q98", 6).alias("q98"), F.when(F.col("q98") <= 0.3, "geographic").otherwise("projected").alias("crs"))


@query(f"""WITH {TRK}, q AS (SELECT log_id, fix_id, CASE WHEN k % 3 = 0 THEN NULL WHEN k % 7 = 1 THEN 'infinity'::DOUBLE ELSE 52.3 + k / 250.0::DOUBLE END AS lat, CASE WHEN log_id % 4 = 1 THEN 'nan'::DOUBLE ELSE 13.1 + k / 150.0::DOUBLE END AS lon FROM trk), f AS (SELECT *, count(*) OVER (PARTITION BY log_id) AS n FROM q WHERE isfinite(lat) AND isfinite(lon)) SELECT log_id, fix_id FROM f WHERE n >= 2""")
def placed_routes(spark, d):
    """Fixes with a finite place, of logs that have two or more."""
    k = F.col("k")
    lat = F.when(k % 3 == 0, F.lit(None).cast("double")).when(k % 7 == 1, F.lit(float("inf"))).otherwise(52.3 + k / 250.0)
    t = trk(spark, d).withColumn("lat", lat).withColumn("lon", F.when(F.col("log_id") % 4 == 1, F.lit(float("nan"))).otherwise(13.1 + k / 150.0))
    return S.placed_routes(t, ["log_id"], "lat", "lon").select("log_id", "fix_id")
