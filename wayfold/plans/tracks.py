"""Queries of sequence operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold.functions.geo import haversine
from wayfold.operators import aggregates as A
from wayfold.operators import sequences as S
from wayfold.operators import thinning as N
from wayfold.operators import training as T
from wayfold.plans.adapters import PL, PLANE, SIG, TRK, chain, hav, pl, plane, sig, table, trk

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


SESSION_SQL = f"""{TRK}, f AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 21600000000 THEN 1 ELSE 0 END AS nw FROM trk WINDOW w AS (PARTITION BY log_id ORDER BY ts, fix_id)),
 ses AS (SELECT * EXCLUDE nw, CAST(sum(nw) OVER (PARTITION BY log_id ORDER BY ts, fix_id) AS BIGINT) AS session_id FROM f)"""


def sessions(spark, d):
    return S.gap_sessions(trk(spark, d), ["log_id"], "ts", ["ts", "fix_id"], 6 * 3600)


@query(f"WITH {SESSION_SQL} SELECT log_id, session_id, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n_fixes, round(avg(v), 6) AS mean_value FROM ses GROUP BY ALL")
def gap_sessions(spark, d):
    """W7."""
    return sessions(spark, d).groupBy("log_id", "session_id").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count(F.lit(1)).alias("n_fixes"), F.round(F.avg("v"), 6).alias("mean_value"))


@query(f"""WITH {TRK} SELECT log_id, fix_id, CAST(dense_rank() OVER (PARTITION BY log_id ORDER BY CAST(ts AS DATE)) AS BIGINT) AS pass_id,
 CAST(row_number() OVER (PARTITION BY log_id, CAST(ts AS DATE) ORDER BY ts, fix_id) AS BIGINT) AS pass_row_index FROM trk""")
def day_pass_ids(spark, d):
    """W6, J11."""
    t = trk(spark, d).withColumn("day", F.to_date("ts"))
    return S.day_pass_ids(t, ["log_id"], "day", ["ts", "fix_id"]).select("log_id", "fix_id", "pass_id", "pass_row_index")


@query(f"""WITH {SESSION_SQL} SELECT log_id, session_id, date_trunc('hour', ts) AS hour, min(ts) AS pass_ts, round(avg(v), 6) AS mobile_mean, round(avg(k), 6) AS station_value, count(*) AS mobile_points
 FROM ses GROUP BY ALL""")
def session_summary(spark, d):
    """A pass over an hour's end gives two rows."""
    t = sessions(spark, d).withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz")).withColumn("kd", F.col("k").cast("double"))
    out = A.passes(t, ["log_id", "session_id"], "ts", "hour", "v", "kd")
    return out.withColumn("mobile_mean", F.round("mobile_mean", 6)).withColumn("station_value", F.round("station_value", 6))


LAT, LON = "52.4 + (k % 50) / 1000.0::DOUBLE", "13.3 + (k * 7 % 50) / 1000.0::DOUBLE"
POS = f"{TRK}, p AS (SELECT *, CAST({LAT} AS DOUBLE) AS lat, CAST({LON} AS DOUBLE) AS lon FROM trk)"


def placed(spark, d):
    return trk(spark, d).withColumn("lat", 52.4 + (F.col("k") % 50) / 1000.0).withColumn("lon", 13.3 + (F.col("k") * 7 % 50) / 1000.0)


@query(f"""WITH {POS}, l AS (SELECT *, lag(ts) OVER w AS pts, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM p WINDOW w AS (PARTITION BY log_id ORDER BY ts, fix_id)),
 s AS (SELECT log_id, fix_id, (epoch_us(ts) - epoch_us(pts)) / 1e6 AS delta_s, {hav('plat', 'plon', 'lat', 'lon')} AS m FROM l)
 SELECT log_id, fix_id, round(delta_s, 6) AS delta_s, CASE WHEN delta_s IS NULL THEN NULL ELSE round(m, 4) END AS step_distance_m, CASE WHEN delta_s <> 0 THEN round(m / delta_s, 6) END AS step_speed_m_s,
 coalesce(CASE WHEN delta_s <> 0 THEN m / delta_s END > 0.5, false) AS jump_flag FROM s""")
def lag_speed_jump(spark, d):
    """W8, F1."""
    out = S.steps(placed(spark, d), ["log_id"], "ts", "lat", "lon", ["ts", "fix_id"], 0.5)
    return out.select("log_id", "fix_id", F.round("delta_s", 6).alias("delta_s"), F.round("step_distance_m", 4).alias("step_distance_m"), F.round("step_speed_m_s", 6).alias("step_speed_m_s"), "jump_flag")


@query(f"""WITH {TRK} SELECT log_id, hour, fix_id, mode, v FROM (SELECT *, date_trunc('hour', ts) AS hour, row_number() OVER (PARTITION BY log_id, date_trunc('hour', ts) ORDER BY v DESC,
 CASE mode WHEN 'click' THEN 3 WHEN 'view' THEN 2 ELSE 0 END DESC, k DESC, fix_id) AS rn FROM trk) WHERE rn = 1""")
def priority_dedupe(spark, d):
    """W9, W29, O2."""
    t = trk(spark, d).withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    rank = F.when(F.col("mode") == "click", 3).when(F.col("mode") == "view", 2).otherwise(0)
    return S.best_row(t, ["log_id", "hour"], [F.col("v").desc(), rank.desc(), F.col("k").desc(), "fix_id"]).select("log_id", "hour", "fix_id", "mode", "v")


@query("""SELECT o_custkey, o_orderdate, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_totalprice DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""")
def visit_dedupe(spark, d):
    """W10."""
    o = table(spark, d, "orders")
    return S.best_row(o, ["o_custkey", "o_orderdate"], [F.col("o_totalprice").desc(), F.col("o_orderkey").desc()]).select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")


@query(f"""WITH {SIG}, a AS (SELECT *, v < 0.1 AS low, pos - lag(pos) OVER w AS st, lag(v < 0.1) OVER w AS plow FROM sig WINDOW w AS (PARTITION BY log_id ORDER BY pos)),
 b AS (SELECT *, sum(CASE WHEN plow IS NULL OR plow <> low THEN 1 ELSE 0 END) OVER (PARTITION BY log_id ORDER BY pos) AS run FROM a),
 m AS (SELECT log_id, quantile_cont(st, 0.5) AS step FROM b GROUP BY log_id), r AS (SELECT log_id, run, max(pos) - min(pos) AS span FROM b WHERE low GROUP BY ALL), g AS (SELECT log_id, max(span) AS span FROM r GROUP BY log_id)
 SELECT m.log_id, CAST(CASE WHEN span IS NULL THEN 0 ELSE span + step END AS DOUBLE) AS longest_run FROM m LEFT JOIN g USING (log_id)""")
def longest_cool_run(spark, d):
    """W1."""
    return S.longest_run_below(sig(spark, d), ["log_id"], "pos", "v", 0.1).withColumn("longest_run", F.col("longest_run").cast("double"))


@query(f"""WITH {SIG}, a AS (SELECT *, coalesce(v < lag(v) OVER w, false) AS dr FROM sig WINDOW w AS (PARTITION BY log_id ORDER BY pos)),
 b AS (SELECT *, pos - max(CASE WHEN NOT dr THEN pos END) OVER (PARTITION BY log_id ORDER BY pos) AS streak FROM a)
 SELECT log_id, CAST(coalesce(min(CASE WHEN streak >= 3 AND pos < least(greatest(floor(64 * 0.5), 10), 600) THEN pos - 2 END), -1) AS BIGINT) AS streak_start FROM b GROUP BY log_id""")
def start_streak(spark, d):
    """W2."""
    return S.first_streak(sig(spark, d), ["log_id"], "pos", "v", 3, zone=0.5).fillna(-1)


CROP = f"""{SIG}, a AS (SELECT *, coalesce(v > lag(v) OVER w, false) AS up FROM sig WINDOW w AS (PARTITION BY log_id ORDER BY pos)),
 c AS (SELECT log_id, CAST(coalesce(max(CASE WHEN up AND pos >= 64 - 12 THEN pos + 1 END), 0) AS BIGINT) AS crop_end FROM a GROUP BY log_id)"""


@query(f"WITH {CROP} SELECT s.log_id, s.pos, round(s.v, 6) AS v, c.crop_end FROM sig s JOIN c USING (log_id) WHERE s.pos >= 3 AND (c.crop_end <= 3 OR s.pos < c.crop_end)")
def tail_rise(spark, d):
    """W3, W4."""
    s = sig(spark, d)
    ends = S.tail_rise(s, ["log_id"], "pos", "v")
    return S.crop(s.join(ends, "log_id"), ["log_id"], "pos", F.lit(3), F.col("crop_end")).select("log_id", "pos", F.round("v", 6).alias("v"), "crop_end")


@query(f"""WITH {TRK}, o AS (SELECT *, epoch_us(ts) - first_value(epoch_us(ts)) OVER (PARTITION BY log_id ORDER BY fix_id) > 864000000000 AS late FROM trk),
 b AS (SELECT *, bool_or(late) OVER (PARTITION BY log_id ORDER BY fix_id) AS gone FROM o) SELECT log_id, fix_id, ts FROM b WHERE NOT gone""")
def prefix_cap(spark, d):
    """Ten days in the order of fixes, which isn't that of time."""
    return S.prefix_cap(trk(spark, d), ["log_id"], "ts", ["fix_id"], 10 * 86400).select("log_id", "fix_id", "ts")


@query(f"""WITH {SIG}, b AS (SELECT log_id, pos, CASE WHEN abs(v) > 0.1 THEN v END AS x FROM sig), r AS (SELECT *, min(CASE WHEN x IS NOT NULL THEN pos END) OVER (PARTITION BY log_id) AS f, max(CASE WHEN x IS NOT NULL THEN pos END) OVER (PARTITION BY log_id) AS l FROM b)
 SELECT log_id, pos, round(x, 6) AS x FROM r WHERE pos BETWEEN f AND l""")
def edge_trim(spark, d):
    """P1."""
    s = sig(spark, d).select("log_id", "pos", F.when(F.abs("v") > 0.1, F.col("v")).alias("x"))
    return S.trim_empty_ends(s, ["log_id"], "pos", ["x"]).select("log_id", "pos", F.round("x", 6).alias("x"))


@query(f"""WITH {TRK}, m AS (SELECT log_id, CAST(extract(day FROM ts) AS BIGINT) % 3 AS mo, count(*) AS n FROM trk GROUP BY ALL), t AS (SELECT log_id, mo FROM (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY n DESC, mo) AS rn FROM m) WHERE rn = 1),
 a AS (SELECT log_id, count(*) AS n, avg(CASE WHEN k >= 40 THEN 1.0 ELSE 0.0 END) AS share, quantile_cont(CAST(k AS DOUBLE), 0.5) AS med FROM trk GROUP BY log_id)
 SELECT log_id, mo AS dominant, n, round(share, 6) AS share, round(med, 6) AS median, mo IN (1, 2) AND share >= 0.6 AND med >= 40 AS indoor FROM a JOIN t USING (log_id) WHERE n > 30""")
def indoor_filter(spark, d):
    """P12, P13, A13."""
    t = trk(spark, d).withColumn("mo", (F.dayofmonth("ts") % 3).cast("long"))
    a = t.groupBy("log_id").agg(F.expr("mode(mo, true)").alias("dominant"), F.count(F.lit(1)).alias("n"), F.avg((F.col("k") >= 40).cast("double")).alias("share"), F.percentile(F.col("k").cast("double"), F.lit(0.5)).alias("median")).where("n > 30")
    a = a.withColumn("indoor", F.col("dominant").isin(1, 2) & (F.col("share") >= 0.6) & (F.col("median") >= 40))
    return a.withColumn("share", F.round("share", 6)).withColumn("median", F.round("median", 6))


@query(f"""WITH {SIG} SELECT log_id, pos, round(quantile_cont(v, 0.5) OVER (PARTITION BY log_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smooth FROM sig""")
def rolling_median5(spark, d):
    """W13."""
    return S.rolling_median(sig(spark, d), ["log_id"], "pos", "v").select("log_id", "pos", F.round("smooth", 6).alias("smooth"))


@query(f"""WITH {SIG}, r AS (SELECT log_id, pos, quantile_cont(v, 0.5) OVER w AS md, count(v) OVER w AS n FROM sig WINDOW w AS (PARTITION BY log_id ORDER BY pos ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING))
 SELECT log_id, pos, CASE WHEN n >= 14 THEN round(md, 6) END AS smooth FROM r""")
def rolling_median21(spark, d):
    """W14."""
    return S.rolling_median(sig(spark, d), ["log_id"], "pos", "v", 21, 14).select("log_id", "pos", F.round("smooth", 6).alias("smooth"))


SUB = f"""{PLANE}, st AS (SELECT *, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS step_m FROM plane WINDOW w AS (PARTITION BY log_id ORDER BY pos)),
 lim AS (SELECT log_id, CASE WHEN count(CASE WHEN step_m > 0 THEN 1 END) >= 8 THEN least(greatest(80.0, 3 * quantile_cont(CASE WHEN step_m > 0 THEN step_m END, 0.9) / 3.5, 8 * quantile_cont(CASE WHEN step_m > 0 THEN step_m END, 0.5) / 8), 640.0) ELSE 80.0 END AS gap_m FROM st GROUP BY log_id),
 sub AS (SELECT st.*, CAST(1 + sum(CASE WHEN coalesce(step_m > gap_m, false) THEN 1 ELSE 0 END) OVER (PARTITION BY st.log_id ORDER BY pos) AS BIGINT) AS subroute_id FROM st JOIN lim USING (log_id))"""
SUB = SUB.replace(" / 3.5", "").replace(" / 8)", ")")


def _steps(spark, d):
    w = S.over(["log_id"], ["pos"])
    p = plane(spark, d)
    step = F.sqrt(F.pow(F.col("x") - F.lag("x").over(w), F.lit(2.0)) + F.pow(F.col("y") - F.lag("y").over(w), F.lit(2.0)))
    return S.subroutes(p, ["log_id"], "pos", step)


@query(f"WITH {SUB} SELECT log_id, pos, subroute_id, round(step_m, 4) AS step_m FROM sub")
def subroute_split(spark, d):
    """W15, A14."""
    return _steps(spark, d).select("log_id", "pos", "subroute_id", F.round("step_m", 4).alias("step_m"))


@query(f"""WITH {SUB}, a AS (SELECT *, max(abs(y)) OVER (PARTITION BY log_id) AS q FROM sub), b AS (SELECT log_id, subroute_id, CAST(count(*) AS BIGINT) AS n FROM a GROUP BY ALL)
 SELECT log_id, subroute_id, n FROM (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY n DESC, subroute_id) AS rn FROM b) WHERE rn = 1""")
def longest_subroute(spark, d):
    """Ties go to the first."""
    n = _steps(spark, d).groupBy("log_id", "subroute_id").agg(F.count(F.lit(1)).alias("n"))
    return S.best_row(n, ["log_id"], [F.col("n").desc(), "subroute_id"])


SEGS = f"""{PLANE}, l AS (SELECT log_id, pos, x, y, lead(x) OVER w AS xend, lead(y) OVER w AS yend, v AS a, lead(v) OVER w AS b FROM plane WINDOW w AS (PARTITION BY log_id ORDER BY pos)),
 segs AS (SELECT log_id, pos, x, y, xend, yend, coalesce((a + b) / 2, a, b) AS value FROM l WHERE xend IS NOT NULL AND (x <> xend OR y <> yend))"""


def _pairs(spark, d):
    return S.pairs(plane(spark, d), ["log_id"], "pos", "x", "y", "v")


@query(f"WITH {SEGS} SELECT log_id, pos, round(x, 4) AS x, round(y, 4) AS y, round(xend, 4) AS xend, round(yend, 4) AS yend, round(value, 6) AS value FROM segs")
def seg_pairs(spark, d):
    """W16."""
    p = _pairs(spark, d)
    return p.select("log_id", "pos", *[F.round(c, 4).alias(c) for c in ("x", "y", "xend", "yend")], F.round("value", 6).alias("value"))


CUM = f"""{PL}, s AS (SELECT *, {hav('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} AS st, lag(lat) OVER w AS pv FROM pl WINDOW w AS (PARTITION BY log_id ORDER BY pos)),
 cum AS (SELECT *, sum(CASE WHEN pv IS NULL THEN 0 ELSE st END) OVER (PARTITION BY log_id ORDER BY pos) AS m, sum(CASE WHEN pv IS NULL THEN 0 ELSE st END) OVER (PARTITION BY log_id) AS total FROM s)"""


def _cum(spark, d):
    w = S.over(["log_id"], ["pos"])
    p = pl(spark, d)
    step = F.coalesce(haversine(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon")), F.lit(0.0))
    p = p.withColumn("st", step)
    total = F.sum("st").over(S.Window.partitionBy("log_id"))
    return p.withColumn("m", F.sum("st").over(w)).withColumn("total", total)


@query(f"WITH {CUM} SELECT log_id, pos, round(m, 3) AS cum_m FROM cum")
def cum_length(spark, d):
    """W11."""
    return _cum(spark, d).select("log_id", "pos", F.round("m", 3).alias("cum_m"))


@query(f"WITH {CUM} SELECT log_id, pos, round(m / total, 6) AS progress, round(st / 5, 4) AS speed_m_s FROM (SELECT log_id, pos, m, total, CASE WHEN pv IS NULL THEN 0 ELSE st END AS st FROM cum)")
def progress_speed(spark, d):
    """W12."""
    return _cum(spark, d).select("log_id", "pos", F.round(F.col("m") / F.col("total"), 6).alias("progress"), F.round(F.col("st") / 5, 4).alias("speed_m_s"))


@query(f"""WITH {TRK}, d AS (SELECT CAST(ts AS DATE) AS day, avg(v) AS m FROM trk GROUP BY 1), w AS (SELECT 1 AS g, day, m, m - lag(m) OVER (ORDER BY day) AS df, row_number() OVER (ORDER BY day) AS i FROM d)
 SELECT CAST(1 AS BIGINT) AS g, CAST(coalesce((SELECT i FROM w WHERE df <= -2 ORDER BY df, i LIMIT 1), (SELECT min(i) FROM w WHERE m <= 40)) AS BIGINT) AS drop_row""")
def drop_detect(spark, d):
    """W23."""
    days = trk(spark, d).groupBy(F.to_date("ts").alias("day")).agg(F.avg("v").alias("m")).withColumn("g", F.lit(1).cast("long"))
    return S.drop_detection(days, ["g"], ["day"], "m", 2.0, 40.0)


@query(f"""WITH {TRK}, f AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 43200000000 THEN 1 ELSE 0 END AS nw FROM trk WINDOW w AS (PARTITION BY log_id ORDER BY ts, fix_id)),
 g AS (SELECT log_id, fix_id, CAST(sum(nw) OVER (PARTITION BY log_id ORDER BY ts, fix_id) AS BIGINT) AS line_id FROM f) SELECT log_id, line_id, fix_id FROM (SELECT *, count(*) OVER (PARTITION BY log_id, line_id) AS n FROM g) WHERE n > 1""")
def gap_line_groups(spark, d):
    """W22, P18."""
    g = S.gap_sessions(trk(spark, d), ["log_id"], "ts", ["ts", "fix_id"], 12 * 3600, "line_id")
    return g.withColumn("n", F.count(F.lit(1)).over(S.Window.partitionBy("log_id", "line_id"))).where("n > 1").select("log_id", "line_id", "fix_id")


@query(f"""WITH {TRK}, q AS (SELECT log_id, count(*) AS n, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3, quantile_cont(v, 0.01) AS p1, quantile_cont(v, 0.99) AS p99 FROM trk GROUP BY log_id),
 a AS (SELECT trk.log_id, fix_id, v, n, p1, p99, v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS fine FROM trk JOIN q USING (log_id)), b AS (SELECT *, sum(CASE WHEN fine THEN 0 ELSE 1 END) OVER (PARTITION BY log_id) AS outs FROM a),
 c AS (SELECT *, CASE WHEN outs = 0 AND n >= 40 THEN v BETWEEN p1 AND p99 ELSE fine END AS ok FROM b), e AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY log_id) AS lft FROM c)
 SELECT log_id, fix_id, round(v, 6) AS v FROM e WHERE n < 12 OR lft < 8 OR ok""")
def iqr_edges(spark, d):
    """W24, A14."""
    return S.iqr_inliers(trk(spark, d), ["log_id"], "v").select("log_id", "fix_id", F.round("v", 6).alias("v"))


@query(f"""WITH {TRK} SELECT fix_id, round(dense_rank() OVER (ORDER BY CAST(ts AS DATE)) - 0.45 + 0.9 * (epoch_us(ts) % 86400000000) / 86400000000.0, 6) AS axis FROM trk""")
def compact_axis(spark, d):
    """W25."""
    return S.compact_axis(trk(spark, d).withColumn("day", F.to_date("ts")), "day", "ts").select("fix_id", F.round("axis", 6).alias("axis"))


@query(f"""WITH {SIG}, c AS (SELECT log_id, pos, 30.0 * pos + 100.0 * v AS ch FROM sig) SELECT log_id, pos, round(ch, 4) AS chainage, coalesce(ch + 60 >= max(ch) OVER (PARTITION BY log_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS accepted FROM c""")
def backtrack_filter(spark, d):
    """W27, W28."""
    s = sig(spark, d).withColumn("chainage", 30.0 * F.col("pos") + 100.0 * F.col("v"))
    return S.not_backtracking(s, ["log_id"], ["pos"], "chainage").select("log_id", "pos", F.round("chainage", 4).alias("chainage"), "accepted")


@query(f"""WITH RECURSIVE {TRK}, o AS (SELECT log_id, fix_id, epoch_us(ts) AS t, v, row_number() OVER (PARTITION BY log_id ORDER BY ts, fix_id) AS i FROM trk),
 r AS (SELECT log_id, fix_id, i, t AS kt, v AS kv, true AS kept FROM o WHERE i = 1 UNION ALL
 SELECT o.log_id, o.fix_id, o.i, CASE WHEN o.t - r.kt >= 86400000000 OR abs(o.v - r.kv) >= 60 THEN o.t ELSE r.kt END, CASE WHEN o.t - r.kt >= 86400000000 OR abs(o.v - r.kv) >= 60 THEN o.v ELSE r.kv END,
 o.t - r.kt >= 86400000000 OR abs(o.v - r.kv) >= 60 FROM r JOIN o ON o.log_id = r.log_id AND o.i = r.i + 1) SELECT log_id, fix_id FROM r WHERE kept""")
def greedy_thin(spark, d):
    """W30, by source."""
    t = trk(spark, d).withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    return S.greedy_thin(t, ["log_id"], "t", ["fix_id", "v"], lambda a, b: F.abs(b["v"] - a["v"]) >= 60, 86_400_000_000).select("log_id", "fix_id")


@query(f"""WITH {TRK}, o AS MATERIALIZED (SELECT fix_id, epoch_us(ts) AS t, v, row_number() OVER (ORDER BY epoch_us(ts), fix_id) AS i FROM trk),
 nx AS (SELECT a.i, min(b.i) AS j FROM o a JOIN o b ON b.i > a.i AND (b.t - a.t >= 600000000 OR abs(b.v - a.v) >= 250) GROUP BY a.i), {chain("nx")} SELECT fix_id FROM reached JOIN o USING (i)""")
def greedy_thin_global(spark, d):
    """W30, over all sources at once."""
    t = trk(spark, d).withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    return N.thin_all(t, "t", ["fix_id"], ["v"], lambda a, b: abs(b["v"] - a["v"]) >= 250, 600_000_000).select("fix_id")


@query("""WITH n AS (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber) AS i, count(*) OVER () AS n FROM lineitem), k AS (SELECT DISTINCT CAST(round_even(1 + g * (n - 1) / 499.0, 0) AS BIGINT) AS i FROM (SELECT max(n) AS n FROM n), range(500) t(g))
 SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber FROM n JOIN k USING (i)""")
def systematic_sample(spark, d):
    """Within one sequence, here all lines."""
    rows = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"))
    return S.systematic_sample(rows, ["l_orderkey", "l_linenumber"], 500)


@query(f"""WITH {TRK}, w AS (SELECT *, CAST(ts AS DATE) AS day, count(*) OVER (PARTITION BY CAST(ts AS DATE), log_id) AS n, min(ts) OVER (PARTITION BY CAST(ts AS DATE), log_id) AS f, max(ts) OVER (PARTITION BY CAST(ts AS DATE), log_id) AS l FROM trk)
 SELECT log_id, fix_id, CASE WHEN n = 1 THEN CASE WHEN extract(hour FROM ts) < 14 THEN 'to_uni' ELSE 'from_uni' END WHEN epoch_us(ts) - epoch_us(f) <= epoch_us(l) - epoch_us(ts) THEN 'to_uni' ELSE 'from_uni' END AS direction FROM w""")
def direction_rule(spark, d):
    """Nearer the day's first or last; alone, before or after two."""
    w = S.Window.partitionBy("log_id", F.to_date("ts"))
    t = S.micros(F.col("ts"))
    rows = trk(spark, d).withColumn("t", t).withColumn("n", F.count(F.lit(1)).over(w)).withColumn("f", F.min("t").over(w)).withColumn("l", F.max("t").over(w))
    early = F.when(F.col("n") == 1, F.hour("ts") < 14).otherwise(F.col("t") - F.col("f") <= F.col("l") - F.col("t"))
    return rows.select("log_id", "fix_id", F.when(early, "to_uni").otherwise("from_uni").alias("direction"))


@query(f"""WITH {TRK}, l AS (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS dt, abs(k - lag(k) OVER w) AS dk FROM trk WINDOW w AS (PARTITION BY log_id ORDER BY ts, fix_id)) SELECT log_id, coalesce(bool_or(dt > 0 AND dt <= 36000000000 AND dk >= 50), false) AS swings FROM l GROUP BY log_id""")
def swing_signature(spark, d):
    """W21."""
    w = S.over(["log_id"], ["ts", "fix_id"])
    t = trk(spark, d)
    dt = S.micros(F.col("ts")) - F.lag(S.micros(F.col("ts"))).over(w)
    t = t.withColumn("hit", (dt > 0) & (dt <= 36_000_000_000) & (F.abs(F.col("k") - F.lag("k").over(w)) >= 50))
    return t.groupBy("log_id").agg(F.coalesce(F.bool_or("hit"), F.lit(False)).alias("swings"))


@query(f"""WITH {SIG}, a AS (SELECT *, v < 0 AS st, lag(v < 0) OVER (PARTITION BY log_id ORDER BY pos) AS ps FROM sig), b AS (SELECT *, sum(CASE WHEN ps IS NULL OR ps <> st THEN 1 ELSE 0 END) OVER (PARTITION BY log_id ORDER BY pos) AS run FROM a),
 e AS (SELECT log_id, run, min(pos) AS first_pos, max(pos) AS last_pos, count(*) * 5 AS dwell_s, (min(pos) + max(pos)) / 126.0 AS center FROM b WHERE st GROUP BY ALL) SELECT log_id, first_pos, last_pos, CAST(dwell_s AS BIGINT) AS dwell_s, round(center, 6) AS center FROM e WHERE dwell_s BETWEEN 10 AND 240 AND center BETWEEN 0.03 AND 0.97""")
def stop_events(spark, d):
    """W31."""
    w = S.over(["log_id"], ["pos"])
    a = sig(spark, d).withColumn("st", F.col("v") < 0)
    a = a.withColumn("turn", F.when(F.coalesce(F.lag("st").over(w) != F.col("st"), F.lit(True)), 1).otherwise(0))
    a = a.withColumn("run", F.sum("turn").over(w)).where("st")
    e = a.groupBy("log_id", "run").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), (F.count(F.lit(1)) * 5).alias("dwell_s"))
    e = e.withColumn("center", (F.col("first_pos") + F.col("last_pos")) / 126.0)
    return e.where("dwell_s BETWEEN 10 AND 240 AND center BETWEEN 0.03 AND 0.97").select("log_id", "first_pos", "last_pos", "dwell_s", F.round("center", 6).alias("center"))


# Traces of bike rides on the way to (even) and from (odd) somewhere, of which every ninth is a walk, every thirteenth short; speeds are drawn from signals.
RIDES = f"""{SIG}, rd AS (SELECT log_id AS trace, pos, CASE WHEN log_id % 9 = 8 THEN 'foot trip' WHEN log_id % 2 = 0 THEN 'bike to uni' ELSE 'from uni bike' END AS route, pos * 5 - (pos % 16 = 7)::INTEGER * 5 AS t, 52.4::DOUBLE + 0.0004::DOUBLE * pos / (CASE WHEN log_id % 13 = 5 THEN 10 ELSE 1 END) AS lat, 13.3::DOUBLE AS lon, CASE WHEN (pos + log_id) % 25 = 3 THEN 1 ELSE 3 END AS gm, CASE WHEN pos % 10 <> 9 THEN greatest(0, v * 25 + 1) END AS sp FROM sig)"""
TRAINED = f"""{RIDES}, q0 AS (SELECT *, CASE WHEN lag(lat) OVER w IS NOT NULL THEN {hav('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} END AS leg FROM rd WHERE gm >= 2 AND route <> 'foot trip' WINDOW w AS (PARTITION BY trace ORDER BY pos)), q1 AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY trace) AS n, sum(leg) OVER (PARTITION BY trace) AS m FROM q0) WHERE n >= 15 AND m >= 800),
 q2 AS (SELECT * EXCLUDE (leg, n, m, rn) FROM (SELECT *, row_number() OVER (PARTITION BY trace, t ORDER BY pos) AS rn FROM q1) WHERE rn = 1), q3 AS (SELECT *, CASE WHEN lag(lat) OVER w IS NOT NULL THEN {hav('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} END AS st, t - lag(t) OVER w AS dt FROM q2 WINDOW w AS (PARTITION BY trace ORDER BY t)),
 q4 AS (SELECT *, sum(coalesce(st, 0)) OVER (PARTITION BY trace ORDER BY t) AS cum FROM q3), q5 AS (SELECT *, cum / max(cum) OVER (PARTITION BY trace) AS rel, CASE WHEN sp BETWEEN 0 AND 35 THEN sp ELSE st / dt END AS speed, count(*) OVER (PARTITION BY trace) AS n5 FROM q4), tr AS MATERIALIZED (SELECT * FROM q5 WHERE n5 >= 15),
 sd AS MATERIALIZED (SELECT greatest(0.45::DOUBLE, least(1.6::DOUBLE, quantile_cont(speed, 0.2))) AS stand, count(speed) AS n FROM tr WHERE speed BETWEEN 0 AND 35),
 sm AS (SELECT *, quantile_cont(speed, 0.5) OVER w AS med, count(speed) OVER w AS cnt FROM tr WINDOW w AS (PARTITION BY trace ORDER BY t ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING)),
 sk AS (SELECT sm.*, speed IS NOT NULL AND ((cnt >= 7 AND med <= greatest(stand, 0.8)) OR speed <= stand) AS stands FROM sm, sd), tn AS (SELECT *, CASE WHEN lag(stands) OVER w = stands THEN 0 ELSE 1 END AS fresh FROM sk WINDOW w AS (PARTITION BY trace ORDER BY t)), rn AS (SELECT *, sum(fresh) OVER (PARTITION BY trace ORDER BY t) AS run FROM tn),
 ev AS MATERIALIZED (SELECT trace, CASE WHEN trace % 2 = 0 THEN 'to_uni_bike' ELSE 'from_uni_bike' END AS cls, quantile_cont(rel, 0.5) AS c, CAST(max(t) - min(t) AS DOUBLE) AS dw FROM rn WHERE stands GROUP BY trace, run HAVING max(t) - min(t) BETWEEN 8 AND 240 AND quantile_cont(rel, 0.5) BETWEEN 0.03 AND 0.97)"""


def _rides(spark, d):
    g, pos = F.col("log_id"), F.col("pos")
    route = F.when(g % 9 == 8, "foot trip").when(g % 2 == 0, "bike to uni").otherwise("from uni bike")
    return sig(spark, d).select(
        g.alias("trace"), "pos", route.alias("route"), F.timestamp_seconds(pos * 5 - F.when(pos % 16 == 7, 5).otherwise(0)).alias("ts"), (52.4 + 0.0004 * pos / F.when(g % 13 == 5, 10).otherwise(1)).alias("lat"), F.lit(13.3).alias("lon"),
        F.when((pos + g) % 25 == 3, 1).otherwise(3).alias("gps_mode"), F.when(pos % 10 != 9, F.greatest(F.lit(0.0), F.col("v") * 25 + 1)).alias("speed"))


@query(f"""WITH RECURSIVE {TRAINED}, o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY c, dw) AS i FROM ev), fd AS (SELECT cls, i, CAST(0 AS BIGINT) AS grp, c AS total, CAST(1 AS BIGINT) AS n FROM o WHERE i = 1 UNION ALL
 SELECT o.cls, o.i, CASE WHEN abs(o.c - fd.total / fd.n) <= 0.035 THEN grp ELSE grp + 1 END, CASE WHEN abs(o.c - fd.total / fd.n) <= 0.035 THEN total + o.c ELSE o.c END, CASE WHEN abs(o.c - fd.total / fd.n) <= 0.035 THEN n + 1 ELSE 1 END FROM fd JOIN o ON o.cls = fd.cls AND o.i = fd.i + 1),
 cg AS (SELECT fd.cls, grp, avg(o.c) AS mid, quantile_cont(o.dw, 0.5) AS dw, count(*) AS n FROM fd JOIN o ON o.cls = fd.cls AND o.i = fd.i GROUP BY fd.cls, grp HAVING count(*) >= 2),
 cn AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY mid) AS i, count(*) OVER (PARTITION BY cls) AS m FROM cg), ck AS (SELECT * FROM cn WHERE m <= 18 OR round_even(1 + floor((i - 1) / ((m - 1) / 17.0::DOUBLE)) * ((m - 1) / 17.0::DOUBLE), 0) = i OR round_even(1 + (floor((i - 1) / ((m - 1) / 17.0::DOUBLE)) + 1) * ((m - 1) / 17.0::DOUBLE), 0) = i),
 md AS (SELECT cls, list_sort(list(mid)) AS hs, quantile_cont(dw, 0.5) AS dw FROM ck GROUP BY cls), en AS (SELECT cls, count(*) AS n FROM ev GROUP BY cls), fn AS (SELECT CASE WHEN trace % 2 = 0 THEN 'to_uni_bike' ELSE 'from_uni_bike' END AS cls, count(DISTINCT trace) AS f FROM tr GROUP BY 1)
 SELECT cls AS route_class, 'training_route_specific' AS source, round(dw, 6) AS dwell_s, len(hs) AS n_hotspots, round(list_sum(hs), 4) AS total, en.n AS raw_stop_events_n, f AS files_n FROM md JOIN en USING (cls) JOIN fn USING (cls)
 UNION ALL SELECT replace(cls, '_bike', '_opnv'), 'bike_template_for_opnv', round(dw * 0.6::DOUBLE, 6), len(hs), round(list_sum(hs), 4), 0, 0 FROM md""")
def trained_stops(spark, d):
    """Stops learnt from rides both ways."""
    model, _ = T.trained_stops(_rides(spark, d), ["trace"], "pos")
    total = F.aggregate("hotspots", F.lit(0.0), lambda a, x: a + x)
    return model.select("route_class", "source", F.round("dwell_s", 6).alias("dwell_s"), F.size("hotspots").cast("long").alias("n_hotspots"), F.round(total, 4).alias("total"), "raw_stop_events_n", "files_n")


@query(f"WITH {TRAINED} SELECT trace, cls AS route_class, round(c, 6) AS center_rel, round(dw, 6) AS dwell_s FROM ev")
def trained_events(spark, d):
    """The stops of rides, by the speed up to which one stands."""
    rows = T.training_traces(_rides(spark, d), ["trace"], "pos")
    stand = A.stop_speed(rows, "speed_m_s").select("stand_mps")
    held = T.smoothed(rows, ["trace"]).join(F.broadcast(stand))  # one row
    out = T.stop_events(held, ["trace"], F.col("stand_mps"))
    return out.select("trace", "route_class", F.round("center_rel", 6).alias("center_rel"), F.round("dwell_s", 6).alias("dwell_s"))


@query(f"WITH {TRAINED} SELECT trace, pos, round(rel, 6) AS progress_rel, round(speed, 4) AS speed_m_s FROM tr")
def training_traces(spark, d):
    """The rides that stops are learnt from."""
    return T.training_traces(_rides(spark, d), ["trace"], "pos").select("trace", "pos", F.round("progress_rel", 6).alias("progress_rel"), F.round("speed_m_s", 4).alias("speed_m_s"))
