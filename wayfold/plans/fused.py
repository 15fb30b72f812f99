"""Queries of composite operators."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from wayfold.functions import geo
from wayfold.operators import aggregates as A
from wayfold.operators import fusion as X
from wayfold.operators import heatmap as H
from wayfold.operators import loading as O
from wayfold.operators import sequences as S
from wayfold.plans.adapters import PL, PLANE, SIG, STN, TRK, chain, hav, pl, plane, sig, stn, table, trk
from wayfold.plans.matching import PROJ, PROJECTED, _edges

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"""WITH {SIG}, a AS (SELECT *, coalesce(v < lag(v) OVER w, false) AS dr, coalesce(v > lag(v) OVER w, false) AS up FROM sig WINDOW w AS (PARTITION BY log_id ORDER BY pos)),
 b AS (SELECT *, pos - max(CASE WHEN NOT dr THEN pos END) OVER (PARTITION BY log_id ORDER BY pos) AS streak FROM a),
 c AS (SELECT log_id, coalesce(min(CASE WHEN streak >= 3 AND pos < 32 THEN pos - 2 END), 0) AS s, coalesce(max(CASE WHEN up AND pos >= 32 THEN pos + 1 END), 0) AS e FROM b GROUP BY log_id),
 k AS (SELECT sig.* FROM sig JOIN c USING (log_id) WHERE pos >= s AND (e <= s OR pos < e)), m AS (SELECT *, min(pos) OVER (PARTITION BY log_id) AS f FROM k)
 SELECT log_id, pos, round(v, 6) AS v FROM m WHERE (pos - f) * 5 <= 200""")
def crop_pipeline(spark, d):
    """C11, P1, P13, W2 to W5."""
    s = sig(spark, d).withColumn("ts", F.timestamp_seconds(F.col("pos") * 5))
    return X.cropped_logs(s, ["log_id"], "pos", "ts", "v", 30, 3, 200.0, zone=0.5).select("log_id", "pos", F.round("v", 6).alias("v"))


NETWORK = f"""{TRK}, p AS (SELECT *, CAST(52.3 + (k * 13 % 100) / 250.0 AS DOUBLE) AS lat, CAST(13.1 + (k * 37 % 100) / 150.0 AS DOUBLE) AS lon FROM trk), {STN},
 near AS (SELECT log_id, fix_id, ts, v, station_id, radius_m, {hav('lat', 'lon', 's_lat', 's_lon')} AS m FROM p CROSS JOIN stn), hit AS (SELECT *, date_trunc('hour', ts) AS hour FROM near WHERE m <= radius_m),
 hourly AS (SELECT s_suppkey AS station_id, date_trunc('hour', ts) AS station_hour, round(avg(value), 6) AS pm FROM events JOIN supplier ON s_suppkey % 10 = event_id % 10 GROUP BY ALL)"""


@query(f"""WITH {NETWORK} SELECT hit.log_id, hit.station_id, hit.fix_id, round(m, 4) AS distance_m, pm, CAST(dense_rank() OVER (PARTITION BY log_id, hit.station_id ORDER BY CAST(ts AS DATE)) AS BIGINT) AS pass_id,
 CAST(row_number() OVER (PARTITION BY log_id, hit.station_id, CAST(ts AS DATE) ORDER BY ts, fix_id) AS BIGINT) AS pass_row_index FROM hit LEFT JOIN hourly ON hourly.station_id = hit.station_id AND station_hour = hour""")
def station_match(spark, d):
    """C12, J1, J4, W6."""
    t = trk(spark, d).withColumn("lat", 52.3 + (F.col("k") * 13 % 100) / 250.0).withColumn("lon", 13.1 + (F.col("k") * 37 % 100) / 150.0)
    e = table(spark, d, "events").select("ts", "value", (F.col("event_id") % 10).alias("m"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("station_id"), (F.col("s_suppkey") % 10).alias("m"))
    means = e.groupBy("m", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("station_hour")).agg(F.round(F.avg("value"), 6).alias("pm"))
    hourly = means.join(s, "m").select("station_id", "station_hour", "pm")
    out = X.matched_passes(t, stn(spark, d), hourly, ["log_id"], "ts", ["ts", "fix_id"], "lat", "lon", 3000.0)
    return out.select("log_id", "station_id", "fix_id", F.round("distance_m", 4).alias("distance_m"), "pm", "pass_id", "pass_row_index")


@query(f"""WITH {PROJECTED}, j AS (SELECT pr.*, t.ts, CASE WHEN k % 11 <> 0 THEN k % 4 END AS gm, k * 3.0::DOUBLE AS eph FROM pr JOIN trk t USING (log_id, fix_id)),
 g AS (SELECT *, greatest(55, least(250, 3.5 * coalesce(eph, 120))) AS allowed, CASE WHEN gm IS NULL OR gm < 2 THEN 'gps_mode_below_fix_threshold' WHEN eph > 250 THEN 'eph_above_hard_threshold' WHEN dist > greatest(55, least(250, 3.5 * coalesce(eph, 120))) THEN 'too_far_from_baseline' END AS gate FROM j),
 b AS (SELECT *, max(CASE WHEN gate IS NULL THEN chain END) OVER (PARTITION BY log_id ORDER BY ts, fix_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM g),
 r AS (SELECT *, coalesce(gate, CASE WHEN coalesce(chain + 60 < far, false) THEN 'backtracking_against_segment_direction' END, CASE WHEN dist > 20 THEN 'accepted_projected_to_baseline' ELSE 'accepted_raw' END) AS reason FROM b)
 SELECT log_id, fix_id, CASE WHEN starts_with(reason, 'accepted') THEN 'accepted' ELSE 'rejected' END AS status, reason, round(allowed, 4) AS allowed_distance_m, round(CASE WHEN gm >= 3 THEN 1.25 WHEN gm = 2 THEN 1.0 ELSE 0.0 END / (1 + greatest(eph, 1) / 25.0), 6) AS quality_weight,
 round(CASE WHEN starts_with(reason, 'accepted') THEN CASE WHEN dist > 20 THEN nx ELSE px END END, 3) AS adjusted_x, round(CASE WHEN starts_with(reason, 'accepted') THEN CASE WHEN dist > 20 THEN ny ELSE py END END, 3) AS adjusted_y, round(CASE WHEN starts_with(reason, 'accepted') THEN chain END, 3) AS adjusted_chainage_m FROM r""")
def fix_evaluation(spark, d):
    """Fixes judged, and moved onto their line where they are away from it."""
    k = F.col("k")
    t = trk(spark, d).select("log_id", "fix_id", "ts", (63.0 * k).alias("px"), (25.0 * (k % 7) - 60.0).alias("py"), F.when(k % 11 != 0, k % 4).alias("gm"), (k * 3.0).alias("eph"))
    out = X.judged_fixes(t, _edges(spark, d), ["log_id"], "fix_id", "px", "py", ["ts", "fix_id"], "gm", "eph")
    return out.select("log_id", "fix_id", "status", "reason", F.round("allowed_distance_m", 4).alias("allowed_distance_m"), F.round("quality_weight", 6).alias("quality_weight"), *[F.round(c, 3).alias(c) for c in ("adjusted_x", "adjusted_y", "adjusted_chainage_m")])


ANCHORS = f"{TRK}, an AS (SELECT log_id, t, c FROM (SELECT log_id, epoch_us(ts) // 60000000 AS t, 40.0 * k AS c, row_number() OVER (PARTITION BY log_id, epoch_us(ts) // 60000000 ORDER BY CASE mode WHEN 'click' THEN 3 WHEN 'view' THEN 2 ELSE 1 END DESC, k DESC) AS rn FROM trk) WHERE rn = 1)"


def _anchors(spark, d):
    t = trk(spark, d).withColumn("t", F.floor(S.micros(F.col("ts")) / 60_000_000).cast("long")).withColumn("c", 40.0 * F.col("k"))
    rank = F.when(F.col("mode") == "click", 3).when(F.col("mode") == "view", 2).otherwise(1)
    return X.collapsed_anchors(t, ["log_id"], "t", rank, "c").select("log_id", "t", "c")


@query(f"""WITH {ANCHORS}, l AS (SELECT *, lead(t) OVER w AS t2, lead(c) OVER w AS c2 FROM an WINDOW w AS (PARTITION BY log_id ORDER BY t)), g AS (SELECT *, unnest(range(CAST(ceil(t / 60.0) AS BIGINT), CAST(floor((t2 - 1) / 60.0) AS BIGINT) + 1)) * 60 AS grid_t FROM l WHERE t2 IS NOT NULL),
 m AS (SELECT *, least(t2 - t, abs(c2 - c) / 5.5::DOUBLE * 1.2::DOUBLE) AS moving FROM g), f AS (SELECT *, CASE WHEN moving <= 0 THEN CASE WHEN grid_t - t >= t2 - t THEN 1.0 ELSE 0.0 END ELSE (grid_t - t - (t2 - t - moving) / 2) / moving END AS share FROM m)
 SELECT log_id, grid_t, round(c + sign(c2 - c) * abs(c2 - c) * greatest(0, least(1, share)), 4) AS chainage_m FROM f""")
def interpolated_track(spark, d):
    """Chainage each hour between anchors, in minutes, without stops."""
    out = X.interpolated(_anchors(spark, d), ["log_id"], "t", "c", F.lit(5.5), 60)
    return out.select("log_id", "grid_t", F.round("chainage_m", 4).alias("chainage_m"))


@query(f"""WITH RECURSIVE {TRK}, o AS (SELECT log_id, CAST(k AS DOUBLE) AS x, row_number() OVER (PARTITION BY log_id ORDER BY k) AS i FROM trk),
 r AS (SELECT log_id, i, CAST(0 AS BIGINT) AS cluster, x AS total, CAST(1 AS BIGINT) AS n FROM o WHERE i = 1 UNION ALL
 SELECT o.log_id, o.i, CASE WHEN abs(o.x - r.total / r.n) <= 3 THEN r.cluster ELSE r.cluster + 1 END, CASE WHEN abs(o.x - r.total / r.n) <= 3 THEN r.total + o.x ELSE o.x END, CASE WHEN abs(o.x - r.total / r.n) <= 3 THEN r.n + 1 ELSE 1 END FROM r JOIN o ON o.log_id = r.log_id AND o.i = r.i + 1)
 SELECT log_id, cluster, round(max(total) / max(n), 6) AS center, max(n) AS n FROM r GROUP BY ALL HAVING max(n) >= 2""")
def greedy_clusters(spark, d):
    """W32."""
    return X.greedy_clusters(trk(spark, d), ["log_id"], "k", 3.0).select("log_id", "cluster", F.round("center", 6).alias("center"), "n")


@query(f"""WITH {PLANE}, a AS (SELECT *, x - lag(x) OVER w AS ix, y - lag(y) OVER w AS iy, lead(x) OVER w - x AS ox, lead(y) OVER w - y AS oy FROM plane WINDOW w AS (PARTITION BY log_id ORDER BY pos)),
 u AS (SELECT *, coalesce(ix / sqrt(ix * ix + iy * iy), 0) + coalesce(ox / sqrt(ox * ox + oy * oy), 0) AS tx, coalesce(iy / sqrt(ix * ix + iy * iy), 0) + coalesce(oy / sqrt(ox * ox + oy * oy), 0) AS ty FROM a)
 SELECT log_id, pos, round(x + 3 * -ty / sqrt(tx * tx + ty * ty), 4) AS off_x, round(y + 3 * tx / sqrt(tx * tx + ty * ty), 4) AS off_y FROM u""")
def offset_path(spark, d):
    """F37."""
    return X.offset_path(plane(spark, d), ["log_id"], "pos", "x", "y").select("log_id", "pos", F.round("off_x", 4).alias("off_x"), F.round("off_y", 4).alias("off_y"))


@query(f"""WITH {TRK}, r AS (SELECT mode, min(v) AS lo, quantile_cont(v, 0.9) AS hi FROM trk GROUP BY mode) SELECT fix_id, CAST(floor(greatest(0, least(1, (v - lo) / (hi - lo))) * 255) AS BIGINT) AS color FROM trk JOIN r USING (mode)""")
def palette(spark, d):
    """F38, A8."""
    t = trk(spark, d)
    low = t.groupBy("mode").agg(F.min("v").alias("lo"))
    r = A.quantiles(t, ["mode"], "v", [0.9]).select("mode", F.get("q", F.lit(0)).alias("hi")).join(low, "mode")
    return t.join(F.broadcast(r), "mode").select("fix_id", X.palette_index(F.col("v"), F.col("lo"), F.col("hi")).alias("color"))


def _files_sql(match: str) -> str:
    return f"""WITH {TRK}, rw AS MATERIALIZED (SELECT p || log_id AS sf, log_id AS g, p, fix_id AS pos, CASE WHEN log_id % 20 <> 13 THEN ts + to_seconds(CASE WHEN p = 'g' THEN 2 ELSE 0 END) + to_days(CASE WHEN log_id % 11 = 7 THEN 60 ELSE 0 END) END AS ts, CASE WHEN log_id % 10 <> 3 THEN 52.3 + (k * 13 % 100) / 250.0::DOUBLE END AS lat, 13.1 + (k * 37 % 100) / 150.0::DOUBLE AS lon
  FROM trk, (VALUES ('f'), ('g')) v(p) WHERE p = 'f' OR log_id % 5 = 4),
 fl0 AS (SELECT DISTINCT sf, 'n' || g % 40 AS sn, {match} AS cm, CASE WHEN g % 17 = 5 THEN 'unreadable' END AS err FROM rw), fl AS MATERIALIZED (SELECT *, NOT (SELECT bool_or(cm) FROM fl0) AS fb FROM fl0),
 ct AS MATERIALIZED (SELECT sf, count(CASE WHEN ts IS NOT NULL AND lat IS NOT NULL THEN 1 END) AS placed, count(CASE WHEN ts IS NOT NULL AND lat IS NOT NULL AND i THEN 1 END) AS placed_in, count(CASE WHEN i THEN 1 END) AS timed_in FROM (SELECT *, ts BETWEEN TIMESTAMP '2024-01-07 00:00:00' AND TIMESTAMP '2024-01-21 00:00:00' AS i FROM rw) GROUP BY sf),
 dd AS (SELECT * FROM (SELECT rw.sf, pos, ts, lat, lon, row_number() OVER (PARTITION BY ts, lat, lon, sn ORDER BY rw.sf, pos) AS rn FROM rw JOIN fl ON fl.sf = rw.sf WHERE (cm OR fb) AND err IS NULL AND lat IS NOT NULL AND ts BETWEEN TIMESTAMP '2024-01-07 00:00:00' AND TIMESTAMP '2024-01-21 00:00:00') WHERE rn = 1),
 o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY ts, sf, pos) AS i FROM dd), nx AS (SELECT a.i, min(b.i) AS j FROM o a JOIN o b ON b.i > a.i AND b.i <= a.i + 64 AND (epoch_us(b.ts) - epoch_us(a.ts) >= 15000000 OR {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} >= 10) GROUP BY a.i),
 {chain('nx')}, kp AS MATERIALIZED (SELECT sf, o.i, pos FROM reached JOIN o USING (i))"""


def _report_sql(match: str) -> str:
    return _files_sql(match) + """, ld AS (SELECT sf, count(*) AS n FROM kp GROUP BY sf), rp AS (SELECT fl.*, coalesce(placed, 0) AS placed, coalesce(placed_in, 0) AS placed_in, coalesce(timed_in, 0) AS timed_in, coalesce(n, 0) AS n FROM fl LEFT JOIN ct ON ct.sf = fl.sf LEFT JOIN ld ON ld.sf = fl.sf),
 rs AS (SELECT *, CASE WHEN NOT (cm OR fb) THEN 'excluded_by_filename_time_hints' WHEN err IS NOT NULL THEN 'parse_error' WHEN placed = 0 AND timed_in > 0 THEN 'loaded_time_only_no_valid_gps_points' WHEN placed = 0 THEN 'no_valid_timestamp_or_latlon_rows' WHEN placed_in = 0 THEN 'outside_google_time_window'
  WHEN n = 0 THEN 'dropped_during_global_deduplication' WHEN fb AND NOT cm THEN 'loaded_via_context_fallback' ELSE 'loaded_for_fusion' END AS reason FROM rp)
 SELECT sf AS source_file, CASE WHEN starts_with(reason, 'loaded') THEN 'loaded_for_fusion' ELSE 'sorted_out' END AS status, reason, cm OR fb AS selected_for_loading, CASE WHEN (cm OR fb) AND err IS NULL THEN placed ELSE 0 END AS rows_parsed, CASE WHEN (cm OR fb) AND err IS NULL THEN CASE WHEN placed = 0 THEN timed_in ELSE placed_in END ELSE 0 END AS rows_after_time_window, n AS rows_loaded FROM rs"""


def _loaded(spark, d, match):
    k, g = F.col("k"), F.col("log_id")
    t = trk(spark, d).withColumn("p", F.explode(F.when(g % 5 == 4, F.array(F.lit("f"), F.lit("g"))).otherwise(F.array(F.lit("f")))))
    shift = F.make_dt_interval(F.when(g % 11 == 7, 60).otherwise(0), F.lit(0), F.lit(0), F.when(F.col("p") == "g", 2).otherwise(0))
    rows = t.select(F.concat("p", g.cast("string")).alias("source_file"), F.col("fix_id").alias("pos"), F.when(g % 20 != 13, F.col("ts") + shift).alias("ts"), F.when(g % 10 != 3, 52.3 + (k * 13 % 100) / 250.0).alias("lat"), (13.1 + (k * 37 % 100) / 150.0).alias("lon"))
    files = t.select(F.concat("p", g.cast("string")).alias("source_file"), F.concat(F.lit("n"), (g % 40).cast("string")).alias("source_name"), match(g, F.col("p")).alias("context_match"), F.when(g % 17 == 5, "unreadable").alias("error")).distinct()
    return O.loaded_fixes(files, rows, (datetime(2024, 1, 8), datetime(2024, 1, 20)))


REPORT = ("source_file", "status", "reason", "selected_for_loading", "rows_parsed", "rows_after_time_window", "rows_loaded")


@query(_report_sql("p = 'g' OR g % 3 <> 0"))
def file_status(spark, d):
    """What became of each file: left out, unreadable, without places, outside the window, loaded or dropped."""
    return _loaded(spark, d, lambda g, p: (p == "g") | (g % 3 != 0))[1].select(*REPORT)


@query(_report_sql("g < 0"))
def file_status_fallback(spark, d):
    """The same, where no file's hints fit."""
    return _loaded(spark, d, lambda g, p: g < 0)[1].select(*REPORT)


@query(_files_sql("p = 'g' OR g % 3 <> 0") + " SELECT sf AS source_file, pos, row_number() OVER (ORDER BY i) - 1 AS fix_id FROM kp")
def loaded_fixes(spark, d):
    """The fixes of all files that are loaded, thinned as one sequence and numbered."""
    return _loaded(spark, d, lambda g, p: (p == "g") | (g % 3 != 0))[0].select("source_file", "pos", "fix_id")


@query(_report_sql("p = 'g' OR g % 3 <> 0").replace(" SELECT sf AS source_file, CASE WHEN starts_with(reason, 'loaded')", ", st AS (SELECT sf AS source_file, CASE WHEN starts_with(reason, 'loaded')") + """),
 fx AS (SELECT sf, CASE WHEN pos % 3 = 0 AND CAST(sf[2:] AS BIGINT) % 4 <> 1 THEN 'accepted' ELSE 'rejected' END AS s, CASE WHEN pos % 2 = 0 THEN 'far' ELSE 'late' END AS r FROM kp WHERE CAST(sf[2:] AS BIGINT) % 7 <> 2),
 fs AS (SELECT sf, count(*) AS n, count(CASE WHEN s = 'accepted' THEN 1 END) AS a, count(CASE WHEN s <> 'accepted' AND r = 'far' THEN 1 END) AS f, count(CASE WHEN s <> 'accepted' AND r = 'late' THEN 1 END) AS l FROM fx GROUP BY sf),
 fz AS (SELECT st.*, coalesce(n, 0) AS n, coalesce(a, 0) AS a, CASE WHEN coalesce(f + l, 0) = 0 THEN '' WHEN f >= l THEN 'far' ELSE 'late' END AS top FROM st LEFT JOIN fs ON fs.sf = st.source_file)
 SELECT source_file, status, n AS fixes_considered_n, a AS accepted_fixes_n, n - a AS rejected_fixes_n, top AS top_rejection_reason, CASE WHEN status = 'loaded_for_fusion' AND a > 0 THEN 'processed' ELSE 'sorted_out' END AS final_status,
 CASE WHEN status <> 'loaded_for_fusion' THEN reason WHEN n = 0 THEN 'no_fix_rows_reached_segment_evaluation' WHEN a = 0 THEN 'all_fixes_rejected::' || top ELSE 'accepted_fixes_used_in_fusion' END AS final_reason FROM fz""")
def file_audit(spark, d):
    """Files with what became of their fixes, where accepted ones are required."""
    fixes, report = _loaded(spark, d, lambda g, p: (p == "g") | (g % 3 != 0))
    g, pos = F.substr("source_file", F.lit(2)).cast("long"), F.col("pos")
    judged = fixes.where(g % 7 != 2).select("source_file", F.when((pos % 3 == 0) & (g % 4 != 1), "accepted").otherwise("rejected").alias("status"), F.when(pos % 2 == 0, "far").otherwise("late").alias("reason"))
    out = O.file_audit(report, judged, True)
    return out.select("source_file", "status", "fixes_considered_n", "accepted_fixes_n", "rejected_fixes_n", "top_rejection_reason", "final_status", "final_reason")


@query(f"""WITH {PROJ}, ends AS (SELECT log_id, 52.4 + min(ay) / 111320.0 AS lat1, 13.3 + min(ax) / 68000.0 AS lon1, 52.4 + max(by_) / 111320.0 AS lat2, 13.3 + max(bx) / 68000.0 AS lon2 FROM ed GROUP BY log_id),
 w AS (SELECT *, CASE WHEN log_id % 2 = 0 THEN lat1 ELSE lat2 END + 0.001 AS s_lat, CASE WHEN log_id % 2 = 0 THEN lon1 ELSE lon2 END AS s_lon, CASE WHEN log_id % 2 = 0 THEN lat2 ELSE lat1 END AS e_lat, CASE WHEN log_id % 2 = 0 THEN lon2 ELSE lon1 END AS e_lon FROM ends),
 h AS (SELECT log_id, {hav('s_lat', 's_lon', 'lat1', 'lon1')} + {hav('e_lat', 'e_lon', 'lat2', 'lon2')} AS al, {hav('s_lat', 's_lon', 'lat2', 'lon2')} + {hav('e_lat', 'e_lon', 'lat1', 'lon1')} AS ag FROM w) SELECT log_id, ag + 1e-6 < al AS reversed, round(least(al, ag), 3) AS score FROM h""")
def oriented_lines(spark, d):
    """J17."""
    e = _edges(spark, d).groupBy("log_id").agg((52.4 + F.min("ay") / 111320.0).alias("lat1"), (13.3 + F.min("ax") / 68000.0).alias("lon1"), (52.4 + F.max("by") / 111320.0).alias("lat2"), (13.3 + F.max("bx") / 68000.0).alias("lon2"))
    even = F.col("log_id") % 2 == 0
    pick = lambda a, b: F.when(even, F.col(a)).otherwise(F.col(b))
    w = e.select("log_id", (pick("lat1", "lat2") + 0.001).alias("start_lat"), pick("lon1", "lon2").alias("start_lon"), pick("lat2", "lat1").alias("end_lat"), pick("lon2", "lon1").alias("end_lon"))
    return X.oriented(e, w, ["log_id"]).select("log_id", "reversed", F.round("score", 3).alias("score"))


HEAT = f"""{PLANE}, sm AS (SELECT log_id, pos, x, y, quantile_cont(v, 0.5) OVER (PARTITION BY log_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS v FROM plane)"""


@query(f"""WITH {HEAT}, l AS (SELECT log_id, x, y, lead(x) OVER w AS xend, lead(y) OVER w AS yend, (v + lead(v) OVER w) / 2 AS value FROM sm WINDOW w AS (PARTITION BY log_id ORDER BY pos)), r AS (SELECT log_id, value, round_even(x / 180.0, 0) * 180.0 AS x, round_even(y / 180.0, 0) * 180.0 AS y, round_even(xend / 180.0, 0) * 180.0 AS xend, round_even(yend / 180.0, 0) * 180.0 AS yend FROM l WHERE xend IS NOT NULL),
 c AS (SELECT log_id, value, CASE WHEN x < xend OR (x = xend AND y <= yend) THEN x ELSE xend END AS x, CASE WHEN x < xend OR (x = xend AND y <= yend) THEN y ELSE yend END AS y, CASE WHEN x < xend OR (x = xend AND y <= yend) THEN xend ELSE x END AS xend, CASE WHEN x < xend OR (x = xend AND y <= yend) THEN yend ELSE y END AS yend FROM r WHERE x <> xend OR y <> yend)
 SELECT x + 0.0 AS x, y + 0.0 AS y, xend + 0.0 AS xend, yend + 0.0 AS yend, count(*) AS n_obs, count(DISTINCT log_id) AS n_routes, round(avg(value), 6) AS value_mean FROM c GROUP BY 1, 2, 3, 4""")
def heatmap_pipeline(spark, d):
    """Smoothing, segments and edges; W13, W16, A5."""
    p = S.rolling_median(plane(spark, d), ["log_id"], "pos", "v", name="sv")
    out = A.merged_edges(S.pairs(p, ["log_id"], "pos", "x", "y", "sv"), "log_id", 180.0)
    return out.select(*[(F.col(c) + 0.0).alias(c) for c in ("x", "y", "xend", "yend")], "n_obs", "n_routes", F.round("value_mean", 6).alias("value_mean"))


@query(f"""WITH {TRK}, q AS (SELECT log_id, fix_id, 52.3 + (k * 13 % 100) / 250.0::DOUBLE AS lat, 13.1 + (k * 37 % 100) / 150.0::DOUBLE AS lon FROM trk), b AS (SELECT *, CASE WHEN lat < 52.4 THEN 52.4 WHEN lat > 52.6 THEN 52.6 ELSE lat END AS cl, CASE WHEN lon < 13.2 THEN 13.2 WHEN lon > 13.5 THEN 13.5 ELSE lon END AS co FROM q)
 SELECT log_id, fix_id, round({hav('lat', 'lon', 'cl', 'co')}, 4) AS box_m FROM b""")
def box_prefilter(spark, d):
    """F32."""
    t = trk(spark, d).withColumn("lat", 52.3 + (F.col("k") * 13 % 100) / 250.0).withColumn("lon", 13.1 + (F.col("k") * 37 % 100) / 150.0)
    return t.select("log_id", "fix_id", F.round(geo.box_distance(F.col("lat"), F.col("lon"), F.lit(52.4), F.lit(13.2), F.lit(52.6), F.lit(13.5)), 4).alias("box_m"))


HEATMAP = f"""WITH {PL}, hf AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY log_id) AS n FROM pl WHERE NOT (log_id % 5 = 0 AND pos % 17 = 3) AND NOT (log_id % 50 = 9 AND pos > 0)) WHERE n >= 2), hi AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY pos) AS i, (n - 1) / 39.0::DOUBLE AS gap FROM hf),
 hk AS (SELECT * FROM hi WHERE n <= 40 OR round_even(1 + floor((i - 1) / gap) * gap, 0) = i OR round_even(1 + (floor((i - 1) / gap) + 1) * gap, 0) = i),
 hx AS (SELECT log_id, pos, v, quantile_cont(v, 0.5) OVER (PARTITION BY log_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS sm, 6378137.0 * radians(lon) AS x, 6378137.0 * ln(tan(pi() / 4 + radians(lat) / 2)) AS y FROM hk),
 hs AS (SELECT *, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS st FROM hx WINDOW w AS (PARTITION BY log_id ORDER BY pos)), hq AS (SELECT log_id, count(CASE WHEN st > 0 THEN 1 END) AS c, quantile_cont(CASE WHEN st > 0 THEN st END, 0.9) AS p9, quantile_cont(CASE WHEN st > 0 THEN st END, 0.5) AS p5 FROM hs GROUP BY log_id),
 hb AS MATERIALIZED (SELECT hs.*, 1 + sum(CASE WHEN st > CASE WHEN c >= 8 THEN least(greatest(80, 3 * p9, 8 * p5), 640) ELSE 80 END THEN 1 ELSE 0 END) OVER (PARTITION BY hs.log_id ORDER BY pos) AS sub FROM hs JOIN hq USING (log_id)),
 he AS MATERIALIZED (SELECT * FROM (SELECT log_id, sub, pos, x AS ax, y AS ay, lead(x) OVER w AS bx, lead(y) OVER w AS by_, sm, lead(sm) OVER w AS sm2 FROM hb WINDOW w AS (PARTITION BY log_id, sub ORDER BY pos)) WHERE bx IS NOT NULL),
 hm AS (SELECT *, sqrt(pow(bx - ax, 2) + pow(by_ - ay, 2)) AS em FROM he), hl AS MATERIALIZED (SELECT * FROM (SELECT log_id, sub, sum(em) AS len, row_number() OVER (PARTITION BY log_id ORDER BY sum(em) DESC, sub) AS rn FROM hm GROUP BY log_id, sub) WHERE rn = 1),
 hc AS MATERIALIZED (SELECT hm.*, len, coalesce(sum(em) OVER (PARTITION BY hm.log_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum FROM hm JOIN hl ON hl.log_id = hm.log_id AND hl.sub = hm.sub),
 ht AS (SELECT hb.log_id, hb.pos, hb.v, hc.pos AS edge, x, y, ax, ay, bx, by_, em, cum, len, CASE WHEN em <= 1e-6 THEN 0 ELSE least(1, greatest(0, ((x - ax) * (bx - ax) + (y - ay) * (by_ - ay)) / (em * em))) END AS t FROM hb JOIN hc ON hc.log_id = hb.log_id),
 hp AS (SELECT * FROM (SELECT log_id, pos, v, len, cum + t * em AS chain, row_number() OVER (PARTITION BY log_id, pos ORDER BY sqrt(pow(x - ax - t * (bx - ax), 2) + pow(y - ay - t * (by_ - ay), 2)), edge) AS rn FROM ht) WHERE rn = 1),
 bn AS MATERIALIZED (SELECT log_id, CAST(least(floor(chain / 200.0), greatest(ceil(len / 200.0), 1) - 1) AS BIGINT) AS segment_index, count(*) AS n_points, avg(v) AS mean FROM hp GROUP BY ALL)"""


def _heatmap(spark, d):
    g, pos = F.col("log_id"), F.col("pos")
    t = pl(spark, d).withColumn("lat", F.when((g % 5 == 0) & (pos % 17 == 3), float("nan")).otherwise(F.col("lat"))).withColumn("lon", F.when(~((g % 50 == 9) & (pos > 0)), F.col("lon")))
    return H.heatmap(t, ["log_id"], "pos", "lat", "lon", "v", 3857, 2, 40, 200.0, 180.0)


@query(HEATMAP + " SELECT log_id, segment_index, n_points, round(mean, 6) AS v_mean, CAST(floor((mean - lo) / (hi - lo) * 255) AS BIGINT) AS color FROM bn, (SELECT min(mean) AS lo, max(mean) AS hi FROM bn)")
def heatmap_bins(spark, d):
    """Coloured stretches of routes, from places in one run."""
    return _heatmap(spark, d).bins.select("log_id", "segment_index", "n_points", F.round("v_mean", 6).alias("v_mean"), "color")


@query(HEATMAP + """, rr AS (SELECT log_id, coalesce((sm + sm2) / 2, sm, sm2) AS value, round_even(ax / 180.0, 0) * 180.0 AS x, round_even(ay / 180.0, 0) * 180.0 AS y, round_even(bx / 180.0, 0) * 180.0 AS xend, round_even(by_ / 180.0, 0) * 180.0 AS yend FROM he),
 rc AS (SELECT log_id, value, CASE WHEN x < xend OR (x = xend AND y <= yend) THEN x ELSE xend END AS x, CASE WHEN x < xend OR (x = xend AND y <= yend) THEN y ELSE yend END AS y, CASE WHEN x < xend OR (x = xend AND y <= yend) THEN xend ELSE x END AS xend, CASE WHEN x < xend OR (x = xend AND y <= yend) THEN yend ELSE y END AS yend FROM rr WHERE x <> xend OR y <> yend),
 rg AS MATERIALIZED (SELECT x, y, xend, yend, count(*) AS n_obs, count(DISTINCT log_id) AS n_routes, avg(value) AS m FROM rc GROUP BY 1, 2, 3, 4)
 SELECT x + 0.0 AS x, y + 0.0 AS y, xend + 0.0 AS xend, yend + 0.0 AS yend, n_obs, n_routes, round(m, 6) AS value_mean, CAST(floor((m - lo) / (hi - lo) * 255) AS BIGINT) AS color FROM rg, (SELECT min(m) AS lo, max(m) AS hi FROM rg)""")
def heatmap_edges(spark, d):
    """Coloured undirected edges of all routes, from the same run."""
    return _heatmap(spark, d).edges.select(*[(F.col(c) + 0.0).alias(c) for c in ("x", "y", "xend", "yend")], "n_obs", "n_routes", F.round("value_mean", 6).alias("value_mean"), "color")


@query(HEATMAP + """ SELECT hb.log_id, count(*) AS n_points, round(avg(v), 6) AS overall_mean, round(quantile_cont(v, 0.5), 6) AS overall_median, CAST(4326 AS INTEGER) AS epsg, round(any_value(len), 3) AS route_length_m, any_value(c) AS n_bins
 FROM hb LEFT JOIN hl ON hl.log_id = hb.log_id LEFT JOIN (SELECT log_id, count(*) AS c FROM bn GROUP BY log_id) b ON b.log_id = hb.log_id GROUP BY hb.log_id""")
def heatmap_routes(spark, d):
    """A row for each route of the run."""
    rounded = ("overall_mean", "overall_median")
    return _heatmap(spark, d).routes.select("log_id", "n_points", *[F.round(c, 6).alias(c) for c in rounded], "epsg", F.round("route_length_m", 3).alias("route_length_m"), "n_bins")
