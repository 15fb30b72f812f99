"""Queries of parsing, naming and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold.functions import parse as P
from wayfold.operators import sequences as S
from wayfold.plans.adapters import TRK, table, trk

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"""WITH {TRK}, t AS (SELECT fix_id, CASE fix_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') WHEN 1 THEN strftime(ts, '%d.%m.%Y %H:%M') WHEN 2 THEN strftime(ts, '%Y-%m-%d') ELSE 'n/a' END AS txt, CASE WHEN fix_id % 5 = 0 THEN CAST(fix_id * 1.5 AS VARCHAR) END AS unix FROM trk)
 SELECT fix_id, round(coalesce(try_cast(unix AS DOUBLE), epoch_us(coalesce(try_strptime(txt, '%Y-%m-%dT%H:%M:%S'), try_strptime(txt, '%d.%m.%Y %H:%M'), try_strptime(txt, '%Y-%m-%d'))) / 1e6), 3) AS t FROM t""")
def coalesce_time(spark, d):
    """Seconds from a number or from texts of several formats."""
    ts = F.col("ts")
    txt = F.when(F.col("fix_id") % 4 == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")).when(F.col("fix_id") % 4 == 1, F.date_format(ts, "dd.MM.yyyy HH:mm")).when(F.col("fix_id") % 4 == 2, F.date_format(ts, "yyyy-MM-dd")).otherwise("n/a")
    unix = F.when(F.col("fix_id") % 5 == 0, (F.col("fix_id") * 1.5).cast("string"))
    return trk(spark, d).select("fix_id", F.round(P.epoch_seconds(unix, txt), 3).alias("t"))


CLASS_TEXTS = ("to-uni bike", "From my Uni, public", "logs/2024/uni_to_CYCLING.v2.csv", "TO UNI by rad", "from uni to home opnv", "unicorn into PT", "OePNV: home", "", "trip.from__uni__bike")
TOKEN = "regexp_replace(regexp_replace(lower(trim({0})), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"
STEM = "regexp_replace(regexp_extract(trim({0}), '([^/]*)$', 1), '(.)\\.[^.]+$', '\\1')"


@query(f"""WITH t AS (SELECT c_custkey, {list(CLASS_TEXTS)}[CAST(c_custkey % {len(CLASS_TEXTS)} AS INTEGER) + 1] AS txt FROM customer), n AS (SELECT c_custkey, txt, {TOKEN.format(STEM.format('txt'))} AS s, {TOKEN.format('txt')} AS w FROM t),
 k AS (SELECT c_custkey, w, CASE WHEN contains(s, 'from') AND contains(s, 'uni') THEN 'from_uni' WHEN contains(s, 'to') AND contains(s, 'uni') THEN 'to_uni' END AS a, CASE WHEN contains(s, 'bike') OR contains(s, 'cycling') THEN 'bike' WHEN contains(s, 'opnv') OR contains(s, 'oepnv') OR contains(s, 'public') OR contains(s, 'pt') THEN 'opnv' END AS b FROM n)
 SELECT c_custkey, a || '_' || b AS route_class, CASE b WHEN 'bike' THEN CASE WHEN a IS NOT NULL THEN 'CYCLING' END WHEN 'opnv' THEN CASE WHEN a IS NOT NULL THEN 'IN_TRAIN' END END AS mode FROM k""")
def canonical_class(spark, d):
    """the class that free text or a file's name tells, and its mode."""
    txt = F.get(F.array(*[F.lit(x) for x in CLASS_TEXTS]), (F.col("c_custkey") % len(CLASS_TEXTS)).cast("int"))
    return table(spark, d, "customer").select("c_custkey", P.route_class(txt).alias("route_class"), P.mode_of_class(txt).alias("mode"))


ROW_TEXTS = (None, "unknown", "to_uni_bike", "from uni", "public", "trip_from_uni_by_bike.csv")


@query("""WITH v AS (SELECT o_orderkey AS k, [NULL, 'unknown', 'to_uni_bike', 'from uni', 'public', 'trip_from_uni_by_bike.csv'] AS t FROM orders),
 r AS (SELECT k, t[CAST(k % 3 AS INTEGER) + 1] AS f, t[CAST(k % 5 AS INTEGER) + 2] AS n, t[CAST(k % 4 AS INTEGER) + 3] AS dd, t[CAST(k % 2 AS INTEGER) + 3] AS tr FROM v),
 c(txt, cls, dir, kind) AS (VALUES ('unknown', NULL, NULL, NULL), ('to_uni_bike', 'to_uni_bike', 'to_uni', 'bike'), ('from uni', NULL, 'from_uni', NULL), ('public', NULL, NULL, 'opnv'), ('trip_from_uni_by_bike.csv', 'from_uni_bike', 'from_uni', 'bike'))
 SELECT r.k AS o_orderkey, coalesce(a.cls, b.cls, x.dir || '_' || y.kind) AS route_class FROM r LEFT JOIN c a ON a.txt = r.f LEFT JOIN c b ON b.txt = r.n LEFT JOIN c x ON x.txt = r.dd LEFT JOIN c y ON y.txt = r.tr""")
def classified_rows(spark, d):
    """the class of a classification's row: its own, that of names, that of direction and transport."""
    k = F.col("o_orderkey")
    t = lambda i: F.get(F.array(*[F.lit(x).cast("string") for x in ROW_TEXTS]), i.cast("int"))
    return table(spark, d, "orders").select("o_orderkey", P.route_class_of_row(t(k % 3), [t(k % 5 + 1)], [t(k % 4 + 2)], [t(k % 2 + 2)]).alias("route_class"))


MODES = ("Walking", "foot", "S-Bahn", "tram", "Rail", "BUS ", "bike", "")


@query("""WITH m AS (SELECT event_id AS fix_id, CAST(event_id % 8 AS INTEGER) AS i, CAST(event_id % 11 AS INTEGER) AS j FROM events)
 SELECT fix_id, ['walk', 'walk', NULL, 'train', 'train', 'bus', NULL, NULL][i + 1] AS route_mode, ['bike', 'opnv', 'opnv', 'opnv', NULL, 'opnv', 'opnv', 'opnv', 'opnv', 'opnv', NULL][j + 1] AS transport,
 CASE WHEN j = 0 THEN 2 WHEN j IN (2, 3, 5, 6, 7, 8, 9) AND j <> 9 THEN 2 ELSE 4 END AS n_classes FROM m""")
def mode_labels(spark, d):
    """labels of stretches, and the transport and the classes that a mode allows."""
    label = F.get(F.array(*[F.lit(x) for x in MODES]), (F.col("fix_id") % 8).cast("int"))
    mode = F.get(F.array(*[F.lit(x) for x in ("cycling", "walking", "in_bus", "IN_VEHICLE", "flying", "in_tram", "IN_SUBWAY", "in_rail_vehicle", "IN_PASSENGER_VEHICLE", "running", "still")]), (F.col("fix_id") % 11).cast("int"))
    return trk(spark, d).select("fix_id", P.route_mode(label).alias("route_mode"), P.transport_of_mode(mode).alias("transport"), F.size(P.classes_of_mode(mode)).alias("n_classes"))


@query("""WITH t AS (SELECT event_id AS fix_id, CASE WHEN event_id % 13 <> 0 THEN CAST(event_id * 7 % 1100 AS INTEGER) // CASE WHEN event_id % 3 = 0 THEN 100 ELSE 1 END END AS t, ['IN_SUBWAY', 'IN_TRAM', 'IN_TRAIN', 'IN_BUS'][CAST(event_id % 4 AS INTEGER) + 1] AS m FROM events),
 r AS (SELECT *, t IN (0, 1, 2) OR t BETWEEN 100 AND 499 AS rail FROM t) SELECT fix_id, coalesce(rail, false) AS is_rail, CASE WHEN t IS NULL THEN true WHEN m = 'IN_SUBWAY' THEN t IN (1, 109) OR t BETWEEN 400 AND 499 WHEN m = 'IN_TRAM' THEN t = 0 OR t BETWEEN 900 AND 999 WHEN m = 'IN_TRAIN' THEN t IN (2, 109) OR t BETWEEN 100 AND 199 ELSE rail END AS fits FROM r""")
def route_types(spark, d):
    """rail families, and whether a route type goes with a mode."""
    k = F.col("fix_id")
    code = F.floor((k * 7 % 1100) / F.when(k % 3 == 0, 100).otherwise(1))
    text = F.when(k % 13 != 0, F.concat(code.cast("string"), F.when(k % 2 == 0, ".0").otherwise(""))).otherwise(F.when(k % 2 == 0, "n/a"))
    mode = F.get(F.array(*[F.lit(x) for x in ("IN_SUBWAY", "IN_TRAM", "IN_TRAIN", "IN_BUS")]), (k % 4).cast("int"))
    return trk(spark, d).select("fix_id", P.is_rail(P.gtfs_type(text)).alias("is_rail"), P.type_fits_mode(P.gtfs_type(text), mode).alias("fits"))


@query("""SELECT p_partkey, 10 * (CASE WHEN contains(lower(p_name), 'a') THEN 1 ELSE 0 END + CASE WHEN contains(lower(p_name || ' ' || p_type), 'steel') THEN 1 ELSE 0 END + CASE WHEN contains(lower(p_name || ' ' || p_type), 'brass') THEN 1 ELSE 0 END) AS score FROM (SELECT p_partkey, p_name, p_type FROM part)
 WHERE p_name IS NOT NULL""".replace("contains(lower(p_name), 'a')", "contains(lower(p_name || ' ' || p_type || ' '), 'a')"))
def keyword_scores(spark, d):
    """F45."""
    return table(spark, d, "part").select("p_partkey", P.keyword_score([F.col("p_name"), F.col("p_type"), F.lit(None).cast("string")], ["A", "Steel", "brass"]).alias("score"))


@query("""SELECT DISTINCT p_type AS name, regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug, lower(replace(p_type, ' ', '')) AS tight, CASE WHEN contains(lower(p_type), 'steel') THEN 'yes' ELSE 'no' END = 'yes' AS truth FROM part""")
def names_of_columns(spark, d):
    """names for comparison and for files, over the distinct types; what counts as true."""
    names = [r["p_type"] for r in table(spark, d, "part").select("p_type").distinct().collect()]  # as few as column names
    rows = [(n, P.slug(n), P.tight_name(n), "Yes" if "steel" in n.lower() else "no") for n in names]
    return spark.createDataFrame(rows, "name string, slug string, tight string, said string").withColumn("truth", P.truth(F.col("said"))).drop("said")


@query("""WITH t AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN (52 + c_custkey % 10 / 10.0) || '°, ' || (13 + c_custkey % 7 / 10.0) || '°' WHEN 1 THEN '-33.5, +151.25' ELSE 'unknown' END AS txt FROM customer),
 x AS (SELECT c_custkey, regexp_extract_all(regexp_replace(txt, '[°Â]', '', 'g'), '([-+]?\\d+(?:\\.\\d+)?)', 1) AS n FROM t) SELECT c_custkey, CASE WHEN len(n) >= 2 THEN CAST(n[1] AS DOUBLE) END AS lat, CASE WHEN len(n) >= 2 THEN CAST(n[2] AS DOUBLE) END AS lon FROM x""".replace("\\\\", "\\"))
def parse_lat_lng(spark, d):
    """F20."""
    k = F.col("c_custkey")
    one = lambda base, m: F.concat(F.lit(str(base) + "."), (k % m).cast("string"))
    txt = F.when(k % 3 == 0, F.concat(one(52, 10), F.lit("°, "), one(13, 7), F.lit("°"))).when(k % 3 == 1, F.lit("-33.5, +151.25")).otherwise("unknown")
    lat, lon = P.lat_lng(txt)
    return table(spark, d, "customer").select("c_custkey", lat.alias("lat"), lon.alias("lon"))


@query("""WITH t AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN replace(CAST(l_quantity AS VARCHAR), '.', ',') WHEN l_linenumber % 3 = 1 THEN ' ' || CAST(l_quantity AS VARCHAR) ELSE 'n/a' END AS txt FROM lineitem),
 b AS (SELECT *, try_cast(replace(trim(CASE WHEN trim(txt) <> 'n/a' THEN txt END), ',', '') AS DOUBLE) AS dot, try_cast(replace(trim(CASE WHEN trim(txt) <> 'n/a' THEN txt END), ',', '.') AS DOUBLE) AS comma FROM t),
 w AS (SELECT count(dot) >= count(comma) AS use_dot FROM b) SELECT l_orderkey, l_linenumber, round(CASE WHEN use_dot THEN dot ELSE comma END, 6) AS number FROM b, w""")
def robust_number(spark, d):
    """the decimal sign by a vote of the whole column, the point winning ties."""
    n = F.col("l_linenumber") % 3
    q = F.col("l_quantity").cast("string")
    t = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.when(n == 0, F.replace(q, F.lit("."), F.lit(","))).when(n == 1, F.concat(F.lit(" "), q)).otherwise("n/a").alias("txt"))
    t = t.withColumn("dot", P.robust_number(F.col("txt"))).withColumn("comma", P.robust_number(F.col("txt"), ","))
    vote = t.agg((F.count("dot") >= F.count("comma")).alias("use_dot"))
    return t.join(F.broadcast(vote)).select("l_orderkey", "l_linenumber", F.round(F.when(F.col("use_dot"), F.col("dot")).otherwise(F.col("comma")), 6).alias("number"))


COMPONENTS = ("Stickstoffdioxid", "station__nitrogen_oxides", "NO", "Ozon", "so2", "Feinstaub PM2,5", "Stickoxide (NO)", "a__kohlenmonoxid", "b__no2 reducing", "b__ nox ", "x__other")


@query(f"""WITH t AS (SELECT p_partkey, {list(COMPONENTS)}[CAST(p_partkey % {len(COMPONENTS)} AS INTEGER) + 1] AS c FROM part), k AS (SELECT p_partkey, c, lower(c) AS t FROM t),
 g AS (SELECT *, CASE WHEN regexp_matches(t, 'stickoxide|\\bnox\\b|nitrogen_oxides') THEN 'NOx' WHEN regexp_matches(t, 'stickstoffmonoxid|\\bno\\b|nitric_oxide') THEN 'NO' WHEN regexp_matches(t, 'stickstoffdioxid|\\bno2\\b|nitrogen_dioxide') THEN 'NO2'
 WHEN regexp_matches(t, 'ozon|\\bo3\\b') THEN 'O3' WHEN regexp_matches(t, 'schwefeldioxid|\\bso2\\b|sulfur_dioxide|sulphur_dioxide') THEN 'SO2' WHEN regexp_matches(t, 'feinstaub.*pm\\s*2[._, ]?5|\\bpm\\s*2[._, ]?5\\b|pm2_5|pm25') THEN 'PM2.5' END AS component FROM k)
 SELECT p_partkey, component, coalesce(component IN ('NO', 'NO2', 'NOx', 'O3', 'SO2'), false) AND NOT regexp_matches(t, 'kohlenmonoxid|\\bco\\b|ammoniak|\\bnh3\\b|methan|\\bch4\\b|reduzier|reducing') AS oxidising,
 'Station ' || CASE WHEN component IN ('NO', 'NO2', 'NOx', 'O3', 'SO2') THEN component ELSE regexp_replace(c, '^[^_]+__', '') END AS label FROM g""")
def component_class(spark, d):
    """F41."""
    c = F.get(F.array(*[F.lit(x) for x in COMPONENTS]), (F.col("p_partkey") % len(COMPONENTS)).cast("int"))
    return table(spark, d, "part").select("p_partkey", P.component(c).alias("component"), P.is_oxidising(c).alias("oxidising"), P.gas_label(c).alias("label"))


@query("""SELECT fix_id, CASE m WHEN 'IN_VEHICLE' THEN 'IN_TRAIN' WHEN 'IN_BUS' THEN 'IN_TRAIN' WHEN 'IN_PASSENGER_VEHICLE' THEN 'IN_TRAIN' WHEN 'ON_FOOT' THEN 'WALKING' WHEN 'IN_RAIL_VEHICLE' THEN 'IN_TRAIN' ELSE m END AS travel_mode,
 CAST(CASE m WHEN 'ON_FOOT' THEN 1.4 WHEN 'CYCLING' THEN 5.5 WHEN 'IN_BUS' THEN 7.5 WHEN 'IN_VEHICLE' THEN 11.5 WHEN 'IN_RAIL_VEHICLE' THEN 18.0 ELSE 4.0 END AS DOUBLE) AS speed FROM (SELECT event_id AS fix_id, ['ON_FOOT', 'CYCLING', 'IN_BUS', 'IN_VEHICLE', 'IN_RAIL_VEHICLE', 'FLYING'][CAST(event_id % 6 AS INTEGER) + 1] AS m FROM events)""")
def travel_modes(spark, d):
    """F12, F17."""
    names = F.array(*[F.lit(x) for x in (" on_foot", "cycling ", "In_Bus", "IN_VEHICLE", "in_rail_vehicle", "flying")])
    m = F.get(names, (F.col("fix_id") % 6).cast("int"))
    return trk(spark, d).select("fix_id", P.travel_mode(m).alias("travel_mode"), P.mode_speed(m).alias("speed"))


@query("""SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS base, lower(trim(regexp_extract(url, '^(https?)', 1))) = 'https' AS secure FROM pages""")
def base_names(spark, d):
    """F46."""
    return table(spark, d, "pages").select("page_id", P.base_name(F.col("url")).alias("base"), F.startswith(F.lower(F.trim("url")), F.lit("https")).alias("secure"))


@query("""WITH n AS (SELECT o_orderkey, 'enviro_log_' || CASE WHEN o_orderkey % 2 = 0 THEN '2020-01-15_' ELSE '' END || (1500000000 + o_orderkey) || '.csv' AS name FROM orders)
 SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN name ELSE 'enviro_log_' || strftime(make_timestamp((1500000000 + o_orderkey) * 1000000), '%Y-%m-%d') || '_' || (1500000000 + o_orderkey) || '.csv' END AS dated,
 CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END AS n_hints FROM n""")
def file_hints(spark, d):
    """P10, F23."""
    k = F.col("o_orderkey")
    name = F.concat(F.lit("enviro_log_"), F.when(k % 2 == 0, "2020-01-15_").otherwise(""), (k + 1500000000).cast("string"), F.lit(".csv"))
    o = table(spark, d, "orders").select("o_orderkey", name.alias("name"))
    return o.select("o_orderkey", P.dated_name(F.col("name")).alias("dated"), F.size(P.time_hints(F.col("name"))).cast("int").alias("n_hints"))


@query("""SELECT source, lang, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) AS rn FROM documents) WHERE rn = 1""")
def variant_pick(spark, d):
    """O5, by size: of the variants of a log the largest, then the first."""
    docs = table(spark, d, "documents").select("source", "lang", "doc_id", "n_chars")
    return S.best_row(docs, ["source", "lang"], [F.col("n_chars").desc(), "doc_id"])


@query(f"""WITH {TRK}, t AS (SELECT log_id, epoch_us(max(ts)) - epoch_us(min(ts)) AS us FROM trk GROUP BY log_id), r AS (SELECT *, CAST(round_even(us / 1e6, 0) AS BIGINT) AS s FROM t)
 SELECT log_id, lpad(CAST(s // 3600 AS VARCHAR), CAST(greatest(2, length(CAST(s // 3600 AS VARCHAR))) AS INTEGER), '0') || ':' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS span, printf('%.1f MiB', us / 1048576.0) AS size FROM r""")
def duration_text(spark, d):
    """hh:mm:ss, and mebibytes."""
    t = trk(spark, d).groupBy("log_id").agg((F.max(S.micros(F.col("ts"))) - F.min(S.micros(F.col("ts")))).alias("us"))
    return t.select("log_id", P.duration_text(F.col("us") / 1e6).alias("span"), P.bytes_text(F.col("us")).alias("size"))


@query("""WITH u AS (SELECT p_partkey, p_retailprice * (p_size % 7) * 9.701 AS m, p_retailprice AS x, ['Resistance (ohm)', 'Width (m)', 'Gas (kOhms)', 'plain', 'R (Ω)'][CAST(p_partkey % 5 AS INTEGER) + 1] AS label FROM part), v AS (SELECT *, regexp_extract(label, '\\(([^)]+)\\)', 1) AS unit FROM u)
 SELECT p_partkey, CASE WHEN m < 1000 THEN CAST(CAST(round_even(m, 0) AS BIGINT) AS VARCHAR) || ' m' WHEN abs(m / 1000 - round_even(m / 1000, 0)) < 1e-8 THEN CAST(CAST(round_even(m / 1000, 0) AS BIGINT) AS VARCHAR) || ' km' ELSE printf('%.1f km', m / 1000) END AS distance,
 round(CASE WHEN regexp_matches(lower(unit), 'ohm|ω') THEN x / 1000 ELSE x END, 6) AS shown, CASE WHEN regexp_matches(lower(unit), 'ohm|ω') THEN 'kΩ' ELSE unit END AS unit FROM v""".replace("\\\\", "\\"))
def display_text(spark, d):
    """distances, numbers and units as they are shown."""
    label = F.get(F.array(*[F.lit(x) for x in ("Resistance (ohm)", "Width (m)", "Gas (kOhms)", "plain", "R (Ω)")]), (F.col("p_partkey") % 5).cast("int"))
    unit, metres = P.label_unit(label), F.col("p_retailprice") * (F.col("p_size") % 7) * 9.701
    return table(spark, d, "part").select("p_partkey", P.distance_text(metres).alias("distance"), F.round(P.display_number(F.col("p_retailprice"), unit), 6).alias("shown"), P.display_unit(unit).alias("unit"))


@query("""SELECT event_id AS fix_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, timezone('Europe/Berlin', timezone('UTC', ts)) AS ts_local, strftime(timezone('Europe/Berlin', timezone('UTC', ts)), '%Y-%m-%d') AS date_local, strftime(timezone('Europe/Berlin', timezone('UTC', ts)), '%H:%M:%S') AS time_local, epoch_us(ts) // 1000000 AS unix_time_s, epoch_us(ts) // 1000000 % 5 = 0 AS is_exact_grid FROM events""")
def local_times(spark, d):
    """nested fields, and local wall time."""
    e = table(spark, d, "events")
    local = F.convert_timezone(F.lit("UTC"), F.lit("Europe/Berlin"), F.col("ts"))
    unix = F.floor(S.micros(F.col("ts")) / 1000000).cast("long")
    props = F.from_json("props", "k bigint")
    return e.select(F.col("event_id").alias("fix_id"), props["k"].alias("k"), local.alias("ts_local"), F.date_format(local, "yyyy-MM-dd").alias("date_local"), F.date_format(local, "HH:mm:ss").alias("time_local"), unix.alias("unix_time_s"), (unix % 5 == 0).alias("is_exact_grid"))
