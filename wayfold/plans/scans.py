"""Queries of scans and sinks: each writes files from the driver tables to the shared folder and reads them back."""

from __future__ import annotations

import struct

from pyspark.sql import Window
from pyspark.sql import functions as F

from wayfold.functions import parse as P
from wayfold.operators import pipelines as W
from wayfold.operators import rail as R
from wayfold.operators import sequences as S
from wayfold.plans.adapters import hav, table
from wayfold.sources import sinks, tables, vectors
from wayfold.sources.shared import file_system, fresh_path

QUERIES, ORACLES = {}, {}

#: Rows of a file whose cells may hold ends of lines, which one task reads.
CELLS = 50_000


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _csv(df, path: str, order: str | None = None, **options) -> str:
    """The rows as CSV files, with quotes doubled; in an order over the files by their names and within them, if one is given."""
    rows = df if order is None else df.orderBy(order).drop(order)
    rows.write.options(header=True, escape='"', **options).csv(path)
    return path


def _only_file(spark, path: str) -> str:
    fs, at = file_system(spark, path)
    return next(s.getPath().toString() for s in fs.listStatus(at) if s.getPath().getName().startswith("part-"))


def _logs(spark, d) -> list[str]:
    """Two kinds of files: semicolons and UTF-8, and commas and Latin-1 with another time column."""
    e = table(spark, d, "events")
    k, iso = F.col("event_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    lat = F.when(k % 17 != 0, 50 + k.cast("double") / 1e6)
    one = e.where("event_id % 2 = 0").select(F.concat(iso, F.lit("Z")).alias("timestamp_iso"), F.lit("2000-01-01").alias("gps_time_utc"), lat.alias("gps_lat"), (13 + k.cast("double") / 1e6).alias("gps_lon"), (k % 4).alias("gps_mode"), F.lit("a;b").alias("Straße"))
    two = e.where("event_id % 2 = 1").select(iso.alias("gps_time_utc"), lat.alias("gps_lat"), (13 + k.cast("double") / 1e6).alias("gps_lon"), F.lit("Größe, weiß").alias("größe"))
    top = fresh_path(spark, "logs")
    return [_csv(one, f"{top}/a", sep=";"), _csv(two, f"{top}/b", encoding="ISO-8859-1")]


@query("SELECT ts, 50 + CAST(event_id AS DOUBLE) / 1e6 AS lat, 13 + CAST(event_id AS DOUBLE) / 1e6 AS lon, CAST(CASE WHEN event_id % 2 = 0 THEN event_id % 4 END AS DOUBLE) AS gps_mode, CAST(NULL AS DOUBLE) AS gps_eph_m FROM events WHERE event_id % 17 <> 0")
def scan_fixes(spark, d):
    """Logs of two delimiters, encodings and time columns."""
    return tables.sensor_fixes(spark, _logs(spark, d)).select("ts", "lat", "lon", "gps_mode", "gps_eph_m")


@query("SELECT ts, count(*) AS n FROM events GROUP BY ts")
def scan_times(spark, d):
    """S8."""
    return tables.fix_times(spark, _logs(spark, d)).groupBy("ts").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_id, timezone('Europe/Berlin', timezone('UTC', date_trunc('second', ts))) AS mobile_timestamp_local, date_trunc('hour', timezone('Europe/Berlin', timezone('UTC', ts))) AS station_hour_local,
 50 + CAST(event_id AS DOUBLE) / 1e6 AS mobile_lat, 13.5 AS mobile_lon FROM events WHERE event_id % 19 <> 0""".replace("13.5 AS", "13.5::DOUBLE AS"))
def scan_track(spark, d):
    """A track by tabs, with names to be matched, times without a zone, and local hours."""
    e, k = table(spark, d, "events"), F.col("event_id")
    df = e.select(k.cast("string").alias("event id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias(" Timestamp UTC"), F.when(k % 19 != 0, 50 + k.cast("double") / 1e6).cast("string").alias("GPS Latitude"), F.lit("13.5").alias("Lng"))
    got = tables.mobile_track(spark, _csv(df, fresh_path(spark, "track"), sep="\t"))
    return got.select(F.col("event id").cast("long").alias("event_id"), "mobile_timestamp_local", "station_hour_local", "mobile_lat", "mobile_lon")


@query("SELECT ts AS mobile_aq_timestamp, CAST(value AS DOUBLE) AS mobile_aq__pm2_5_count, CAST(CASE WHEN event_id % 3 = 0 THEN event_id END AS DOUBLE) AS mobile_aq__temp_c FROM events")
def scan_metrics(spark, d):
    """Measured columns that hold a number somewhere; neither places, nor file columns, nor text."""
    k = F.col("event_id")
    df = table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("datetime"), F.col("value").alias("PM2.5 count"), F.when(k % 3 == 0, k.cast("string")).otherwise("n/a").alias("Temp °C"), F.col("event_type").alias("label"), k.alias("gps_eph_m"), k.alias("rows_before"), k.alias("unix_time_s"), k.alias("Latitude"))
    got = tables.source_metrics(spark, _csv(df, fresh_path(spark, "metrics")))
    return got.drop("source_file")


@query("SELECT date_trunc('hour', ts) AS ts, arg_max(event_type, event_id) AS event_type, round(arg_max(value, event_id), 6) AS value FROM events GROUP BY 1")
def scan_last_metrics(spark, d):
    """Times from seconds alone, of equal times the last row, columns of places left out."""
    unix = F.unix_timestamp(F.date_trunc("hour", "ts"))
    df = table(spark, d, "events").select("event_id", unix.alias("unix_time_s"), "event_type", "value", F.lit(1).alias("gps_lat"))
    logs = df.repartition("unix_time_s").sortWithinPartitions("event_id").drop("event_id")  # a time is in one log, as the last row is a log's
    got = tables.raw_metrics(spark, _csv(logs, fresh_path(spark, "last")))
    return tables.required(got, ["ts", "event_type", "value"]).select("ts", "event_type", F.round(F.col("value").cast("double"), 6).alias("value"))


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS t FROM orders)
 SELECT t AS station_hour_local, CASE WHEN k % 5 <> 0 THEN CAST(k AS DOUBLE) / 4 END AS s1__feinstaub_pm2_5, CAST(k AS DOUBLE) AS s1__value_2, -1.5::DOUBLE AS s1__ozon FROM o""")
def scan_station(spark, d):
    """A report, in files of some rows, with two lines before its data, a component without a name, and decimal commas."""
    k = F.col("o_orderkey")
    t = F.date_format(F.expr("o_orderdate + make_dt_interval(0, int(o_orderkey % 24))"), "dd.MM.yyyy HH:mm")
    n = F.when(k % 5 != 0, F.replace((k.cast("double") / 4).cast("decimal(20,2)").cast("string"), F.lit("."), F.lit(","))).otherwise("-")
    heads = "Station;Mitte\n\n;Feinstaub PM2,5; ;Ozon\nEinheit;x;y;z\n"
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0  # of a task's rows, and so of a file's
    rows = table(spark, d, "orders").select(F.concat(F.when(first, heads).otherwise(""), F.concat_ws(";", t, n, k.cast("string"), F.lit('"-1,5"'))).alias("value"))
    path = fresh_path(spark, "station")
    rows.write.text(path)
    return tables.station_hours(spark, path, "s1")


@query("""WITH c AS (SELECT c_custkey AS k, unnest(['a', 'b']) AS part FROM customer), f AS (SELECT c_custkey AS k FROM customer)
 SELECT 's' || k || part AS startTime, CASE WHEN part = 'a' OR k % 2 = 0 THEN 'e' || k || part END AS endTime, CASE WHEN part = 'a' THEN 'CYCLING' END AS activity_topCandidate_type, CASE WHEN part = 'a' THEN '12.5' END AS activity_distanceMeters, CASE WHEN part = 'a' THEN 2 ELSE -1 END AS n_points FROM c
 UNION ALL SELECT 'f' || k, 'g' || k, 'IN_BUS', CAST(k AS VARCHAR), 1 FROM f""")
def scan_timeline(spark, d):
    """Nested segments as JSON and as literals, and flat rows."""
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("k"), (F.col("c_custkey") % 2 == 0).alias("json"))
    path = '[{"point": "52.5°, 13.4°", "time": "t1"}, {"point": "52.6°, 13.5°", "time": "t2"}]'
    one = F.concat(F.lit('{"startTime": "s'), "k", F.lit('a", "endTime": "e'), "k", F.lit(f'a", "timelinePath": {path}, "activity": {{"topCandidate": {{"type": "CYCLING"}}, "distanceMeters": 12.5}}}}'))
    two = F.concat(F.lit('{"startTime": "s'), "k", F.lit('b", "endTime": '), F.when(F.col("json"), F.concat(F.lit('"e'), "k", F.lit('b"'))).otherwise("None"), F.lit("}"))
    cell = F.concat(F.lit("["), one, F.lit(", "), two, F.lit("]"))
    nested = c.select(F.when(F.col("json"), cell).otherwise(F.replace(cell, F.lit('"'), F.lit("'"))).alias("semanticSegments"))
    flat = c.select(F.concat(F.lit("f"), "k").alias("start_time"), F.concat(F.lit("g"), "k").alias("endTime"), F.lit("IN_BUS").alias("activity.topCandidate.type"), F.col("k").alias("activity.distanceMeters"), F.lit('[{"point": "1, 2", "time": "x"}]').alias("timelinePath"))
    top = fresh_path(spark, "timeline")
    small = {"maxRecordsPerFile": CELLS}
    got = tables.timeline(spark, [_csv(nested, f"{top}/a", **small), _csv(flat, f"{top}/b", **small)])
    return got.select("startTime", "endTime", "activity_topCandidate_type", "activity_distanceMeters", F.coalesce(F.size("timelinePath"), F.lit(-1)).alias("n_points"))


@query("SELECT 'f' || o_orderkey % 500 || '.csv' AS output_name, arg_max('logs/a' || o_custkey || '.csv', o_orderkey) AS source_file FROM orders WHERE o_orderkey % 7 <> 0 GROUP BY 1")
def scan_index(spark, d):
    """Of rows with one output the last; blank rows and paths of another system."""
    k = F.col("o_orderkey")
    source = F.when(k % 7 == 0, F.when(k % 2 == 0, "nan").otherwise("")).otherwise(F.concat(F.lit("logs/a"), F.col("o_custkey").cast("string"), F.lit(".csv")))
    df = table(spark, d, "orders").select("o_orderkey", source.alias("source_file"), F.lit("x").alias("source_name"), F.concat(F.lit("C:\\out\\f"), (k % 500).cast("string"), F.lit(".csv")).alias("output_file"))
    return tables.source_map(spark, _csv(df, fresh_path(spark, "index"), "o_orderkey", sep=";"))


@query("""WITH h AS (SELECT DISTINCT user_id AS file, CASE WHEN event_id % 3 = 0 THEN event_type || '_speed' ELSE event_type END AS col FROM events UNION SELECT user_id, 'gas_ohms' FROM events WHERE user_id % 2 = 0 UNION SELECT user_id, 'note' FROM events),
 c AS (SELECT col, count(*) AS n FROM h GROUP BY col), p AS (SELECT col, n, CASE col WHEN 'gas_ohms' THEN 0 WHEN 'missing' THEN 1 WHEN 'click' THEN 2 ELSE 3 END AS place FROM c), r AS (SELECT *, row_number() OVER (ORDER BY place, n DESC, col) AS rank FROM p WHERE place < 3 OR contains(col, 'speed') OR contains(col, 'pm') OR contains(col, 'gas'))
 SELECT CAST(rank AS BIGINT) AS rank, col AS "column", n AS n_files FROM r WHERE rank <= 4""")
def display_columns(spark, d):
    """Preferred columns, then those that tell a measurement, by the files that have them."""
    e = table(spark, d, "events")
    own = e.select(F.col("user_id").alias("file"), F.when(F.col("event_id") % 3 == 0, F.concat("event_type", F.lit("_speed"))).otherwise(F.col("event_type")).alias("column"))
    gas, note = e.where("user_id % 2 = 0").select("user_id", F.lit("gas_ohms")), e.select("user_id", F.lit("note"))
    return tables.display_columns(own.union(gas).union(note), ["gas_ohms", "missing", "click"])


@query("""SELECT 'enviro_log_' || strftime(make_timestamp((1700000000 + user_id) * 1000000), '%Y-%m-%d') || '_' || (1700000000 + user_id) || '.csv' AS name, count(*) AS n_rows, round(sum(value), 4) AS total, 'event_id,pm10_count,value' AS columns FROM events GROUP BY user_id""")
def sink_logs(spark, d):
    """A file for each log under its dated name, found again and read back."""
    e = table(spark, d, "events")
    rows = e.select(F.concat(F.lit("enviro_log_"), (F.col("user_id") + 1700000000).cast("string"), F.lit(".csv")).alias("log"), "value", F.lit(1).alias("PM10 count"), F.lit(2).alias("pm2_5_ug_m3"), "event_id", F.lit(3).alias("pm10_count"))
    rows = sinks.leading(P.without_particles(rows), ["log", "event_id"]).drop("PM10 count")
    path = fresh_path(spark, "out")
    sinks.log_files(rows, path, "log", ["event_id"])
    found = tables.discovered(spark, f"{path}", pattern="enviro_log*.csv").select("name")
    got = tables.csv(spark, path)
    names = ",".join(sorted(c for c in got.columns if c != "source_file"))
    by = got.groupBy(F.col("source_file").alias("name")).agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum(F.col("value").cast("double")), 4).alias("total"))
    return by.join(found, "name").withColumn("columns", F.lit(names))


@query("""SELECT 'index' AS kind, o_orderstatus AS name, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'sorted_out', o_orderstatus || ':' || CASE WHEN o_totalprice < 50000 THEN 'cheap' ELSE 'urgent' END, count(*) FROM orders WHERE o_totalprice < 50000 OR o_orderpriority = '1-URGENT' GROUP BY 2""")
def sink_exports(spark, d):
    """K3, K5 to K7, K9: exports with a dated index, and what is sorted out with a summary, both read back."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    path = fresh_path(spark, "exports")
    sinks.exported(o, path, "o_orderstatus", F.concat(F.lower("o_orderstatus"), F.lit("_out")), "2024-01-31")
    sinks.sorted_out(o, path, "o_orderstatus", F.when(F.col("o_totalprice") < 50000, "cheap").when(F.col("o_orderpriority") == "1-URGENT", "urgent"))
    index, summary = tables.csv(spark, f"{path}/index_2024-01-31.csv"), tables.csv(spark, f"{path}/summary.csv")
    n = F.col("rows").cast("long").alias("n")
    return index.select(F.lit("index").alias("kind"), F.col("o_orderstatus").alias("name"), n).union(summary.select(F.lit("sorted_out"), F.concat_ws(":", "o_orderstatus", "reason"), n))


def _put(spark, path: str, data: bytes) -> None:
    fs, at = file_system(spark, path)
    out = fs.create(at)
    out.write(bytearray(data))
    out.close()


def polyline_file(lines: list[list[tuple[float, float]]]) -> bytes:
    """A shapefile of polylines."""
    body = b""
    for i, points in enumerate(lines):
        xs, ys = zip(*points, strict=True)
        own = struct.pack("<i4d2ii", 3, min(xs), min(ys), max(xs), max(ys), 1, len(points), 0) + b"".join(struct.pack("<2d", *p) for p in points)
        body += struct.pack(">2i", i + 1, len(own) // 2) + own
    return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(body)) // 2) + struct.pack("<2i8d", 1000, 3, *[0.0] * 8) + body


@query("""SELECT 'to_uni_bike' AS route_class, n_nationkey AS pos, 52.0::DOUBLE + n_nationkey / 100.0::DOUBLE AS lat, 13.0::DOUBLE + n_nationkey / 50.0::DOUBLE AS lon FROM nation
 UNION ALL SELECT 'from_uni_opnv', n_nationkey, 51.0::DOUBLE + n_nationkey / 100.0::DOUBLE, 12.0::DOUBLE + n_nationkey / 50.0::DOUBLE FROM nation""")
def vector_routes(spark, d):
    """Lines of shapefiles and well-known binary, one for each class, by their names."""
    keys = sorted(r[0] for r in table(spark, d, "nation").select("n_nationkey").collect())  # 25 rows
    line = lambda lat, lon: [(lon + k / 50.0, lat + k / 100.0) for k in keys]
    top = fresh_path(spark, "routes")
    _put(spark, f"{top}/to_uni_bike.shp", polyline_file([line(52.0, 13.0)[:9], line(52.0, 13.0)[9:]]))
    _put(spark, f"{top}/to_uni_bike_longer_name.shp", polyline_file([line(0.0, 0.0)]))
    _put(spark, f"{top}/from_uni_opnv_train.shp", polyline_file([line(1.0, 1.0)]))
    points = line(51.0, 12.0)
    _put(spark, f"{top}/From-Uni public.wkb", struct.pack("<BII", 1, 2, len(points)) + b"".join(struct.pack("<2d", *p) for p in points))
    _put(spark, f"{top}/other.shp", polyline_file([line(2.0, 2.0)]))
    return vectors.known_routes(vectors.vertices(spark, top))


def _zipped(spark, parts: dict, target: str) -> str:
    """A ZIP file of tables as CSV, copied as streams."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs, at = file_system(spark, target)
    out = jvm.java.util.zip.ZipOutputStream(fs.create(at))
    for name, df in parts.items():
        path = fresh_path(spark, "part")
        df.repartition(1).write.option("header", True).csv(path)
        own = _only_file(spark, path)
        out.putNextEntry(jvm.java.util.zip.ZipEntry(name))
        stream = fs.open(jvm.org.apache.hadoop.fs.Path(own))
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, conf, False)
        stream.close()
        out.closeEntry()
    out.close()
    return target


@query("""WITH s AS (SELECT s_suppkey AS k, j, 52.3::DOUBLE + (s_suppkey * 6007 % 1000) / 2500.0::DOUBLE + 0.004::DOUBLE * least(j, 3) AS lat, 13.1::DOUBLE + (s_suppkey * 50021 % 1000) / 1500.0::DOUBLE + 0.006::DOUBLE * least(j, 3) AS lon FROM supplier, range(5) r(j)),
 n AS (SELECT count(*) AS n FROM supplier), t AS (SELECT c_custkey % n + 1 AS k, [0, 3, 109, 700, 2][CAST(c_nationkey % 5 AS INTEGER) + 1] AS type FROM customer, n), f AS (SELECT k, type, count(*) AS c FROM t GROUP BY ALL), m AS (SELECT k, arg_min(type, -c * 10000 + type) AS route_type FROM f GROUP BY k)
 SELECT 'sh' || s.k AS shape_id, CAST(coalesce(any_value(m.route_type), -1) AS INTEGER) AS route_type, 4 AS n_vertices, round(min(lat), 6) AS south, round(max(lon), 6) AS east FROM s LEFT JOIN m ON m.k = s.k WHERE m.route_type IS NULL OR m.route_type IN (0, 1, 2) OR m.route_type BETWEEN 100 AND 499 GROUP BY s.k""")
def rail_network(spark, d):
    """Shapes, trips and routes of a ZIP file; a shape's type is that of most of its trips."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("j"))
    step = F.least("j", F.lit(3))  # the last vertex is doubled
    shapes = s.select(F.concat(F.lit("sh"), "k").alias("shape_id"), (52.3 + (F.col("k") * 6007 % 1000) / 2500.0 + 0.004 * step).alias("shape_pt_lat"), (13.1 + (F.col("k") * 50021 % 1000) / 1500.0 + 0.006 * step).alias("shape_pt_lon"), F.col("j").alias("shape_pt_sequence"))
    n = table(spark, d, "supplier").count()
    trips = table(spark, d, "customer").select(F.concat(F.lit("r"), "c_nationkey").alias("route_id"), F.concat(F.lit("sh"), F.col("c_custkey") % n + 1).alias("shape_id"))
    routes = table(spark, d, "nation").select(F.concat(F.lit("r"), "n_nationkey").alias("route_id"), F.get(F.array(*[F.lit(x) for x in (0, 3, 109, 700, 2)]), (F.col("n_nationkey") % 5).cast("int")).alias("route_type"))
    top = vectors.unzipped(spark, _zipped(spark, {"shapes.txt": shapes, "trips.txt": trips, "routes.txt": routes}, fresh_path(spark, "gtfs.zip")))
    read = lambda name: spark.read.csv(f"{top}/{name}.txt", header=True)
    got = R.rail_shapes(read("shapes"), read("trips"), read("routes"))
    return got.select("shape_id", F.coalesce("route_type", F.lit(-1)).alias("route_type"), F.size("line").alias("n_vertices"), F.round("box.south", 6).alias("south"), F.round("box.east", 6).alias("east"))


@query("""WITH n AS (SELECT s_suppkey AS k, row_number() OVER (ORDER BY s_suppkey) AS i, count(*) OVER () AS n FROM supplier), g AS (SELECT DISTINCT CAST(round_even(1 + j * (n - 1) / 499.0::DOUBLE, 0) AS BIGINT) AS i FROM (SELECT max(n) AS n FROM n), range(500) t(j)), s AS (SELECT k FROM n WHERE n <= 500 OR i IN (SELECT i FROM g))
 SELECT k, 'LINESTRING (' || printf('%.1f', (k % 1000) * 1.0) || ' 0.0, ' || printf('%.1f', k % 1000 + 1.0) || ' 2.0)' AS wkt, (SELECT count(*) FROM s) AS drawn FROM s""")
def drawn_segments(spark, d):
    """An even sample of segments as well-known text, and as a drawing, of which the lines are counted."""
    k = F.col("s_suppkey")
    taken = S.systematic_sample(table(spark, d, "supplier").select("s_suppkey"), ["s_suppkey"], 500)
    s = taken.select(k.alias("k"), (k % 1000 * 1.0).cast("double").alias("x"), F.lit(0.0).alias("y"), (k % 1000 + 1.0).cast("double").alias("xend"), F.lit(2.0).alias("yend"), F.lit("#c92a2a").alias("color"))
    return sinks.with_wkt(s).select("k", "wkt", F.lit(sinks.svg(s).count("<line ")).cast("long").alias("drawn"))


@query("""SELECT source || '-' || lang AS base_log, arg_max(doc_id, n_chars * 1000000000 + doc_id) AS doc_id FROM documents GROUP BY ALL""")
def preferred_variants(spark, d):
    """Of a log's variants the newest, then the largest, then the last by name."""
    t = table(spark, d, "documents").select("doc_id", F.concat_ws("-", "source", "lang").alias("base"), "n_chars")
    name = F.concat("base", F.lit("_Cut_"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit(".csv"))
    f = t.select("doc_id", name.alias("path"), name.alias("name"), F.lit(1).alias("length"), F.timestamp_seconds("n_chars").alias("modificationTime"))
    return W.preferred(f).select("base_log", "doc_id")


CROPPED = """t AS (SELECT user_id AS u, event_id AS f, row_number() OVER w - 1 AS pos, 15 + value / 10 AS v, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), l AS (SELECT *, least(greatest(floor(n * 0.2), 10), 600) AS lim, coalesce(v < lag(v) OVER w, false) AS dr, coalesce(v > lag(v) OVER w, false) AS up, v < 19 AS cool FROM t WINDOW w AS (PARTITION BY u ORDER BY pos)),
 s AS (SELECT *, pos - max(CASE WHEN NOT dr THEN pos END) OVER (PARTITION BY u ORDER BY pos) AS streak, pos - row_number() OVER (PARTITION BY u, cool ORDER BY pos) AS isle FROM l),
 r AS (SELECT u, max(c) AS longest FROM (SELECT u, isle, count(*) AS c FROM s WHERE cool GROUP BY ALL) GROUP BY u), i AS (SELECT s.u FROM s LEFT JOIN r ON r.u = s.u WHERE s.u % 4 = 0 GROUP BY s.u HAVING avg(CASE WHEN v >= 19 THEN 1.0 ELSE 0.0 END) >= 0.8 AND quantile_cont(v, 0.5) >= 19 AND coalesce(max(longest), 0) * 60 < 600),
 c AS (SELECT u, coalesce(min(CASE WHEN streak >= 3 AND pos < lim THEN pos - 2 END), 0) AS a, coalesce(max(CASE WHEN up AND pos >= n - lim THEN pos + 1 END), 0) AS e FROM s GROUP BY u), k AS (SELECT s.* FROM s JOIN c USING (u) WHERE n > 30 AND u NOT IN (SELECT u FROM i) AND pos >= a AND (e <= a OR pos < e)), m AS (SELECT *, min(pos) OVER (PARTITION BY u) AS p0 FROM k)"""


@query(f"""WITH {CROPPED} SELECT 'enviro_log_' || strftime(make_timestamp((1700000000 + u) * 1000000), '%Y-%m-%d') || '_' || (1700000000 + u) || '.csv' AS name, count(*) AS n_rows, min(f) AS first_fix, max(f) AS last_fix FROM m WHERE (pos - p0) * 60 <= 3600 GROUP BY u""")
def crop_files(spark, d):
    """Logs cropped from files to files, some of them from indoors."""
    e, k = table(spark, d, "events"), F.col("event_id")
    w = Window.partitionBy("user_id").orderBy("event_id")
    at = F.timestamp_seconds(F.when(F.col("user_id") % 4 == 0, 1705276800).otherwise(1717200000) + (F.row_number().over(w) - 1) * 60)
    logs = e.select(F.concat(F.lit("enviro_log_"), (F.col("user_id") + 1700000000).cast("string"), F.lit(".csv")).alias("log"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp_iso"), (15 + F.col("value") / 10).alias("temperature_C"), F.lit("x").alias("pm2_5_ug_m3"), k.alias("event_id"))
    top = fresh_path(spark, "crop")
    sinks.log_files(logs, f"{top}/in", "log", ["event_id"])
    W.crop_files(spark, f"{top}/in", f"{top}/out", streak=3)
    got = tables.csv(spark, f"{top}/out")
    fix = F.col("event_id").cast("long")
    return tables.required(got, ["timestamp_iso", "temperature_C", "event_id", "file_pos"]).groupBy(F.col("source_file").alias("name")).agg(F.count(F.lit(1)).alias("n_rows"), F.min(fix).alias("first_fix"), F.max(fix).alias("last_fix"))


STATIONS = [("s0", "Nord", 52.40, 13.30, 9000.0), ("s1", "Mitte", 52.45, 13.45, 12000.0)]


@query(f"""WITH t AS (SELECT event_id AS f, user_id % 5 AS g, date_trunc('second', ts) AS ts, timezone('Europe/Berlin', timezone('UTC', date_trunc('second', ts))) AS tl, 52.3::DOUBLE + (event_id * 13 % 100) / 250.0::DOUBLE AS lat, 13.1::DOUBLE + (event_id * 37 % 100) / 150.0::DOUBLE AS lon, value FROM events),
 st(sid, label, la, lo, r) AS (VALUES {', '.join(f"('{a}', '{b}', {c}::DOUBLE, {e}::DOUBLE, {r}::DOUBLE)" for a, b, c, e, r in STATIONS)}), n AS (SELECT t.*, st.*, {hav('lat', 'lon', 'la', 'lo')} AS m FROM t CROSS JOIN st), h AS (SELECT * FROM n WHERE m <= r),
 q AS (SELECT g, ts, arg_max(value, f) AS aq FROM t WHERE f % 2 = 0 GROUP BY ALL) SELECT h.f AS event_id, h.sid AS station_id, label AS station_label, round(m, 4) AS distance_to_station_m, dense_rank() OVER (PARTITION BY h.sid ORDER BY tl::DATE) AS pass_id, row_number() OVER (PARTITION BY h.sid, tl::DATE ORDER BY tl, h.g, m, h.f) AS pass_row_index,
 CASE WHEN h.sid = 's0' AND day(tl) % 2 = 1 THEN hour(tl) + 0.5::DOUBLE END AS s0__ozon, round(q.aq, 6) AS mobile_aq__noise FROM h LEFT JOIN q ON q.g = h.g AND q.ts = h.ts""")
def match_files(spark, d):
    """Tracks from files near stations, with the hours of reports and measurements of logs."""
    e, k = table(spark, d, "events").withColumn("s", F.date_trunc("second", "ts")), F.col("event_id")
    group = (F.col("user_id") % 5).cast("string")
    top = fresh_path(spark, "match")
    stamp = F.date_format("s", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    sinks.log_files(e.select(F.concat(F.lit("track_"), group, F.lit("_interp.csv")).alias("log"), stamp.alias("timestamp"), (52.3 + (k * 13 % 100) / 250.0).alias("lat"), (13.1 + (k * 37 % 100) / 150.0).alias("lon"), "event_id"), f"{top}/in", "log", ["event_id"])
    sinks.log_files(e.where("event_id % 2 = 0").select(F.concat(F.lit("src_"), group, F.lit(".csv")).alias("log"), stamp.alias("datetime"), F.col("value").alias("Noise"), "event_id"), f"{top}/logs", "log", ["event_id"])
    index = spark.range(5).select(F.concat(F.lit("track_"), "id", F.lit("_interp.csv")).alias("output_file"), F.concat(F.lit("old\\src_"), "id", F.lit(".csv")).alias("source_file"), F.lit("individual_interpolated_files_x.csv").alias("log"))
    sinks.log_files(index, f"{top}/in", "log")
    days = spark.range(-1, 32).select(F.explode(F.sequence(F.lit(0), F.lit(23))).alias("h"), F.date_add(F.to_date(F.lit("2024-01-01")), F.col("id").cast("int")).alias("day"))
    stations = []
    for n, (sid, label, lat, lon, radius) in enumerate(STATIONS):
        line = days.where(F.dayofmonth("day") % 2 == 1).select((F.datediff("day", F.lit("2000-01-01")) * 24 + F.col("h")).alias("at"), F.concat(F.date_format("day", "dd.MM.yyyy"), F.lit(" "), F.lpad(F.col("h").cast("string"), 2, "0"), F.lit(":00;"), F.col("h").cast("string"), F.lit(",5")).alias("value"))
        heads = spark.createDataFrame([(0, "Station"), (1, ";Ozon" if n == 0 else ";Stickoxide")], "at int, value string")
        heads.union(line).repartition(1).sortWithinPartitions("at").select("value").write.text(f"{top}/{sid}")
        stations.append({"station_id": sid, "station_label": label, "lat": lat, "lon": lon, "radius_m": radius, "station_csv": _only_file(spark, f"{top}/{sid}")})
    got = W.matched_files(spark, f"{top}/in", stations, f"{top}/logs", 0.0)
    names = [F.col(c) for c in ("station_id", "station_label", "pass_id")]
    return got.select(F.col("event_id").cast("long").alias("event_id"), *names, F.round("distance_to_station_m", 4).alias("distance_to_station_m"), "pass_row_index", "s0__ozon", F.round("mobile_aq__noise", 6).alias("mobile_aq__noise"))
