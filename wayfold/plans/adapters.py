"""The driver tables seen as tracks, signals, polylines, points and intervals, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trk(spark, d) -> DataFrame:
    """Events as fixes: log_id, fix_id, ts, v, mode, k."""
    return table(spark, d, "events").select(
        F.col("user_id").alias("log_id"), F.col("event_id").alias("fix_id"), "ts", F.col("value").alias("v"),
        F.col("event_type").alias("mode"), F.get_json_object("props", "$.k").cast("long").alias("k"))


TRK = "trk AS (SELECT user_id AS log_id, event_id AS fix_id, ts, value AS v, event_type AS mode, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)"


def sig(spark, d) -> DataFrame:
    """Embeddings as signals: log_id, pos, v."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("log_id"), F.posexplode(F.transform("embedding", lambda x: x.cast("double"))).alias("p", "v")).select("log_id", F.col("p").cast("long").alias("pos"), "v")


SIG = "sig AS (SELECT vec_id AS log_id, unnest(range(len(embedding))) AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"


def pl(spark, d) -> DataFrame:
    """Signals as polylines in degrees: log_id, pos, lat, lon, v."""
    return sig(spark, d).select("log_id", "pos", (52.4 + 0.001 * F.col("v") * F.col("pos")).alias("lat"), (13.3 + 0.001 * F.col("pos")).alias("lon"), "v")


PL = SIG + ", pl AS (SELECT log_id, pos, 52.4 + 0.001 * v * pos AS lat, 13.3 + 0.001 * pos AS lon, v FROM sig)"


def plane(spark, d) -> DataFrame:
    """Signals as polylines in metres: log_id, pos, x, y, v."""
    return sig(spark, d).select("log_id", "pos", (100.0 * F.col("pos")).alias("x"), (250.0 * F.col("v")).alias("y"), "v")


PLANE = SIG + ", plane AS (SELECT log_id, pos, 100.0::DOUBLE * pos AS x, 250.0::DOUBLE * v AS y, v FROM sig)"


def pts(spark, d) -> DataFrame:
    """Customers as points: id, lat, lon."""
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("id"), (52.3 + (k * 7919 % 1000) / 2500.0).alias("lat"), (13.1 + (k * 104729 % 1000) / 1500.0).alias("lon"))


def stn(spark, d) -> DataFrame:
    """Suppliers as stations: station_id, s_lat, s_lon, radius_m."""
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(k.alias("station_id"), (52.3 + (k * 6007 % 1000) / 2500.0).alias("s_lat"), (13.1 + (k * 50021 % 1000) / 1500.0).alias("s_lon"), (1000.0 + 500.0 * (k % 5)).alias("radius_m"))


PTS = "pts AS (SELECT c_custkey AS id, 52.3::DOUBLE + (c_custkey * 7919 % 1000) / 2500.0::DOUBLE AS lat, 13.1::DOUBLE + (c_custkey * 104729 % 1000) / 1500.0::DOUBLE AS lon FROM customer)"
STN = "stn AS (SELECT s_suppkey AS station_id, 52.3::DOUBLE + (s_suppkey * 6007 % 1000) / 2500.0::DOUBLE AS s_lat, 13.1::DOUBLE + (s_suppkey * 50021 % 1000) / 1500.0::DOUBLE AS s_lon, 1000.0::DOUBLE + 500.0::DOUBLE * (s_suppkey % 5) AS radius_m FROM supplier)"


def seg(spark, d) -> DataFrame:
    """Orders as intervals of their customer: cust, seg_id, s, e."""
    o = table(spark, d, "orders")
    return o.select(F.col("o_custkey").alias("cust"), F.col("o_orderkey").alias("seg_id"), F.col("o_orderdate").alias("s"), F.expr("o_orderdate + make_dt_interval(int(o_orderkey % 30))").alias("e"))


SEG = "seg AS (SELECT o_custkey AS cust, o_orderkey AS seg_id, o_orderdate AS s, o_orderdate + to_days(CAST(o_orderkey % 30 AS INTEGER)) AS e FROM orders)"


def hav(a, b, c, e) -> str:
    """Haversine in SQL."""
    return (f"(2 * 6371000.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE, pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({e} - {b}) / 2), 2)))))")


def chain(nx: str, levels: int = 17) -> str:
    """SQL of ``reached`` (i): the rows that pointers (i, j) in ``nx`` lead to from row 1, by doubling them."""
    out = [f"j0 AS MATERIALIZED (SELECT i, j FROM {nx} WHERE j IS NOT NULL), r0 AS MATERIALIZED (SELECT CAST(1 AS BIGINT) AS i)"]
    for k in range(levels):
        out.append(f"r{k + 1} AS MATERIALIZED (SELECT i FROM r{k} UNION SELECT j FROM r{k} JOIN j{k} USING (i)), j{k + 1} AS MATERIALIZED (SELECT a.i, b.j FROM j{k} a JOIN j{k} b ON a.j = b.i)")
    return ", ".join([*out, f"reached AS (SELECT i FROM r{levels})"])
