"""Passes of a mobile sensor held against fixed stations, and the reference system of coordinates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions.geo import SYSTEMS
from wayfold.functions.parse import best_filled, finite, robust_number, station_column
from wayfold.operators import aggregates as A
from wayfold.operators import sequences as S

Names = Sequence[str]

# What mobile columns hold, best first, and the station's pollutant that each is held against.
MOBILE = {
    "PM2.5": ["mobile_aq__pm2_5_count", "pm2_5_count", "pm2_5_ug_m3", "pm2_5_atm_ug_m3"],
    "NO2": ["mobile_aq__gas_oxidising_ohms", "gas_oxidising_ohms"],
    "NO": ["mobile_aq__gas_reducing_ohms", "gas_reducing_ohms"],
}
REQUIRED = ["station_id", "station_hour_local", "pass_id", "mobile_timestamp_local"]
# End of fixed values.


def in_days(ts: Column, first: str, last: str) -> Column:
    """Whether a local time is on the days from ``first`` (its first second) to ``last`` (its last)."""
    return F.coalesce((ts >= F.to_timestamp_ntz(F.lit(f"{first} 00:00:00"))) & (ts <= F.to_timestamp_ntz(F.lit(f"{last} 23:59:59"))), F.lit(False))


def pass_summary(rows: DataFrame, mobile: Column, station: Column) -> DataFrame:
    """C14, A1: passes in an hour with both sides: pass_timestamp, mobile_value, station_value, mobile_points.

    The mobile mean is of all values there are, the station's of the finite ones; passes without a time, a mobile value or
    a station's are left out.  Rows have station_id, station_label, pass_id, station_hour and mobile_ts.
    """
    t = rows.withColumn("__m", mobile).withColumn("__s", station).where("__m IS NOT NULL")
    out = t.groupBy("station_id", "station_label", "pass_id", "station_hour").agg(
        F.coalesce(F.min("mobile_ts"), F.min("station_hour")).alias("pass_timestamp"), F.avg("__m").alias("mobile_value"),
        F.avg(finite(F.col("__s"))).alias("station_value"), F.count("__m").alias("mobile_points"))
    return out.where("pass_timestamp IS NOT NULL AND mobile_points > 0 AND station_value IS NOT NULL")


def daily(passes: DataFrame, keys: Names = ("station_id",)) -> DataFrame:
    """A3: means of a day's passes with finite values on both sides, at noon, and their number."""
    fine = passes.where(finite(F.col("station_value")).isNotNull() & finite(F.col("mobile_value")).isNotNull() & F.col("pass_timestamp").isNotNull())
    out = fine.groupBy(*keys, F.to_date("pass_timestamp").alias("__day")).agg(F.avg("station_value").alias("station_daily_mean"), F.avg("mobile_value").alias("mobile_daily_mean"), F.count(F.lit(1)).alias("n_passes"))
    return out.withColumn("pass_timestamp", F.expr("cast(__day AS timestamp_ntz) + interval 12 hours")).drop("__day")


def compared(matched: DataFrame, pollutant: str, station_ids: Sequence[str]) -> DataFrame:
    """Pass summaries of the stations that have the pollutant, with the columns that were compared, the axis
    (F40), and the passes scaled to the station's range (W26).

    ``matched`` has the required columns as text or typed; stations without the column, or without passes, give nothing.
    """
    if missing := [c for c in REQUIRED if c not in matched.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    mobile = best_filled(matched, MOBILE[pollutant])
    label = F.when(F.coalesce(F.col("station_label"), F.lit("")) != "", F.col("station_label")).otherwise(F.col("station_id")) if "station_label" in matched.columns else F.col("station_id")
    rows = matched.withColumn("station_label", label).withColumn("station_hour", F.col("station_hour_local").cast("timestamp_ntz")).withColumn("mobile_ts", F.col("mobile_timestamp_local").cast("timestamp_ntz"))
    out = None
    for sid in station_ids if mobile is not None else ():
        column = station_column(matched.columns, sid, pollutant)
        if column is None:
            continue
        number = lambda c: robust_number(F.col(f"`{c}`").cast("string"))
        part = pass_summary(rows.where(F.col("station_id") == sid), number(mobile), number(column)).withColumn("mobile_column", F.lit(mobile)).withColumn("station_column", F.lit(column))
        out = part if out is None else out.unionByName(part)
    if out is None:
        none = rows.limit(0).withColumn("__x", F.lit(None).cast("double"))
        out = pass_summary(none, F.col("__x"), F.col("__x")).withColumn("mobile_column", F.lit("")).withColumn("station_column", F.lit(""))
    axis = A.padded_limits(out, ["station_id"], ["mobile_value", "station_value"]).withColumnsRenamed({"low": "axis_low", "high": "axis_high"})
    ends = out.groupBy("station_id").agg(F.min("mobile_value").alias("__a"), F.max("mobile_value").alias("__b"), F.min("station_value").alias("__c"), F.max("station_value").alias("__d"))
    out = out.join(F.broadcast(axis), "station_id").join(F.broadcast(ends), "station_id")  # a row for each station
    return out.withColumn("mobile_scaled", A.rescale(F.col("mobile_value"), F.col("__a"), F.col("__b"), F.col("__c"), F.col("__d"))).drop("__a", "__b", "__c", "__d")


def compared_manifest(compared_passes: DataFrame, pollutant: str) -> DataFrame:
    """C14, K9: a row for each station: what was compared, and how many passes."""
    by = compared_passes.groupBy("station_id", "station_label", "mobile_column", F.col("station_column").alias("station_columns"))
    return by.agg(F.count(F.lit(1)).alias("compared_passes")).withColumn("plot_type", F.lit(pollutant.lower()))


def reference_system(points: DataFrame, keys: Names, lat: str, lon: str, order: Names, default: int = 32633, sample: int = 300) -> DataFrame:
    """The EPSG code of each key's coordinates (north or latitude, east or longitude), with its score.

    4326 where there are fewer than two, or where 98 % are at most 90 and 180; else, of the systems known, the one in which
    an even sample of ``sample`` points makes the best latitudes and longitudes: nine of ten valid, in a small box that isn't none.
    """
    fine = points.where(finite(F.col(lat)).isNotNull() & finite(F.col(lon)).isNotNull())
    q = fine.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.percentile(F.abs(lat), F.lit(0.98)).alias("__lat"), F.percentile(F.abs(lon), F.lit(0.98)).alias("__lon"))
    q = points.select(*keys).distinct().join(q, list(keys), "left").withColumn("__plain", F.coalesce((F.col("__n") < 2) | ((F.col("__lat") <= 90) & (F.col("__lon") <= 180)), F.lit(True)))
    rest = fine.join(q.where("NOT __plain").select(*keys), list(keys), "left_semi")
    chosen = S.systematic_sample(rest.select(*keys, *order, F.col(lat).alias("__y"), F.col(lon).alias("__x")), list(order), sample, list(keys))
    codes = [default, *[c for c in SYSTEMS if c != default]]
    made = []
    for place, code in enumerate(codes):
        y, x = SYSTEMS[code](F.col("__x"), F.col("__y"))
        made.append(F.struct(F.lit(code).alias("epsg"), F.lit(place).alias("place"), y.alias("lat"), x.alias("lon")))
    t = chosen.select(*keys, F.explode(F.array(*made)).alias("c")).select(*keys, "c.*")
    ok = F.coalesce(finite(F.col("lat")).isNotNull() & finite(F.col("lon")).isNotNull() & (F.abs("lat") <= 90) & (F.abs("lon") <= 180), F.lit(False))
    t = t.withColumn("ok", ok)
    of = lambda c: F.when(F.col("ok"), F.col(c))
    s = t.groupBy(*keys, "epsg", "place").agg(F.avg(F.col("ok").cast("double")).alias("valid"), ((F.max(of("lon")) - F.min(of("lon"))) * (F.max(of("lat")) - F.min(of("lat")))).alias("area"))
    s = s.where("valid >= 0.9").withColumn("area", F.when(F.col("area") > 0, F.col("area")).otherwise(1e6))
    penalty = F.when(F.col("area") > 25, 2.0).when(F.col("area") < 1e-8, 1.0).otherwise(0.0)
    bonus = F.when(F.col("epsg") == default, 0.02).otherwise(0.0)
    s = s.withColumn("score", F.col("valid") - F.log1p("area") * 0.05 - penalty + bonus)
    best = S.best_row(s, list(keys), [F.col("score").desc(), "place"]).select(*keys, "epsg", "score")
    out = q.join(best, list(keys), "left")
    return out.select(*keys, F.when(F.col("__plain"), 4326).otherwise(F.coalesce("epsg", F.lit(default))).alias("epsg"), F.when(~F.col("__plain"), F.col("score")).alias("score"))
