"""Grouped aggregates of passes, days, routes, bins and edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions.geo import DEGREE_M
from wayfold.functions.parse import finite
from wayfold.sources.shared import saved

Names = Sequence[str]


def stats(c: Column, name: str) -> list[Column]:
    """Mean, median, least and most of the finite values."""
    x = finite(c)
    return [F.avg(x).alias(f"{name}_mean"), F.percentile(x, F.lit(0.5)).alias(f"{name}_median"), F.min(x).alias(f"{name}_min"), F.max(x).alias(f"{name}_max")]


def quantiles(df: DataFrame, keys: Names, value: str, shares: Sequence[float], accuracy: int = 20_000) -> DataFrame:
    """Exact quantiles (linear between neighbours) of finite values: keys, n and q, an array as long as ``shares``.

    No task holds a group's values: a sketch bounds each quantile from both sides, one pass counts what is below the
    bounds and groups what is within them by value, and the wanted ranks are found among those few.  Bounds that miss a
    rank are widened.  Keys must not be null; there should be few of them (a plain ``percentile`` is for many small groups).
    """
    rows = df.where(finite(F.col(value)).isNotNull()).select(*keys, F.col(value).cast("double").alias("__x"))
    wide = 2.0 / accuracy
    while True:
        ends = [min(1.0, max(0.0, p + d)) for p in shares for d in (-wide, wide)]
        sketch = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("__x").alias("__least"), F.max("__x").alias("__most"), F.percentile_approx("__x", ends, accuracy).alias("__cuts"))
        part = F.explode(F.array(*[F.struct(
            F.lit(i).alias("i"), F.lit(p).alias("p"), (F.col("__least") if p - wide <= 0 else F.get("__cuts", F.lit(2 * i))).alias("low"),
            (F.col("__most") if p + wide >= 1 else F.get("__cuts", F.lit(2 * i + 1))).alias("high")) for i, p in enumerate(shares)])).alias("w")
        bounds = saved(sketch.select(*keys, "n", part).select(*keys, "n", "w.*"), "bounds")  # a row for each key and share
        met = rows.join(F.broadcast(bounds), list(keys)) if keys else rows.join(F.broadcast(bounds))  # few keys, or a row for each share
        below = met.where("__x < low").groupBy(*keys, "i").agg(F.count(F.lit(1)).alias("below"))
        counts = met.where("__x >= low AND __x <= high").groupBy(*keys, "i", "__x").agg(F.count(F.lit(1)).alias("c"))
        counts = counts.join(below, [*keys, "i"], "left").join(bounds, [*keys, "i"])
        upto = F.coalesce("below", F.lit(0)) + F.sum("c").over(Window.partitionBy(*keys, "i").orderBy("__x"))
        place = F.col("p") * (F.col("n") - 1)
        counts = counts.withColumn("upto", upto).withColumn("lower", F.floor(place)).withColumn("upper", F.ceil(place)).withColumn("share", place - F.floor(place))
        has = lambda r: (F.col("upto") > F.col(r)) & (F.col("upto") - F.col("c") <= F.col(r))
        found = counts.groupBy(*keys, "i").agg(F.max("n").alias("n"), F.max("share").alias("share"), F.max(F.when(has("lower"), F.col("__x"))).alias("a"), F.max(F.when(has("upper"), F.col("__x"))).alias("b"))
        found = saved(found, "quantiles")
        if wide >= 1 or found.where("a IS NULL OR b IS NULL").isEmpty():
            break
        wide *= 8
    between = F.col("a") + (F.col("b") - F.col("a")) * F.col("share")
    ordered = F.array_sort(F.collect_list(F.struct("i", between.alias("x"))))
    out = found.groupBy(*keys).agg(F.max("n").alias("n"), F.transform(ordered, lambda s: s["x"]).alias("q"))
    return out


def stop_speed(speeds: DataFrame, speed: str) -> DataFrame:
    """One row: the speed up to which one stands (a fifth of all are slower; 0.45 to 1.6), and the medians up to it and above."""
    fine = speeds.where(F.col(speed).between(0.0, 35.0)).select(F.col(speed).alias("__v"))
    limit = quantiles(fine, [], "__v", [0.2]).select(F.greatest(F.lit(0.45), F.least(F.lit(1.6), F.get("q", F.lit(0)))).alias("stand_mps"), F.col("n").alias("samples"))
    rows = fine.join(F.broadcast(limit.select("stand_mps")))  # one row
    halves = quantiles(rows.withColumn("__moving", F.col("__v") > F.col("stand_mps")), ["__moving"], "__v", [0.5])
    median = lambda m: F.max(F.when(F.col("__moving") == m, F.get("q", F.lit(0))))
    out = halves.agg(median(False).alias("stand_median_mps"), median(True).alias("moving_median_mps"))
    return limit.join(F.broadcast(out))  # one row each


def padded_limits(df: DataFrame, keys: Names, values: Names) -> DataFrame:
    """low and high of an axis: a twentieth of the range beyond the finite values; a range that is a point is
    padded by a tenth of it, one at least; 0 to 1 without values."""
    every = F.array(*[finite(F.col(c).cast("double")) for c in values])
    out = df.groupBy(*keys).agg(F.min(F.array_min(every)).alias("__a"), F.max(F.array_max(every)).alias("__b"))
    a, b = F.col("__a"), F.col("__b")
    # Numbers that differ by less than this share of them are one.
    same = F.abs(b - a) <= 1.5e-8 * F.when(F.abs(a) > 1.5e-8, F.abs(a)).otherwise(1.0)
    pad = F.when(same, F.greatest(F.lit(1.0), 0.1 * F.abs(a))).otherwise(0.05 * (b - a))
    return out.select(*keys, F.coalesce(a - pad, F.lit(0.0)).alias("low"), F.coalesce(b + pad, F.lit(1.0)).alias("high"))


def padded_box(df: DataFrame, keys: Names, xs: Names, ys: Names, least: float = 1.0, share: float = 0.08) -> DataFrame:
    """a map's limits (x_low, x_high, y_low, y_high) around all finite coordinates; 0 to 1 without any."""
    every = lambda names: F.array(*[finite(F.col(c).cast("double")) for c in names])
    out = df.groupBy(*keys).agg(*[f(g(every(n))).alias(f"__{c}{e}") for c, n in (("x", xs), ("y", ys)) for e, f, g in (("a", F.min, F.array_min), ("b", F.max, F.array_max))])
    there = F.col("__xa").isNotNull() & F.col("__ya").isNotNull()
    cols = []
    for c in "xy":
        a, b = F.col(f"__{c}a"), F.col(f"__{c}b")
        wide = b > a
        a, b = F.when(wide, a).otherwise(a - 0.5), F.when(wide, b).otherwise(b + 0.5)
        pad = F.greatest((b - a) * share, F.lit(least))
        cols += [F.when(there, a - pad).otherwise(0.0).alias(f"{c}_low"), F.when(there, b + pad).otherwise(1.0).alias(f"{c}_high")]
    return out.select(*keys, *cols)


def passes(df: DataFrame, keys: Names, ts: str, hour: str, mobile: str, station: str | Sequence[str]) -> DataFrame:
    """A1, A2: a pass in an hour: its first time, the mean on both sides (the station's finite), its points.

    With several station columns each has its mean, under its own name.
    """
    sides = [F.avg(finite(F.col(station))).alias("station_value")] if isinstance(station, str) else [F.avg(finite(F.col(c))).alias(c) for c in station]
    return df.groupBy(*keys, hour).agg(F.coalesce(F.min(ts), F.min(hour)).alias("pass_ts"), F.avg(mobile).alias("mobile_mean"), *sides, F.count(F.lit(1)).alias("mobile_points"))


def route_bins(df: DataFrame, keys: Names, measure: str, length: Column, value: str, size: float = 20.0) -> DataFrame:
    """Values by stretches of a route; the last one is closed at its end."""
    bins = F.greatest(F.ceil(length / size), F.lit(1))
    index = F.least(F.floor(F.col(measure) / size), bins - 1).cast("long")
    rows = df.withColumn("segment_index", index)
    out = rows.groupBy(*keys, "segment_index").agg(F.count(F.lit(1)).alias("n_points"), *stats(F.col(value), value))
    return out.withColumn("m_start", F.col("segment_index") * size).withColumn("m_mid", (F.col("segment_index") + 0.5) * size)


def merged_edges(segments: DataFrame, route: str, snap: float = 18.0) -> DataFrame:
    """A5: segments with snapped ends as undirected edges; means of values and of the smaller end first."""
    s = lambda c: F.rint(F.col(c) / snap) * snap
    rows = segments.select(route, "value", *[s(c).alias(c) for c in ("x", "y", "xend", "yend")])
    a, b = F.struct("x", "y"), F.struct(F.col("xend").alias("x"), F.col("yend").alias("y"))
    rows = rows.withColumn("p", F.least(a, b)).withColumn("q", F.greatest(a, b)).where("p <> q")
    return rows.groupBy("p", "q").agg(F.count(F.lit(1)).alias("n_obs"), F.countDistinct(route).alias("n_routes"), *stats(F.col("value"), "value")).select(
        F.col("p.x").alias("x"), F.col("p.y").alias("y"), F.col("q.x").alias("xend"), F.col("q.y").alias("yend"), "n_obs", "n_routes", "value_mean", "value_median", "value_min", "value_max")


def color_norm(df: DataFrame, keys: Names, value: str) -> DataFrame:
    """The range of values; one that is a point widens by a standard deviation, or by one, around the median.

    Where all finite values are one, it is the median.
    """
    x = finite(F.col(value))
    out = df.groupBy(*keys).agg(F.min(x).alias("low"), F.max(x).alias("high"), F.stddev_samp(x).alias("sd"))
    pad = F.when(F.coalesce(F.col("sd"), F.lit(0.0)) > 0, F.col("sd")).otherwise(F.lit(1.0))
    flat = F.col("low") == F.col("high")
    return out.select(*keys, F.when(flat, F.col("low") - pad).otherwise(F.col("low")).alias("low"), F.when(flat, F.col("low") + pad).otherwise(F.col("high")).alias("high"))


def rescale(x: Column, low: Column, high: Column, to_low: Column, to_high: Column) -> Column:
    """From one range to another; a range that is a point is padded by a twentieth, one at least."""
    pad = F.greatest(F.abs(low) * 0.05, F.lit(1.0))
    a, b = F.when(low == high, low - pad).otherwise(low), F.when(low == high, high + pad).otherwise(high)
    return to_low + (x - a) / (b - a) * (to_high - to_low)


def centroid(df: DataFrame, keys: Names, lat: str, lon: str, weight: str) -> DataFrame:
    """The weighted mean in the plane around the unweighted mean."""
    mean = df.groupBy(*keys).agg(F.avg(lat).alias("lat0"), F.avg(lon).alias("lon0"))
    rows = df.join(mean, list(keys))
    k = DEGREE_M * F.cos(F.radians("lat0"))
    x, y = (F.col(lon) - F.col("lon0")) * k, (F.col(lat) - F.col("lat0")) * DEGREE_M
    out = rows.groupBy(*keys, "lat0", "lon0").agg((F.sum(F.col(weight) * x) / F.sum(weight)).alias("x"), (F.sum(F.col(weight) * y) / F.sum(weight)).alias("y"))
    return out.select(*keys, (F.col("lat0") + F.col("y") / DEGREE_M).alias("lat"), (F.col("lon0") + F.col("x") / k).alias("lon"))


def top_reason(df: DataFrame, keys: Names, accepted: str, reason: str) -> DataFrame:
    """Fixes considered, accepted and rejected, and the commonest reason; ties: the first by name."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("considered"), F.count_if(F.col(accepted)).alias("accepted"), F.count_if(~F.col(accepted)).alias("rejected"))
    by = df.where(~F.col(accepted)).groupBy(*keys, reason).agg(F.count(F.lit(1)).alias("n"))
    top = by.groupBy(*keys).agg(F.min(F.struct(-F.col("n"), F.col(reason).alias("reason"))).alias("top")).select(*keys, F.col("top.reason").alias("top_reason"))
    return counts.join(top, list(keys), "left")


def class_durations(df: DataFrame, keys: Names, name: str, seconds: float, least_s: float) -> DataFrame:
    """Seconds by class as JSON, and the class that rules, if for ``least_s``; ties: the first."""
    by = df.groupBy(*keys, name).agg((F.count(F.lit(1)) * seconds).alias("s"))
    top = F.min(F.struct(-F.col("s"), F.col(name).alias("name")))
    pairs = F.array_sort(F.collect_list(F.struct(F.col(name).alias("key"), F.col("s").cast("long").alias("value"))))
    out = by.groupBy(*keys).agg(top.alias("top"), F.to_json(F.map_from_entries(pairs)).alias("durations"))
    return out.select(*keys, F.when(-F.col("top.col1") >= least_s, F.col("top.name")).alias("dominant"), "durations")
