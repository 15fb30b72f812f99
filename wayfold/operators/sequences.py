"""Operators along a sequence of rows: sessions, runs, streaks, crops, dedupes, folds.

``keys`` name the sequence, ``order`` its order, which must be total.  All are windows or grouped
aggregates, so they scale with the number of sequences; only :func:`greedy_thin` holds a sequence
(of bounded columns) at once, inside the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions.geo import haversine
from wayfold.functions.parse import finite
from wayfold.sources.shared import saved

Names = Sequence[str]

#: Rows that a task of a table dealt by key holds, about.
TASK_ROWS = 1 << 18


def over(keys: Names, order: Sequence) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def dealt(df: DataFrame, keys: Names) -> DataFrame:
    """The rows by key over as many tasks as hold about ``TASK_ROWS`` each, so that what a task sorts doesn't grow with the table.

    Left to themselves, shuffles are put together by compressed bytes, of which a task may hold millions of rows.
    """
    n = df.count() // TASK_ROWS
    return df.repartition(max(n + 1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys) if n else df


def micros(c: Column) -> Column:
    """Microseconds since 1970 of a timestamp of either kind."""
    return F.unix_micros(c.cast("timestamp"))


def gap_sessions(df: DataFrame, keys: Names, ts: str, order: Names, gap_s: float, name: str = "session_id") -> DataFrame:
    """Numbers from 1; a session ends where the next gap is over ``gap_s`` (strictly)."""
    w = over(keys, order)
    step = micros(F.col(ts)) - F.lag(micros(F.col(ts))).over(w)
    fresh = F.when(step.isNull() | (step > gap_s * 1_000_000), 1).otherwise(0)
    return df.withColumn("__fresh", fresh).withColumn(name, F.sum("__fresh").over(w).cast("long")).drop("__fresh")


def same(a: DataFrame, b: DataFrame, columns: Names) -> Column:
    """Whether two tables' rows agree in columns, nulls included."""
    out = F.lit(True)
    for c in columns:
        out = out & a[c].eqNullSafe(b[f"__{c}"])
    return out


def day_pass_ids(df: DataFrame, keys: Names, day: str, order: Names) -> DataFrame:
    """The rank of the day among the sequence's days, and the row's number in its day.

    Days are ranked apart, a row each, and joined back, so that no task holds all rows of a sequence.
    """
    named = [F.col(c).alias(f"__{c}") for c in (*keys, day)]
    days = df.select(*named).distinct()
    days = days.withColumn("pass_id", F.row_number().over(over([f"__{k}" for k in keys], [f"__{day}"])).cast("long"))
    out = df.join(days, same(df, days, [*keys, day])).select(*df.columns, "pass_id")
    return out.withColumn("pass_row_index", F.row_number().over(over([*keys, day], order)).cast("long"))


def with_extremes(df: DataFrame, keys: dict[str, Column], t: Column, counted: Column | None = None) -> DataFrame:
    """The rows with the first and last ``t`` of those that share ``keys``, and how many are ``counted``: __first, __last, __count.

    They are aggregated before they are shuffled and joined back, so that no task holds all rows of a key.
    """
    rows = df.withColumns({f"__by_{k}": c for k, c in keys.items()}).withColumn("__t", t)
    names = [f"__by_{k}" for k in keys]
    ends = rows.groupBy(*[F.col(c).alias(f"__{c}") for c in names]).agg(F.min("__t").alias("__first"), F.max("__t").alias("__last"), F.count_if(F.lit(True) if counted is None else counted).alias("__count"))
    return rows.join(ends, same(rows, ends, names)).select(*rows.columns, "__first", "__last", "__count").drop(*names)


def steps(df: DataFrame, keys: Names, ts: str, lat: str, lon: str, order: Names, jump_m_s: float = 70.0) -> DataFrame:
    """Seconds, metres and speed since the row before, and whether that is a jump."""
    w = over(keys, order)
    delta = (micros(F.col(ts)) - F.lag(micros(F.col(ts))).over(w)) / 1e6
    metres = haversine(F.lag(lat).over(w), F.lag(lon).over(w), F.col(lat), F.col(lon))
    out = df.withColumn("delta_s", delta).withColumn("step_distance_m", metres)
    out = out.withColumn("step_speed_m_s", F.when(F.col("delta_s") != 0, F.col("step_distance_m") / F.col("delta_s")))
    return out.withColumn("jump_flag", F.coalesce(F.col("step_speed_m_s") > jump_m_s, F.lit(False)))


def best_row(df: DataFrame, keys: Names, order: Sequence) -> DataFrame:
    """The first row of each key in an order."""
    return df.withColumn("__nth", F.row_number().over(over(keys, order))).where("__nth = 1").drop("__nth")


def longest_run_below(df: DataFrame, keys: Names, pos: str, value: str, threshold: float) -> DataFrame:
    """For each sequence the longest run of values under a threshold: last less first position,
    and a median step, which counts as the last one's length.  Null values are left out first."""
    rows = df.where(F.col(value).isNotNull())
    w = over(keys, [pos])
    step = F.col(pos) - F.lag(pos).over(w)
    rows = rows.withColumn("__low", F.col(value) < threshold).withColumn("__step", F.when(step > 0, step))
    turn = F.when(F.coalesce(F.lag("__low").over(w) != F.col("__low"), F.lit(True)), 1).otherwise(0)
    rows = rows.withColumn("__turn", turn).withColumn("__run", F.sum("__turn").over(w))
    usual = rows.groupBy(*keys).agg(F.percentile("__step", F.lit(0.5)).alias("step"))
    runs = rows.where("__low").groupBy(*keys, "__run").agg((F.max(pos) - F.min(pos)).alias("span"))
    longest = runs.groupBy(*keys).agg(F.max("span").alias("span"))
    out = usual.join(longest, list(keys), "left")
    return out.select(*keys, F.when(F.col("span").isNull(), F.lit(0.0)).otherwise(F.col("span") + F.coalesce("step", F.lit(5.0))).alias("longest_run"))


def first_streak(df: DataFrame, keys: Names, pos: str, value: str, length: int, zone: float = 0.2, least: int = 10, most: int = 600) -> DataFrame:
    """Where the first ``length`` drops in a row begin, in the head zone; null if nowhere."""
    w = over(keys, [pos])
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    rows = df.withColumn("__i", F.row_number().over(w) - 1).withColumn("__n", n)
    rows = rows.withColumn("__drop", F.coalesce(F.col(value) < F.lag(value).over(w), F.lit(False)))
    back = F.last(F.when(~F.col("__drop"), F.col("__i")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("__streak", F.col("__i") - back)
    limit = F.least(F.greatest(F.floor(F.col("__n") * zone), F.lit(least)), F.lit(most))
    hit = F.when((F.col("__streak") >= length) & (F.col("__i") < limit), F.col("__i") - (length - 1))
    return rows.groupBy(*keys).agg(F.min(hit).cast("long").alias("streak_start"))


def tail_rise(df: DataFrame, keys: Names, pos: str, value: str, zone: float = 0.2, least: int = 10, most: int = 600) -> DataFrame:
    """The exclusive end of a crop after the last rise in the tail zone; 0 if there is none."""
    w = over(keys, [pos])
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    rows = df.withColumn("__i", F.row_number().over(w) - 1).withColumn("__n", n)
    rows = rows.withColumn("__rise", F.coalesce(F.col(value) > F.lag(value).over(w), F.lit(False)))
    start = F.col("__n") - F.least(F.greatest(F.floor(F.col("__n") * zone), F.lit(least)), F.lit(most))
    return rows.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("__rise") & (F.col("__i") >= start), F.col("__i") + 1)), F.lit(0)).cast("long").alias("crop_end"))


def crop(df: DataFrame, keys: Names, pos: str, start: Column, end: Column) -> DataFrame:
    """Rows [start, end) of each sequence; an end not after the start means the whole tail."""
    rows = df.withColumn("__i", F.row_number().over(over(keys, [pos])) - 1)
    first = F.coalesce(start, F.lit(0))
    return rows.where((F.col("__i") >= first) & ((end <= first) | (F.col("__i") < end))).drop("__i")


def prefix_cap(df: DataFrame, keys: Names, ts: str, order: Names, seconds: float, rows_without_time: int | None = None) -> DataFrame:
    """Rows up to the first that is over ``seconds`` after the first row with a time; later ones go for good."""
    w = over(keys, order)
    start = F.first(micros(F.col(ts)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    late = F.coalesce((micros(F.col(ts)) - start) > seconds * 1_000_000, F.lit(False))
    rows = df.withColumn("__late", F.max(late.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    fine = F.col("__late") == 0
    if rows_without_time is not None:
        rows = rows.withColumn("__start", start).withColumn("__i", F.row_number().over(w))
        fine = F.when(F.col("__start").isNull(), F.col("__i") <= rows_without_time).otherwise(fine)
    return rows.where(fine).drop("__late", "__start", "__i")


def trim_empty_ends(df: DataFrame, keys: Names, pos: str, columns: Names) -> DataFrame:
    """Rows from the first to the last with something in ``columns``; blank text is nothing."""
    full = F.lit(False)
    for c in columns:
        full = full | F.coalesce(F.trim(F.col(c).cast("string")) != "", F.lit(False))
    w = Window.partitionBy(*keys)
    rows = df.withColumn("__at", F.when(full, F.col(pos)))
    rows = rows.withColumn("__first", F.min("__at").over(w)).withColumn("__last", F.max("__at").over(w))
    return rows.where(F.col(pos).between(F.col("__first"), F.col("__last"))).drop("__at", "__first", "__last")


def rolling_median(df: DataFrame, keys: Names, pos: str, value: str, window: int = 5, least: int = 1, name: str = "smooth") -> DataFrame:
    """The median of the finite values around each row, with shorter windows at the ends."""
    w = over(keys, [pos]).rowsBetween(-(window // 2), window // 2)
    x = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), F.col(value))
    return df.withColumn(name, F.when(F.count(x).over(w) >= least, F.percentile(x, F.lit(0.5)).over(w)))


def subroutes(df: DataFrame, keys: Names, pos: str, step: Column, floor_m: float = 80.0) -> DataFrame:
    """Numbers from 1; breaks where a step is over a limit fitted to the sequence's steps."""
    w = over(keys, [pos])
    rows = df.withColumn("step_m", step)
    positive = F.when(F.col("step_m") > 0, F.col("step_m"))
    part = Window.partitionBy(*keys)
    fitted = F.least(F.greatest(F.lit(floor_m), 3 * F.percentile(positive, F.lit(0.9)).over(part), 8 * F.percentile(positive, F.lit(0.5)).over(part)), F.lit(8 * floor_m))
    limit = F.when(F.count(positive).over(part) >= 8, fitted).otherwise(F.lit(floor_m))
    rows = rows.withColumn("gap_m", limit)
    fresh = F.when(F.coalesce(F.col("step_m") > F.col("gap_m"), F.lit(False)), 1).otherwise(0)
    return rows.withColumn("__fresh", fresh).withColumn("subroute_id", (F.sum("__fresh").over(w) + 1).cast("long")).drop("__fresh")


def pairs(df: DataFrame, keys: Names, pos: str, x: str, y: str, value: str) -> DataFrame:
    """A segment from each row to the next, with the mean of the values there are; none of no length."""
    w = over(keys, [pos])
    nxt = lambda c: F.lead(c).over(w)
    rows = df.select(*keys, pos, F.col(x).alias("x"), F.col(y).alias("y"), nxt(x).alias("xend"), nxt(y).alias("yend"), F.col(value).alias("__a"), nxt(value).alias("__b"))
    rows = rows.where(F.col("xend").isNotNull() & F.col("yend").isNotNull() & ((F.col("x") != F.col("xend")) | (F.col("y") != F.col("yend"))))
    both = (F.col("__a") + F.col("__b")) / 2
    return rows.withColumn("value", F.coalesce(both, "__a", "__b")).drop("__a", "__b")


def not_backtracking(df: DataFrame, keys: Names, order: Names, chainage: str, tolerance_m: float = 60.0) -> DataFrame:
    """Rows whose chainage is at most the tolerance behind the furthest before.

    A rejected row lies below the furthest so far, so the maximum over all earlier rows is the
    maximum over accepted ones.
    """
    w = over(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    furthest = F.max(chainage).over(w)
    return df.withColumn("accepted", F.coalesce(F.col(chainage) + tolerance_m >= furthest, F.lit(True)))


def greedy_thin(df: DataFrame, keys: Names, t: str, fields: Names, far: callable, seconds: float) -> DataFrame:
    """Keeps a row that is ``seconds`` after the last kept row, or ``far`` from it.

    A fold, for what is kept depends on what was kept.  It runs over the sorted array of a sequence:
    ``t`` in seconds, and ``fields``, of which ``far(last, row)`` tells distance.  Give keys
    under which sequences have a size that one task holds.
    """
    row = F.struct(F.col(t).alias("t"), *[F.col(f) for f in fields])
    kind = df.select(row.alias("r")).schema["r"].dataType.simpleString()
    # The places of kept rows; a place is cheap to append, and the last kept row is looked up by it.
    rows = F.array_sort(F.collect_list(row))
    last = lambda acc, all_: F.get(all_, F.element_at(acc, -1))
    whole = df.groupBy(*keys).agg(rows.alias("__rows")).withColumn("__rows", F.col("__rows").cast(f"array<{kind}>"))
    new = lambda acc, i: (F.size(acc) == 0) | (F.get("__rows", i)["t"] - last(acc, F.col("__rows"))["t"] >= seconds) | far(last(acc, F.col("__rows")), F.get("__rows", i))
    kept = F.aggregate(F.sequence(F.lit(0), F.size("__rows") - 1), F.array().cast("array<int>"), lambda acc, i: F.when(new(acc, i), F.concat(acc, F.array(i))).otherwise(acc))
    return whole.withColumn("__kept", kept).select(*keys, F.explode(F.transform("__kept", lambda i: F.get("__rows", i))).alias("__r")).select(*keys, "__r.*")


def placed_routes(df: DataFrame, keys: Names, lat: str, lon: str, least: int = 2) -> DataFrame:
    """Rows with a finite place, of sequences that have ``least`` of them."""
    fine = df.where(finite(F.col(lat)).isNotNull() & finite(F.col(lon)).isNotNull())
    enough = fine.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= least)
    return fine.join(enough, same(fine, enough, keys), "left_semi")


def drop_detection(df: DataFrame, keys: Names, order: Names, value: str, least_drop: float, threshold: float, tolerance: float = 0.0) -> DataFrame:
    """The row (of those with a finite value) after the largest drop of at least ``least_drop``; else the first up to a
    threshold and its tolerance; null where there are fewer than two rows."""
    w = over(keys, order)
    fine = df.where(~F.isnan(value) & (F.abs(value) < float("inf")))
    rows = fine.withColumn("__diff", F.col(value) - F.lag(value).over(w)).withColumn("__i", F.row_number().over(w))
    big = F.min(F.when(F.col("__diff") <= -abs(least_drop), F.struct("__diff", "__i")))
    low = F.min(F.when(F.col(value) <= threshold + abs(tolerance), F.col("__i")))
    found = rows.groupBy(*keys).agg(big.alias("__big"), low.alias("__low"), F.count(F.lit(1)).alias("__n"))
    return found.select(*keys, F.when(F.col("__n") >= 2, F.coalesce(F.col("__big.__i"), F.col("__low"))).cast("long").alias("drop_row"))


def iqr_inliers(df: DataFrame, keys: Names, value: str, times: float = 1.5, least: int = 12, survive: int = 8) -> DataFrame:
    """Rows within the quartiles by 1.5 of their distance; from 40 rows on, where none is out, within
    the first and last hundredth; all where there are under ``least`` or under ``survive`` would be left."""
    part = Window.partitionBy(*keys)
    q = lambda p: F.percentile(value, F.lit(p)).over(part)
    rows = df.withColumn("__n", F.count(value).over(part))
    rows = rows.withColumn("__low", q(0.25) - times * (q(0.75) - q(0.25))).withColumn("__high", q(0.75) + times * (q(0.75) - q(0.25)))
    rows = rows.withColumn("__in", F.col(value).between(F.col("__low"), F.col("__high")))
    rows = rows.withColumn("__out", F.sum((~F.col("__in")).cast("int")).over(part))
    tail = (F.col("__out") == 0) & (F.col("__n") >= 40)
    rows = rows.withColumn("__in", F.when(tail, F.col(value).between(q(0.01), q(0.99))).otherwise(F.col("__in")))
    left = F.sum(F.col("__in").cast("int")).over(part)
    rows = rows.withColumn("__left", left)
    return rows.where((F.col("__n") < least) | (F.col("__left") < survive) | F.col("__in")).drop("__n", "__low", "__high", "__in", "__out", "__left")


def compact_axis(df: DataFrame, day: str, ts: str) -> DataFrame:
    """Days without data take no room: the day's rank, and where in the day the row is."""
    of_day = F.pmod(micros(F.col(ts)), F.lit(86_400_000_000)) / 86_400_000_000
    ranks = df.select(day).distinct().withColumn("__rank", F.dense_rank().over(Window.orderBy(day)))
    return df.join(ranks, day).withColumn("axis", F.col("__rank") - 0.45 + 0.9 * of_day).drop("__rank")


def table_rank(df: DataFrame, order: Names, name: str) -> DataFrame:
    """The row's number (from 1) in the whole table (and __n, the table's rows), without taking it through one task.

    Rows are dealt out by ranges of all columns of the order, which must be total, sorted within a range, and written to
    the shared folder; a row's number is its place there and the rows of the ranges before.
    """
    place = F.monotonically_increasing_id()  # the range, and the place in it
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = saved(dealt.withColumn("__range", F.shiftright(place, 33)).withColumn("__at", place.bitwiseAND(F.lit((1 << 33) - 1))), "ranked")
    counts = rows.groupBy("__range").agg(F.count(F.lit(1)).alias("__count"))  # a row for each range
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__range", F.coalesce(F.sum("__count").over(before), F.lit(0)).alias("__before"), F.sum("__count").over(Window.partitionBy()).alias("__n"))
    rows = rows.join(F.broadcast(offsets), "__range")  # as many rows as partitions
    return rows.withColumn(name, F.col("__before") + F.col("__at") + 1).drop("__range", "__at", "__before")


def systematic_sample(df: DataFrame, order: Names, most: int, keys: Names = ()) -> DataFrame:
    """At most ``most`` rows of each sequence, evenly spaced, first and last among them.

    Without keys the whole table is one sequence: only the columns of its order are ranked, and the rows taken are
    found by them (at most ``most``, which are broadcast).
    """
    if keys:
        rows = df.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).withColumn("__i", F.row_number().over(over(keys, order)))
    else:
        rows = table_rank(df.select(*order), order, "__i")
    # Row i is taken if it is the rounded place of some step k: 1 + k * (n - 1) / (m - 1).
    gap = (F.col("__n") - 1) / F.lit(float(most - 1))
    k = F.floor((F.col("__i") - 1) / gap)
    hit = (F.rint(1 + k * gap) == F.col("__i")) | (F.rint(1 + (k + 1) * gap) == F.col("__i"))
    taken = rows.where((F.col("__n") <= most) | hit).drop("__n", "__i")
    if keys:
        return taken
    # Where rows tie in the order, as many are taken as hit ranks, the first by all their columns.
    named = taken.groupBy(*[F.col(c).alias(f"__{c}") for c in order]).agg(F.count(F.lit(1)).alias("__wanted"))
    same = [df[c].eqNullSafe(named[f"__{c}"]) for c in order]
    met = df.join(F.broadcast(named), same)  # at most ``most`` rows
    tie = Window.partitionBy(*order).orderBy(F.xxhash64(*df.columns), F.hash(*df.columns))
    return met.withColumn("__nth", F.row_number().over(tie)).where("__nth <= __wanted").select(*df.columns)
