"""Greedy thinning of one sequence of all rows, without a task that holds it.

What is kept depends on what was kept before, so the fold looks sequential.  But from every row it is
known which row would be kept next, and these pointers compose: within a range of the order they are
followed to the last row that would be kept there, and across ranges the pointers between such last
rows are doubled until the first row's chain is whole.  A task holds one range.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfold.functions.geo import EARTH_RADIUS_M
from wayfold.sources.shared import release, saved, ship_package

Names = Sequence[str]
#: Rows of a range.
ROWS = 1 << 20


def places_apart(metres: float, lat: str = "lat", lon: str = "lon") -> Callable:
    """A test of whether rows are ``metres`` or more apart on the sphere."""

    def far(last: dict, rows: dict) -> np.ndarray:
        a, b, c, d = (np.radians(np.asarray(x, dtype=np.float64)) for x in (last[lat], last[lon], rows[lat], rows[lon]))
        h = np.sin((c - a) / 2) ** 2 + np.cos(a) * np.cos(c) * np.sin((d - b) / 2) ** 2
        return 2 * EARTH_RADIUS_M * np.arcsin(np.sqrt(np.clip(h, 0.0, 1.0))) >= metres

    return far


def _first_far(left: dict, right: dict, start: np.ndarray, far: Callable, seconds: float) -> np.ndarray:
    """For each row of ``left`` the first row of ``right``, from its place in ``start`` on, that it lets be kept; -1 if none does."""
    n, found, open_, at = len(right["t"]), np.full(len(start), -1, dtype=np.int64), np.arange(len(start)), start.copy()
    while len(open_):
        inside = at[open_] < n
        open_ = open_[inside]
        to = at[open_]
        a, b = {c: x[open_] for c, x in left.items()}, {c: x[to] for c, x in right.items()}
        done = (b["t"] - a["t"] >= seconds) | far(a, b)
        found[open_[done]] = to[done]
        open_ = open_[~done]
        at[open_] += 1
    return found


def next_kept(rows: dict, far: Callable, seconds: float) -> np.ndarray:
    """The row that is kept next after each row, -1 where none is."""
    return _first_far(rows, rows, np.arange(1, len(rows["t"]) + 1), far, seconds)


def _ends(nxt: np.ndarray) -> np.ndarray:
    """The last row of each row's chain."""
    jump = np.where(nxt < 0, np.arange(len(nxt)), nxt)
    while not np.array_equal(further := jump[jump], jump):
        jump = further
    return jump


def thin_all(df: DataFrame, t: str, ties: Names, fields: Names, far: Callable, seconds: float, carried: Names = (), rows_of_range: int = ROWS) -> DataFrame:
    """W30 over all sources: keeps a row that is ``seconds`` after the last kept row, or ``far`` from it.

    ``t`` and ``ties`` order the rows totally; those without a time are left out.  ``far(last, rows)`` gets dicts of numpy
    arrays of ``fields``, as many of both, and must be false where it can't tell.  Gives t, ties, fields and what else is
    ``carried`` of the rows that are kept.
    """
    spark = df.sparkSession
    ship_package(spark)
    columns = list(dict.fromkeys([t, *ties, *fields, *carried]))
    wanted = df.where(F.col(t).isNotNull()).select(*columns)
    ranges = max(1, -(-wanted.count() // rows_of_range))
    dealt = wanted.repartitionByRange(ranges, t, *ties).sortWithinPartitions(t, *ties)
    rows = saved(dealt.withColumn("__id", F.monotonically_increasing_id()).withColumn("__range", F.shiftright("__id", 33)), "ranges")
    values = list(dict.fromkeys([t, *fields]))

    def arrays(f: pd.DataFrame) -> dict:
        return {"t": f[t].to_numpy(), **{c: f[c].to_numpy() for c in fields}}

    def edges(f: pd.DataFrame) -> pd.DataFrame:
        """A range's rows that may be kept first in it, and those that may be kept last in it."""
        f = f.sort_values("__id", ignore_index=True)
        nxt = next_kept(arrays(f), far, seconds)
        f["__end"] = f["__id"].to_numpy()[_ends(nxt)]
        f["__last"] = nxt < 0
        early = f[t].to_numpy() < f[t].to_numpy()[0] + seconds
        f["__first"] = early | np.append(True, early[:-1])  # and the row after them
        return f.loc[f["__first"] | f["__last"], ["__range", "__id", *values, "__end", "__first", "__last"]]

    own = [rows.schema[c] for c in values]
    flag = [T.StructField(c, T.BooleanType()) for c in ("__first", "__last")]
    long = lambda c: T.StructField(c, T.LongType())
    ends = saved(rows.groupBy("__range").applyInPandas(edges, T.StructType([long("__range"), long("__id"), *own, long("__end"), *flag])), "ends")

    def entered(key: tuple, last: pd.DataFrame, first: pd.DataFrame) -> pd.DataFrame:
        """Where chains that end before a range enter it; none where the range lets nothing be kept after them."""
        first = first.sort_values("__id", ignore_index=True)
        at = _first_far(arrays(last), arrays(first), np.zeros(len(last), dtype=np.int64), far, seconds) if len(last) else np.zeros(0, dtype=np.int64)
        hit = at >= 0
        out = last[["__id", *values]].assign(__range=key[0], __entry=pd.array([None] * len(last), dtype="Int64"), __to=pd.array([None] * len(last), dtype="Int64"))
        out.loc[hit, "__entry"], out.loc[hit, "__to"] = first["__id"].to_numpy()[at[hit]], first["__end"].to_numpy()[at[hit]]
        return out

    met = T.StructType([long("__id"), *own, long("__range"), long("__entry"), long("__to")])
    firsts = ends.where("__first").select("__range", "__id", "__end", *values)
    waiting, found = ends.where("__last").select("__id", *values, (F.col("__range") + 1).alias("__range")), []
    top = ends.agg(F.max("__range")).first()[0]
    while top is not None:  # once more for each range that chains pass without keeping a row
        step = saved(waiting.groupBy("__range").cogroup(firsts.groupBy("__range")).applyInPandas(entered, met), "entries")
        found.append(step.where("__entry IS NOT NULL").select("__id", "__entry", "__to"))
        waiting = step.where(F.col("__entry").isNull() & (F.col("__range") < top)).select("__id", *values, (F.col("__range") + 1).alias("__range"))
        if waiting.isEmpty():
            break
    if top is None:
        return wanted.limit(0)
    links = found[0]
    for f in found[1:]:
        links = links.union(f)
    links = saved(links, "links")
    start = ends.agg(F.min(F.struct("__id", "__end")).alias("s")).select("s.*").first()
    reached = saved(spark.createDataFrame([(start["__end"],)], "__id long"), "reached")
    jumps, n = links.select("__id", "__to"), 1
    while True:  # the chain of the first row, twice as far each time
        grown = saved(reached.union(reached.join(jumps, "__id").select(F.col("__to").alias("__id"))).distinct(), "reached")
        release(reached)
        reached, before, n = grown, n, grown.count()
        if n == before:
            break
        a, b = jumps.select("__id", F.col("__to").alias("__mid")), jumps.select(F.col("__id").alias("__mid"), "__to")
        jumps = saved(a.join(b, "__mid").select("__id", "__to"), "jumps")
    first = spark.createDataFrame([(start["__id"],)], "__entry long")
    entries = links.join(reached, "__id").select("__entry").union(first).select(F.shiftright("__entry", 33).alias("__range"), "__entry")

    def kept(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("__id", ignore_index=True)
        nxt, i, taken = next_kept(arrays(f), far, seconds).tolist(), int(np.searchsorted(f["__id"].to_numpy(), f["__entry"].iloc[0])), []
        while i >= 0:
            taken.append(i)
            i = nxt[i]
        return f.loc[taken, columns]

    placed = rows.join(F.broadcast(entries), "__range")  # a row for each range at most
    return placed.groupBy("__range").applyInPandas(kept, T.StructType([rows.schema[c] for c in columns]))
