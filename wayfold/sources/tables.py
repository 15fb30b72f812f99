"""Scans of logs, reports and timelines: text first, then names and types.

Every scan reads all columns as text, without inference, and types them afterwards; what doesn't
parse is null.  Rows know their file by ``source_file``, so one scan takes any number of files.
Files differ in delimiter, encoding and header: one pass over their lines tells all three of each file,
on the executors, and files alike in them are read by one scan with a fixed schema.
"""

from __future__ import annotations

import csv as csv_rows
import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from functools import reduce
from itertools import batched

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfold.functions.parse import base_name, first_present, flexible_time, header_key, robust_number, slug, to_number
from wayfold.sources.shared import entries, file_system, fresh_path, head, literal, plain_path, release, saved, ship_package

# Names under which logs hold their columns, and those that aren't measurements.
TIME_COLUMNS = ["timestamp_iso", "timestamp", "gps_time_utc", "time", "datetime"]
LAT_COLUMNS, LON_COLUMNS = ["gps_lat", "lat", "latitude"], ["gps_lon", "lon", "lng", "longitude"]
TRACK_TIME_COLUMNS = ["timestamp_iso", "timestamp", "datetime", "date_time", "time", "timestamp_utc", "timestamp_local", "datetime_utc", "datetime_local", "recorded_at", "created_at"]
TRACK_LAT_COLUMNS, TRACK_LON_COLUMNS = ["gps_lat", "gps_latitude", "latitude", "lat", "y"], ["gps_lon", "gps_longitude", "longitude", "lon", "lng", "x"]
SENSOR_TIMES = ["timestamp_iso", "timestamp", "gps_time_utc"]
SENSOR_NUMBERS = ["gps_mode", "gps_lat", "gps_lon", "gps_speed_m_s", "gps_track_deg", "gps_eph_m"]
NOT_MEASURED = ["source_file", "source_name", "output_file", "status", "status_message", "original_filename", "output_filename", "rows_before", "rows_after", "window_start_utc", "window_end_utc", "unix_time_s", "gps_time_utc", "gps_time_iso"]
NOT_METRICS = ["timestamp", "timestamp_iso", "gps_time_utc", "gps_lat", "gps_lon", "gps_mode", "gps_speed_m_s", "gps_track_deg", "gps_eph_m", "source_file", "source_name", "fix_id"]
DISPLAY_TOKENS = ["speed", "distance", "score", "delta", "noise", "pm", "gas", "temp", "humid"]
DELIMITERS = (",", ";", "\t", "|")
HEAD, SMALL, MANY, HEADS = 8192, 32768, 1000, 16
FILES, LISTERS = 1 << 14, 64  # files that the driver lists at a time, and tasks that do it
# End of fixed values.

SEGMENTS = (
    "array<struct<startTime:string,endTime:string,timelinePath:array<struct<point:string,time:string>>,"
    "visit:struct<topCandidate:struct<placeLocation:struct<latLng:string>,probability:string>>,"
    "activity:struct<topCandidate:struct<type:string>,distanceMeters:string,start:struct<latLng:string>,end:struct<latLng:string>>>>"
)


def sniffed(text: str) -> str:
    """The delimiter that most lines hold equally often, then the one they hold most of; a comma if none."""
    lines = [re.sub(r'"[^"]*"', "", x) for x in text.splitlines() if x.strip()]
    best, found = (0.0, 0), ","
    for c in DELIMITERS:
        n, agree = Counter(x.count(c) for x in lines).most_common(1)[0] if lines else (0, 0)
        if n and (agree / len(lines), n) > best:
            best, found = (agree / len(lines), n), c
    return found


def sniffed_delimiter(spark: SparkSession, path: str) -> str:
    """From the first 8192 bytes of a file; a line that they cut counts only if it is the only one."""
    text = head(spark, path).decode("utf-8-sig", "ignore")
    return sniffed(text if len(text) < 8000 or "\n" not in text else text[: text.rindex("\n")])


def header_delimiter(line: str) -> str:
    """S3: the first of comma, semicolon and tab that a header holds, else the first other one; a comma if none."""
    return next((c for c in DELIMITERS if c in line), ",")


def _small_heads(spark: SparkSession, path) -> DataFrame:
    """:func:`_heads` of small files: a file is a row, so nothing is gathered."""
    rows = spark.read.text(path, wholetext=True).where(F.col("_metadata.file_size") <= SMALL)
    longest = F.when(F.contains("value", F.lit("\r")), 2 * HEAD).otherwise(HEAD)  # two marks of a line's end are one
    return rows.select(F.col("_metadata.file_path").alias("file"), F.is_valid_utf8("value").alias("fine"), F.substring(F.col("value").cast("binary"), F.lit(1), longest).alias("head"))


def _heads(spark: SparkSession, path) -> DataFrame:
    """file, fine (whether all lines are UTF-8) and head (the first HEAD bytes) of files with rows that aren't small.

    With a file a task, as many lines as may begin in the first HEAD bytes; so what is gathered of a file is bounded.
    """
    rows = spark.read.text(path).where(F.col("_metadata.file_size") > SMALL)
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    early = (F.col("block") == 0) & (F.col("id").bitwiseAND(F.lit((1 << 33) - 1)) < HEAD)
    first = F.array_sort(F.collect_list(F.when(early, F.struct("id", F.substring(F.col("value").cast("binary"), 1, HEAD).alias("line")))))
    lines = F.transform(first, lambda x: F.concat(x["line"], F.lit(b"\n")))
    head = F.aggregate(lines, F.lit(b""), lambda acc, x: F.when(F.length(acc) < HEAD, F.concat(acc, x)).otherwise(acc))
    return rows.groupBy("file").agg(F.bool_and(F.is_valid_utf8("value")).alias("fine"), F.substring(head, 1, HEAD).alias("head"))


def _kinds(spark: SparkSession, path, delimiter: str | Callable[[str], str] | None, of_kinds: Callable[[DataFrame], DataFrame]) -> list[DataFrame]:
    """``of_kinds`` of file, encoding (UTF-8, or Latin-1 where a line isn't), sep and names (its header's) of files with rows; made and saved.

    Of small files and of other ones.
    """
    ship_package(spark)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for file, fine, first in zip(f["file"], f["fine"], f["head"], strict=True):
                plain = bytes(first).removeprefix(b"\xef\xbb\xbf").replace(b"\r\n", b"\n")[:HEAD]
                text = plain.decode("utf-8" if fine else "latin-1", "ignore")
                if lines := text.splitlines():
                    sep = sniffed(text) if delimiter is None else delimiter if isinstance(delimiter, str) else delimiter(lines[0])
                    out.append((file, "UTF-8" if fine else "ISO-8859-1", sep, list(_header(lines[0], sep))))
            yield pd.DataFrame(out, columns=["file", "encoding", "sep", "names"])

    told = lambda heads: saved(of_kinds(heads.mapInPandas(run, "file string, encoding string, sep string, names array<string>")), "kinds")
    with _file_cost(spark, SMALL):
        small = told(_small_heads(spark, path))
    with _file_cost(spark, "1t"):  # a file a task
        large = told(_heads(spark, path))
    return [small, large]


@contextmanager
def _set(spark: SparkSession, name: str, value: int | str):
    """A setting of the session within it."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(value))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _file_cost(spark: SparkSession, size: int | str):
    """Scans that run within it count this many bytes for opening a file, as they deal files to tasks."""
    return _set(spark, "spark.sql.files.openCostInBytes", size)


def _seen(spark: SparkSession, folder: str) -> Iterator[tuple[str, bool, int, int]]:
    """What readers see of a folder, as :func:`entries` gives it."""
    for x in entries(spark, folder):
        name = x[0].rpartition("/")[2]
        if not (name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")):
            yield x


def _batches(spark: SparkSession, path) -> Iterator[list[tuple[str, int, int]]] | None:
    """Path, size and time (ms) of the files of a folder without folders in it that has over FILES, FILES at a time; None for any other.

    The driver never holds more of them.
    """
    if not isinstance(path, str):
        return None
    n = 0
    for _, folder, _, _ in _seen(spark, path):
        if folder:
            return None
        n += 1
    return batched(((x, size, at) for x, folder, size, at in _seen(spark, path) if not folder), FILES) if n > FILES else None


def _header(line: str, delimiter: str) -> tuple[str, ...]:
    """Names without marks and blanks; nameless ones by place, repeated ones numbered."""
    out: list[str] = []
    for i, c in enumerate(next(csv_rows.reader([line], delimiter=delimiter), [])):
        name = c.replace("﻿", "").strip() or f"Unnamed: {i}"
        n, plain = 0, name
        while name.lower() in (x.lower() for x in out):
            n += 1
            name = f"{plain}.{n}"
        out.append(name)
    return tuple(out)


def scans(spark: SparkSession, path, delimiter: str | Callable[[str], str] | None = None, multiline: bool = False, file_column: str = "source_file") -> list[DataFrame]:
    """A scan for each kind of file: text columns, the file's name, and file_row, which orders a file's rows.

    ``delimiter`` is a character, or chooses one from a file's header; by default it is sniffed.
    Quotes within quoted cells are doubled.  A column named as the file's name is replaced by it.
    Over FILES files are scanned and their rows saved FILES at a time, so the driver holds no more files than these.
    """
    scan = lambda files, flat=False: _scans(spark, files, delimiter, multiline, file_column, flat)
    if not isinstance(path, str) and len(path) > FILES:
        batches = batched(path, FILES)
    elif (found := _batches(spark, path)) is not None:
        batches = ([literal(x) for x, _, _ in b] for b in found)
    else:
        return [df for _, _, df in scan(path)]
    kinds: dict[tuple, list[tuple[str, str, T.StructType]]] = {}  # a row for each batch and kind
    with _set(spark, "spark.sql.sources.parallelPartitionDiscovery.parallelism", LISTERS):
        for b in batches:
            for kind, first, df in scan(list(b), isinstance(path, str)):
                if not hasattr(df, "_wayfold_path"):
                    with _file_cost(spark, SMALL):
                        df = saved(df, "rows")
                kinds.setdefault(kind, []).append((first, df._wayfold_path, df.schema))
    return [spark.read.schema(made[0][2]).parquet(*[x for _, x, _ in made]) for made in sorted(kinds.values(), key=lambda made: min(x for x, _, _ in made))]


def _scans(spark: SparkSession, path, delimiter, multiline: bool, file_column: str, flat: bool) -> list[tuple[tuple, str, DataFrame]]:
    """Kind, first file and scan of each kind of file; ``flat`` if the path is known to be files of one folder."""
    alike = lambda k: k.groupBy("encoding", "sep", "names").agg(F.collect_list("file").alias("files"))
    small, large = _kinds(spark, path, delimiter, alike)
    both = small.withColumn("small", F.size("files")).union(large.withColumn("small", F.lit(0)))
    found = both.groupBy("encoding", "sep", "names").agg(F.sort_array(F.flatten(F.collect_list("files"))).alias("files"), F.sum("small").alias("small")).collect()  # a row for each kind
    release(small, large)
    whole = len(found) == 1 and (flat or spark.read.text(path).columns == ["value"])  # no names of files are needed, and no folders tell columns
    out = []
    for r in sorted(found, key=lambda r: r["files"][0]):
        encoding, sep, names, files = r["encoding"], r["sep"], r["names"], path if whole else [literal(plain_path(f)) for f in r["files"]]
        schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in names)
        df = spark.read.schema(schema).option("quote", '"').option("escape", '"').option("multiLine", multiline).csv(files, sep=sep, header=True, encoding=encoding, mode="PERMISSIVE")
        place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
        df = df.select("*", F.col("_metadata.file_name").alias("__file"), place.alias("file_row")).withColumn(file_column, F.col("__file")).drop("__file")
        if r["small"] > MANY:  # what follows may read them again and again
            with _file_cost(spark, SMALL):
                df = saved(df, "rows")
        out.append(((encoding, sep, tuple(names)), r["files"][0], df))
    return out


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def csv(spark: SparkSession, path, delimiter: str | Callable[[str], str] | None = None) -> DataFrame:
    """All files as text columns, united by name, with source_file."""
    return _union(_required(scans(spark, path, delimiter), path)).drop("file_row")


def flexible_csv(spark: SparkSession, path) -> DataFrame:
    """S3: the delimiter by the header."""
    return csv(spark, path, header_delimiter)


def _required(frames: list[DataFrame], path) -> list[DataFrame]:
    if not frames:
        raise ValueError(f"no rows in {path}")
    return frames


def utc_time(c: Column) -> Column:
    """A time with or without an offset, as a time in UTC without zone; one without an offset is in UTC."""
    t = F.trim(c)
    iso, zoned = t.rlike(r"^\d{4}-\d{2}"), t.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    instant = F.when(zoned & iso, t.try_cast("timestamp")).cast("timestamp_ntz")
    naive = F.coalesce(F.when(iso, t.try_cast("timestamp_ntz")), flexible_time(t).cast("timestamp_ntz"))
    return F.when(zoned, F.convert_timezone(F.current_timezone(), F.lit("UTC"), instant)).otherwise(naive)


def sensor_fixes(spark: SparkSession, path, delimiter: str | None = None) -> DataFrame:
    """Time, place and quality of fixes; the time is that of the first time column which the file has.

    Columns that a file lacks are null; rows without a time or a place go.
    """
    frames = []
    for df in scans(spark, path, delimiter):
        ts = next((c for c in SENSOR_TIMES if c in df.columns), None) or first_present(df.columns, TIME_COLUMNS)
        lat, lon = first_present(df.columns, LAT_COLUMNS), first_present(df.columns, LON_COLUMNS)
        named = {"gps_lat": lat, "gps_lon": lon} | {c: c if c in df.columns else None for c in SENSOR_NUMBERS if c not in ("gps_lat", "gps_lon")}
        number = lambda c: F.lit(None).cast("double") if named[c] is None else to_number(F.col(f"`{named[c]}`"))
        time = F.lit(None).cast("timestamp_ntz") if ts is None else utc_time(F.col(f"`{ts}`"))
        frames.append(df.select("source_file", time.alias("ts"), number("gps_lat").alias("lat"), number("gps_lon").alias("lon"), *[number(c).alias(c) for c in SENSOR_NUMBERS if c not in ("gps_lat", "gps_lon")]))
    return _union(_required(frames, path)).where("ts IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL")


def fix_times(spark: SparkSession, path, delimiter: str | None = None) -> DataFrame:
    """The times of a log alone."""
    frames = []
    for df in scans(spark, path, delimiter):
        ts = next((c for c in SENSOR_TIMES if c in df.columns), None)
        frames.append(df.select("source_file", (F.lit(None).cast("timestamp_ntz") if ts is None else utc_time(F.col(ts))).alias("ts")))
    return _union(_required(frames, path)).where("ts IS NOT NULL")


def mobile_track(spark: SparkSession, path, zone: str = "Europe/Berlin", placed: bool = False) -> DataFrame:
    """All columns of a track, with its time in UTC and local, the local hour, and its place; with file_row if ``placed``."""
    frames = []
    for df in scans(spark, path, header_delimiter):
        named = {k: first_present(df.columns, v, header_key) for k, v in (("timestamp", TRACK_TIME_COLUMNS), ("latitude", TRACK_LAT_COLUMNS), ("longitude", TRACK_LON_COLUMNS))}
        if missing := [k for k, v in named.items() if v is None]:
            raise ValueError(f"no column for {', '.join(missing)}; there are {df.columns}")
        utc = utc_time(F.col(f"`{named['timestamp']}`"))
        df = df.withColumn("mobile_timestamp", utc).withColumn("mobile_timestamp_local", F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col("mobile_timestamp")))
        df = df.withColumn("station_hour_local", F.date_trunc("hour", "mobile_timestamp_local").cast("timestamp_ntz"))
        df = df.withColumn("mobile_lat", to_number(F.col(f"`{named['latitude']}`"))).withColumn("mobile_lon", to_number(F.col(f"`{named['longitude']}`")))
        frames.append(df.where("mobile_timestamp_local IS NOT NULL AND mobile_lat IS NOT NULL AND mobile_lon IS NOT NULL"))
    out = _union(_required(frames, path))
    return out if placed else out.drop("file_row")


def _numeric(frames: list[tuple[DataFrame, list[str]]]) -> list[list[str]]:
    """P5: of each table's columns those that hold a number somewhere; one job for all tables."""
    counts = [df.agg(F.array(*[F.count(to_number(F.col(f"`{c}`"))) for c in names]).alias("n")).select(F.lit(i).alias("i"), "n") for i, (df, names) in enumerate(frames) if names]
    found = {r["i"]: r["n"] for r in reduce(lambda a, b: a.union(b), counts).collect()} if counts else {}
    return [[c for c, n in zip(names, found.get(i, []), strict=False) if n] for i, (_, names) in enumerate(frames)]


def source_metrics(spark: SparkSession, path) -> DataFrame:
    """The measured columns that hold a number somewhere, as mobile_aq__ columns, by time."""
    frames = []
    skip = {header_key(c) for c in [*TRACK_TIME_COLUMNS, *TRACK_LAT_COLUMNS, *TRACK_LON_COLUMNS, *NOT_MEASURED, "file_row"]}
    own = [(df, [c for c in df.columns if header_key(c) not in skip and not header_key(c).startswith("gps_")]) for df in scans(spark, path, header_delimiter)]
    for (df, _), kept in zip(own, _numeric(own), strict=True):
        ts = first_present(df.columns, TRACK_TIME_COLUMNS, header_key)
        if ts is None:
            raise ValueError(f"no column for timestamp; there are {df.columns}")
        frames.append(df.select("source_file", utc_time(F.col(f"`{ts}`")).alias("mobile_aq_timestamp"), *[to_number(F.col(f"`{c}`")).alias(f"mobile_aq__{slug(c)}") for c in kept]))
    return _union(_required(frames, path)).where("mobile_aq_timestamp IS NOT NULL")


def _metric_time(df: DataFrame, times: Sequence[str]) -> Column:
    ts = next((c for c in times if c in df.columns), None)
    if ts is not None:
        return utc_time(F.col(ts))
    if "unix_time_s" in df.columns:
        micros = F.round(to_number(F.col("unix_time_s")) * 1_000_000).cast("long")
        return F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.timestamp_micros(micros).cast("timestamp_ntz"))
    return F.lit(None).cast("timestamp_ntz")


def _last_of_equal(rows: DataFrame) -> DataFrame:
    last = Window.partitionBy("source_file", "ts").orderBy(F.col("file_row").desc())
    return rows.where("ts IS NOT NULL").withColumn("__nth", F.row_number().over(last)).where("__nth = 1").drop("__nth", "file_row")


def raw_metrics(spark: SparkSession, path, delimiter: str | None = None) -> DataFrame:
    """All columns that aren't about place, as text, by time, or by unix_time_s; of equal times the last row."""
    frames = [df.select("source_file", "file_row", _metric_time(df, SENSOR_TIMES).alias("ts"), *[f"`{c}`" for c in df.columns if c not in (*NOT_METRICS, "file_row")]) for df in scans(spark, path, delimiter)]
    return _last_of_equal(_union(_required(frames, path)))


def air_metrics(spark: SparkSession, path, delimiter: str | None = None) -> DataFrame:
    """The numeric columns of :func:`raw_metrics`, as mobile_aq__ columns; of equal times the last row."""
    frames = []
    skip = {*TIME_COLUMNS, *NOT_MEASURED, *LAT_COLUMNS, *LON_COLUMNS, "file_row"}
    own = [(df, [c for c in df.columns if c not in skip and not c.startswith("gps_")]) for df in scans(spark, path, delimiter)]
    for (df, _), kept in zip(own, _numeric(own), strict=True):
        frames.append(df.select("source_file", "file_row", _metric_time(df, TIME_COLUMNS).alias("ts"), *[to_number(F.col(f"`{c}`")).alias(f"mobile_aq__{slug(c)}") for c in kept]))
    return _last_of_equal(_union(_required(frames, path)))


def _components(spark: SparkSession, path: str) -> tuple[str, ...]:
    """Component names of a report's file."""
    lines = [x for x in head(spark, path, 1 << 16).decode("utf-8-sig", "replace").splitlines() if x.strip()]
    cells = next(csv_rows.reader(lines[1:2], delimiter=";"), [])
    names = tuple(x.strip() or f"value_{i}" for i, x in enumerate(cells[1:], 1))
    if not names:
        raise ValueError(f"too few columns in {path}")
    return names


def _reports(spark: SparkSession, path: str) -> list[tuple[tuple[str, ...], DataFrame]]:
    """Component names, and the lines that begin with a date as columns c0, c1, ...; once for files alike, if a report is a folder."""
    fs, at = file_system(spark, path)
    found = sorted(s.getPath().toString() for s in fs.listStatus(at) if s.isFile() and s.getLen() and s.getPath().getName()[0] not in "._") if fs.exists(at) and fs.getFileStatus(at).isDirectory() else [path]
    if not found:
        raise ValueError(f"no report in {path}")
    with ThreadPoolExecutor(HEADS) as pool:
        alike: dict[tuple[str, ...], list[str]] = {}
        for file, names in zip(found, pool.map(lambda f: _components(spark, f), found), strict=True):
            alike.setdefault(names, []).append(file)
    return [(names, _dated_lines(spark, files, len(names))) for names, files in alike.items()]


def _dated_lines(spark: SparkSession, path, n: int) -> DataFrame:
    schema = ", ".join(f"c{i} string" for i in range(n + 1))
    rows = spark.read.schema(schema).csv(path, sep=";", header=False, mode="PERMISSIVE", escape='"')
    rows = rows.where(F.col("c0").rlike(r"^\d{2}\.\d{2}\.\d{4}\s+\d{2}:\d{2}$"))
    time = F.try_to_timestamp(F.regexp_replace("c0", r"\s+", " "), F.lit("dd.MM.yyyy HH:mm")).cast("timestamp_ntz")
    return rows.withColumn("station_hour_local", time).where("station_hour_local IS NOT NULL")


def station_hours(spark: SparkSession, path: str, station_id: str) -> DataFrame:
    """An hourly report as a row for each hour, with a {station}__{component} column for each component.

    The second line that isn't blank holds the components; nameless ones are value_1, value_2, ...;
    data are the lines that begin with a date; decimals have a comma.  A folder is a report in several such files.
    """
    number = lambda c: to_number(F.replace(F.trim(c), F.lit(","), F.lit(".")))
    frames = []
    for names, rows in _reports(spark, path):
        plain = _header(";".join(f"{station_id}__{slug(n)}" for n in names), ";")
        frames.append(rows.select("station_hour_local", *[number(f"c{i}").alias(n) for i, n in enumerate(plain, 1)]))
    return _union(frames)


def station_report(spark: SparkSession, path: str, station_id: str) -> DataFrame:
    """An hourly report in long form: station_id, station_hour_local, component, value."""
    frames = []
    for names, rows in _reports(spark, path):
        pairs = F.array(*[F.struct(F.lit(n).alias("component"), F.col(f"c{i}").alias("text")) for i, n in enumerate(names, 1)])
        long = rows.select("station_hour_local", F.explode(pairs).alias("p"))
        frames.append(long.select(F.lit(station_id).alias("station_id"), "station_hour_local", "p.component", robust_number(F.col("p.text"), ",").alias("value")))
    return _union(frames)


def _from_literal(c: Column) -> Column:
    """JSON from text that may be written as a Python literal."""
    t = F.trim(c)
    for word, json in (("None", "null"), ("True", "true"), ("False", "false")):
        t = F.regexp_replace(t, rf"(?<=[:\[,])(\s*){word}(?=\s*[,\]\}}])", f"$1{json}")
    return F.when(F.startswith(t, F.lit("{")), F.concat(F.lit("["), t, F.lit("]"))).otherwise(t)


def path_points(c: Column) -> Column:
    """the (point, time) pairs of a path's text."""
    return F.from_json(_from_literal(c), "array<struct<point:string,time:string>>")


def _flat(cell: Column) -> list[Column]:
    """a segment's nested fields as columns."""
    names = ["startTime", "endTime", "timelinePath", "visit.topCandidate.placeLocation.latLng", "visit.topCandidate.probability", "activity.topCandidate.type", "activity.distanceMeters", "activity.start.latLng", "activity.end.latLng"]
    return [reduce(lambda c, f: c[f], n.split("."), cell).alias(n.replace(".", "_")) for n in names]


def timeline(spark: SparkSession, path) -> DataFrame:
    """Timelines, flat or as cells of nested segments, with their path as an array of (point, time).

    Dots in names become underscores.
    """
    frames = []
    for df in scans(spark, path, multiline=True):
        start, end = first_present(df.columns, ["startTime", "start_time", "start_time_utc"]), first_present(df.columns, ["endTime", "end_time", "end_time_utc"])
        if start is not None and end is not None:
            flat = df.select("source_file", "file_row", *[F.col(f"`{c}`").alias({start: "startTime", end: "endTime"}.get(c, c).replace(".", "_")) for c in df.columns if c not in ("source_file", "file_row")])
            if "timelinePath" in flat.columns:
                flat = flat.withColumn("timelinePath", path_points(F.col("timelinePath")))
            frames.append(flat)
            continue
        cell = first_present(df.columns, ["semanticSegments", "semantic_segments"])
        if cell is None:
            raise ValueError(f"neither start and end columns nor nested segments; there are {df.columns}")
        rows = df.select("source_file", "file_row", F.explode(F.from_json(_from_literal(F.col(f"`{cell}`")), SEGMENTS)).alias("__s"))
        frames.append(rows.select("source_file", "file_row", *_flat(F.col("__s"))))
    return _union(_required(frames, path)).drop("file_row")


def _glob(spark: SparkSession, pattern: str) -> str:
    """A pattern of names as a regular expression, as readers understand it."""
    return f"^(?:{spark.sparkContext._jvm.org.apache.hadoop.fs.GlobPattern(pattern).compiled().pattern()})$"


def _listed(spark: SparkSession, path, pattern: str, deep: bool) -> DataFrame | None:
    """path, name, size and time of files, or None if there are none."""
    if (batches := _batches(spark, path)) is not None:
        where = fresh_path(spark, "listed")
        rows = "path string, length long, at long"
        for b in batches:
            spark.createDataFrame(b, rows).write.mode("append").parquet(where)
        found = spark.read.schema(rows).parquet(where).select("path", base_name(F.col("path")).alias("name"), "length", F.timestamp_millis("at").alias("modificationTime"))
        found = found.where(F.col("name").rlike(_glob(spark, pattern)) & (F.col("length") > 0))  # readers leave out empty ones
        return None if found.isEmpty() else found
    try:
        found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", deep).load(path)
    except AnalysisException:
        return None
    with _file_cost(spark, SMALL):
        found = saved(found.select("path", base_name(F.col("path")).alias("name"), "length", "modificationTime"), "listed")
    return None if found.isEmpty() else found


def first_of_equal(found: DataFrame) -> DataFrame:
    """Of files equal in name and size the first path."""
    first = Window.partitionBy("name", "length").orderBy("path")
    return found.withColumn("__nth", F.row_number().over(first)).where("__nth = 1").drop("__nth")


def files(spark: SparkSession, path: str, pattern: str = "*.csv") -> DataFrame:
    """Path, name, size and time of files below a folder; of those equal in name and size the first path."""
    return first_of_equal(_listed(spark, path, pattern, True) or spark.createDataFrame([], "path string, name string, length long, modificationTime timestamp"))


def discovered(spark: SparkSession, path: str, roots: Sequence[str] = (), pattern: str = "enviro_log*.csv") -> DataFrame:
    """The logs of a folder: those in it, else those below it, else any CSV files in it.

    If there is no such folder, the logs below the roots, of those equal in name and size the first path.
    """
    none = spark.createDataFrame([], "path string, name string, length long, modificationTime timestamp")
    for kind, deep in ((pattern, False), (pattern, True), ("*.csv", False)):
        if (found := _listed(spark, path, kind, deep)) is not None:
            return found
    below = [x for x in (_listed(spark, r, pattern, True) for r in roots) if x is not None]
    return first_of_equal(_union(below).distinct()) if below else none


def required(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The table, if it has these columns."""
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def headers(spark: SparkSession, path) -> DataFrame:
    """A row for each file and column."""
    return _union(_kinds(spark, path, None, lambda k: k)).select("file", F.explode("names").alias("column"))


def display_columns(names: DataFrame, preferred: Sequence[str], most: int = 4) -> DataFrame:
    """Up to ``most`` columns to show: preferred ones that some file (file, column) has, in their order, then
    those whose name tells a measurement, by the number of files that have them, then by name."""
    counts = names.distinct().groupBy("column").agg(F.count(F.lit(1)).alias("n_files"))
    place = F.coalesce(*[F.when(F.col("column") == c, F.lit(i)) for i, c in enumerate(preferred)], F.lit(len(preferred)))
    telling = reduce(lambda a, b: a | b, [F.lower("column").contains(t) for t in DISPLAY_TOKENS])
    fit = counts.withColumn("place", place).where((F.col("place") < len(preferred)) | telling)
    ranked = fit.withColumn("rank", F.row_number().over(Window.orderBy("place", F.col("n_files").desc(), "column")))  # a row for each column name
    return ranked.where(F.col("rank") <= most).select(F.col("rank").cast("long").alias("rank"), "column", "n_files")


def source_map(spark: SparkSession, path) -> DataFrame:
    """output_name and source_file of index files; of rows with one output the last, by file name and row.

    Index files without both columns are left out.
    """
    frames = [df for df in scans(spark, path, header_delimiter, file_column="index_file") if {"source_file", "output_file"} <= set(df.columns)]
    if not frames:
        return spark.createDataFrame([], "output_name string, source_file string")
    rows = _union([f.select(F.trim("source_file").alias("source_file"), F.trim("output_file").alias("output_file"), F.col("index_file"), "file_row") for f in frames])
    fine = lambda c: F.col(c).isNotNull() & ~F.lower(c).isin("", "nan")
    rows = rows.where(fine("source_file") & fine("output_file")).withColumn("output_name", base_name(F.col("output_file")))
    last = Window.partitionBy("output_name").orderBy(F.col("index_file").desc(), F.col("file_row").desc())
    return rows.withColumn("__nth", F.row_number().over(last)).where("__nth = 1").select("output_name", "source_file")
