"""Parsing and naming: text to numbers, times, places, modes and classes."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """The number, or null where it is NaN or infinite."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def to_number(c: Column) -> Column:
    """A number from text; null where it isn't one, or is NaN."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x), x)


def robust_number(c: Column, decimal: str = ".") -> Column:
    """a number with ``decimal`` as its point; blanks, marks of absence and NBSP are dropped."""
    t = F.trim(F.regexp_replace(c, "[ \\s]+", ""))
    t = F.when(~F.lower(t).isin("", "na", "n/a", "nan", "null", "none", "-", "--"), t)
    t = F.replace(t, F.lit(","), F.lit(".")) if decimal == "," else F.replace(t, F.lit(","), F.lit(""))
    return to_number(t)


#: Formats that are tried in turn, row by row.
TIME_FORMATS = (
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]", "yyyy-MM-dd HH:mm:ss[.SSSSSS][XXX]", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd HH:mm",
    "dd.MM.yyyy HH:mm:ss", "dd.MM.yyyy HH:mm", "yyyy-MM-dd",
)


def flexible_time(c: Column, formats=TIME_FORMATS) -> Column:
    """the first format that fits."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats])


def epoch_seconds(unix: Column, *texts: Column) -> Column:
    """Seconds since 1970 from a number, else from the first text that parses."""
    return F.coalesce(to_number(unix), *[F.unix_micros(flexible_time(t)) / 1e6 for t in texts])


def truth(c: Column) -> Column:
    """F27."""
    return F.coalesce(F.lower(F.trim(c)).isin("1", "true", "yes", "y", "ja", "t", "on"), F.lit(False))


def lat_lng(c: Column) -> tuple[Column, Column]:
    """the first two signed decimals of a text such as "52.5°, 13.4°"."""
    numbers = F.regexp_extract_all(F.regexp_replace(c, "[°Â]", ""), F.lit(r"([-+]?\d+(?:\.\d+)?)"), F.lit(1))
    two = F.size(numbers) >= 2
    return F.when(two, F.get(numbers, F.lit(0)).try_cast("double")), F.when(two, F.get(numbers, F.lit(1)).try_cast("double"))


# Travel modes, their other names, their speeds in metres a second.
MODE_ALIASES = {"IN_VEHICLE": "IN_PASSENGER_VEHICLE", "ON_FOOT": "WALKING", "IN_RAIL_VEHICLE": "IN_TRAIN"}
MOTORIZED_TO_RAIL = {"IN_BUS": "IN_TRAIN", "IN_PASSENGER_VEHICLE": "IN_TRAIN", "IN_VEHICLE": "IN_TRAIN"}
MODE_SPEED = {"WALKING": 1.4, "RUNNING": 2.8, "CYCLING": 5.5, "IN_BUS": 7.5, "IN_PASSENGER_VEHICLE": 11.5, "IN_TRAM": 8.0, "IN_SUBWAY": 13.5, "IN_TRAIN": 18.0}
DEFAULT_SPEED = 4.0
# End of fixed values.


def looked_up(c: Column, pairs: dict, default: Column | None = None) -> Column:
    out = None
    for k, v in pairs.items():
        out = F.when(c == k, F.lit(v)) if out is None else out.when(c == k, F.lit(v))
    return out if default is None else out.otherwise(default)


def travel_mode(c: Column, force_rail: bool = True) -> Column:
    """upper case, aliases, and motorised modes as rail."""
    m = F.upper(F.trim(c))
    m = looked_up(m, MODE_ALIASES, m)
    return looked_up(m, MOTORIZED_TO_RAIL, m) if force_rail else m


def mode_speed(c: Column) -> Column:
    """metres a second by default for a mode."""
    return looked_up(travel_mode(c, False), MODE_SPEED, F.lit(DEFAULT_SPEED))


def _token(c: Column) -> Column:
    """Lower case, with an underscore for each stretch of other characters."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def uni_direction(c: Column) -> Column:
    """from_uni or to_uni, as free text says; "from" counts before "to"."""
    t = _token(c)
    return F.when(t.contains("uni"), F.when(t.contains("from"), "from_uni").when(t.contains("to"), "to_uni"))


def uni_transport(c: Column) -> Column:
    """bike or opnv, as free text says."""
    t = _token(c)
    public = t.contains("opnv") | t.contains("oepnv") | t.contains("public") | t.contains("pt")
    return F.when(t.contains("bike") | t.contains("cycling"), "bike").when(public, "opnv")


def file_stem(c: Column) -> Column:
    """What is before the last point of a path's last part; all of it if it has no other point than a first one."""
    last = F.regexp_extract(F.regexp_replace(c, "/+$", ""), "([^/]*)$", 1)
    return F.regexp_replace(last, r"(?<=.)\.[^.]+$", "")


def route_class(c: Column) -> Column:
    """to or from the university, by bike or public transport, as free text or a file's name says."""
    stem = file_stem(F.trim(c))
    start, kind = uni_direction(stem), uni_transport(stem)
    return F.when(start.isNotNull() & kind.isNotNull(), F.concat_ws("_", start, kind))


def route_class_of_row(final: Column, names: list[Column], directions: list[Column], transports: list[Column]) -> Column:
    """the class that a row of a classification tells: by its own class, by names, by direction and transport."""
    start, kind = F.coalesce(*map(uni_direction, directions)), F.coalesce(*map(uni_transport, transports))
    return F.coalesce(*map(route_class, [final, *names]), F.when(start.isNotNull() & kind.isNotNull(), F.concat_ws("_", start, kind)))


def route_mode(c: Column) -> Column:
    """walk, train or bus, as the label of a stretch says."""
    t = _token(c)
    return F.when(t.isin("walk", "walking", "foot"), "walk").when(t.isin("train", "subway", "tram", "rail"), "train").when(t == "bus", "bus")


def transport_of_mode(c: Column) -> Column:
    """bike or opnv; walking is taken for a part of a trip by opnv."""
    m = travel_mode(c)
    return F.when(m == "CYCLING", "bike").when(m.isin("IN_TRAIN", "IN_SUBWAY", "IN_TRAM", "IN_BUS", "IN_PASSENGER_VEHICLE", "IN_RAIL_VEHICLE", "WALKING", "RUNNING"), "opnv")


def classes_of_mode(c: Column) -> Column:
    """the route classes that a mode allows; all of them if it doesn't tell."""
    m = travel_mode(c)
    both = lambda kind: F.array(F.lit(f"to_uni_{kind}"), F.lit(f"from_uni_{kind}"))
    public = m.isin("IN_TRAIN", "IN_SUBWAY", "IN_TRAM", "IN_BUS", "IN_PASSENGER_VEHICLE", "IN_RAIL_VEHICLE")
    return F.when(m == "CYCLING", both("bike")).when(public, both("opnv")).otherwise(F.concat(both("bike"), both("opnv")))


def mode_of_class(c: Column) -> Column:
    """the mode that a route class goes by."""
    k = route_class(c)
    return F.when(F.endswith(k, F.lit("_bike")), "CYCLING").when(F.endswith(k, F.lit("_opnv")), "IN_TRAIN")


def gtfs_type(c: Column) -> Column:
    """a route type as a whole number, cut."""
    return to_number(c).cast("int")


def is_rail(route_type: Column) -> Column:
    """whether a route type is of the rail families; not if there is none."""
    return F.coalesce(route_type.isin(0, 1, 2) | ((route_type >= 100) & (route_type < 500)), F.lit(False))


def type_fits_mode(route_type: Column, mode: Column) -> Column:
    """whether a route type goes with a mode; it does if there is none."""
    within = lambda a, b: (route_type >= a) & (route_type < b)
    fits = (
        F.when(mode == "IN_SUBWAY", route_type.isin(1, 109) | within(400, 500)).when(mode == "IN_TRAM", (route_type == 0) | within(900, 1000))
        .when(mode == "IN_TRAIN", route_type.isin(2, 109) | within(100, 200)).otherwise(is_rail(route_type)))
    return F.coalesce(route_type.isNull() | fits, F.lit(False))


def base_name(c: Column) -> Column:
    """what follows the last slash of either kind."""
    return F.element_at(F.split(c, r"[/\\]"), -1)


def time_hints(c: Column) -> Column:
    """P10: times in a file name: epochs of 10 or 13 digits, and dates, from 2015 to 2100."""
    digits = F.regexp_extract_all(c, F.lit(r"(?<!\d)(\d{13}|\d{10})(?!\d)"), F.lit(1))
    epochs = F.transform(digits, lambda x: F.timestamp_millis(F.when(F.length(x) == 13, x.cast("long")).otherwise(x.cast("long") * 1000)))
    days = F.regexp_extract_all(c, F.lit(r"(20\d{2}-\d{2}-\d{2})"), F.lit(1))
    both = F.concat(epochs, F.transform(days, lambda x: F.try_to_timestamp(x, F.lit("yyyy-MM-dd"))))
    return F.filter(both, lambda t: t.isNotNull() & F.year(t).between(2015, 2100))


def dated_name(c: Column) -> Column:
    """the name of a log that tells its epoch alone, with the day (in UTC) before it; other names as they are."""
    alone = r"^(?:enviro(?:_log)?_)?(\d{10})(\.[^.]*)?$"
    epoch = F.regexp_extract(c, alone, 1)
    day = F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.timestamp_seconds(epoch.try_cast("long")).cast("timestamp_ntz")), "yyyy-MM-dd")
    return F.when(epoch != "", F.concat(F.lit("enviro_log_"), day, F.lit("_"), epoch, F.regexp_extract(c, alone, 2))).otherwise(c)


def component(c: Column) -> Column:
    """the pollutant that a station column's name tells."""
    t = F.lower(c)
    is_nox, is_no = t.rlike(r"stickoxide|\bnox\b|nitrogen_oxides"), t.rlike(r"stickstoffmonoxid|\bno\b|nitric_oxide")
    return (F.when(is_nox, "NOx").when(is_no, "NO")
            .when(t.rlike(r"stickstoffdioxid|\bno2\b|nitrogen_dioxide"), "NO2")
            .when(t.rlike(r"ozon|\bo3\b"), "O3")
            .when(t.rlike(r"schwefeldioxid|\bso2\b|sulfur_dioxide|sulphur_dioxide"), "SO2")
            .when(t.rlike(r"feinstaub.*pm\s*2[._, ]?5|\bpm\s*2[._, ]?5\b|pm2_5|pm25"), "PM2.5"))


def is_oxidising(c: Column) -> Column:
    """whether a station column is of a gas that is held against oxidising resistance."""
    t = F.lower(c)
    gas = F.coalesce(component(c).isin("NO2", "NO", "NOx", "O3", "SO2"), F.lit(False))
    return gas & ~t.rlike(r"kohlenmonoxid|\bco\b|ammoniak|\bnh3\b|methan|\bch4\b|reduzier|reducing")


def gas_label(c: Column) -> Column:
    """the label of a station column; what follows its station where the gas isn't known."""
    known = component(c)
    return F.concat(F.lit("Station "), F.when(known.isin("NO2", "NO", "NOx", "O3", "SO2"), known).otherwise(F.regexp_replace(c, "^[^_]+__", "")))


def station_column(names: list[str], station_id: str, wanted: str) -> str | None:
    """the first column of a station, by name, whose pollutant is the one wanted."""
    prefix = f"{station_id.lower()}__"
    tests = {
        "NO": lambda t: re.search(r"stickstoffmonoxid|\bno\b|nitric_oxide", t) and not re.search(r"stickoxide|\bnox\b|nitrogen_oxides", t),
        "NO2": lambda t: re.search(r"stickstoffdioxid|\bno2\b|nitrogen_dioxide", t),
        "NOx": lambda t: re.search(r"stickoxide|\bnox\b|nitrogen_oxides", t),
        "PM2.5": lambda t: re.search(r"feinstaub.*pm\s*2[._, ]?5|\bpm\s*2[._, ]?5\b|pm2_5|pm25", t),
    }
    return next((c for c in names if c.lower().startswith(prefix) and tests[wanted](c.lower())), None)


def bytes_text(n: Column) -> Column:
    """mebibytes with one decimal; a half goes to the even one (format_string alone would round it up)."""
    tenths = F.rint(finite(n.cast("double")) * 10 / 1048576.0)  # exact for whole bytes
    return F.coalesce(F.format_string("%.1f MiB", tenths / 10), F.lit("n/a"))


def distance_text(metres: Column) -> Column:
    """whole metres, or kilometres from a thousand on, with a decimal unless they are whole."""
    km = metres / 1000
    far = F.when(F.abs(km - F.rint(km)) < 1e-8, F.format_string("%d km", F.rint(km).cast("long"))).otherwise(F.format_string("%.1f km", F.bround(km, 1)))
    return F.when(finite(metres).isNull(), "").when(metres >= 1000, far).otherwise(F.format_string("%d m", F.rint(metres).cast("long")))


def in_ohms(unit: Column) -> Column:
    """whether a unit is of resistance, which is shown in thousands."""
    return F.coalesce(F.lower(unit).rlike("ohm|ω"), F.lit(False))


def display_number(x: Column, unit: Column) -> Column:
    """a number in the unit it is shown in."""
    return F.when(in_ohms(unit) & finite(x).isNotNull(), x / 1000).otherwise(x)


def display_unit(unit: Column) -> Column:
    """the unit that numbers are shown in."""
    return F.when(in_ohms(unit), "kΩ").otherwise(F.coalesce(unit, F.lit("")))


def label_unit(label: Column) -> Column:
    """what a label has in brackets."""
    return F.regexp_extract(label, r"\(([^)]+)\)", 1)


def keyword_score(texts: list[Column], keywords: list[str]) -> Column:
    """ten for each keyword that the texts hold."""
    text = F.lower(F.concat_ws(" ", *[F.coalesce(t, F.lit("")) for t in texts]))
    return sum((F.when(text.contains(k.lower()), 10).otherwise(0) for k in keywords), F.lit(0))


def duration_text(seconds: Column) -> Column:
    """hh:mm:ss of the nearest second; n/a for what is no duration."""
    x = finite(seconds.cast("double"))
    s = F.rint(x).cast("long")
    text = F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), s % 60)
    return F.when(x >= 0, text).otherwise("n/a")


# Letters and their transliteration, as they are and as text decoded wrongly has them.
TRANSLITERATED = {
    "Ã¤": "ae", "Ã¶": "oe", "Ã¼": "ue", "Ã„": "Ae", "Ã–": "Oe", "Ãœ": "Ue", "ÃŸ": "ss",
    "ä": "ae", "ö": "oe", "ü": "ue", "Ä": "Ae", "Ö": "Oe", "Ü": "Ue", "ß": "ss", "µ": "u",
}
# End of fixed values.


def slug(name: str) -> str:
    """a name in lower-case ASCII letters, digits and underscores."""
    for a, b in TRANSLITERATED.items():
        name = name.replace(a, b)
    plain = unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode().lower()
    return re.sub(r"[^a-z0-9]+", "_", plain).strip("_")


def plain_name(name: str) -> str:
    """a column name for comparison."""
    return re.sub(r"[^a-z0-9]+", "", name.lower().lstrip("﻿"))


def header_key(name: str) -> str:
    """a column name for comparison, with an underscore for each stretch of other characters."""
    return re.sub(r"[\W_]+", "_", name.replace("\ufeff", "").strip().lower()).strip("_")


def tight_name(name: str) -> str:
    """a column name without blanks, in lower case."""
    return re.sub(r"\s+", "", name).lower()


def file_slug(name: str) -> str:
    """a name for files: ASCII letters, digits and underscores."""
    plain = unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode().lower()
    return re.sub(r"[^a-z0-9]+", "_", plain).strip("_")


def first_present(columns: list[str], candidates: list[str], key=plain_name) -> str | None:
    """The first candidate that is a column, whatever its case and separators; the exact name before others."""
    known = {key(c): c for c in reversed(columns) if key(c)}
    return next((x if x in columns else known[key(x)] for x in candidates if x in columns or key(x) in known), None)


def best_filled(df, candidates: list[str]) -> str | None:
    """The candidate column that holds most numbers, the first of those that tie; none if none holds any."""
    there = [c for c in candidates if c in df.columns]
    if not there:
        return None
    n = df.agg(*[F.count(robust_number(F.col(f"`{c}`").cast("string"))).alias(c) for c in there]).first()
    best = max(there, key=lambda c: n[c])
    return best if n[best] else None


# Particle counts that a cropped log keeps.
PARTICLE_COUNTS = ["pm0_3_count", "pm0_5_count", "pm1_0_count", "pm2_5_count", "pm5_0_count", "pm10_count"]
# End of fixed values.


def without_particles(df, kept: list[str] = PARTICLE_COUNTS):
    """The table without the columns that begin with pm, but for the counts that are kept."""
    wanted = {tight_name(c) for c in kept}
    return df.select(*[f"`{c}`" for c in df.columns if not tight_name(c).startswith("pm") or tight_name(c) in wanted])
