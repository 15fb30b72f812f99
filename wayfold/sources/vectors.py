"""Lines of vector files: shapefiles, GeoPackages and well-known binary, and timetables in ZIP files."""

from __future__ import annotations

import sqlite3
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.functions.parse import base_name, file_stem, route_class
from wayfold.sources.shared import file_system, fresh_path

VERTEX = "path string, feature int, attributes string, pos int, x double, y double"

# Labels of stretches that shapes of modes have in their names.
AUXILIARY = r"(^|_)(walk|train|bus|rail|tram|subway|metro|mode)(_|$)"
# End of fixed values.


def wkb_points(data: bytes) -> list[tuple[float, float]]:
    """All (x, y) of a geometry in well-known binary, in order; other dimensions are left out."""
    out: list[tuple[float, float]] = []

    def read(at: int) -> int:
        order = "<" if data[at] == 1 else ">"
        (kind,) = struct.unpack_from(order + "I", data, at + 1)
        at += 5
        if kind & 0x20000000:  # an identifier of the reference system
            at += 4
        width = 2 + bool(kind & 0x80000000) + bool(kind & 0x40000000)
        kind &= 0x0FFFFFFF
        width, kind = max(width, 2 + (kind // 1000 in (1, 2)) + 2 * (kind // 1000 == 3)), kind % 1000

        def points(at: int, n: int) -> int:
            values = struct.unpack_from(f"{order}{n * width}d", data, at)
            out.extend(zip(values[::width], values[1::width], strict=True))
            return at + 8 * n * width

        if kind == 1:
            return points(at, 1)
        (n,) = struct.unpack_from(order + "I", data, at)
        at += 4
        if kind == 2:
            return points(at, n)
        for _ in range(n):
            if kind == 3:  # a ring
                (m,) = struct.unpack_from(order + "I", data, at)
                at = points(at + 4, m)
            else:
                at = read(at)
        return at

    if data:
        read(0)
    return out


def shapefile_points(data: bytes) -> list[list[tuple[float, float]]]:
    """The (x, y) of each record of a shapefile, its parts one after the other."""
    out, at = [], 100
    while at + 8 <= len(data):
        (words,) = struct.unpack_from(">i", data, at + 4)
        body, at = data[at + 8 : at + 8 + 2 * words], at + 8 + 2 * words
        (kind,) = struct.unpack_from("<i", body)
        if kind in (1, 11, 21):
            out.append([struct.unpack_from("<2d", body, 4)])
        elif kind in (8, 18, 28):
            (n,) = struct.unpack_from("<i", body, 36)
            out.append([struct.unpack_from("<2d", body, 40 + 16 * i) for i in range(n)])
        elif kind in (3, 5, 13, 15, 23, 25):
            parts, n = struct.unpack_from("<2i", body, 36)
            out.append([struct.unpack_from("<2d", body, 44 + 4 * parts + 16 * i) for i in range(n)])
        else:
            out.append([])
    return out


def geopackage_points(data: bytes) -> list[tuple[str, list[tuple[float, float]]]]:
    """The attributes (as JSON) and (x, y) of each feature of a GeoPackage, by its key."""
    import json

    con = sqlite3.connect(":memory:")
    con.deserialize(data)
    out = []
    for name, column in con.execute("SELECT table_name, column_name FROM gpkg_geometry_columns ORDER BY 1").fetchall():
        quoted = '"' + name.replace('"', '""') + '"'
        rows = con.execute(f"SELECT * FROM {quoted} ORDER BY rowid")
        names = [d[0] for d in rows.description]
        for r in rows.fetchall():
            blob = r[names.index(column)] or b""
            envelope = (0, 32, 48, 48, 64)[(blob[3] >> 1) & 7] if blob else 0
            told = {n: v for n, v in zip(names, r, strict=True) if n != column and not isinstance(v, bytes)}
            out.append((json.dumps(told), wkb_points(blob[8 + envelope :])))
    con.close()
    return out


def vertices(spark: SparkSession, path) -> DataFrame:
    """Path, feature (from 0), attributes (JSON), pos, x and y of the vertices of shapefiles, GeoPackages and .wkb files.

    A file is read by one task, as its format asks for; files are shared out.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, data in zip(f["path"], f["content"], strict=True):
                kind = name.rsplit(".", 1)[-1].lower()
                found = geopackage_points(data) if kind == "gpkg" else [("{}", p) for p in (shapefile_points(data) if kind == "shp" else [wkb_points(data)])]
                rows = [(name, i, told, j, x, y) for i, (told, points) in enumerate(found) for j, (x, y) in enumerate(points)]
                if rows:
                    yield pd.DataFrame(rows, columns=["path", "feature", "attributes", "pos", "x", "y"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, VERTEX)


def known_routes(points: DataFrame) -> DataFrame:
    """route_class, pos, lat and lon of the files' lines (x east, y north, in degrees), a line for each class.

    A file's class is told by its name; of files of one class the one whose name has fewest parts, then the first path;
    files of modes (walk, train, bus) don't count for public transport.
    """
    stem = F.regexp_replace(F.regexp_replace(F.lower(file_stem(base_name(F.col("path")))), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    rows = points.withColumn("__stem", stem).withColumn("route_class", route_class(base_name(F.col("path")))).where("route_class IS NOT NULL")
    rows = rows.where(~(F.col("route_class").endswith("_opnv") & F.col("__stem").rlike(AUXILIARY)))
    own = rows.select("path", "route_class", F.size(F.split("__stem", "_")).alias("__parts")).distinct()
    first = Window.partitionBy("route_class").orderBy("__parts", "path")
    best = own.withColumn("__nth", F.row_number().over(first)).where("__nth = 1").select("path")
    rows = rows.join(F.broadcast(best), "path")  # a path for each class
    place = Window.partitionBy("route_class").orderBy("feature", "pos")
    return rows.select("route_class", (F.row_number().over(place) - 1).alias("pos"), F.col("y").alias("lat"), F.col("x").alias("lon"))


def unzipped(spark: SparkSession, path: str) -> str:
    """A ZIP file's members in a folder below the shared one, copied as streams; gives the folder."""
    jvm, target = spark.sparkContext._jvm, fresh_path(spark, "unzipped")
    fs, at = file_system(spark, path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out_fs, _ = file_system(spark, target)
    members = jvm.java.util.zip.ZipInputStream(fs.open(at))
    try:
        while (entry := members.getNextEntry()) is not None:
            if not entry.isDirectory():
                name = entry.getName().replace("\\", "/").rsplit("/", 1)[-1].lower()
                out = out_fs.create(jvm.org.apache.hadoop.fs.Path(f"{target}/{name}"))
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(members, out, conf, False)
                out.close()
    finally:
        members.close()
    return target
