"""The folder that the driver and all executors share, and the head of a file."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession


_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where it is unset, and only under a local master, a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="wayfold-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/wayfold-{uuid.uuid4().hex[:12]}/{name}"


def file_system(spark: SparkSession, path: str) -> tuple:
    """The Hadoop file system of a path, and the path as it knows it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back, so that a lost executor costs a re-read."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._wayfold_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables that :func:`saved` wrote, once nothing reads them any more."""
    for t in tables:
        if (path := getattr(t, "_wayfold_path", None)) is not None:
            fs, at = file_system(t.sparkSession, path)
            fs.delete(at.getParent(), True)


@contextmanager
def scope(spark: SparkSession):
    """Clears what is written to the shared folder within it, for callers that keep what they need elsewhere."""
    root = shared_dir(spark)
    fs, at = file_system(spark, root)
    before = {s.getPath().toString() for s in fs.listStatus(at)} if fs.exists(at) else set()
    try:
        yield
    finally:
        for s in fs.listStatus(at) if fs.exists(at) else ():
            if s.getPath().getName().startswith("wayfold-") and s.getPath().toString() not in before:
                fs.delete(s.getPath(), True)


def plain_path(path: str) -> str:
    """A path from file metadata as readers take it."""
    return re.sub(r"^(\w+):/+(?=[^/])", r"\1:/", unquote(path)) if path.startswith("file:") else unquote(path)


def entries(spark: SparkSession, folder: str) -> Iterator[tuple[str, bool, int, int]]:
    """Path, whether it is a folder, size and time (ms) of what is in a folder, one by one; nothing if there is no such folder.

    A local folder is listed here, as Hadoop holds all its entries at once.
    """
    fs, at = file_system(spark, folder)
    full = fs.makeQualified(at)
    if full.toUri().getScheme() != "file":
        found = fs.listStatusIterator(full) if fs.exists(full) and fs.getFileStatus(full).isDirectory() else None
        while found is not None and found.hasNext():
            s = found.next()
            yield s.getPath().toString(), s.isDirectory(), s.getLen(), s.getModificationTime()
    elif os.path.isdir(top := full.toUri().getPath()):
        with os.scandir(top) as here:
            for x in here:
                try:
                    s = x.stat()
                except FileNotFoundError:  # gone since, or a link to nothing
                    continue
                yield f"{full.toString().rstrip('/')}/{x.name}", x.is_dir(), s.st_size, s.st_mtime_ns // 1_000_000


def literal(path: str) -> str:
    """A path in which readers find no pattern."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def head(spark: SparkSession, path: str, size: int = 8192) -> bytes:
    """The first bytes of a file."""
    fs, at = file_system(spark, path)
    stream = fs.open(at)
    try:
        return bytes(stream.readNBytes(size))
    finally:
        stream.close()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable by Python workers that weren't given its path."""
    context = spark.sparkContext
    if _ROOT in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(context, "_wayfold_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="wayfold-zip-")  # the driver hands it to executors
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = os.path.join(folder, "wayfold_package.zip")
    with zipfile.ZipFile(target, "w") as out:
        for at, _, names in os.walk(os.path.join(_ROOT, "wayfold")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(at, name)
                    out.write(full, os.path.relpath(full, _ROOT))
    context.addPyFile(target)
    if target in sys.path:  # the driver has the package itself
        sys.path.remove(target)
    context._wayfold_shipped = True
