"""Intermediate tables in the shared folder, and other session plumbing.

Lineage is cut by writing a Parquet table below ``spark.checkpoint.dir`` and reading it
back, so that a lost executor costs a re-read instead of a recomputation of all that came
before.  Only where that setting is absent (tests on one machine) a folder of our own is
made, and then only under a local master.
"""

from __future__ import annotations

import atexit
import os
import shutil
import sys
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_PACKAGE_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share."""
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


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back; its lineage ends there."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._wayfold_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables that :func:`saved` wrote, once all that was made of them is written itself."""
    for t in tables:
        path = getattr(t, "_wayfold_path", None)
        if path is not None:
            hadoop = t.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(hadoop.getParent(), True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened where a column of ``df`` has them."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n in taken:
            n += "_"
        out.append(n)
    return out


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ship_package(spark: SparkSession) -> None:
    """Make this package importable by Python workers that weren't given its path."""
    import builtins

    if _PACKAGE_ROOT in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    context = spark.sparkContext
    if getattr(context, "_wayfold_shipped", False):
        return
    import zipfile

    folder = tempfile.mkdtemp(prefix="wayfold-zip-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = os.path.join(folder, "wayfold_package.zip")
    with zipfile.ZipFile(target, "w") as out:
        top = os.path.join(_PACKAGE_ROOT, "wayfold")
        for at, _, names in os.walk(top):
            for x in names:
                if x.endswith(".py"):
                    full = os.path.join(at, x)
                    out.write(full, os.path.relpath(full, _PACKAGE_ROOT))
    context.addPyFile(target)
    if target in sys.path:  # the driver has the package itself
        sys.path.remove(target)
    builtins.setattr(context, "_wayfold_shipped", True)
