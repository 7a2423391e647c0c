"""Sessions, and making this package importable wherever its Python functions run."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
import zipfile

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession


def session(app: str = "granary", **conf: str) -> SparkSession:
    """A session with what the engine relies on: UTC, adaptive execution and skew joins; more settings may be given."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers of the cluster, once for each Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_granary_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(), "granary_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "granary")):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    sc._granary_shipped = True


def work_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all machines share; it is removed when the program ends.

    Where that is unset, a local session, as in tests, gets a folder of its own; on a cluster that is an error, since
    executors would write where nobody reads.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="granary-")
        sc.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/granary-{uuid.uuid4().hex}"
    atexit.register(_removed, sc, path)
    return path


def _removed(sc: SparkContext, path: str) -> None:
    with contextlib.suppress(Exception):  # at the end of the program there may be no JVM any more
        folder = sc._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(sc._jvm.org.apache.hadoop.conf.Configuration() if sc._jsc is None else sc._jsc.hadoopConfiguration()).delete(folder, True)


def stored(df: DataFrame) -> DataFrame:
    """The rows, written once to the shared folder and read again: their lineage ends here and survives lost executors."""
    path = work_dir(df.sparkSession)
    df.write.parquet(path)
    got = df.sparkSession.read.schema(df.schema).parquet(path)
    got._stored_at = path
    return got


def discard(df: DataFrame) -> None:
    """Remove the files of a stored table that nothing reads any more."""
    _removed(df.sparkSession.sparkContext, df._stored_at)
