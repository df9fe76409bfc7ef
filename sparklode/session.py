"""Session helpers: making the package importable on executors, and the shared folder for cut lineage."""

from __future__ import annotations

import atexit
import io
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_written: list[str] = []
#: Rows of an Arrow batch unless the session sets another number than Spark's default: texts make large rows.
BATCH_ROWS = 2000


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once per application, through the shared folder and Spark's file distribution."""
    sc = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if sc.applicationId not in _shipped:
        here = os.path.dirname(os.path.abspath(__file__))
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w") as z:
            for folder, _, files in os.walk(here):
                for f in files:
                    if f.endswith(".py"):
                        full = os.path.join(folder, f)
                        z.write(full, os.path.join("sparklode", os.path.relpath(full, here)))
        uri = scratch(spark, "package") + "/sparklode.zip"
        path = sc._jvm.org.apache.hadoop.fs.Path(uri)
        out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path)
        out.write(bytearray(held.getvalue()))
        out.close()
        sc.addPyFile(uri)
        _shipped.add(sc.applicationId)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; a local one only where none is set, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._conf.get("spark.checkpoint.dir")
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = held.get() if held.isDefined() else None
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        held = tempfile.mkdtemp(prefix="sparklode-")
        atexit.register(shutil.rmtree, held, ignore_errors=True)
        root = "file://" + held
        spark.sparkContext.setCheckpointDir(root)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    whole = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub("^file:/+", "file:///", whole)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def sweep(spark: SparkSession) -> None:
    """Deletes what this program has written to the shared folder so far, cut tables and indexes there; for a job's end."""
    while _written:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles(spark: SparkSession, tasks: int):
    """For what runs inside: shuffles have tasks partitions, if that is more than the session has, and keep them."""
    own = {"spark.sql.shuffle.partitions": str(tasks), "spark.sql.adaptive.coalescePartitions.enabled": "false"} if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")) else {}
    before = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def cut(df: DataFrame, name: str = "table", tasks: int = 0) -> DataFrame:
    """df, written to the shared folder and read again: its lineage ends there, so that a lost executor costs no recomputation of it.
    tasks: of its shuffles, as in shuffles."""
    path = scratch(df.sparkSession, name)
    with shuffles(df.sparkSession, tasks):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
