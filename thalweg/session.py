"""Session construction and lineage cutting."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Lets a join use a placement by one of its keys as it is, instead of hashing all keys anew (off: it may).
SUBSET_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"
#: Settings the library relies on; a cluster's own values win where they are set.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
    SUBSET_KEYS: "false",
}


def get_spark(app: str = "thalweg", master: str | None = None, **conf: str) -> SparkSession:
    """The running session, or a new one with the library's defaults."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); where unset, one of our own if all of Spark is one process.

    On a cluster there is no such folder but the one it names: without it nothing is written and an error says so.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), "thalweg-shared")
    return folder.rstrip("/")


_TABLES: list[str] = []
_KEPT: dict[tuple, object] = {}


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder and read it again.

    Unlike a local checkpoint the files outlive any executor, and unlike checkpoint() the plan runs once. The table
    goes when the application ends, or before that by `release`.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    _TABLES.append(path)
    return spark.read.schema(df.schema).parquet(path)


def kept(spark: SparkSession, key: tuple, make):
    """What `make` gives, made once per application and key: for tables that depend on stored data alone."""
    key = (spark.sparkContext.applicationId, *key)
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def release(spark: SparkSession) -> int:
    """Delete all tables materialised so far; for long sessions, when results that read them are written."""
    n = 0
    _KEPT.clear()
    while _TABLES:
        target = spark._jvm.org.apache.hadoop.fs.Path(_TABLES.pop())
        n += bool(target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True))
    return n


def parallelism(spark: SparkSession) -> int:
    """How many reduce tasks the session wants for a large exchange."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application; they need not have it on their path."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="thalweg-package-")  # the driver serves it to executors until it ends
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, "thalweg.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)
