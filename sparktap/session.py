"""Session helpers: recommended settings, shared folders, shipping of the package."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Settings that the queries are written for; a cluster may set its own sizes.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, driver_memory: str = "8g") -> SparkSession:
    """A session for tests and the bench."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("sparktap")
    conf = DEFAULTS | {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": driver_memory,
    }
    spark = b.config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. A folder of our own is made on a local master only,
    where all tasks run on this machine; elsewhere a missing setting is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master.split("[")[0] != "local":
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share (master {master})")
        found = "file://" + tempfile.mkdtemp(prefix="sparktap-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Tables written and not released yet, of each application, in the order of their making.
_tables: dict[str, list[str]] = {}


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table in the shared folder and read it again: cuts the lineage, survives lost executors.

    The table stays until release() or the end of a temporary_tables() block around it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _tables.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def temporary_folder(spark: SparkSession, name: str) -> str:
    """A folder in the shared one for what isn't a table; it goes at the end of a temporary_tables() block around it."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _tables.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def release(*tables: DataFrame | None) -> None:
    """Delete materialised tables that no plan reads any more. What isn't such a table is passed over."""
    for t in tables:
        path = getattr(t, "table_path", None)
        if path is None:
            continue
        mine = _tables.get(t.sparkSession.sparkContext.applicationId, [])
        if path in mine:
            mine.remove(path)
            _delete(t.sparkSession, path)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """On leaving, deletes all tables materialised inside but those passed to the function that it gives.

    For callers that write an operator's result: `with temporary_tables(spark): near_duplicates(docs).write...`.
    """
    mine = _tables.setdefault(spark.sparkContext.applicationId, [])
    before, kept = set(mine), set()

    def keep(table: DataFrame) -> DataFrame:
        kept.add(table.table_path)
        return table

    try:
        yield keep
    finally:
        for path in [x for x in mine if x not in before and x not in kept]:
            mine.remove(path)
            _delete(spark, path)


_shipped: set[str] = set()


#: Bytes of an Arrow batch where the session has no setting of its own: Spark's 64 MB is large for Python's objects.
ARROW_BYTES = "4m"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application. A setting that the caller made stays as it is."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, ARROW_BYTES)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="sparktap-zip-"), "sparktap.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(os.path.join(root, "sparktap")):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, root))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
