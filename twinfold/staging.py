"""Written tables that end a lineage, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or where it is unset a temporary folder (local mode) or one below the warehouse."""
    if given := spark.conf.get("spark.checkpoint.dir", None):
        return given.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        local = spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")
        _OWN[app] = tempfile.mkdtemp(prefix="twinfold-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_twinfold"
    return _OWN[app]


_LEVELS: list[list[tuple[SparkSession, str]]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """Removes the paths made inside when it ends, but for those made with outer; what is returned must not read them."""
    _LEVELS.append([])
    try:
        yield
    finally:
        for spark, path in _LEVELS.pop():
            remove_path(spark, path)


def new_path(spark: SparkSession, name: str, outer: bool = False) -> str:
    """A fresh path below the shared folder, removed when the driver ends or the enclosing scratch does; with outer, the one around that."""
    path = f"{shared_dir(spark)}/twinfold-{name}-{uuid.uuid4().hex[:12]}"
    for level in (_LEVELS[:-1] if outer else _LEVELS)[-1:]:
        level.append((spark, path))
    atexit.register(remove_path, spark, path)
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    """Removes a staged path with Hadoop's file system; after the session's end it stays to the folder's owner."""
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the JVM may be gone
        pass


def stage(df: DataFrame, name: str, outer: bool = False, batch: int | None = None) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it again; shuffle files of the write are released. batch: rows of an Arrow batch meanwhile, at most."""
    spark = df.sparkSession
    conf = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"} | ({"spark.sql.execution.arrow.maxRecordsPerBatch": str(batch)} if batch else {})
    path, before = new_path(spark, name, outer), {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def parts(df: DataFrame) -> int:
    """Tasks for few rows that take long: small shuffles are otherwise read by fewer tasks than there are cores."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


#: Rows of a table of short texts up to which it is broadcast.
MAX_BROADCAST = 300_000


def small(df: DataFrame, n: int) -> DataFrame:
    """df, of n rows, to be broadcast unless they are many."""
    return F.broadcast(df) if n <= MAX_BROADCAST else df
