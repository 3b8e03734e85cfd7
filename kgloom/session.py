"""Session helpers shared by all operators: the package on executors, intermediates in the cluster's shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_shipped: set[str] = set()
_own_dir: dict[tuple[str, str], str] = {}
_once: dict[tuple[str, str], tuple[str, StructType]] = {}
#: Of this thread or task alone, the paths to remove at the end of each open ``scratch``, the innermost last.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors once a session, so that Python operators run wherever they land."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(prefix="kgloom-"), "kgloom.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in os.walk(root):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.join("kgloom", os.path.relpath(full, root)))
        spark.sparkContext.addPyFile(path)
        _shipped.add(app)
    return spark


def work_dir(spark: SparkSession) -> str:
    """This application's own folder in the one that driver and executors share; it goes when the driver ends. Where the session
    names no shared folder, a session of this machine alone gets a temporary one; any other fails, as its executors couldn't see
    that."""
    app = spark.sparkContext.applicationId
    base = (spark.conf.get("spark.checkpoint.dir", None) or "").rstrip("/")
    if not base and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if (app, base) not in _own_dir:
        made = f"{base or tempfile.mkdtemp(prefix='kgloom-')}/kgloom-{app}-{uuid.uuid4().hex[:8]}"
        fs, at = _path(spark, made)
        fs.mkdirs(at)
        fs.deleteOnExit(at)
        _own_dir[app, base] = made
    return _own_dir[app, base]


def _path(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def own_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A new path in the shared folder. What is written there goes when the enclosing ``scratch`` ends (if kept, the one
    around that), or else when the driver does."""
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    open_ = _scopes.get()
    if len(open_) > keep:
        open_[-1 - keep].append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _path(spark, path)
    fs.delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes the intermediates that are written within, but for those marked ``keep``. What leaves the block must be
    written and kept: a frame that still reads the others would fail."""
    own: list[str] = []
    token = _scopes.set((*_scopes.get(), own))
    try:
        yield
    finally:
        _scopes.reset(token)
        for path in own:
            remove(spark, path)


def saved(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """df written as Parquet in the shared folder and read back: ends a loop's growing lineage, survives lost executors."""
    spark = df.sparkSession
    path = own_path(spark, name, keep)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def once(spark: SparkSession, key: str, make: Callable[[], DataFrame]) -> DataFrame:
    """make's rows, written at the first call of this application and read back at every one; they stay until the driver ends."""
    known = (spark.sparkContext.applicationId, key)
    if known not in _once:
        path, df = f"{work_dir(spark)}/once-{uuid.uuid4().hex}", make()
        df.write.parquet(path)
        _once[known] = (path, df.schema)
    path, schema = _once[known]
    return spark.read.schema(schema).parquet(path)


def cut(df: DataFrame, keep: bool = False) -> DataFrame:
    return saved(df, "cut", keep)


#: Rows of narrow columns that a task takes where a side is dealt by counts, and those of a frame that may be sent to every task.
PART_ROWS, FEW_ROWS = 250_000, 500_000


def dealt(df: DataFrame, rows: int, *keys: str, part_rows: int = PART_ROWS) -> DataFrame:
    """df dealt by keys into parts of about ``part_rows`` rows, at least one a core; rows: how many df has, as counted. So what
    a task holds does not grow with the input, whatever the session's number of partitions."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // part_rows)), *keys)


def counted(df: DataFrame, most: int = FEW_ROWS) -> DataFrame:
    """df, a written frame of narrow rows, marked to be sent to every task if it has at most so many rows; it is counted for that."""
    return F.broadcast(df) if df.count() <= most else df
