"""Session helper for local runs and tests, and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the engine expects (ANSI on, UTC, AQE)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quire")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, its lineage cut.

    The folder is the one the session names in ``spark.checkpoint.dir``; only where that is
    unset (local tests) a folder of this machine is used.
    """
    workspace(df.sparkSession)
    return df.checkpoint(eager=True)


def workspace(spark: SparkSession) -> str:
    """The shared folder of this session, set for checkpoints where it isn't yet."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix=f"quire-{os.getpid()}-"))
    return context.getCheckpointDir()


#: Where :func:`staged` writes; None: beside the checkpoints.
_FOLDER: ContextVar[str | None] = ContextVar("quire_folder", default=None)
#: Folders of :func:`staged` outside any :func:`scratch`, until :func:`release`.
_KEPT: list[str] = []


def staged(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: made once, its lineage cut, and later reads take the columns they need. The table
    goes with the :func:`scratch` folder it lies in, else with :func:`release`."""
    spark = df.sparkSession
    own = _FOLDER.get()
    target = f"{own or workspace(spark)}/staged-{uuid.uuid4().hex}"
    if own is None:
        _KEPT.append(target)
    df.write.parquet(target)
    return spark.read.schema(df.schema).parquet(target)


#: Folders of :func:`derived`, by session, source and what it is.
_DERIVED: dict[tuple, str] = {}


def derived(spark: SparkSession, source: str, what: str, make: Callable[[str], None]) -> str:
    """A folder beside the checkpoints with something derived from the table at ``source``: made at the first call of a session, and again when a file
    of the source changes. It goes with :func:`release`."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    seen = tuple(sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files))
    key = (spark.sparkContext.applicationId, source, what, seen)
    if key not in _DERIVED:
        folder = f"{workspace(spark)}/derived-{uuid.uuid4().hex}"
        make(folder)
        _DERIVED[key] = folder
        _KEPT.append(folder)
    return _DERIVED[key]


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Deletes what :func:`staged` and :func:`derived` made; frames that read them are no longer usable."""
    _DERIVED.clear()
    while _KEPT:
        delete(spark, _KEPT.pop())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder beside the checkpoints that is deleted at the end, with all tables staged meanwhile. What leaves it must be cut."""
    folder = f"{workspace(spark)}/scratch-{uuid.uuid4().hex}"
    token = _FOLDER.set(folder)
    try:
        yield folder
    finally:
        _FOLDER.reset(token)
        delete(spark, folder)


def parallelism(spark: SparkSession) -> int:
    """Tasks that keep all cores busy: the shuffle setting, or the cores if that is larger."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """A scan that is to feed costly work per row: if it has fewer partitions than there are cores, its rows are hashed by ``keys`` to
    one partition a core. Scans of many files, as large tables have, stay as they are. ``df`` must not contain a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    own = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df if own >= cores else df.repartition(cores, *keys)


def ship(spark: SparkSession) -> SparkSession:
    """Makes this package importable in the Python workers of all executors, once a session: they need not share a folder with the driver."""
    context = spark.sparkContext
    if getattr(context, "_quire_shipped", False):
        return spark
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="quire-package-")) / "quire.zip"
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    context.addPyFile(str(target))  # the driver serves it to the executors
    context._quire_shipped = True
    return spark
