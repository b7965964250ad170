"""Session set-up and the two things jobs need from a session: tables and durable cut points."""

from __future__ import annotations

import atexit
import os
import sys
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


TEXT_TABLES = ("documents", "pages", "conversations")


def build_session(app: str = "attestra", cores: str = "*", shuffle: int = 8) -> SparkSession:
    """Local session for tests and the benchmark; on a cluster the submitter provides one."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEM", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def load(spark: SparkSession, sf_dir: str, name: str, spread: bool | None = None) -> DataFrame:
    """A table of the folder. Rows that take much work each (``spread``; by default the text tables) and arrive
    in fewer pieces than there are cores are dealt out once; tables of a size worth a cluster are split by
    the scan itself and are left as they are.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name in TEXT_TABLES if spread is None else spread:
        cores = spark.sparkContext.defaultParallelism
        if df.rdd.getNumPartitions() < cores:
            return df.repartition(cores)
    return df


def scratch_folder(spark: SparkSession) -> str:
    """The folder of this application inside the shared one that ``spark.checkpoint.dir`` names.

    Only a session on the ``local`` master, where driver and tasks are one process, may leave the setting
    out (tests); it then gets a temporary folder. Anywhere else that is an error, because executors could not
    read each other's files. The folder is removed when the driver ends.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="attestra-")
        spark.sparkContext.setCheckpointDir(named)
    folder = f"{named.rstrip('/')}/attestra-{spark.sparkContext.applicationId}"
    if folder not in _OWNED:
        _OWNED.add(folder)
        atexit.register(_drop, spark, folder)
    return folder


_OWNED: set[str] = set()


def _drop(spark: SparkSession, folder: str) -> None:
    """Remove the written tables of this application; a session that is gone already leaves them to its cluster."""
    jvm = spark.sparkContext._jvm
    if jvm is None or spark.sparkContext._jsc is None:
        return
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def durable(df: DataFrame, kept: bool = False) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and go on from there.

    Used where a job reads one intermediate result several times and each read must see the same rows
    (ranks, tiles, matches): a lost executor never recomputes a different version of it, the work before
    it is not repeated, and its size is known when the joins after it are planned. Inside ``passing`` the table goes with
    that scope, or with the scope around it if it is ``kept``.
    """
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/{uuid.uuid4().hex}"
    scopes = _PASSING.get()
    for scope in scopes[: len(scopes) - kept][-1:]:
        scope.append(path)
    (df.write.option("compression", "zstd") if scopes else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_PASSING: ContextVar[tuple[list[str], ...]] = ContextVar("passing", default=())


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """What is written to disk for the work inside goes when it is over: tables of ``durable`` at the end, files of a shuffle
    with the job that wrote them.

    Of what is read later, nothing may come from inside, unless it is ``kept`` or written elsewhere.
    """
    paths: list[str] = []
    token, cleanup = _PASSING.set((*_PASSING.get(), paths)), spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, cleanup)
        _PASSING.reset(token)
        for path in paths:
            _drop(spark, path)


STATIC_LIMIT, MEASURED_LIMIT = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"


@contextmanager
def measured_joins(spark: SparkSession) -> Iterator[None]:
    """Jobs that run inside send a side of a join to every task only if its rows, once shuffled, are measured to be under the
    session's limit.

    Else the size of a file decides, and it says little of the rows: a key that repeats takes a few bytes in a written
    table and many times that in the table of a broadcast join, which the driver gathers and builds.
    """
    limit, measured = spark.conf.get(STATIC_LIMIT), spark.conf.get(MEASURED_LIMIT, None)
    spark.conf.set(MEASURED_LIMIT, limit if measured is None else measured)
    spark.conf.set(STATIC_LIMIT, "-1")
    try:
        yield
    finally:
        spark.conf.set(STATIC_LIMIT, limit)
        if measured is None:
            spark.conf.unset(MEASURED_LIMIT)
        else:
            spark.conf.set(MEASURED_LIMIT, measured)


def ships_with_job(module: str) -> None:
    """Python code of this module travels with the task, so executors need no installed copy of it."""
    cloudpickle.register_pickle_by_value(sys.modules[module])
