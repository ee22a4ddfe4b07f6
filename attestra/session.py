"""Session defaults for local runs, and the shared folder that cuts lineage."""
from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager
from typing import Iterator

from pyspark.sql import DataFrame, SparkSession


#: Sizes that keep a task small, whatever the size of the tables: what moves compresses well, and 64 MB of it (Spark's default) are some 3 GB of groups in one
#: task.  A shuffle starts with 256 parts, as Spark joins small parts but never cuts a large one, so a task's share does not hang on the session's number.
#: HotSpot never compiles a method above 8000 bytecodes; beyond that Spark's split projections are faster.
SIZES = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "1MB", "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "256",
         "spark.sql.files.maxPartitionBytes": "16MB", "spark.sql.codegen.hugeMethodLimit": "8000"}


#: Shuffle files go at the end of a query, and not only when the driver next collects its garbage.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def sized(spark: SparkSession) -> SparkSession:
    """The session with tasks of bounded size; a session takes these settings at any time, and they change no result."""
    for name, value in SIZES.items():
        spark.conf.set(name, value)
    return spark


def local_session(cores: int | str = "*", name: str = "attestra", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench.  A cluster brings its own configuration."""
    return sized(SparkSession.builder.master(f"local[{cores}]").appName(name)
            .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
            .config("spark.sql.adaptive.enabled", "true")
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.sql.execution.arrow.pyspark.enabled", "true")
            .config("spark.driver.memory", "12g")
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .getOrCreate())


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can read again: the one the cluster names in ``spark.checkpoint.dir``.  A local session, whose
    executors are the driver, gets a temporary folder that goes with the process; a cluster without one is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="attestra-")
        atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
    return _LOCAL[app]


_LOCAL: dict[str, str] = {}


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A session's setting for the jobs within."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def written(df: DataFrame, name: str | None = None, parts: tuple[str, ...] = (), **options) -> DataFrame:
    """Write an intermediate that several steps read, and read it back as a table; ``parts`` become folders, ``options`` go to the writer.

    Later steps then scan only their columns, plans do not repeat the expressions behind them, and
    a lost executor re-reads files instead of recomputing from the start.  What was shuffled for the table goes when it stands."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name or uuid.uuid4().hex}"
    before = spark.conf.get(CLEANED, "false")
    spark.conf.set(CLEANED, "true")
    try:
        df.write.mode("overwrite").partitionBy(*parts).options(**options).parquet(path)
    finally:
        spark.conf.set(CLEANED, before)
    return spark.read.parquet(path)
