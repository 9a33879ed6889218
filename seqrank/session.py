"""What needs the session: the shared folder, written intermediate tables, and the package at the workers."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Only where the session names none (in local mode) a temporary one is made, and kept in the session.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("seqrank.work.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="seqrank-")
        spark.conf.set("seqrank.work.dir", base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A place in the shared folder that nothing lies at."""
    return f"{shared_dir(spark)}/seqrank/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete what lies at a path through Hadoop's file system, wherever that is."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


#: The tables of the scopes that are open in this thread (or task of an event loop), innermost last.
_scopes: contextvars.ContextVar[tuple[list["Stored"], ...]] = contextvars.ContextVar("seqrank_scopes", default=())
#: Tables written outside any scope, or kept by the outermost: their caller's result reads them.
_kept: list["Stored"] = []


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Tables written inside are deleted at the end, but those with ``keep``: a result that is still to be read needs them. Threads have scopes of their own."""
    own: list[Stored] = []
    before = _scopes.set((*_scopes.get(), own))
    try:
        yield
    finally:
        _scopes.reset(before)
        for t in own:
            t.drop()


def release(spark: SparkSession) -> int:
    """Delete the tables that results of this session still could read, once they are no longer wanted; how many there were."""
    mine = [t for t in _kept if t.spark.sparkContext is spark.sparkContext]
    for t in mine:
        _kept.remove(t)
        t.drop()
    return len(mine)


class Stored:
    """A DataFrame written to the shared folder and read again: its lineage is the files alone, and lost executors lose nothing."""

    def __init__(self, df: DataFrame, name: str, keep: bool = False):
        self.spark = df.sparkSession
        self.path = fresh_path(self.spark, name)
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        scopes = _scopes.get()
        within = scopes[:-1] if keep else scopes  # what outlives this scope ends with the one around it
        (within[-1] if within else _kept).append(self)

    def drop(self) -> None:
        drop_path(self.spark, self.path)


def stored(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Written to the shared folder and read again, until the scope ends or the caller calls release()."""
    return Stored(df, name, keep).df


def ship(spark: SparkSession) -> None:
    """Send the package to the workers, once per application: they need not have it on their path."""
    context = spark.sparkContext
    if getattr(context, "_seqrank_shipped", False):
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="seqrank-")) / "seqrank.zip"  # the driver serves it to the executors
    with zipfile.ZipFile(target, "w") as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, str(Path(package.name) / file.relative_to(package)))
    context.addPyFile(str(target))
    context._seqrank_shipped = True


#: Rows and bytes of an Arrow batch, where the session has Spark's defaults: rows are whole texts here.
BATCH, BATCH_BYTES = 2000, 8 << 20
#: Each bound with Spark's default, as the session gives it.
_BOUNDS = (("maxRecordsPerBatch", "10000", BATCH), ("maxBytesPerBatch", f"{64 << 20}b", BATCH_BYTES))


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches bounded by rows and bytes: what a worker is sent at once doesn't grow with the table or its texts. Bounds that the session's owner has set stay."""
    for key, default, value in _BOUNDS:
        if spark.conf.get(f"spark.sql.execution.arrow.{key}") == default:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", value)


def ready(spark: SparkSession) -> None:
    """The package at the workers, and batches bounded in the session whose tables are read."""
    ship(spark)
    bound_batches(spark)


def ready_active() -> None:
    """For an expression over texts, which has no session at hand: the active one is made ready, or the application's in a thread that has none active."""
    ready(SparkSession.getActiveSession() or SparkSession.builder.getOrCreate())
