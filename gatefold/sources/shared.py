"""Tables written once and read again, in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []
_own: list[str] = []


def folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one of its own only on a local master where that is unset."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no shared folder")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="gatefold-tables-"))
    return _own[0]


def new_path(spark: SparkSession) -> str:
    """A path in the shared folder that nothing has used, removed when the process ends."""
    path = f"{folder(spark)}/gatefold-tables/{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


#: Bytes of an Arrow batch, where the session says nothing else: Python workers then hold little, however long rows are.
BATCH = 4 << 20


def lean(spark: SparkSession) -> None:
    """Bounds what a Python worker is sent at a time by bytes; Spark alone bounds rows."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in spark.conf.getAll and spark.sparkContext.getConf().get(key) is None:
        spark.conf.set(key, BATCH)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet and read back: its lineage ends here, and its rows stay as they were written."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a task where a narrow row is much work, about.
EACH = 20_000


def dealt(df: DataFrame, each: int = EACH) -> DataFrame:
    """``df``'s rows dealt out evenly to tasks of about ``each``, and to every core at least. Readers cut files by bytes, so
    that a table of a few megabytes is one task, whatever work its rows are."""
    context = df.sparkSession.sparkContext
    return df.repartition(max(context.defaultParallelism, -(-df.count() // each)))


def remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clear() -> None:
    for spark, path in _made:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session has gone; the folder goes with the cluster's own clean-up
            return
