"""Tables that an operator writes once and reads again, in the folder the cluster shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only on a local master where that is unset."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no shared folder")
    global _own
    if _own is None:
        _own = "file://" + tempfile.mkdtemp(prefix="gatefold-")
    return _own


_own: str | None = None


def new_path(spark: SparkSession) -> str:
    """A fresh path in the shared folder, removed when the process ends."""
    path = f"{shared_folder(spark)}/gatefold/{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


#: Bytes of an Arrow batch, where the session says nothing else: Python workers then hold little, however long rows are.
BATCH = 4 << 20

#: The session's setting by which Spark removes an execution's shuffle files at its end.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def lean(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in spark.conf.getAll and spark.sparkContext.getConf().get(key) is None:
        spark.conf.set(key, BATCH)


def stored(df: DataFrame, hashes: bool = False) -> DataFrame:
    """``df`` written as Parquet and read back: lineage ends here, and lost executors cost no recomputation. hashes: most
    values are, which no dictionary shortens and zstd hardly, at several times snappy's cost."""
    spark, path = df.sparkSession, new_path(df.sparkSession)
    lean(spark)
    before = spark.conf.get(TIDY)
    spark.conf.set(TIDY, "true")  # nothing executes this plan again, so its shuffle files go with it
    try:
        writer = df.write.option("compression", "snappy").option("parquet.enable.dictionary", "false") if hashes else df.write.option("compression", "zstd")
        writer.parquet(path)
    finally:
        spark.conf.set(TIDY, before)
    back = spark.read.schema(df.schema).parquet(path)
    back.scratch_path = path
    return back


def release(*tables: DataFrame) -> None:
    """Removes tables that ``stored`` returned and nothing reads any more."""
    for df in tables:
        remove(df.sparkSession, df.scratch_path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clear() -> None:
    for spark, path in _made:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session has gone; its folder goes with the cluster's own clean-up
            return
