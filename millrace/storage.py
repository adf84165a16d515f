"""Tables written to the folder that the driver and all executors share.

Iterative operators cut their lineage here: a written table survives the loss of
any executor, unlike cached or locally checkpointed blocks.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few numbers or short strings that are broadcast at most.
BROADCAST_ROWS = 1_000_000
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where it is unset (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = found.get() if found.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc = spark.sparkContext
        folder = getattr(sc, "_millrace_dir", None) or "file://" + tempfile.mkdtemp(prefix="millrace-")
        sc._millrace_dir = folder
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/millrace-{uuid.uuid4().hex[:12]}-{name}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: same rows, no lineage."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.mode("overwrite").option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._millrace_path = path
    return out


def opened(path: str, columns: list[str]):
    """Folder below path -> the one record of the one file in it, for tasks that read single records of a partitioned table."""
    read = read_folder(path, columns)
    return lambda folder: read(folder, 1).to_pylist()[0]


def read_folder(path: str, columns: list[str]):
    """Folder below path -> the rows of the files in it, for tasks that read single parts of a partitioned table; of `files` files, if that is given."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyarrow import fs

    store, inside = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)

    def get(folder: str, files: int | None = None) -> pa.Table:
        found = [x.path for x in store.get_file_info(fs.FileSelector(f"{inside}/{folder}", allow_not_found=files is None)) if x.path.endswith(".parquet")]
        if files is not None and len(found) != files:
            raise OSError(f"{len(found)} files of {folder} in {path}")
        tables = []
        for name in found:
            with store.open_input_file(name) as f:
                tables.append(pq.ParquetFile(f).read(columns=columns))
        return pa.concat_tables(tables) if tables else pa.table({c: [] for c in columns})

    return get


def cached(spark: SparkSession, key: tuple, make) -> DataFrame:
    """The table made by make(), once for each key: later calls read it. A write that did not end counts as none."""
    import hashlib

    path = f"{shared_dir(spark)}/millrace-cache-{hashlib.sha256(repr(key).encode()).hexdigest()[:24]}"
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").parquet(path)
        _written.append((spark, path))
    return spark.read.parquet(path)


def size_checked(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it has few rows, else as it is, for a join that shuffles; it is counted, so it should be cheap to read."""
    return F.broadcast(df) if df.count() <= rows else df


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """Python workers get at most so many rows at once in what is run inside: their memory follows the batch."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(was)) if int(was) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, was)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(*dfs: DataFrame) -> None:
    """Delete tables of materialize() that no later plan reads."""
    for df in dfs:
        path = getattr(df, "_millrace_path", None)
        if path:
            delete(df.sparkSession, path)


@atexit.register
def _sweep() -> None:
    for spark, path in _written:
        try:
            delete(spark, path)
        except Exception:  # the session may be gone already
            return
