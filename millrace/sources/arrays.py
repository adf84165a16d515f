"""Array files as tables: a Spark data source that reads and writes .npy files, and embedding folders.

Reading: a file of any size is many input partitions. The driver reads its header alone (a few
hundred bytes), plans ranges of rows, and each task reads the bytes of its range.

Writing: each task writes .npy parts of a bounded size and reports their first rows, numbers of
rows and dimensions. The driver takes these for a ledger, checks that the parts have one number
of dimensions and cover each row once, and only then publishes the ledger, parts.json, in one
move; a folder without it is no array. A failed write deletes its parts and leaves what was
published before. Files are opened with pyarrow.fs by their URI, so they can lie in any store
that it knows.
"""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from millrace.functions.text import namespaced
from millrace.sources.jsonl import numbered_lines
from millrace.storage import size_checked

#: Bytes of vectors that a task reads, and rows of a batch that it hands on.
RANGE_BYTES, BATCH = 64 << 20, 4096
_registering = threading.Lock()


def _open(path: str):
    from pyarrow import fs

    store, inside = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return store, inside


@dataclass(frozen=True)
class Header:
    """What the head of a .npy file says: rows, dimensions, type, and where the data begins."""

    rows: int
    dims: int
    kind: str
    width: int
    at: int


def header(path: str) -> Header:
    """The header of a two-dimensional array of floats; anything else is an error, as is a file of another length."""
    import numpy as np
    from numpy.lib import format as npy

    store, inside = _open(path)
    with store.open_input_file(inside) as f:
        version = npy.read_magic(f)
        read = npy.read_array_header_1_0 if version == (1, 0) else npy.read_array_header_2_0
        shape, by_column, kind = read(f)
        at, size = f.tell(), f.size()
    if len(shape) != 2 or by_column or kind.kind != "f":
        raise ValueError(f"{path} must be a two-dimensional array of floats in row order, not {kind} of shape {shape}")
    rows, dims = shape
    if size - at != rows * dims * kind.itemsize:
        raise ValueError(f"{path} has {size - at} bytes of data where its header says {rows} x {dims} of {kind}")
    return Header(rows, dims, np.dtype(kind).str, dims * kind.itemsize, at)


LEDGER = "parts.json"


def gaps(parts: list[dict], rows: int) -> list[str]:
    """What is wrong with a ledger: rows that no part has or that two have, and parts of other dimensions."""
    wrong, at = [], 0
    for p in sorted(parts, key=lambda p: p["first"]):
        if p["first"] != at:
            wrong.append(f"rows {at} to {p['first'] - 1} are missing" if p["first"] > at else f"rows {p['first']} to {min(at, p['first'] + p['rows']) - 1} are there twice")
        at = max(at, p["first"] + p["rows"])
    if at != rows:
        wrong.append(f"rows {at} to {rows - 1} are missing" if at < rows else f"{at} rows where {rows} were expected")
    dims = sorted({p["dims"] for p in parts})
    return wrong + ([f"vectors of {dims} dimensions in one array"] if len(dims) > 1 else [])


def ledger(path: str) -> list[tuple[str, int]]:
    """(file, first row) of the parts of an array: those of its published ledger, or the file itself."""
    store, inside = _open(path)
    from pyarrow import fs

    if store.get_file_info(inside).type == fs.FileType.File:
        return [(path, 0)]
    with store.open_input_stream(f"{inside.rstrip('/')}/{LEDGER}") as f:
        return [(f"{path.rstrip('/')}/{p['file']}", p["first"]) for p in json.loads(f.read())["parts"]]


@dataclass
class _Rows(InputPartition):
    path: str
    head: Header
    before: int
    first: int
    last: int


class _NpyReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.bytes = int(options.get("rangebytes", RANGE_BYTES))

    def partitions(self) -> list[InputPartition]:
        out = []
        for path, before in ledger(self.path):
            h = header(path)
            step = max(1, self.bytes // max(1, h.width))
            out += [_Rows(path, h, before, a, min(a + step, h.rows)) for a in range(0, h.rows, step)]
        return out or [_Rows("", Header(0, 0, "<f4", 0, 0), 0, 0, 0)]

    def read(self, partition: _Rows) -> Iterator:
        import numpy as np
        import pyarrow as pa

        h = partition.head
        if partition.first == partition.last:
            return
        store, inside = _open(partition.path)
        with store.open_input_file(inside) as f:
            for a in range(partition.first, partition.last, BATCH):
                n = min(BATCH, partition.last - a)
                x = np.frombuffer(f.read_at(n * h.width, h.at + a * h.width), dtype=h.kind).astype("float32")
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * h.dims, pa.int32()), pa.array(x, pa.float32()))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + n) + partition.before, pa.int64()), vectors], ["row_idx", "embedding"])


@dataclass
class _Parts(WriterCommitMessage):
    parts: list


class _NpyWriter(DataSourceArrowWriter):
    def __init__(self, options: dict) -> None:
        self.path, self.rows, self.kind = options["path"], int(options["rows"]), options.get("kind", "<f2")
        self.bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.run = uuid.uuid4().hex[:12]

    def write(self, batches: Iterator) -> WriterCommitMessage:
        import numpy as np

        store, inside = _open(self.path)
        store.create_dir(inside, recursive=True)
        made: list[dict] = []
        rows: list[np.ndarray] = []
        first = 0

        def put() -> None:
            if rows:
                name = f"part-{self.run}-{first:012d}-{uuid.uuid4().hex[:8]}.npy"
                with store.open_output_stream(f"{inside}/{name}") as f:
                    np.save(f, np.stack(rows).astype(self.kind), allow_pickle=False)
                made.append({"file": name, "first": first, "rows": len(rows), "dims": len(rows[0])})
                rows.clear()

        for batch in batches:
            for i, v in zip(batch.column("row_idx").to_pylist(), batch.column("embedding")):
                x = v.values.to_numpy(zero_copy_only=False)
                # a part is an island: consecutive rows of one number of dimensions
                if rows and (i != first + len(rows) or len(x) != len(rows[0]) or len(rows) * x.nbytes >= self.bytes):
                    put()
                if not rows:
                    first = i
                rows.append(x)
        put()
        return _Parts(made)

    def commit(self, messages: list) -> None:
        parts = sorted((p for m in messages if m for p in m.parts), key=lambda p: p["first"])
        wrong = gaps(parts, self.rows)
        if wrong:
            self.abort(messages)
            raise ValueError(f"{self.path}: {'; '.join(wrong)}")
        store, inside = _open(self.path)
        store.create_dir(inside, recursive=True)
        with store.open_output_stream(f"{inside}/{LEDGER}.{self.run}") as f:
            f.write(json.dumps({"rows": self.rows, "parts": parts}).encode())
        store.move(f"{inside}/{LEDGER}.{self.run}", f"{inside}/{LEDGER}")

    def abort(self, messages: list) -> None:
        from pyarrow import fs

        store, inside = _open(self.path)
        for info in store.get_file_info(fs.FileSelector(inside, allow_not_found=True)):
            if info.base_name.startswith(f"part-{self.run}-"):
                store.delete_file(info.path)


class NpySource(DataSource):
    """Format "npy": (row_idx, embedding). Option rangeBytes: what one task reads, or a part holds.

    Writing takes the option rows, how many there must be, and kind, the type of the numbers.
    """

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "row_idx long, embedding array<float>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _NpyReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _NpyWriter(dict(self.options))


def _register(spark: SparkSession) -> None:
    """The source, once for each session: threads that register it at one time would fail."""
    with _registering:
        if not getattr(spark, "_millrace_npy", False):
            spark.dataSource.register(NpySource)
            spark._millrace_npy = True


def write_npy(vectors: DataFrame, path: str, rows: int, parts: int, kind: str = "<f2", **options) -> None:
    """Write (row_idx, embedding), rows 0 to rows - 1 each once, as parts of one array; else an error, and nothing is published."""
    spark = vectors.sparkSession
    _register(spark)
    ordered = vectors.select(F.col("row_idx").cast("long").alias("row_idx"), F.col("embedding").cast("array<float>").alias("embedding")).repartitionByRange(parts, "row_idx").sortWithinPartitions("row_idx")
    ordered.write.format("npy").mode("append").options(rows=rows, kind=kind, **options).save(path)


def read_npy(spark: SparkSession, path: str, **options) -> DataFrame:
    """(row_idx, embedding) of a .npy file, or of the parts of write_npy()."""
    _register(spark)
    return spark.read.format("npy").options(**options).load(path)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def embedding_set(spark: SparkSession, folder: str, namespace: str = "", **options) -> DataFrame:
    """(row_idx, id, embedding, success) of a folder with embeddings.npy, ids.txt and perhaps token_counts.jsonl.

    Line n of ids.txt names row n; other numbers of lines and rows are an error before a vector is read. A row
    without an id is not usable, nor is one that token_counts.jsonl calls failed, or, without that file, a zero vector.
    Ids get the namespace. Lines of token_counts.jsonl that are no JSON, or name no row, say nothing.
    """
    root = folder.rstrip("/")
    for name in ("embeddings.npy", "ids.txt"):
        if not _exists(spark, f"{root}/{name}"):
            raise FileNotFoundError(f"{root} has no {name}")
    rows = header(f"{root}/embeddings.npy").rows
    named = numbered_lines(spark, f"{root}/ids.txt", blank=True)
    lines = named.count()
    if lines != rows:
        raise ValueError(f"{root}: ids.txt has {lines} lines, embeddings.npy has {rows} rows")
    raw = F.when(F.col("line") != "", F.col("line"))
    ids = named.select((F.col("number") - 1).alias("row_idx"), namespaced(F.lit(namespace), raw).alias("id"))
    met = read_npy(spark, f"{root}/embeddings.npy", **options).join(ids, "row_idx")
    if _exists(spark, f"{root}/token_counts.jsonl"):
        told = numbered_lines(spark, f"{root}/token_counts.jsonl")
        v = F.try_parse_json("line")
        at = F.coalesce(F.try_variant_get(v, "$.idx", "long"), F.col("number") - 1)
        bad = told.where(v.isNotNull() & ~F.coalesce(F.try_variant_get(v, "$.success", "boolean"), F.lit(True))).select(at.alias("row_idx")).distinct().withColumn("failed", F.lit(True))
        met = met.join(size_checked(bad), "row_idx", "left")
        ok = F.col("failed").isNull()
    else:
        ok = F.exists("embedding", lambda x: x != 0)
    return met.withColumn("success", ok & F.col("id").isNotNull()).select("row_idx", "id", "embedding", "success")


def describe(vectors: DataFrame) -> dict:
    """Rows, usable and failed ones of an embedding set."""
    n, ok = vectors.agg(F.count("*"), F.count_if("success")).first()
    return {"rows": n, "usable": ok, "failed": n - ok}
