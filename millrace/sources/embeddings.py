"""Embedding sets: reading, checking, embedding jobs, and merging in the original order."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Records that an embedding job has as Python values at a time.
ROWS = 1024


def check_dims(vectors: DataFrame, vec: str = "embedding") -> int:
    """The one dimension of a set; an error if there are several."""
    lo, hi = vectors.agg(F.min(F.size(vec)), F.max(F.size(vec))).first()
    if lo != hi:
        raise ValueError(f"vectors of {lo} to {hi} dimensions in one set")
    return hi or 0


def union_corpora(corpora: dict[str, DataFrame], id_col: str = "d") -> DataFrame:
    """All corpora with namespaced ids; duplicates stay."""
    from millrace.functions.text import namespaced

    out = None
    for tag, df in corpora.items():
        one = df.withColumn(id_col, namespaced(F.lit(tag), F.col(id_col).cast("string"))).withColumn("dataset", F.lit(tag))
        out = one if out is None else out.unionByName(one)
    return out


class Backend:
    """An embedding backend: load() once a task, then embed(batch) -> vectors. Flags say what it can take."""

    fused, max_images, clip_based, matryoshka = True, 1, False, True

    def load(self) -> None: ...

    def validate(self, text: str | None, images: list[str]) -> str | None:
        return None if text or images else "empty record"

    def embed(self, items: list[dict]) -> list[list[float]]:
        raise NotImplementedError


class HashedWords(Backend):
    """A deterministic stand-in: signed hashed bag of words of `dims` dimensions."""

    def __init__(self, dims: int = 64):
        self.dims = dims

    def embed(self, items):
        import zlib

        out = []
        for it in items:
            v = [0.0] * self.dims
            for w in (it["text"] or "").split():
                h = zlib.crc32(w.encode("utf-8", "surrogatepass"))
                v[h % self.dims] += 1.0 if h >> 31 else -1.0
            out.append(v)
        return out


BACKENDS: dict[str, Callable[..., Backend]] = {}


def register(name: str, make: Callable[..., Backend]) -> None:
    if name in BACKENDS:
        raise KeyError(f"{name} is registered already")
    BACKENDS[name] = make


register("hashed_words", HashedWords)


def calibration_path(settings: dict, backend: type[Backend] | None, env: dict) -> str | None:
    """Path of the calibration means in force, or none.

    Off by the environment or by the settings; the settings' path goes before the
    environment's; backends that are not contrastive pairs of towers need an explicit leave.
    """
    on = lambda k: str(env.get(k, "")).lower() in ("1", "true", "yes", "on")
    path = str(settings.get("means") or env.get("CALIBRATION_MEANS") or "").strip()
    barred = backend is not None and not backend.clip_based and not (settings.get("allow_any") or on("CALIBRATION_ALLOW_ANY"))
    return None if on("CALIBRATION_DISABLE") or settings.get("enable") is False or barred else path or None


def complete(spark: SparkSession, path: str, expected: int) -> bool:
    """Whether the embedding set at a path was written to its end and has the expected rows: a job may skip it."""
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        return False
    return spark.read.parquet(path).count() == expected


def embed(records: DataFrame, backend: Backend, row: str = "row_idx", text: str = "text", batch: int = 32) -> DataFrame:
    """(row_idx, embedding, n_tokens, success, error): batches first, then item by item where a batch fails.

    A worker holds the texts and vectors of some ROWS records as Python values, however many Spark hands it at once.
    """
    schema = "row_idx long, embedding array<float>, n_tokens long, success boolean, error string"
    rows = max(batch, ROWS // batch * batch)

    def run(batches):
        import pyarrow as pa

        kinds = [pa.int64(), pa.list_(pa.float32()), pa.int64(), pa.bool_(), pa.string()]
        backend.load()
        for whole in (x.slice(at, rows) for x in batches for at in range(0, x.num_rows, rows)):
            items = [{"row_idx": r, "text": t if isinstance(t, str) else None} for r, t in zip(*(whole.column(i).to_pylist() for i in range(2)))]
            out = []
            for i in range(0, len(items), batch):
                part = items[i : i + batch]
                errors = [backend.validate(x["text"], []) for x in part]
                good = [k for k, e in enumerate(errors) if e is None]
                try:
                    vectors = dict(zip(good, backend.embed([part[k] for k in good]))) if good else {}
                except Exception:
                    vectors = {}
                    for k in good:
                        try:
                            vectors[k] = backend.embed([part[k]])[0]
                        except Exception as e:
                            errors[k] = str(e)
                for k, (x, e) in enumerate(zip(part, errors)):
                    v = vectors.get(k)
                    out.append((x["row_idx"], None if v is None else np.asarray(v, dtype=np.float32), len((x["text"] or "").split()), v is not None, e))
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), kinds)], [f.split()[0] for f in schema.split(", ")])

    return records.select(F.col(row).cast("long").alias("row_idx"), F.col(text).alias("text")).mapInArrow(run, schema)


def merged(ids: DataFrame, embedded: DataFrame, dims: int) -> DataFrame:
    """Every row of ids in its order; failed or missing ones have a zero vector and success false."""
    met = ids.join(embedded, "row_idx", "left")
    zero = F.array_repeat(F.lit(0.0).cast("float"), dims)
    return met.withColumn("embedding", F.coalesce("embedding", zero)).withColumn("success", F.coalesce("success", F.lit(False)))


def failed(ids: DataFrame, embedded: DataFrame) -> DataFrame:
    """(row_idx, error): the rows of ids without an embedding, and why."""
    met = ids.join(embedded.select("row_idx", "success", "error"), "row_idx", "left").where(~F.coalesce("success", F.lit(False)))
    return met.select("row_idx", F.coalesce("error", F.lit("no result")).alias("error"))


def matryoshka_dims(wanted: list[int], full: int) -> tuple[list[int], list[int]]:
    """(dimensions to store with the full one, those skipped as too large)."""
    ok = sorted({d for d in wanted if 0 < d <= full} | {full})
    return ok, sorted({d for d in wanted if d > full})


def matryoshka_setup(vectors: DataFrame, wanted: list[int], calibrated: bool = False, vec: str = "embedding") -> DataFrame:
    """unpacked() at the wanted dimensions that the vectors have and at the full one; calibrated vectors cannot be cut."""
    if wanted and calibrated:
        raise ValueError("dimensions cannot be cut from calibrated vectors")
    dims, _ = matryoshka_dims(wanted, check_dims(vectors, vec))
    return unpacked(vectors, dims, vec)


def unpacked(vectors: DataFrame, dims: list[int], vec: str = "embedding") -> DataFrame:
    """A row for each vector and dimension, cut and normalised; write it with partitionBy("dim")."""
    from millrace.functions import vectors as V

    each = F.explode(F.array(*(F.struct(F.lit(d).alias("dim"), V.truncate(F.col(vec), d).alias("cut")) for d in dims)))
    return vectors.withColumn("_e", each).withColumn("dim", F.col("_e.dim")).withColumn(vec, F.col("_e.cut")).drop("_e")
