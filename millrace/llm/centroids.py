"""Centroid clustering of integer vectors, exact on doubles, in rounds over packed blocks.

Vectors are written once as blocks of rows, a dense array of floats each, so that a round is
one pass of matrix products over few large records instead of many small rows. Distances are
|x|^2 - 2 x.c + |c|^2 by a product of float64 matrices. Every number in it is an integer, so
it is exact in whatever order BLAS adds as long as none reaches 2^53: with |x_i| <= a and
|c_i| <= b in d dimensions, d (a + b)^2 < 2^53 is enough. Rows beyond that bound are computed
with Python's integers instead. Sums of a cluster's vectors are a product with the one-hot
assignment under a bound of the same kind, and partial sums are Python integers, so nothing
overflows. treeAggregate() combines k x d sums of the blocks on the executors; the driver
holds k centroids.

Defined results: vectors of another length, null ones, and those with a null or non-finite
component take no part and have no row; repeated rows and ids are rows of their own; a null
id takes part and comes last among the first centroids; rows with one id come in the order
of their components there; fewer vectors than k give as many clusters as vectors; an empty
table gives no rows; distances and sums over 2^63 - 1 are null, as a long can't hold them;
other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.columns import col
from millrace.storage import materialize

#: Rows of a block: 1 MB of doubles at 64 dimensions, whose products stay in a core's cache.
BLOCK = 2048
EXACT = 1 << 53
LONG = (1 << 63) - 1
#: Floors of doubles under this are exact in int64.
WHOLE = float(1 << 62)


def usable(vec: Column, d: int) -> Column:
    """Whether a vector has exactly d components, all finite."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce((F.size(vec) == d) & finite, F.lit(False))


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles, as int64 where it fits and as Python integers otherwise; scale is a power of two."""
    with np.errstate(over="ignore"):
        y = np.floor(x * scale)
    if not y.size or np.abs(y).max() < WHOLE:
        return y.astype(np.int64)
    return np.array([[int(v) * scale if abs(v) >= EXACT else int(np.floor(v * scale)) for v in row] for row in x.tolist()], dtype=object)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows of integers x to centroids c: int64, or Python integers where a row exceeds the bound."""
    if not len(x):
        return np.zeros((0, len(c)), dtype=np.int64)
    d, far = x.shape[1], int(np.abs(c).max())
    fits = np.array([d * (int(a) + far) ** 2 < EXACT for a in np.abs(x).max(axis=1)])
    if fits.all():
        return doubles(x, c)
    out = np.empty((len(x), len(c)), dtype=object)
    if fits.any():
        out[fits] = doubles(x[fits], c).astype(object)
    big, to = x[~fits].astype(object), c.astype(object)
    for k in range(len(to)):
        diff = big - to[k]
        out[~fits, k] = (diff * diff).sum(axis=1)
    return out


def doubles(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    x, c = x.astype(np.float64), c.astype(np.float64)
    return (np.einsum("ij,ij->i", x, x)[:, None] - 2.0 * (x @ c.T) + np.einsum("ij,ij->i", c, c)[None, :]).astype(np.int64)


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, distance) of each row; ties go to the smaller number, as argmin takes the first."""
    if not len(x):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    got = distances(x, c)
    at = np.argmin(got, axis=1)
    return at, got[np.arange(len(x)), at]


def sums(x: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Componentwise sums of each cluster's rows, as Python integers."""
    if not len(x):
        return np.full((k, x.shape[1]), 0, dtype=object)
    if len(x) * int(np.abs(x).max()) < EXACT:
        one = np.zeros((k, len(x)))
        one[at, np.arange(len(x))] = 1.0
        return (one @ x.astype(np.float64)).astype(np.int64).astype(object)
    out = np.full((k, x.shape[1]), 0, dtype=object)
    big = x.astype(object)
    for i in range(k):
        if (mine := big[at == i]).size:
            out[i] = mine.sum(axis=0)
    return out


def integers(rows: list[list[int]]) -> np.ndarray:
    """Centroids as int64 where they fit."""
    return np.array(rows, dtype=np.int64 if all(abs(v) < WHOLE for r in rows for v in r) else object).reshape(len(rows), -1)


def blocks(vectors: DataFrame, d: int) -> DataFrame:
    """(ids, vecs): blocks of rows of (id, vec), as bytes; the ids are an array of their own, null where an id is."""

    kind = dict(vectors.dtypes)["id"]
    wide = "double" in dict(vectors.dtypes)["vec"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                vec = part.column(1).flatten().to_numpy(zero_copy_only=False).astype("<f8" if wide else "<f4")
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
                yield pa.RecordBatch.from_arrays([ids, pa.array([vec.tobytes()], pa.binary())], ["ids", "vecs"])

    return vectors.mapInArrow(pack, f"ids array<{kind}>, vecs binary")


def unpacked(b: bytes, d: int, wide: bool, scale: int) -> np.ndarray:
    return whole(np.frombuffer(b, dtype="<f8" if wide else "<f4").reshape(-1, d).astype(np.float64), scale)


def first_centroids(vectors: DataFrame, k: int, seed: int, scale: int) -> list[list[int]]:
    """The k vectors of least sha256 of '<seed>:<id>'; a top-k, so no more than k rows reach the driver."""
    text = F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))
    found = vectors.orderBy(F.asc_nulls_last(F.sha2(text.cast("binary"), 256)), "vec").limit(k).select("vec").collect()
    return [[int(v) for v in whole(np.array([r.vec], dtype=np.float64), scale)[0]] for r in found]


def cluster(df: DataFrame, row: str = "vec_id", vec: str = "embedding", d: int = 64, k: int = 8, rounds: int = 10, scale: int = 1024, seed: int = 3) -> tuple[DataFrame, list[list[int]], list[dict]]:
    """(assignment, centroids, clusters) after `rounds` rounds and a last assignment.

    assignment: (row, cluster, distance). clusters: rows, and their distances' sum, of each one.
    """
    spark = df.sparkSession
    vectors = df.select(col(row).alias("id"), col(vec).alias("vec")).where(usable(F.col("vec"), d))
    wide, kind = "double" in dict(vectors.dtypes)["vec"], dict(vectors.dtypes)["id"]
    centroids = first_centroids(vectors, k, seed, scale)
    if not centroids:
        return spark.createDataFrame([], f"`{row}` {kind}, cluster int, distance long"), [], []
    packed = materialize(blocks(vectors, d), "blocks")
    # two levels of a tree: the driver adds about as many partials as the root of the partitions
    arrays = packed.select("vecs").rdd

    def gathered(rows: list[list[int]], means: bool):
        n = len(rows)

        def add(acc, block):
            c = integers(rows)
            x = unpacked(block.vecs, d, wide, scale)
            at, far = nearest(x, c)
            count = np.bincount(at, minlength=n).astype(object)
            if means:
                return (count if acc[0] is None else acc[0] + count, sums(x, at, n) if acc[1] is None else acc[1] + sums(x, at, n))
            inertia = np.array([sum(far[at == i].tolist()) for i in range(n)], dtype=object)
            return (count if acc[0] is None else acc[0] + count, inertia if acc[1] is None else acc[1] + inertia)

        def join(a, b):
            return b if a[0] is None else a if b[0] is None else (a[0] + b[0], a[1] + b[1])

        return arrays.treeAggregate((None, None), add, join, depth=2)

    for _ in range(rounds):
        count, total = gathered(centroids, True)
        centroids = [[int(v) // int(m) for v in total[i]] if (m := count[i]) else centroids[i] for i in range(len(centroids))]
    count, inertia = gathered(centroids, False)
    held = centroids

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = integers(held)
        for batch in batches:
            for i in range(batch.num_rows):
                at, far = nearest(unpacked(batch.column(1)[i].as_py(), d, wide, scale), c)
                longs = pa.array([v if v <= LONG else None for v in far.tolist()], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0)[i].values, pa.array(at, pa.int32()), longs], ["id", "cluster", "distance"])

    assignment = packed.mapInArrow(assign, f"id {kind}, cluster int, distance long").withColumnRenamed("id", row)
    return assignment, centroids, [{"rows": int(m), "inertia": int(v)} for m, v in zip(count, inertia)]


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def query(spark, sf_dir: str) -> DataFrame:
    made, centroids, clusters = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    total = sum(c["inertia"] for c in clusters)
    long = lambda v: F.lit(v if v <= LONG else None).cast("long")
    of = lambda values: F.element_at(F.array(*values), F.col("cluster") + 1) if values else F.lit(None)
    return made.select(
        "vec_id", "cluster", "distance",
        of([long(c["inertia"]) for c in clusters]).cast("long").alias("cluster_inertia"),
        long(total).alias("inertia"),
        of([F.lit(digest(c)) for c in centroids]).cast("string").alias("centroid_sha256"),
    )


def _oracle(k: int = 8, rounds: int = 10, d: int = 64) -> str:
    """The rounds one after the other: x(id, v) vectors, c<r>(n, v) centroids, a<r>(id, n, dist)."""
    finite = "len(embedding) = 64 and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0"
    parts = [
        f"x as materialized (select vec_id, list_transform(embedding, lambda e: floor(1024 * e::double)::bigint) as v from embeddings where {finite})",
        f"c0 as materialized (select row_number() over (order by h) - 1 as n, v from (select sha256('3:' || vec_id) as h, v from x order by h limit {k}))",
    ]
    for r in range(rounds + 1):
        parts.append(f"a{r} as materialized (select vec_id, v, n, dist from (select x.vec_id, x.v, c.n, list_sum(list_transform(list_zip(x.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint as dist from x, c{r} c) qualify row_number() over (partition by vec_id order by dist, n) = 1)")
        if r < rounds:
            s = f"select n, i, floor(sum(e)::hugeint / count(*))::bigint as m from (select n, unnest(v) as e, generate_subscripts(v, 1) as i from a{r}) group by n, i"
            parts.append(f"c{r + 1} as materialized (select c.n, coalesce(m.v, c.v) as v from c{r} c left join (select n, list(m order by i) as v from ({s}) group by n) m on m.n = c.n)")
    last = f"select vec_id, n::int as cluster, dist as distance, (sum(dist) over (partition by a.n))::bigint as cluster_inertia, (sum(dist) over ())::bigint as inertia, sha256(array_to_string(c.v, ',')) as centroid_sha256 from a{rounds} a join c{rounds} c using (n)"
    return f"with {', '.join(parts)} {last}"


ORACLE = _oracle()
