"""Evaluation of many datasets as jobs: embed, search, score, each on its own, and a summary of what failed.

Jobs run side by side in threads, each in a Spark job group of its own, so the scheduler shares the
cluster between them and a failed or cancelled one takes no other along. A dataset that
breaks is a row of the summary, not an exception. Embedding sets that were written to their
end are not made again, so a run that was cut off goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import vectors as V
from millrace.operators import retrieval as R
from millrace.plans.evaluation import Dataset, evaluate
from millrace.sources import embeddings as E
from millrace.sources import shards


class Job(NamedTuple):
    """queries (row_idx, id, text), corpus (row_idx, id, text), qrels (q, d, rel) or a retrieval.Gold: made when the job runs, so a broken one is its own."""

    name: str
    queries: Callable[[], DataFrame]
    corpus: Callable[[], DataFrame]
    qrels: Callable[[], DataFrame | R.Gold]


def embedded_set(records: DataFrame, backend: E.Backend, folder: str, parts: int = 4) -> DataFrame:
    """(row_idx, id, embedding, success) of records, from folder if it is whole, else made and written there."""
    spark = records.sparkSession
    n = records.count()
    if not _whole(spark, folder, n):
        work = f"{folder}/work"
        shards.write_shards(E.embed(records, backend), work, parts)
        merged = shards.merge(spark, work, records.select("row_idx", "id"), n)
        shards.write_set(merged, folder, n, parts, kind="<f4")
    return shards.read_set(spark, folder)


def _whole(spark: SparkSession, folder: str, rows: int) -> bool:
    """Was the set written to its end, with so many rows? Its array's ledger is the last thing written."""
    from millrace.sources.arrays import LEDGER, _exists

    if not _exists(spark, f"{folder}/embeddings/{LEDGER}"):
        return False
    told = spark.read.option("wholetext", True).text(f"{folder}/embeddings/{LEDGER}").select(F.try_variant_get(F.parse_json("value"), "$.rows", "long").alias("n")).first()
    return told is not None and told.n == rows


def embedded_dataset(job: Job, backend: E.Backend, folder: str, dim: int | None = None) -> Dataset:
    """The job's dataset of usable vectors; dim: cut to so many dimensions and of unit length again."""
    cut = (lambda c: V.truncate(F.col(c), dim)) if dim is not None else F.col
    ok = lambda df, name: df.where("success and id is not null").select(F.col("id").alias(name), cut("embedding").alias("vec"))
    queries = embedded_set(job.queries(), backend, f"{folder}/{job.name}_queries")
    corpus = embedded_set(job.corpus(), backend, f"{folder}/{job.name}_corpus")
    return Dataset(ok(queries, "q"), ok(corpus, "d"), job.qrels())


def run_jobs(spark: SparkSession, jobs: Sequence[Job], backend: E.Backend, folder: str, ks: Sequence[int], dims: Sequence[int | None] = (None,), at_once: int = 4) -> tuple[DataFrame, DataFrame]:
    """(results, summary). results (dataset, dim, k, metrics, queries): a row for each job, dimension and cut-off of those that ended.

    summary (dataset, dim, status, error): status is done or failed; the error is the first line of what was said. dim is
    null for whole vectors. Larger dimensions than the vectors have are failures, as are jobs whose inputs cannot be read.
    """
    jobs = list(jobs)
    if len({j.name for j in jobs}) != len(jobs):
        raise ValueError("two jobs of one name")

    @inheritable_thread_target(spark)
    def one(job: Job) -> list[tuple]:
        spark.sparkContext.setJobGroup(f"evaluation {job.name}", job.name, interruptOnCancel=True)
        out = []
        for dim in dims:
            try:
                data = embedded_dataset(job, backend, folder, dim)
                if dim is not None and (least := data.corpus.agg(F.min(F.size("vec"))).first()[0]) is not None and least < dim:
                    raise ValueError(f"vectors of {least} dimensions cannot be cut to {dim}")
                rows = evaluate({job.name: data}, ks, mixed=False).where(F.col("dataset") == job.name).collect()  # a row for each cut-off
                out.append((job.name, dim, "done", None, rows))
            except Exception as e:  # noqa: BLE001 -- any failure is this job's alone, and is told
                out.append((job.name, dim, "failed", str(e).strip().split("\n")[0][:300] or type(e).__name__, []))
        return out

    with ThreadPoolExecutor(max(1, at_once)) as pool:
        told = [x for got in pool.map(one, jobs) for x in got]
    summary = spark.createDataFrame([t[:4] for t in told], "dataset string, dim int, status string, error string")
    names = ["k", *R.METRICS, "queries"]
    found = [(name, dim, *(r[c] for c in names)) for name, dim, _, _, rows in told for r in rows]
    kinds = ", ".join(f"{m} double" for m in R.METRICS)
    return spark.createDataFrame(found, f"dataset string, dim int, k int, {kinds}, queries long"), summary
