"""Calibration means on disk: one JSON object with mean vectors, their counts, and where they come from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The means that a file must have, and those it may have.
REQUIRED = ["query_mean", "text_mean", "image_mean"]
OPTIONAL = ["query_image_mean", "query_fused_mean", "fused_mean"]


def write_means(means: DataFrame, path: str, **provenance: str) -> None:
    """means: (bucket, n, mean), at most one row for each known name; buckets of other names are an error."""
    rows = {r.bucket: r for r in means.collect()}  # six rows at most
    if unknown := set(rows) - set(REQUIRED + OPTIONAL):
        raise ValueError(f"unknown means: {sorted(unknown)}")
    dims = {len(r["mean"]) for r in rows.values()}
    if missing := [k for k in REQUIRED if k not in rows]:
        raise ValueError(f"missing means: {missing}")
    if len(dims) != 1:
        raise ValueError(f"means of different dimensions: {sorted(dims)}")
    spark = means.sparkSession
    fields = [(k, [float(x) for x in r["mean"]], int(r["n"])) for k, r in sorted(rows.items())]
    schema = ", ".join([f"{k} array<double>, {k}_count long" for k, _, _ in fields] + ["dim int"] + [f"`{k}` string" for k in provenance])
    values = [v for _, m, n in fields for v in (m, n)] + [dims.pop(), *provenance.values()]
    spark.createDataFrame([tuple(values)], schema).coalesce(1).write.mode("overwrite").json(path)


def read_means(spark: SparkSession, path: str, dim: int | None = None) -> DataFrame:
    """(bucket, n, mean) of a file; a required mean that is missing, or another dimension than `dim`, is an error."""
    schema = ", ".join([f"{k} array<double>, {k}_count long" for k in REQUIRED + OPTIONAL])
    row = spark.read.schema(schema).json(path)
    lack = [F.when(F.col(k).isNull(), F.raise_error(F.lit(f"{path}: no {k}"))) for k in REQUIRED]
    wrong = [F.when(F.size(k) != dim, F.raise_error(F.lit(f"{path}: {k} is not of dimension {dim}"))) for k in REQUIRED + OPTIONAL] if dim is not None else []
    checked = row.where(F.coalesce(*(x.cast("boolean") for x in [*lack, *wrong]), F.lit(True)))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("bucket"), F.col(f"{k}_count").alias("n"), F.col(k).alias("mean")) for k in REQUIRED + OPTIONAL)))
    return checked.select(each.alias("m")).select("m.*").where("mean is not null")
