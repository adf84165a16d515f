"""Means taken off vectors, each row's by its role and modality, with a chain of stand-ins for means that are missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import vectors as V
from millrace.storage import size_checked

#: (role, modality, native, level, mean): the mean of the least level that is there counts. Native ones are for
#: backends that encode text and image as one; a mean made of the role's image and text means comes last.
CHAIN = [
    ("query", "text", False, 1, "query_mean"),
    ("doc", "text", False, 1, "text_mean"),
    ("query", "image", False, 1, "query_image_mean"),
    ("query", "image", False, 2, "image_mean"),
    ("doc", "image", False, 1, "image_mean"),
    ("query", "fused", True, 1, "query_fused_mean"),
    ("query", "fused", True, 2, "fused_mean"),
    ("doc", "fused", True, 1, "fused_mean"),
]
BETWEEN = 9


def modality(has_text: Column, has_image: Column) -> Column:
    """text, image or fused; null for a row of neither."""
    return F.when(has_text & has_image, "fused").when(has_image, "image").when(has_text, "text")


def role_means(means: DataFrame, native: bool, alpha: float = 0.5) -> DataFrame:
    """(role, modality, source, level, mean) of means (bucket, mean): what a row of each role and modality has taken off.

    Fused rows have a native mean only if the backend is native; else, or without one, alpha times the role's image mean
    and the rest of its text mean.
    """
    spark = means.sparkSession
    chain = spark.createDataFrame([c for c in CHAIN if native or not c[2]], "role string, modality string, native boolean, level int, bucket string").drop("native")
    found = chain.join(means.select("bucket", "mean"), "bucket").select("role", "modality", "level", F.col("bucket").alias("source"), "mean")
    least = lambda df: df.groupBy("role", "modality").agg(F.min_by(F.struct("source", "level", "mean"), "level").alias("m")).select("role", "modality", "m.*")
    own = least(found)
    image = own.where("modality = 'image'").select("role", F.col("mean").alias("image"))
    text = own.where("modality = 'text'").select("role", F.col("mean").alias("text"))
    mixed = F.transform(F.arrays_zip("image", "text"), lambda z: alpha * z["image"] + (1 - alpha) * z["text"])
    between = image.join(text, "role").select("role", F.lit("fused").alias("modality"), F.lit(BETWEEN).alias("level"), F.lit("interpolated").alias("source"), mixed.alias("mean"))
    return least(found.unionByName(between))


def calibrated(rows: DataFrame, means: DataFrame, native: bool = False, alpha: float = 0.5, role: str = "role", kind: str = "modality", vec: str = "vec") -> DataFrame:
    """rows with `source` and their mean taken off vec, of unit length again; rows of no modality stay as they are.

    A mean of another dimension, or none in the whole chain, is an error.
    """
    # six rows of means at most
    m = size_checked(role_means(means, native, alpha).select(F.col("role").alias("_r"), F.col("modality").alias("_m"), "source", F.col("mean").alias("_mean")))
    met = rows.join(m, (F.col(role) == F.col("_r")) & (F.col(kind) == F.col("_m")), "left")
    none = F.raise_error(F.concat(F.lit("no mean for "), F.col(role), F.lit(" "), F.col(kind))).cast("array<double>")
    wrong = F.raise_error(F.concat(F.lit("mean of "), F.size("_mean"), F.lit(" dimensions for a vector of "), F.size(vec))).cast("array<double>")
    doubled = F.transform(vec, lambda x: x.cast("double"))
    out = F.when(F.col(kind).isNull(), doubled).when(F.col("_mean").isNull(), none).when(F.size("_mean") != F.size(vec), wrong).otherwise(V.shift(F.col(vec), F.col("_mean")))
    return met.withColumn(vec, out).drop("_r", "_m", "_mean")
