"""Image content by reference: inline data URIs and files. Decoding pixels is the backend's job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def inline(ref: Column) -> Column:
    """The bytes of a base64 data URI; null for any other reference, broken base64 or none."""
    body = F.nullif(F.element_at(F.split(ref, ",", 2), 2), F.lit(""))
    return F.when(ref.startswith("data:") & ref.contains(","), F.try_to_binary(body, F.lit("base64")))


def kind(content: Column) -> Column:
    """png, jpeg, gif, webp or bmp by the leading bytes; null for others."""
    head = F.hex(F.substring(content, 1, 12))
    webp = head.startswith("52494646") & head.endswith("57454250")
    return F.when(head.startswith("89504E47"), "png").when(head.startswith("FFD8FF"), "jpeg").when(head.startswith("474946"), "gif").when(webp, "webp").when(head.startswith("424D"), "bmp")


def load(rows: DataFrame, ref: str, root: str | None = None) -> DataFrame:
    """rows with content (binary) and error: inline images, then files under root by their path.

    The files come from Spark's binaryFile source, so content is read on the executors and
    joined by path; a reference that names nothing has an error in its row.
    """
    out = rows.withColumn("content", inline(F.col(ref)))
    if root is not None:
        bare = lambda c: F.regexp_replace(c, "^file:/*", "/")
        files = rows.sparkSession.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(bare(F.col("path")).alias("_path"), F.col("content").alias("_file"))
        out = out.join(files, bare(F.col(ref)) == F.col("_path"), "left").withColumn("content", F.coalesce("content", "_file")).drop("_path", "_file")
    return out.withColumn("error", F.when(F.col("content").isNull() & F.col(ref).isNotNull(), "image not found"))
