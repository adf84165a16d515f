"""Which records can be embedded, and why others cannot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators.order import numbered


def usability(records: DataFrame, text: str = "text", images: str = "images", max_images: int = 4, keep_marks: bool = False, rejected: Column | None = None) -> DataFrame:
    """records with model_text, images cut to max_images, truncated, usable and error.

    The first of: marks that are not as many as the images; neither text nor image; what `rejected` (a message or
    null, over the new columns) says.
    """
    held = T.placeholders(F.nullif(T.strip(F.col(text)), F.lit("")), F.size(images), keep_marks)
    out = records.withColumn("_p", held).withColumn("model_text", F.col("_p.text")).withColumn("truncated", F.size(images) > max_images).withColumn(images, F.slice(images, 1, max_images))
    empty = F.when(F.col("model_text").isNull() & (F.size(images) == 0), "empty_record")
    error = F.coalesce(F.col("_p.error"), empty, rejected if rejected is not None else F.lit(None).cast("string"))
    return out.withColumn("error", error).withColumn("usable", F.col("error").isNull()).drop("_p")


#: The buckets of calibration, in order.
BUCKETS = ["query_mean", "query_image_mean", "query_fused_mean", "text_mean", "image_mean", "fused_mean"]


def calibration_rows(rows: DataFrame, fused: bool = False, known: DataFrame | None = None) -> DataFrame:
    """(ord, id, query_text, query_image, doc_text, doc_image, fused_text, fused_image, reason) of rows (ord, id, query, positive).

    query and positive are arrays of (text, image). reason is null for a usable row, else the first of: no query; a
    query image that is not in known (image); a query of nothing; fewer than two positives; no text in the first; no
    image, or one not known, in the second; for fused, the same of the third. A null id is the row's ord. Of usable
    rows that share an id all but the first by ord get __dup and a number that runs over all such rows.
    """
    text = lambda c: F.nullif(T.strip(c), F.lit(""))
    image = lambda c: F.nullif(c, F.lit(""))
    first = lambda f: F.get(F.filter(F.transform(F.coalesce("query", F.array()), f), lambda x: x.isNotNull()), F.lit(0))
    at = lambda i, k, f: f(F.get("positive", F.lit(i))[k])
    n = F.coalesce(F.when(F.col("positive").isNotNull(), F.size("positive")), F.lit(0))
    r = rows.select(
        "ord", F.coalesce(F.col("id").cast("string"), F.col("ord").cast("string")).alias("id"),
        first(lambda x: text(x["text"])).alias("query_text"), first(lambda x: image(x["image"])).alias("query_image"),
        at(0, "text", text).alias("doc_text"), at(1, "image", image).alias("doc_image"),
        *(x.alias(k) for k, x in (("fused_text", at(2, "text", text)), ("fused_image", at(2, "image", image)))),
        n.alias("_n"), (F.coalesce(F.size("query"), F.lit(0)) <= 0).alias("_none"),
    )
    for c in ("query_image", "doc_image", "fused_image"):
        if known is None:
            r = r.withColumn(f"_{c}", F.lit(True))
        else:
            r = r.join(known.select(F.col("image").alias(c), F.lit(True).alias(f"_{c}")).distinct(), c, "left")
    lost = lambda c: F.col(c).isNotNull() & F.col(f"_{c}").isNull()
    told = lambda c, code="positive_image_unknown": F.concat(F.lit(f"{code}: "), F.col(c))
    reason = (
        F.when(F.col("_none"), "no_query")
        .when(lost("query_image"), told("query_image", "query_image_unknown"))
        .when(F.col("query_text").isNull() & F.col("query_image").isNull(), "empty_query")
        .when(F.col("_n") < 2, "too_few_positives")
        .when(F.col("doc_text").isNull(), "first_positive_without_text")
        .when(F.col("doc_image").isNull(), "second_positive_without_image")
        .when(lost("doc_image"), told("doc_image"))
    )
    if fused:
        reason = (
            reason.when(F.col("_n") < 3, "no_third_positive")
            .when(F.col("fused_text").isNull(), "third_positive_without_text")
            .when(F.col("fused_image").isNull(), "third_positive_without_image")
            .when(lost("fused_image"), told("fused_image"))
        )
    else:
        r = r.withColumn("fused_text", F.lit(None).cast("string")).withColumn("fused_image", F.lit(None).cast("string"))
    names = ["ord", "id", "query_text", "query_image", "doc_text", "doc_image", "fused_text", "fused_image", "reason"]
    judged = r.withColumn("reason", reason).select(*names)
    # the first of an id is told by a minimum, so no id's rows meet in one task
    firsts = judged.where("reason is null").groupBy("id").agg(F.min("ord").alias("_first"))
    repeated = judged.where("reason is null").select("ord", "id").join(firsts, "id").where("ord > _first").select("ord")
    dup = numbered(repeated, "ord", name="_dup")
    return judged.join(dup, "ord", "left").withColumn("id", F.concat("id", F.coalesce(F.concat(F.lit("__dup"), (F.col("_dup") + 1).cast("string")), F.lit("")))).select(*names)


def calibration_buckets(rows: DataFrame) -> DataFrame:
    """(bucket, id, text, image): each usable row of calibration_rows() in every bucket that it has the parts for."""
    null = F.lit(None).cast("string")
    parts = [("query_text", None), (None, "query_image"), ("query_text", "query_image"), ("doc_text", None), (None, "doc_image"), ("fused_text", "fused_image")]
    each = []
    for name, (t, i) in zip(BUCKETS, parts):
        got = F.struct(F.lit(name).alias("bucket"), (F.col(t) if t else null).alias("text"), (F.col(i) if i else null).alias("image"))
        has = [F.col(c).isNotNull() for c in (t, i) if c]
        each.append(F.when(has[0] & has[-1], got))
    return rows.where("reason is null").select("id", F.explode(F.array_compact(F.array(*each))).alias("b")).select("b.bucket", "id", "b.text", "b.image")
