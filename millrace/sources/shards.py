"""Shards of an embedding job, a ledger of what each holds, and their merge in the records' order.

Record r belongs to shard r % shards. A shard's data is written first and its ledger row after it, so
a shard without a ledger row did not end. The merge reads the ledger alone, a few numbers for each
shard, and refuses shards that are missing, that disagree, or whose rows are not those they should
hold, before it reads a vector.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.sources.arrays import write_npy

#: What a shard's rows have; columns that an embedding job lacks are null.
COLUMNS = {"row_idx": "long", "embedding": "array<float>", "n_tokens": "long", "n_text": "long", "n_image": "long", "success": "boolean", "error": "string"}
_LEDGER = "shard int, of int, rows long, first long, last long, islands long, succeeded long, least_dim int, most_dim int"


def write_shards(embedded: DataFrame, path: str, shards: int, only: list[int] | None = None) -> DataFrame:
    """Write rows (row_idx, embedding, success, ...) as shards under path, all or `only` some; gives their ledger rows.

    A repeated write of a shard replaces it.
    """
    spark = embedded.sparkSession
    have = [(F.col(c) if c in embedded.columns else F.lit(None)).cast(kind).alias(c) for c, kind in COLUMNS.items()]
    rows = embedded.select(*have, F.pmod(F.col("row_idx"), F.lit(shards)).cast("int").alias("shard"))
    wanted = list(range(shards)) if only is None else sorted(only)
    rows = rows if only is None else rows.where(F.col("shard").isin(wanted))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(f"{path}/data")
    written = spark.read.schema(_schema()).parquet(f"{path}/data")
    written = written if only is None else written.where(F.col("shard").isin(wanted))
    # rows of a shard are `shards` apart: an island is a run without a gap
    at = Window.partitionBy("shard").orderBy("row_idx")
    step = F.coalesce((F.col("row_idx") - F.lag("row_idx").over(at) != shards).cast("int"), F.lit(1))
    size = F.when(F.col("success"), F.size("embedding"))
    each = written.withColumn("step", step).groupBy("shard").agg(F.lit(shards).alias("of"), F.count("*").alias("rows"), F.min("row_idx").alias("first"), F.max("row_idx").alias("last"), F.sum("step").alias("islands"), F.count_if("success").alias("succeeded"), F.min(size).alias("least_dim"), F.max(size).alias("most_dim"))
    # a shard may have no rows: it still gets its row
    every = spark.createDataFrame([(k,) for k in wanted], "shard int")
    full = every.join(each, "shard", "left").withColumn("of", F.lit(shards)).fillna(0, ["rows", "islands", "succeeded"])
    names = [c.split()[0] for c in _LEDGER.split(", ")]
    full.select(*names).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(f"{path}/ledger")
    return ledger(spark, path)


def _schema() -> str:
    return ", ".join(f"{c} {kind}" for c, kind in COLUMNS.items()) + ", shard int"


def ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_LEDGER).parquet(f"{path}/ledger")


def faults(told: list, rows: int) -> list[str]:
    """What is wrong with the ledger rows of `rows` records: a line for each fault, none if the shards can be merged."""
    if not told:
        return ["no shard has ended"]
    wrong, of = [], sorted({r.of for r in told})
    if len(of) > 1:
        return [f"shards of {of} in one job"]
    have = {r.shard: r for r in told}
    if missing := sorted(set(range(of[0])) - set(have)):
        wrong.append(f"missing shards: {missing}")
    for k, r in sorted(have.items()):
        want = len(range(k, rows, of[0]))
        if r.rows and (r.first != k or r.islands > 1 or r.last != k + (want - 1) * of[0]):
            wrong.append(f"shard {k}: rows {r.first} to {r.last} in {r.islands} runs, where {k} to {k + max(0, want - 1) * of[0]} were expected in one")
        elif r.rows != want:
            wrong.append(f"shard {k}: {r.rows} rows where {want} were expected")
    dims = sorted({d for r in told for d in (r.least_dim, r.most_dim) if d is not None})
    if len(dims) > 1:
        wrong.append(f"vectors of {dims} dimensions in one job")
    if rows and not dims and not wrong:
        wrong.append("all records failed: the dimension is unknown")
    return wrong


def merge(spark: SparkSession, path: str, ids: DataFrame, rows: int | None = None) -> DataFrame:
    """(row_idx, id, embedding, n_tokens, n_text, n_image, success, error) of ids (row_idx, id), in which a failed record has a zero vector.

    Faults of the ledger are a ValueError before a vector is read.
    """
    told = ledger(spark, path).collect()  # a row for each shard
    if wrong := faults(told, ids.count() if rows is None else rows):
        raise ValueError(f"{path}: {'; '.join(wrong)}")
    dims = max((r.most_dim for r in told if r.most_dim is not None), default=0)
    data = spark.read.schema(_schema()).parquet(f"{path}/data").drop("shard")
    zero = F.array_repeat(F.lit(0.0).cast("float"), dims)
    ok = F.coalesce("success", F.lit(False))
    count = lambda c: F.coalesce(F.when(ok, F.col(c)), F.lit(0)).alias(c)
    return ids.select("row_idx", "id").join(data, "row_idx", "left").select("row_idx", "id", F.when(ok, F.col("embedding")).otherwise(zero).alias("embedding"), count("n_tokens"), count("n_text"), count("n_image"), ok.alias("success"), F.when(~ok, F.coalesce("error", F.lit("no result"))).alias("error"))


def write_set(merged: DataFrame, folder: str, rows: int, parts: int, kind: str = "<f2", metadata: DataFrame | None = None) -> None:
    """An embedding folder of merge(): the array with its ledger, and JSON lines of ids and counts, metadata, and failures.

    metadata (row_idx, ...): what is known of a record besides; a failed record has its error instead. The array is written
    last, so a folder with an array is whole.
    """
    idx = F.col("row_idx").alias("idx")
    counts = merged.select(idx, "id", F.col("n_tokens").alias("token_count"), F.col("n_text").alias("text_token_count"), F.col("n_image").alias("image_token_count"), "success")
    told = merged.select("row_idx", "id", "success", "error")
    more = [c for c in metadata.columns if c != "row_idx"] if metadata is not None else []
    if metadata is not None:
        told = told.join(metadata, "row_idx", "left")
    told = told.select(idx, "id", *(F.when(F.col("success"), F.col(c)).alias(c) for c in more), "success", "error")
    for name, df in (("token_counts", counts), ("embedding_metadata", told), ("failed_records", told.where(~F.col("success")).select("idx", "id", "error"))):
        df.repartitionByRange(parts, "idx").sortWithinPartitions("idx").write.mode("overwrite").json(f"{folder}/{name}")
    write_npy(merged.select("row_idx", "embedding"), f"{folder}/embeddings", rows, parts, kind)


def read_set(spark: SparkSession, folder: str) -> DataFrame:
    """(row_idx, id, embedding, success) of a folder of write_set()."""
    from millrace.sources.arrays import read_npy

    told = spark.read.schema("idx long, id string, success boolean").json(f"{folder}/token_counts").withColumnRenamed("idx", "row_idx")
    return read_npy(spark, f"{folder}/embeddings").join(told, "row_idx").select("row_idx", "id", "embedding", "success")
