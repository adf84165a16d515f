"""Shards, their ledger, and the merge."""

import pytest
from pyspark.sql import functions as F

from millrace.sources import shards as S


@pytest.fixture
def job(spark):
    ids = spark.range(40).select(F.col("id").alias("row_idx"), F.concat(F.lit("d"), "id").alias("id"))
    ok = F.col("row_idx") % 7 != 3
    vec = F.array(*(F.col("row_idx").cast("float") + i for i in range(3)))
    done = ids.select("row_idx", F.when(ok, vec).alias("embedding"), (F.col("row_idx") + 1).alias("n_tokens"), ok.alias("success"), F.when(~ok, "cannot encode").alias("error"))
    return ids, done


def test_merge_in_order_with_zero_vectors_and_sidecars(spark, job, tmp_path):
    ids, done = job
    told = S.write_shards(done, f"{tmp_path}/s", 4).collect()
    assert {r.shard: (r.rows, r.first, r.last, r.islands, r.least_dim) for r in told} == {k: (10, k, 36 + k, 1, 3) for k in range(4)}
    merged = S.merge(spark, f"{tmp_path}/s", ids)
    got = {r.row_idx: r for r in merged.collect()}
    assert len(got) == 40 and list(got[3].embedding) == [0, 0, 0] and got[3].error == "cannot encode" and got[3].n_tokens == 0
    assert list(got[8].embedding) == [8, 9, 10] and got[8].n_tokens == 9 and got[8].id == "d8" and got[8].error is None
    S.write_set(merged, f"{tmp_path}/set", 40, 3, metadata=ids.select("row_idx", (F.col("row_idx") * 2).alias("line_number")))
    back = {r.row_idx: r for r in S.read_set(spark, f"{tmp_path}/set").collect()}
    assert all(back[i].id == f"d{i}" and back[i].success == (i % 7 != 3) and list(back[i].embedding) == list(got[i].embedding) for i in range(40))
    failed = spark.read.json(f"{tmp_path}/set/failed_records").collect()
    assert sorted(r.idx for r in failed) == [i for i in range(40) if i % 7 == 3]
    meta = {r.idx: r for r in spark.read.json(f"{tmp_path}/set/embedding_metadata").collect()}
    assert meta[4].line_number == 8 and meta[3].line_number is None and meta[3].error == "cannot encode"


def test_a_missing_shard_is_an_error_before_vectors_are_read(spark, job, tmp_path):
    ids, done = job
    path = f"{tmp_path}/s"
    S.write_shards(done, path, 4, only=[0, 1, 3])
    with pytest.raises(ValueError, match=r"missing shards: \[2\]"):
        S.merge(spark, path, ids)
    S.write_shards(done, path, 4, only=[2])
    assert S.merge(spark, path, ids).where("success").count() == 34
    # a gap within a shard, rows cut off, and other dimensions
    S.write_shards(done.where("row_idx <> 13"), path, 4, only=[1])
    with pytest.raises(ValueError, match="shard 1: rows 1 to 37 in 2 runs"):
        S.merge(spark, path, ids)
    S.write_shards(done.where("row_idx <> 37"), path, 4, only=[1])
    with pytest.raises(ValueError, match="shard 1: rows 1 to 33 in 1 runs, where 1 to 37"):
        S.merge(spark, path, ids)
    S.write_shards(done.withColumn("embedding", F.slice("embedding", 1, 2)), path, 4, only=[1])
    with pytest.raises(ValueError, match=r"vectors of \[2, 3\] dimensions"):
        S.merge(spark, path, ids)
    S.write_shards(done.unionByName(done.where("row_idx = 5")), path, 4, only=[1])
    with pytest.raises(ValueError, match="shard 1"):
        S.merge(spark, path, ids)


def test_all_failed_and_empty(spark, job, tmp_path):
    ids, done = job
    S.write_shards(done.withColumn("success", F.lit(False)), f"{tmp_path}/f", 2)
    with pytest.raises(ValueError, match="all records failed"):
        S.merge(spark, f"{tmp_path}/f", ids)
    S.write_shards(done.limit(0), f"{tmp_path}/e", 2)
    assert S.merge(spark, f"{tmp_path}/e", ids.limit(0)).count() == 0
