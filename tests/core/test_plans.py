"""Global numbering, tiled search, evaluation, settings, images and job checks."""

from __future__ import annotations

import base64

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import contrastive as C
from millrace.operators import lexical as L
from millrace.operators import retrieval as R
from millrace.operators.order import batches, numbered
from millrace.plans import losses
from millrace.plans.evaluation import Dataset, evaluate
from millrace.sources import embeddings as E
from millrace.sources import images


def test_numbered_is_the_total_order(spark):
    rows = spark.range(0, 5000, numPartitions=7).select((F.col("id") * 7919 % 5000).alias("id"), (F.col("id") % 3).alias("g"))
    got = numbered(rows, "g", "id").orderBy("row_idx").collect()
    assert [r.row_idx for r in got] == list(range(5000))
    assert [(r.g, r.id) for r in got] == sorted((r.g, r.id) for r in got)
    assert batches(rows, 32, "g", "id").groupBy("batch").count().agg(F.max("count"), F.count("*")).first()[:] == (32, 157)
    assert numbered(rows.limit(0), "id").count() == 0
    nulls = spark.createDataFrame([(None,), (2,), (2,)], "id int")
    assert [(r.id, r.row_idx) for r in numbered(nulls, "id").orderBy("row_idx").collect()] == [(None, 0), (2, 1), (2, 2)]


@pytest.mark.parametrize("ids", ["long", "string"])
def test_search_over_tiles(spark, ids):
    rng = np.random.default_rng(1)
    v = rng.integers(-2, 3, (2600, 3)).astype(float)
    v[v.any(axis=1) == 0] = 1.0
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "d long, vec array<double>").repartition(3).withColumn("d", F.col("d").cast(ids))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    key = (lambda j: j) if ids == "long" else str
    q = df.where("cast(d as long) < 40").withColumnRenamed("d", "q")
    got = {}
    for r in R.search(q, df, 7).collect():
        got.setdefault(r.q, []).append((r["rank"], r.score, r.d))
    assert len(got) == 40
    for i, rows in got.items():
        s = u[int(i)] @ u.T
        want = sorted(s.tolist(), reverse=True)[:7]
        assert [x[1] for x in sorted(rows)] == pytest.approx(want, abs=1e-9)
        assert len({x[2] for x in rows}) == 7 and all(s[int(x[2])] == pytest.approx(x[1], abs=1e-9) for x in rows)
    one = spark.createDataFrame([(9, [1.0, 0.0]), (3, [2.0, 0.0]), (5, [3.0, 0.0])], "d long, vec array<double>").withColumn("d", F.col("d").cast(ids))
    assert [r.d for r in R.search(one.limit(1).withColumnRenamed("d", "q"), one, 2).orderBy("rank").collect()] == [key(3), key(5)]


def test_documents_of_several_vectors(spark):
    q = spark.createDataFrame([("q", [1.0, 0.0])], "q string, vec array<double>")
    c = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [1.0, 0.1]), ("a", [1.0, 0.2]), ("b", [1.0, 1.0]), ("c", [0.0, 1.0])], "d string, vec array<double>")
    assert [(r.d, r["rank"]) for r in R.search_documents(q, c, 2).orderBy("rank").collect()] == [("a", 1), ("b", 2)]
    assert R.search_documents(q, c.limit(0), 2).count() == 0


def test_collapse_of_two_and_one(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0])], "id int, vec array<double>")
    got = C.collapse(v).first()
    assert (got.mean_cos, got.max_cos, got.std) == pytest.approx((0.0, 0.0, 0.707107), abs=1e-6)
    assert C.collapse(v.where("id = 1")).first().mean_cos is None


def test_evaluation(spark):
    vec = "vec array<double>"
    sets = {}
    for tag, x in (("a", [1.0, 0.0]), ("b", [0.9, 0.1])):
        q = spark.createDataFrame([("q", x), ("unjudged", x)], f"q string, {vec}")
        c = spark.createDataFrame([("d", x), ("e", [0.0, 1.0])], f"d string, {vec}")
        sets[tag] = Dataset(q, c, spark.createDataFrame([("q", "d", 1.0)], "q string, d string, rel double"))
    for mixed, foreign in ((True, 0.5), (False, 0.0)):
        rows = {(r.dataset, r.k): r for r in evaluate(sets, [1, 2], mixed).collect()}
        assert len(rows) == 8 and rows["a", 1].recall == rows["b", 1].recall == rows["macro", 1].recall == rows["micro", 2].recall == 1.0
        assert rows["macro", 2].foreign == foreign and rows["a", 1].queries == 1 and rows["micro", 1].queries == 2


def test_loss_settings():
    known = {
        "mask": losses.Module({"enable": True, "rule": True}, flat={"mask_rule": "rule"}),
        "dims": losses.Module({"enable": False, "dims": None}, implied_by="dims"),
        "balance": losses.Module({"enable": True, "weight": 0.0}, block="old", needs_views=True),
    }
    got, remarks = losses.settle({"type": "x", "mask_rule": False, "modules": {"dims": {"dims": [8]}, "what": True}, "typo": 1}, known, {"type"})
    assert got == {"mask": {"enable": True, "rule": False}, "dims": {"enable": True, "dims": [8]}, "balance": {"enable": True, "weight": 0.0}}
    assert remarks == ["unknown module what", "old key mask_rule", "unknown key typo"]
    assert losses.settle({"old": False}, known, set())[0]["balance"]["enable"] is False
    both, remarks = losses.settle({"old": {"weight": 1}, "modules": {"balance": {"weight": 2}}}, known, set())
    assert both["balance"]["weight"] == 2 and remarks == ["old block old ignored"]
    assert losses.without_effect(both, known, False) == ["balance"] and losses.without_effect(both, known, True) == []
    assert losses.without_effect(got, known, False) == []


def test_images(spark, tmp_path):
    raw = b"\x89PNG\r\n\x1a\nxyz"
    (tmp_path / "a.png").write_bytes(raw)
    refs = [f"file://{tmp_path}/a.png", f"{tmp_path}/a.png", "data:image/png;base64," + base64.b64encode(raw).decode(), f"{tmp_path}/none.png", "data:,", None]
    rows = spark.createDataFrame(list(enumerate(refs)), "i int, image string")
    got = {r.i: r for r in images.load(rows, "image", str(tmp_path)).withColumn("kind", images.kind(F.col("content"))).collect()}
    assert [got[i].kind for i in range(6)] == ["png", "png", "png", None, None, None]
    assert [got[i].error is None for i in range(6)] == [True, True, True, False, False, True] and bytes(got[0].content) == raw


def test_jobs(spark, tmp_path):
    spark.range(3).write.parquet(f"file://{tmp_path}/set")
    assert E.complete(spark, f"file://{tmp_path}/set", 3) and not E.complete(spark, f"file://{tmp_path}/set", 4) and not E.complete(spark, f"file://{tmp_path}/no", 3)
    assert E.calibration_path({"means": "a"}, None, {"CALIBRATION_DISABLE": "1"}) is None
    assert E.calibration_path({}, None, {}) is None and E.calibration_path({}, None, {"CALIBRATION_MEANS": " b "}) == "b"
    assert (L.progress(5, 10), L.progress(20, 10), L.progress(3, 0), L.progress(-1, 5)) == (0.5, 1.0, 0.0, 0.0)


def test_relevance_by_keys_is_that_of_its_pairs(spark):
    """A key's sides of 40 x 60 rows are judged without their 2400 pairs, and give the figures that the pairs give."""
    from pyspark.sql import functions as F

    from millrace.operators import retrieval as R

    vec = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda p: F.sin((F.col("i") * 13 + p * 7 + F.col("i") * p).cast("double")))
    rows = spark.range(100).withColumnRenamed("id", "i").withColumn("vec", vec).withColumn("key", F.when(F.col("i") % 11 != 3, F.col("i") % 3)).withColumn("grade", F.col("i") % 2)
    q, d = rows.where("i < 40").withColumnRenamed("i", "q"), rows.where("i >= 40").withColumnRenamed("i", "d")
    rel = lambda a, b: F.when(a == b, 2.0).otherwise(1.0)
    keyed = R.KeyedGold(q, d, rel)
    pairs = q.select("q", "key", F.col("grade").alias("a")).join(d.select("d", "key", F.col("grade").alias("b")), "key").select("q", "d", rel(F.col("a"), F.col("b")).alias("rel"))
    asked, found = pairs.select("q").distinct(), R.search(q, d, 10)
    told = [sorted(tuple(round(x, 9) for x in r) for r in R.per_query(found, g, asked, [1, 5, 10]).collect()) for g in (keyed, pairs)]
    assert told[0] == told[1] and len(told[0]) == 3 * asked.count()
    ranks = [sorted(map(tuple, R.strict_ranks(q, d, g, block=7).collect())) for g in (keyed, pairs)]
    assert ranks[0] == ranks[1] == sorted(map(tuple, R.strict_rank(R.scores(q, d), pairs).collect()))
    assert {(r.q, r.rel, r.n) for r in keyed.grades().collect()} == {(r.q, r.rel, r.n) for r in R.Gold(pairs).grades().collect()}
    assert keyed.grades().count() <= 2 * 40
