"""Means with stand-ins, balance terms against plain Python, group negatives, result files and counters."""

import math
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import calibrated as CA
from millrace.operators import contrastive as C
from millrace.operators import modality_balance as B
from millrace.operators import negatives as N
from millrace.operators import report
from millrace.operators import retrieval as R

MEANS = {"query_mean": [1.0, 0.0], "text_mean": [0.0, 1.0], "image_mean": [2.0, 2.0], "query_image_mean": [3.0, 0.0], "query_fused_mean": [5.0, 5.0], "fused_mean": [6.0, 6.0]}


def means(spark, *names):
    return spark.createDataFrame([(k, MEANS[k]) for k in names], "bucket string, mean array<double>")


def test_each_level_of_the_chain(spark):
    told = lambda names, native=False: {(r.role, r.modality): (r.source, list(r["mean"])) for r in CA.role_means(means(spark, *names), native, 0.25).collect()}
    least = ("query_mean", "text_mean", "image_mean")
    got = told(least)
    assert got["query", "text"][0] == "query_mean" and got["doc", "text"][0] == "text_mean" and got["query", "image"] == ("image_mean", [2, 2])
    assert got["query", "fused"] == ("interpolated", [0.25 * 2 + 0.75, 0.5]) and got["doc", "fused"] == ("interpolated", [0.5, 0.25 * 2 + 0.75])
    assert told((*least, "query_image_mean"))["query", "image"][0] == "query_image_mean"
    assert told((*least, "fused_mean"))["doc", "fused"][0] == "interpolated"
    native = told((*least, "fused_mean"), True)
    assert native["doc", "fused"][0] == native["query", "fused"][0] == "fused_mean"
    assert told((*least, "fused_mean", "query_fused_mean"), True)["query", "fused"][0] == "query_fused_mean"


def test_calibrated_rows(spark):
    rows = spark.createDataFrame([(1, "query", "text", [3.0, 0.0]), (2, "doc", None, [3.0, 4.0]), (3, "doc", "image", [2.0, 5.0])], "id int, role string, modality string, vec array<double>")
    full = means(spark, "query_mean", "text_mean", "image_mean")
    got = {r.id: (r.source, list(r.vec)) for r in CA.calibrated(rows, full).collect()}
    assert got == {1: ("query_mean", [1, 0]), 2: (None, [3, 4]), 3: ("image_mean", [0, 1])}
    with pytest.raises(Exception, match="no mean for doc image"):
        CA.calibrated(rows, means(spark, "query_mean", "text_mean")).collect()
    with pytest.raises(Exception, match="mean of 2 dimensions"):
        CA.calibrated(rows.withColumn("vec", F.slice("vec", 1, 1)), full).collect()


def views(spark):
    r = random.Random(4)
    vec = lambda: [r.uniform(-1, 1) for _ in range(3)]
    q = [(b // 3, b, i, vec(), not (b == 1 and i == 1)) for b in range(6) for i in range(2)]
    d = [(b // 3, b, j, vec(), not (b == 4 and j == 0)) for b in range(6) for j in range(3)]
    h = [(b // 3, b, g, vec(), True) for b in range(6) for g in range(2)]
    kind = "batch int, block int, {} int, vec array<double>, valid boolean"
    return q, d, h, *(spark.createDataFrame(x, kind.format(n)) for x, n in ((q, "i"), (d, "j"), (h, "g")))


def cos(a, b):
    return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))


def spread(xs, center, metric):
    c = {"mean": sum(xs) / len(xs), "max": max(xs), "min": min(xs)}[center]
    var = sum((x - c) ** 2 for x in xs) / len(xs)
    var = var * 2 * len(xs) / (len(xs) - 1) if metric == "pairwise" else var
    return math.sqrt(var + 1e-12) if metric == "std" else var


@pytest.mark.parametrize(("pos", "neg", "metric"), [("mean", "mean", "variance"), ("max", "min", "std"), ("mean", "min", "pairwise")])
def test_balance_is_by_definition(spark, pos, neg, metric):
    q, d, h, *frames = views(spark)
    got = {r.batch: r for r in B.balance_terms(*frames, pos_center=pos, neg_center=neg, metric=metric, weight=0.5).collect()}
    for batch in (0, 1):
        of = lambda rows, b: [v for t, k, _, v, ok in rows if t == batch and k == b and ok]
        blocks = sorted({b for t, b, *_ in q if t == batch})
        mean = lambda xs: sum(xs) / len(xs) if xs else 0.0
        some = lambda lists, c: mean([spread(x, c, metric) for x in lists if len(x) >= 2])
        p = some([[cos(x, y) for x in of(q, b) for y in of(d, b)] for b in blocks], pos)
        c = some([[cos(x, y) for x in of(q, b) for y in of(d, o)] for b in blocks for o in blocks if b != o], neg)
        n = some([[cos(x, y) for x in of(q, b)] for b in blocks for y in of(h, b)], neg)
        assert [got[batch][k] for k in ("pos", "neg_cross", "neg_hard", "loss")] == pytest.approx([p, c, n, p + 0.5 * (c + n) / 2])
    assert {r.neg_hard for r in B.balance_terms(*frames[:2]).collect()} == {None}
    with pytest.raises(ValueError):
        B.balance_terms(*frames, pos_center="median")


def test_cell_means_need_one_shape(spark):
    *_, q, d, _ = views(spark)
    names = {r.name for r in B.diagnostics(B.cells(q, d, "block")).collect()}
    assert names == {"pos_range", "pos_var", "pos_mean", "n_blocks"}
    full = B.cells(q.withColumn("valid", F.lit(True)), d.withColumn("valid", F.lit(True)), "block")
    got = {r.name: r.value for r in B.diagnostics(full).collect()}
    assert {n for n in got if n.startswith("cell")} == {f"cell_{i}_{j}" for i in range(2) for j in range(3)} and got["n_blocks"] == 6
    one = {r.i: r.x for r in full.where("j = 2").groupBy("i").agg(F.avg("cos").alias("x")).collect()}
    assert got["cell_1_2"] == pytest.approx(one[1])
    assert B.diagnostics(full.limit(0)).count() == 0


def test_any_related_view_drops_the_group(spark):
    picks = spark.createDataFrame([(1, 10), (1, 11), (2, 11), (3, 12)], "row int, src int")
    shown = spark.createDataFrame([(10, 0, "a"), (10, 1, "b"), (10, 2, "late"), (11, 0, "c"), (11, 1, None)], "src int, view int, uid string")
    related = spark.createDataFrame([(1, "late"), (2, "z"), (2, None)], "row int, uid string")
    got = sorted((r.row, r.src, r.view, r.uid) for r in N.group_negatives(picks, shown, related, 2).collect())
    assert got == [(1, 11, 0, "c"), (1, 11, 1, None), (2, 11, 0, "c"), (2, 11, 1, None)]


def test_mined_ones_come_first_and_once(spark):
    mined = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (1, "c", 2), (1, "a", 5)], "row int, doc string, pos int")
    plain = spark.createDataFrame([(1, "b", 0), (1, "c", 1), (1, "d", 2), (2, "e", 0), (2, "e", 3)], "row int, doc string, pos int")
    got = sorted((r.row, r.slot, r.doc, r.mined) for r in N.merged(mined, plain, 4, 2).collect())
    assert got == [(1, 0, "a", True), (1, 1, "b", True), (1, 2, "c", False), (1, 3, "d", False), (2, 0, "e", False)]


def test_result_files_of_a_folder(spark, tmp_path):
    folder = f"file://{tmp_path}/r"
    report.write_result(spark, folder, "one", report.result_payload(None, {"recall@5": 0.5, "ndcg@5": 0.1}))
    report.write_result(spark, folder, "two", report.result_payload("Named", {"recall@5": 0.25}, {"rows": 3}))
    report.write_result(spark, folder, "two", report.result_payload("Named", {"recall@5": 0.75}))
    report.write_result(spark, folder, "none", {"dataset": "x"})
    report.write_result(spark, folder, "mix", {"datasets": {"one": {"metrics": {"recall@5": 0.3}}, "Named": {"metrics": {"recall@5": 0.2}}}})
    got = {(r.part, r.dataset): r.value for r in report.read_results(spark, folder, "recall@5").collect()}
    assert got == {("Origin", "one"): 0.5, ("Origin", "Named"): 0.75, ("Mix", "one"): 0.3, ("Mix", "Named"): 0.2}
    with pytest.raises(Exception, match=r"ndcg@5 not found in"):
        report.read_results(spark, folder, "ndcg@5").collect()


def test_counters_come_from_the_pass(spark):
    queries = spark.createDataFrame([("a", True), ("b", True), ("c", False), ("d", True), (None, True)], "q string, ok boolean")
    qrels = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z"), ("c", "x")], "q string, d string")
    corpus = spark.createDataFrame([("x",), ("x",)], "d string")
    for drop, evaluated, dropped in ((True, {"a"}, 1), (False, {"a", "b"}, 0)):
        gold, golds = R.counted_gold(qrels, corpus, drop)
        kept = spark.createDataFrame(gold.collect(), gold.schema)
        left, counts = R.counted_queries(queries, qrels, kept.where("in_corpus") if not drop else kept, drop)
        assert {r.q for r in left.collect()} == evaluated
        assert golds.get == {"gold_total": 4, "gold_missing": 2}
        assert counts.get == {"total": 5, "null_id": 1, "no_qrels": 1, "failed": 1, "dropped": dropped, "evaluated": 5 - 3 - dropped}


def test_largest_cosine_of_all_from_few_tiles(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8)) * 4
    spread_out = rng.normal(size=(240, 8))
    groups = np.repeat(centres, 25, axis=0) + rng.normal(size=(300, 8)) * 0.3
    near_pair = np.vstack([groups, groups[:1] + 1e-3])
    for x, skips in ((spread_out, False), (groups, True), (near_pair, True), (np.vstack([spread_out, np.zeros((1, 8))]), False), (np.vstack([groups[:5]] * 9), False)):
        u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(u)], "k long, u array<double>")
        made, read, every = C.maxima(df, tile=20)
        scores = u @ u.T
        np.fill_diagonal(scores, -np.inf)
        assert made.agg(F.max("top")).first()[0] == pytest.approx(scores.max(), abs=1e-12)
        assert read <= every and (read < every / 2 or not skips), (read, every)
    assert C.maxima(df.limit(0))[0].count() == 0 and C.maxima(df.limit(1))[0].count() == 0


def test_profile_needs_no_pairs(spark):
    r = random.Random(1)
    vec = lambda n, name: spark.createDataFrame([(i, [r.uniform(-1, 1) for _ in range(6)]) for i in range(n)], f"{name} int, vec array<double>")
    q, d = vec(7, "q"), vec(40, "d")
    want = {x.q: (x.n, x.mean, x.best) for x in R.scores(q, d).groupBy("q").agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.max("score").alias("best")).collect()}
    got = {x.q: (x.n, x.mean, x.best) for x in R.profile(q, d).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_diagnostics_of_ragged_blocks(spark):
    """The last block of a table may be short: its cells count where they are, and the others keep theirs."""
    rows = [(0, 0, 0, 0.1), (0, 0, 1, 0.5), (0, 1, 0, 0.3), (0, 1, 1, 0.7), (1, 0, 0, 0.2), (1, 1, 0, 0.4), (2, 0, 0, 0.6)]
    cell = spark.createDataFrame([(*r, True) for r in rows], "block int, i int, j int, cos double, valid boolean")
    got = {r.name: round(r.value, 9) for r in B.diagnostics(cell, ragged=True).collect()}
    assert {k: v for k, v in got.items() if k.startswith("cell")} == {"cell_0_0": 0.3, "cell_0_1": 0.5, "cell_1_0": 0.35, "cell_1_1": 0.7}
    assert got["n_blocks"] == 3 and got["pos_mean"] == round((0.4 + 0.3 + 0.6) / 3, 9) and got["pos_range"] == round((0.6 + 0.2 + 0) / 3, 9)
    assert {r.name for r in B.diagnostics(cell).collect()} == {"pos_range", "pos_var", "pos_mean", "n_blocks"}
