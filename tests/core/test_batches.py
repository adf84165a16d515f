"""Masks and candidates of batches, calibration rows, shared keys, documents of many vectors, instruction tables."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import identity as I
from millrace.operators import identity_masks as M
from millrace.operators import records, views
from millrace.operators import retrieval as R
from millrace.plans import manifests
from millrace.sources import embeddings as E

EXAMPLES = "batch long, example long, group_id string, query_id string, positive_ids array<string>"
SLOTS = "batch long, example long, slot int, doc string, positive boolean"


def made(seed: int, n: int = 24):
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[rng.integers(len(xs))]
    ids = ["a", "b", "c", "d", None]
    examples = [(i // 8, i, pick(["g", "h", None, None]), pick(["q", "r", None]), pick([None, [], [pick(ids)], [pick(ids), pick(ids)]])) for i in range(n)]
    slots = [(i // 8, i, k, pick(ids), k < 2) for i in range(n) for k in range(4)]
    return examples, slots


@pytest.mark.parametrize("rules", ["ABCD", "B", "C", "D", "A", ""])
def test_masks_are_those_of_all_pairs(spark, rules):
    examples, slots = made(len(rules))
    e, s = spark.createDataFrame(examples, EXAMPLES), spark.createDataFrame(slots, SLOTS)
    e = e.withColumn("slot", F.lit("clash"))
    by = {x[1]: x for x in examples}
    same = lambda a, b, k: a == b or (by[a][k] is not None and by[a][k] == by[b][k])
    wants = lambda a, doc: doc is not None and doc in (by[a][4] or [])
    doc, query = set(), set()
    for b, a, *_ in examples:
        for sb, x, slot, d, positive in slots:
            if sb != b:
                continue
            if not (positive and a == x) and (("B" in rules and positive and same(a, x, 2)) or ("C" in rules and wants(a, d))):
                doc.add((b, a, x, slot))
            if positive and a != x and (("B" in rules and same(a, x, 2)) or ("D" in rules and same(a, x, 3)) or ("C" in rules and wants(a, d))):
                query.add((b, x, slot, a))
    got = M.doc_side(e, s, rules).select("batch", "anchor", "example", "slot").collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == doc
    got = M.query_side(e, s, rules).select("batch", "example", "slot", "candidate").collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == query
    own = {(b, x, k) for b, x, k, d, p in slots if not p and wants(x, d)}
    assert {tuple(r) for r in M.own_slots(e, s).collect()} == own
    with pytest.raises(ValueError):
        M.doc_side(e, s, "X")


def test_candidates(spark):
    _, slots = made(1)
    s = spark.createDataFrame(slots, SLOTS)
    n = lambda mode: {r.anchor: (r.n, r.t) for r in M.candidates(s, mode).groupBy("anchor").agg(F.count("*").alias("n"), F.count_if("target").alias("t")).collect()}
    assert set(n("all").values()) == {(32, 2)} and set(n("positives_only").values()) == {(18, 2)} and set(n("own").values()) == {(4, 2)}
    assert M.candidates(s.limit(0)).count() == 0
    with pytest.raises(ValueError):
        M.candidates(s, "some")


PART = "struct<text:string,image:string>"


def test_calibration_rows(spark):
    good = [("t", None), (None, "i.png"), ("f", "j.png")]
    rows = [
        (0, "x", [("q", None)], good), (1, "x", [(" ", None), (None, "i.png"), ("late", "k.png")], good[:2]), (2, None, None, good),
        (3, "x", [], good), (4, "y", [(None, "lost.png"), ("q", None)], good), (5, "y", [(None, "")], good), (6, "y", [("q", None)], None),
        (7, "y", [("q", None)], good[:1]), (8, "y", [("q", None)], [(" ", None), good[1]]), (9, "y", [("q", None)], [good[0], ("t", "")]),
        (10, "y", [("q", None)], [good[0], (None, "lost.png")]), (11, None, [("q", None)], [good[0], good[1], ("f", None)]), (12, "x", [("q", None)], good), (13, "y", [None, ("q", None)], good),
    ]
    df = spark.createDataFrame(rows, f"ord long, id string, query array<{PART}>, positive array<{PART}>")
    known = spark.createDataFrame([("i.png",), ("j.png",), ("i.png",), (None,)], "image string")
    got = {r.ord: r for r in records.calibration_rows(df, known=known).collect()}
    assert len(got) == len(rows)
    assert {k: r.id for k, r in got.items() if r.reason is None} == {0: "x", 1: "x__dup1", 11: "11", 12: "x__dup2", 13: "y"}
    assert (got[1].query_text, got[1].query_image) == ("late", "i.png") and got[0].fused_text is None
    says = {2: "no_query", 3: "no_query", 4: "query_image_unknown: lost.png", 5: "empty_query", 6: "too_few_positives", 7: "too_few_positives", 8: "first_positive_without_text", 9: "second_positive_without_image", 10: "positive_image_unknown: lost.png"}
    assert all(got[k].reason.startswith(v) for k, v in says.items())
    whole = records.calibration_rows(df, True, known)
    why = {r.ord: r.reason for r in whole.collect()}
    assert [k for k, r in why.items() if r is None] and why[1] == "no_third_positive" and why[11] == "third_positive_without_image"
    held = {(r.bucket, r.id): (r.text, r.image) for r in records.calibration_buckets(whole).collect()}
    assert held["fused_mean", "x"] == ("f", "j.png") and held["text_mean", "y"] == ("t", None) and ("query_image_mean", "x") not in held
    both = {r.bucket: r.image for r in records.calibration_buckets(records.calibration_rows(df)).where("id = 'x__dup1'").collect()}
    assert both["query_fused_mean"] == "i.png" and "fused_mean" not in both
    assert records.calibration_buckets(records.calibration_rows(df.limit(0))).count() == 0


def test_shared_keys(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None), (5, None), (6, "a")], "i long, k string")
    assert {tuple(r) for r in I.classes(rows, "k", "i").collect()} == {(1, 1, 2), (3, 1, 2), (6, 1, 2), (2, 2, 0), (4, 4, 0), (5, 5, 0)}
    pool = spark.createDataFrame([(1, "u", "x"), (2, None, "x"), (3, "u", "y"), (4, "", "x"), (5, "x", "z"), (6, None, None), (7, None, None)], "i long, uid string, content string")
    firsts = I.pool_dedup(pool, "i")
    assert {r.i: (r.first, r.slot) for r in firsts.collect()} == {1: (1, 0), 3: (1, 0), 2: (2, 1), 4: (2, 1), 5: (5, 2), 6: (6, 3), 7: (6, 3)}
    once = firsts.where("i = first").select("slot", (F.col("i") * 10).alias("v"))
    assert {r.i: r.v for r in I.gathered(firsts, once, "i").collect()} == {1: 10, 2: 20, 3: 10, 4: 20, 5: 50, 6: 60, 7: 60}


@pytest.mark.parametrize("ids", ["long", "string"])
def test_documents_of_many_vectors(spark, ids):
    """A third of the vectors are one document's; ties abound."""
    rng = np.random.default_rng(3)
    v = rng.integers(-2, 3, (3000, 3)).astype(float)
    v[v.any(axis=1) == 0] = 1.0
    doc = [0 if i % 3 == 0 else int(rng.integers(1, 400)) for i in range(len(v))]
    df = spark.createDataFrame([(d, x.tolist()) for d, x in zip(doc, v)], "d long, vec array<double>").repartition(3).withColumn("d", F.col("d").cast(ids))
    q = spark.createDataFrame([(i, v[i].tolist()) for i in range(30)], "q long, vec array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    got: dict = {}
    for r in R.search_documents(q, df, 7).orderBy("q", "rank").collect():
        got.setdefault(r.q, []).append((round(r.score, 9), r.d))
    for i in range(30):
        best: dict = {}
        for d, s in zip(doc, u @ u[i]):
            best[d] = max(best.get(d, -2), s)
        scores = sorted((round(s, 9) for s in best.values()), reverse=True)[:7]
        assert [s for s, _ in got[i]] == scores and len({d for _, d in got[i]}) == 7
        assert all(round(best[int(d)], 9) == s for s, d in got[i])
    assert R.over_fetch(df, 2).first().n == 2000 and R.over_fetch(df, 9).first().n == 3000


def test_instruction_tables(spark, tmp_path):
    table = {"t": {"query": "Q"}}
    path = tmp_path / "conf.json"
    for conf in ({"data": {"task_instructions": table}}, {"task_instructions": table}, table):
        path.write_text(json.dumps(conf))
        assert manifests.instruction_tables(str(path)) == manifests.instruction_tables(json.dumps(conf)) == table
    assert manifests.instruction_tables(None) == manifests.INSTRUCTIONS
    with pytest.raises(FileNotFoundError):
        manifests.instruction_tables("nowhere.json")
    tables = {"t": {"query": "Q", "query_image": "QI"}, "empty": {}, "default": {"doc": "D"}}
    rows = spark.createDataFrame([("t", "query", "text", None), ("t", "query", "image", None), ("t", "doc", "text", None), ("empty", "doc", "text", None), (None, "doc", "text", None), ("new", "query", "text", None), ("t", "query", "text", "")], "task string, role string, mod string, own string")
    got = rows.select(views.task_instruction(tables, *(F.col(c) for c in rows.columns)).alias("x")).collect()
    assert [r.x for r in got] == ["Q", "QI", None, "D", "D", None, ""]


def test_matryoshka_setup(spark):
    v = spark.createDataFrame([(1, [3.0, 4.0, 0.0])], "i long, embedding array<double>")
    assert {(r.dim, len(r.embedding)) for r in E.matryoshka_setup(v, [2, 9]).collect()} == {(2, 2), (3, 3)}
    with pytest.raises(ValueError):
        E.matryoshka_setup(v, [2], calibrated=True)
