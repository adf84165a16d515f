"""Core operators on literal fixtures with hand-computed values, and on odd inputs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions import vectors as V
from millrace.operators import contrastive as C
from millrace.operators import identity as I
from millrace.operators import lexical as L
from millrace.operators import report, views
from millrace.operators import retrieval as R
from millrace.operators.components import connected_components
from millrace.plans import manifests as M
from millrace.sources import arrays as A
from millrace.sources import embeddings as E
from millrace.sources import jsonl as J
from millrace.streaming import ingest


def one(spark, c, **cols):
    return spark.range(1).select(c.alias("x")).first().x


def arr(*xs):
    return F.array(*(F.lit(float(x)) for x in xs))


def test_vectors(spark):
    close = lambda c, want: one(spark, c) == pytest.approx(want, abs=1e-6)
    assert close(V.truncate(arr(1, 2, 2, 4), 2), [0.447214, 0.894427])
    assert close(V.normalise(arr(1, 2, 2, 4)), [0.2, 0.4, 0.4, 0.8])
    assert close(V.normalise(arr(0, 0)), [0, 0])
    assert close(V.fuse(arr(3, 4), arr(0, 2)), [0.316228, 0.948683])
    assert close(V.fuse(arr(3, 4), arr(0, 2), 0.5, arr(0.2, 0.1), arr(0.1, 0.2)), [0.196116, 0.980581])
    assert close(V.mean_of(F.array(arr(1, 0), arr(0, 1))), [0.707107, 0.707107])
    assert close(V.fuse_masked(arr(3, 4), arr(0, 2), F.lit(False), F.lit(True)), [0, 1])


QRELS = [("q1", "d1", 1.0), ("q1", "d3", 2.0), ("q2", "d9", 1.0), ("q3", "d2", 1.0), ("q3", "d4", 0.0)]
RANKS = {"q1": ["d2", "d3", "d1", "d4"], "q2": ["d1", "d2", "d3", "d4"], "q3": ["d2", "d1", "d3", "d4"]}


def test_metrics(spark):
    ranked = spark.createDataFrame([(q, d, i + 1) for q, ds in RANKS.items() for i, d in enumerate(ds)], "q string, d string, rank int")
    qrels = spark.createDataFrame(QRELS, "q string, d string, rel double")
    got = {(r.q, r.k): r for r in R.per_query(ranked, qrels, qrels, [1, 3]).collect()}
    vals = lambda r: [round(r[m], 6) for m in R.METRICS]
    assert vals(got["q1", 3]) == [1, 0.666667, 0.669672, 0.5, 0.583333, 1]
    assert vals(got["q1", 1]) == [0] * 6 and vals(got["q2", 3]) == [0] * 6
    assert vals(got["q3", 3]) == [1, 0.333333, 1, 1, 1, 1]
    mean = {r.k: r for r in R.means(R.per_query(ranked, qrels, qrels, [1, 3]), "k").collect()}
    assert vals(mean[3]) == [0.666667, 0.333333, 0.556557, 0.5, 0.527778, 0.666667]
    have = ranked.select("d")
    assert R.gold_in_corpus(qrels, have, drop_missing=True).where("q = 'q2'").count() == 0
    assert R.gold_in_corpus(qrels, have).where("not in_corpus").count() == 1


def test_search_matches_all_pairs(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(40, 6)).tolist() + [[0.0] * 6] + [[1.0] * 6] * 3
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "d long, vec array<double>")
    q = frame.where("d < 7").withColumnRenamed("d", "q")
    for block in (3, 100):
        a = {(r.q, r.rank): r.d for r in R.search(q, frame.repartition(3), 60, block=block).collect()}
        b = {(r.q, r.rank): r.d for r in R.best_k(R.scores(q, frame).withColumn("score", F.round("score", 12)), 60).collect()}
        assert a == b and len(a) == 7 * 44  # k over the corpus size gives the corpus
    assert R.search(q.limit(0), frame, 3).count() == 0


def test_qrels_forms(spark):
    lines = ['{"query_id":"q1","doc_id":"d1","score":1}', '{"qid":"q1","doc_id":"d1","score":3}', '{"qid":"q2","corpus-id":"d1"}', '{"query_id":"q3","positive_ids":["d1",{"doc_id":"d2","score":2}]}', '{"query_id":"q4","docs":{"d1":2,"d2":1}}', "q5\td1", ""]
    got = {(r.q, r.d, r.rel) for r in J.qrels(spark.createDataFrame([(x,) for x in lines], "line string")).collect()}
    assert got == {("q1", "d1", 3), ("q2", "d1", 1), ("q3", "d1", 1), ("q3", "d2", 2), ("q4", "d1", 2), ("q4", "d2", 1), ("q5", "d1", 1)}


def qrels_of(spark, *lines):
    return {(r.q, r.d, r.rel) for r in J.qrels(spark.createDataFrame([(x,) for x in lines], "line string")).collect()}


def test_qrels_names_and_forms_add_up(spark):
    assert qrels_of(spark, '{"qid":"q1","pid":"d1"}', '{"question_id":"q2","doc":"d9","grade":3}', " ", "q3 d3 2 x", "q3\td4") == {("q1", "d1", 1), ("q2", "d9", 3), ("q3", "d3", 2), ("q3", "d4", 1)}
    both = '{"query_id":"q","docs":{"a":2},"doc_scores":{"b":3},"gold_ids":["c",{"cid":"e","gain":5},{"x":1}],"doc_id":"f","rel":0.5}'
    assert qrels_of(spark, both) == {("q", "a", 2), ("q", "b", 3), ("q", "c", 0.5), ("q", "e", 5), ("q", "f", 0.5)}
    assert qrels_of(spark, '{"query":7,"docs":{}}', '{"q_id":"q","did":3,"score":-2}', '{"q_id":"q","doc_ids":[]}') == {("q", "3", 0)}
    assert qrels_of(spark, '{"queryid":"q","relevance":{"a":1},"docid":"b"}') == {("q", "a", 1), ("q", "b", 1)}


@pytest.mark.parametrize("line", ['{"query_id":"q1"}', '{"doc_id":"d"}', "{bad json", "alone", "q d notanumber", '{"qid":"q","doc_id":"d","score":"x"}', '{"qid":"q","doc_id":["d"]}'])
def test_qrels_errors(spark, line):
    with pytest.raises(Exception):
        qrels_of(spark, "q1 d1", line)


def example(spark, line):
    return J.examples(J.parsed(spark.createDataFrame([(line,)], "line string"))).first()


def test_examples_of_all_shapes(spark):
    x = example(spark, '{"queries":["a",{"content":"b","images":["", "i.png"],"uid":"own"}],"query_ids":["q1","q2"],"pos":{"caption":"p","img":"","image_path":"j.png","instruct":"do"},"doc_ids":["d1"],"negatives":[["n1",{"text":"n2","id":9}],["n3"],null],"negative_ids":["x","y"],"relevant_doc_ids":"r","positive_ids":[],"example_id":4,"teacher_scores":[0.5,1],"cluster_id":"c"}')
    views = lambda rs: [tuple(r) for r in rs]
    assert views(x.query_views) == [("a", [], None, "q1"), ("b", ["i.png"], None, "own")]
    assert views(x.positive_views) == [("p", ["j.png"], "do", "d1")]
    assert [views(n) for n in x.negatives] == [[("n1", [], None, "x"), ("n2", [], None, "9")], [("n3", [], None, "y")], [(None, [], None, None)]]
    assert (x.positive_ids, x.task, x.group_id, x.query_id, x.example_id, x.teacher_scores) == (["r", "d1"], "default", "c", None, "4", [0.5, 1.0])
    x = example(spark, '{"q":"a","positive":["p","r"],"query_id":"k","doc_id":"d","negs":"n","positive_ids":["r","d"]}')
    assert [r.uid for r in x.query_views + x.positive_views] == ["k", "d", "d"] and x.positive_ids == ["r", "d"] and x.negatives[0][0].text == "n"


@pytest.mark.parametrize("line", ['{"positive":"p"}', '{"query":"q"}', '{"query":[],"positive":"p"}', '{"query":5,"positive":"p"}', '{"query":"q","positive":"p","negatives":[3]}'])
def test_example_errors(spark, line):
    with pytest.raises(Exception):
        example(spark, line)


def test_examples_and_bad_lines(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"query":"x","positives":["a",{"caption":"b","img":["1.png","2.png"],"id":"P"}],"doc_id":"D","negs":[{"text":"n"}],"positive_ids":"Z"}\n\n{"anchor":{"content":"y","id":0},"pos":"c","query_id":"Q"}\n')
    x = J.examples(J.parsed(J.lines(spark, str(p)))).collect()
    first = next(r for r in x if r.query_views[0].text == "x")
    assert [v.text for v in first.positive_views] == ["a", "b"] and [v.uid for v in first.positive_views] == ["D", "P"]
    assert first.positive_ids == ["Z", "D", "P"] and first.positive_views[1].images == ["1.png", "2.png"] and first.negatives[0][0].text == "n"
    second = next(r for r in x if r.query_id == "Q")
    assert second.query_views[0].uid == "Q" and second.task == "default"
    bad = spark.createDataFrame([("{oops",)], "line string")
    assert J.parsed(bad, strict=False).first().v is None
    with pytest.raises(Exception, match="invalid JSON"):
        J.parsed(bad).collect()
    assert J.lines(spark, str(p), str(p), limit=3).count() == 3


def test_choice_and_fill_of_negatives(spark):
    from millrace.operators import negatives as N

    cands = spark.createDataFrame([("a", f"a{i}", i) for i in range(6)] + [("b", "b0", 0), ("b", "b1", 1)], "row string, doc string, pos int")
    fillers = spark.createDataFrame([("b", "x", 0), ("c", "y", 0)], "row string, doc string, pos int")
    rows = spark.createDataFrame([("a",), ("b",), ("c",)], "row string")
    got = lambda **how: {(r.row, r.slot): (r.doc, r.own) for r in N.select(cands, 4, **how).collect()}
    top = got(strategy="topk", fill="drop")
    assert [top["a", i][0] for i in range(4)] == ["a0", "a1", "a2", "a3"] and ("b", 2) not in top
    repeat = got(strategy="topk", fill="repeat")
    assert [repeat["b", i] for i in range(4)] == [("b0", True), ("b1", True), ("b0", False), ("b1", False)]
    pool = got(fill="random_pool", fillers=fillers, rows=rows)
    assert [pool["b", i] for i in range(4)] == [("b0", True), ("b1", True), ("x", False), ("b0", False)]
    assert [pool["c", i][0] for i in range(4)] == ["y"] * 4
    drawn = [got(seed=s) for s in (1, 1, 2)]
    assert drawn[0] == drawn[1] != drawn[2] and len({drawn[0]["a", i][0] for i in range(4)}) == 4
    assert N.mined_share(8, 0.5, 0.0, 1.0) == 4 and N.mined_share(3, 1, 0.5, 0.5) == 2
    assert N.select(cands.limit(0), 2).count() == 0
    with pytest.raises(ValueError):
        N.select(cands, 2, "other")


def test_calibration_means_are_checked(spark, tmp_path):
    from millrace.sources import calibration as K

    schema = "bucket string, n long, mean array<double>"
    rows = [("query_mean", 2, [1.0, 2.0]), ("text_mean", 3, [0.5, 0.0]), ("image_mean", 1, [0.0, 1.0]), ("fused_mean", 4, [9.0, 9.0])]
    K.write_means(spark.createDataFrame(rows, schema), str(tmp_path / "m"), source="here")
    assert {(r.bucket, r.n, tuple(r["mean"])) for r in K.read_means(spark, str(tmp_path / "m"), 2).collect()} == {(b, n, tuple(m)) for b, n, m in rows}
    with pytest.raises(Exception, match="dimension"):
        K.read_means(spark, str(tmp_path / "m"), 3).collect()
    for bad in (rows[:2], [*rows[:2], ("image_mean", 1, [1.0])], [*rows, ("other", 1, [0.0, 1.0])]):
        with pytest.raises(ValueError):
            K.write_means(spark.createDataFrame(bad, schema), str(tmp_path / "bad"))


def test_index_key_follows_the_texts(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "row long, text string")
    same, other = a.repartition(3), spark.createDataFrame([(1, "x"), (2, "")], "row long, text string")
    assert L.fingerprint(a) == L.fingerprint(same) != L.fingerprint(other)
    assert L.fingerprint(a.limit(0)) != L.fingerprint(a)


def test_namespaces_and_text(spark):
    assert one(spark, T.namespaced(F.lit("a"), F.lit("x"))) == "a::x"
    assert one(spark, T.namespaced(F.lit(None), F.lit("x"))) == "x"
    assert one(spark, T.namespaced(F.lit("a"), F.lit(None).cast("string"))) is None
    assert tuple(one(spark, T.split_namespace(F.lit("a::b::c")))) == ("a", "b::c")
    assert tuple(one(spark, T.split_namespace(F.lit("x")))) == (None, "x")
    assert one(spark, T.tokens(F.lit("AB_1 漢字か9"))) == ["ab_1", "9", "漢字"]
    assert one(spark, T.tokens(F.lit("漢"))) == ["漢"] and one(spark, T.tokens(F.lit("été"))) == ["t"]
    assert one(spark, T.tokens(F.lit("中文字"))) == ["中文", "文字"]
    ph = lambda n, keep=False: tuple(one(spark, T.placeholders(F.lit("a <image> b"), F.lit(n), keep)))
    assert ph(1) == ("a b", None) and ph(1, True) == ("a <image> b", None) and ph(0)[1] and ph(2)[1]


def test_identity(spark):
    r = spark.createDataFrame([("d1", "h1"), (None, "h1"), ("d5", "h1"), ("d1", "h2"), (None, "h3")], "declared string, content string")
    c = {x.node: x.canonical for x in I.canonical(r).collect()}
    assert c["h1"] == c["h2"] == "d1" and c["h3"] == "h3"
    s = I.component_stats(I.canonical(r)).first()
    assert (s.nodes, s.documents) == (5, 2)
    rel = I.relations(spark.createDataFrame([("qA", "d1"), ("qA", "h3"), ("qB", "d1"), ("qB", None)], "query string, doc string"))
    assert rel.where("query = 'qA'").count() == 2 and rel.where("query = 'qB'").count() == 1


def test_components_of_paths_hubs_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1001 + i) for i in range(50)] + [(7777, 7777), (None, 5), (200, 201), (201, 200)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[i] for i in range(1000, 1051)} == {1000}
    assert got[7777] == 7777 and got[201] == 200 and len(got) == 61 + 51 + 1 + 2
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_lexical(spark):
    texts = ["yellow metal ring pendant 3 cm", "yellow metal ring pendant 5 cm", "green metal ring pendant 3 cm", "blue wool scarf"]
    posts = L.postings(spark.createDataFrame(list(enumerate(texts)), "row int, text string"))
    freq = L.frequencies(posts)
    idf = {r.token: round(r.idf, 6) for r in freq.collect()}
    assert (idf["blue"], idf["yellow"], idf["ring"]) == (1.609438, 1.098612, 0.847298)
    assert {r.row: round(r.w, 4) for r in L.weights(posts, freq).collect()} == {0: 5.2856, 1: 6.6689, 2: 6.6689, 3: 7.7709}
    f1 = {(r.i, r.j): round(r.score, 6) for r in L.similar(posts, freq).collect()}
    assert f1 == {(0, 1): 0.682358, (0, 2): 0.682358, (1, 2): 0.430604}
    assert round({(r.i, r.j): r.score for r in L.similar(posts, freq, measure="cosine").collect()}[0, 1], 6) == 0.686973
    top = L.top(L.directed(L.similar(posts, freq)).withColumn("score", F.round("score", 9)), 1)
    assert {r.i: r.j for r in top.collect()}[0] == 1
    # rare tokens join nothing but stay in the weights
    assert {(r.i, r.j): round(r.score, 6) for r in L.similar(posts, freq, min_df=1).collect()} == f1


@pytest.mark.parametrize(("n", "p", "want"), [(50, 0, 40), (50, 0.5, 20), (50, 1, 0), (15, 0.5, 2), (11, 0.5, 0), (6, 0.3, 0)])
def test_band_rounds_half_to_even(spark, n, p, want):
    assert one(spark, L.band_start(F.lit(n), 10, p)) == want


def test_sampling_avoids_related(spark):
    rows = spark.createDataFrame([(i, i) for i in range(30)], "row int, doc int")
    got = L.sampled(rows, rows, rows, 4).collect()
    assert len(got) == 120 and all(r.row != r.doc for r in got) and len({(r.row, r.doc) for r in got}) == 120
    assert [tuple(r) for r in L.sampled(rows, rows, rows, 4).orderBy("row", "pos").collect()] == sorted(((r.row, r.doc, r.pos) for r in got), key=lambda r: (r[0], r[2]))


def test_views(spark):
    five = spark.createDataFrame([([0, 1, 2, 3, 4],)], "v array<int>")
    last = lambda pad: next((r.view, r.valid) for r in views.chunks(five, "v", 2, pad).collect() if r.group == 2)
    assert last("mask") == ([4, 4], [True, False]) and last("cycle") == ([4, 0], [True, True])
    t = F.array(arr(1, 2), arr(3, 0), arr(9, 9))
    m = F.array(F.lit(True), F.lit(True), F.lit(False))
    pooled = {h: one(spark, views.pool(t, m, h)) for h in ("first", "last", "mean", "max")}
    assert pooled == {"first": [1, 2], "last": [3, 0], "mean": [2, 1], "max": [3, 2]}
    assert sorted(one(spark, views.shuffled(F.array(*(F.lit(i) for i in range(9))), F.lit(3)))) == list(range(9))


def test_contrastive(spark):
    logits = spark.createDataFrame([(0, 2.0, True), (0, 1.0, True), (0, 0.0, False), (0, -1.0, False)], "anchor int, logit double, target boolean").withColumn("mask", F.lit(False))
    r = C.info_nce(logits).first()
    assert [round(x, 6) for x in (r.loss_mean, r.loss_joint, r.loss_sibling)] == [0.940190, 0.126928, 0.288726] and r.hit == 1
    masked = logits.withColumn("mask", F.col("logit") == -1)
    assert round(C.info_nce(masked).first().loss_mean, 6) == 0.907606
    d = C.dispersion(spark.createDataFrame([(1, 0.8), (1, 0.5), (1, 0.6), (2, 0.3)], "block int, cos double")).collect()
    assert len(d) == 1
    assert [round(d[0][k], 6) for k in ("variance", "std", "pairwise", "center_max", "center_min", "range")] == [0.015556, 0.124722, 0.046667, 0.043333, 0.033333, 0.3]


def test_embedding_jobs(spark, tmp_path):
    class Fragile(E.HashedWords):
        def embed(self, items):
            if any("bad" in (x["text"] or "") for x in items):
                raise ValueError("cannot encode")
            return super().embed(items)

    rows = spark.createDataFrame([(0, "a b"), (1, "bad"), (2, None), (3, "c")], "row_idx long, text string")
    got = {r.row_idx: r for r in E.embed(rows, Fragile(4)).collect()}
    assert [got[i].success for i in range(4)] == [True, False, False, True] and got[1].error == "cannot encode" and got[2].error == "empty record"
    whole = {r.row_idx: r for r in E.merged(rows.select("row_idx"), E.embed(rows, Fragile(4)), 4).collect()}
    assert list(whole[1].embedding) == [0, 0, 0, 0]
    np.save(tmp_path / "embeddings.npy", np.arange(12, dtype=np.float16).reshape(3, 4))
    assert [r.embedding for r in A.read_npy(spark, str(tmp_path / "embeddings.npy")).orderBy("row_idx").collect()][2] == [8, 9, 10, 11]
    assert E.matryoshka_dims([8, 128, 16], 64) == ([8, 16, 64], [128])
    with pytest.raises(KeyError):
        E.register("hashed_words", E.HashedWords)


def test_driver_side(tmp_path):
    assert M.merged({"a": {"b": 1, "c": 2}, "d": 3}, {"a": {"b": 9}, "d": {"e": 1}}) == {"a": {"b": 9, "c": 2}, "d": {"e": 1}}
    assert M.with_settings({"a": {}}, ["a.b=2", "c=x"]) == {"a": {"b": 2}, "c": "x"}
    with pytest.raises(ValueError):
        M.load_manifest('[{"name":"A"},{"name":"B","tag":"a"}]')
    assert R.cut_offs("10, 1,5,5") == [1, 5, 10]
    taken: set = set()
    assert report.sheet_name("a/b", taken) == "a_b" and report.sheet_name("a:b", taken) == "a_b_2"
    assert report.dataset_order(["x", "b", "a"], None, ["b"]) == ["b", "a", "x"]
    for n in ("queries", "origin_corpus", "qrels"):
        (tmp_path / "One").mkdir(exist_ok=True)
        (tmp_path / "One" / f"{n}.jsonl").touch()
    entries, skipped = M.build_manifest(str(tmp_path), ["One", "Two"])
    assert entries[0]["tag"] == "one" and "Two" in skipped and "missing" in skipped["Two"]
    assert M.view_count(None, None) == 1 and M.view_count(-1, 3) == -1


def test_streaming_ingest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("one\ntwo\none\n\n")
    q = ingest.records(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("seen_lines").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.value for r in spark.sql("select value from seen_lines").collect()) == ["one", "two"]


def test_entry_and_catalogue(spark, sf):
    import __spark_entry__ as entry

    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and entry.entry(spark).count() > 0
    for name in ("J18_pivot", "A24_component_stats", "X01_embed", "S05_qrels", "W06_difficulty_band"):
        assert names[name](spark, sf).count() > 0


def _shuffled_rows(spark, df) -> int:
    """Rows written to shuffles while df is collected."""
    sc, g = spark.sparkContext, spark.sparkContext._gateway
    empty = g.jvm.java.util.ArrayList()

    def total() -> int:
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = sc._jsc.sc().statusStore().stageList(empty, False, False, g.new_array(g.jvm.double, 0), empty)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = total()
    df.collect()
    return total() - before


def test_sampling_shuffles_what_it_keeps(spark):
    """Each row's draws stay together: the result is that of ranking them all, without as many shuffled rows."""
    import hashlib

    n, rows = 3, spark.createDataFrame([(i, i) for i in range(200)], "row long, doc long")
    related = rows.unionByName(rows.select("row", ((F.col("doc") + 1) % 200).alias("doc")))
    sampled = L.sampled(rows, rows.select("doc"), related, n, seed=4)
    want = set()
    for i in range(200):
        drawn = dict.fromkeys(int(hashlib.md5(f"4|{i}|0|{s}".encode()).hexdigest()[:8], 16) % 200 for s in range(n * 16))
        want |= {(i, doc, at + 1) for at, doc in enumerate([x for x in drawn if x not in (i, (i + 1) % 200)][:n])}
    assert {tuple(r) for r in sampled.collect()} == want
    assert _shuffled_rows(spark, sampled) < 200 * 12


def test_rarest_token_shuffles_a_rows_first_ones(spark):
    posts = spark.createDataFrame([(i, f"t{j}") for i in range(20) for j in range(i % 2, 200)], "row long, token string")
    freq = posts.groupBy("token").agg(F.count("*").alias("df"))
    key = "spark.sql.autoBroadcastJoinThreshold"
    was = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        third = L.rarest_token(posts, freq, 3)
        assert {(r.row, r.token) for r in third.collect()} == {(i, "t100" if i % 2 else "t10") for i in range(20)}
        assert _shuffled_rows(spark, third) < 1.5 * posts.count()
    finally:
        spark.conf.set(key, was)
    short = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "row long, token string")
    assert {tuple(r) for r in L.rarest_token(short, short.groupBy("token").agg(F.count("*").alias("df")), 5).collect()} == {(1, "a"), (2, "a")}


def test_embedding_jobs_hold_few_records(spark):
    """However many records a worker is handed at once, it makes Python values of ROWS at most."""
    import pyarrow as pa

    class Handed:
        select = lambda self, *c: self
        mapInArrow = lambda self, run, schema: run

    n = 3 * E.ROWS + 5
    run = E.embed(Handed(), E.HashedWords(4))
    got = list(run(iter([pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(["a b" if i % 7 else None for i in range(n)])], ["row_idx", "text"])])))
    assert max(x.num_rows for x in got) == E.ROWS and [r for x in got for r in x.column(0).to_pylist()] == list(range(n))
    assert [x for b in got for x in b.column(3).to_pylist()] == [bool(i % 7) for i in range(n)]


def test_tiles_of_the_largest_cosine_are_opened_not_shuffled(spark):
    """Pairs of tiles shuffle no tile: what is dealt out are their names, a row for some of a tile's partners."""
    rng = np.random.default_rng(5)
    u = rng.normal(size=(240, 8))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    top, read, every = C.maxima(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(u)], "k long, u array<double>"), tile=20)
    assert read > 60 and _shuffled_rows(spark, top) < 40
    scores = u @ u.T
    np.fill_diagonal(scores, -np.inf)
    assert top.agg(F.max("top")).first()[0] == pytest.approx(scores.max(), abs=1e-12)


def test_rounds_of_blocks_share_an_index(spark, sf, monkeypatch):
    from millrace.plans import catalogue

    made, plain = [], catalogue.X.indexed
    monkeypatch.setattr(catalogue.X, "indexed", lambda *a, **k: made.append(1) or plain(*a, **k))
    catalogue.QUERIES["U07_merged_rounds"][0](spark, sf)
    assert len(made) == 1
