"""Evaluation jobs: failures are isolated, finished embeddings are used again, dimensions are looped over."""

import pytest
from pyspark.sql import functions as F

from millrace.plans import jobs as J
from millrace.sources import embeddings as E



def job(spark, name, broken=False):
    words = ["sea", "sky", "sun", "rain", "wind", "snow"]
    queries = spark.createDataFrame([(i, f"q{i}", w) for i, w in enumerate(words)], "row_idx long, id string, text string")
    corpus = spark.createDataFrame([(i, f"d{i}", f"{w} {w} and") for i, w in enumerate(words)] + [(6, "d6", "")], "row_idx long, id string, text string")
    qrels = spark.createDataFrame([(f"q{i}", f"d{i}", 1.0) for i in range(6)], "q string, d string, rel double")

    def fails():
        raise FileNotFoundError(f"no corpus of {name}")

    return J.Job(name, lambda: queries, fails if broken else (lambda: corpus), lambda: qrels)


def test_one_broken_dataset_of_three(spark, tmp_path):
    three = [job(spark, "a"), job(spark, "b", broken=True), job(spark, "c")]
    results, summary = J.run_jobs(spark, three, E.HashedWords(64), str(tmp_path), [1, 3], dims=(None, 16, 999))
    told = {(r.dataset, r.dim): (r.status, r.error) for r in summary.collect()}
    assert all(told[x, d] == ("done", None) for x in "ac" for d in (None, 16))
    assert {told["b", d] for d in (None, 16, 999)} == {("failed", "no corpus of b")}
    assert told["a", 999] == ("failed", "vectors of 64 dimensions cannot be cut to 999")
    got = {(r.dataset, r.dim, r.k): r for r in results.collect()}
    assert len(got) == 8 and got["a", None, 1].recall == got["c", None, 1].recall == 1.0 and got["a", None, 1].queries == 6
    assert 0 <= got["a", 16, 1].recall <= 1


def test_finished_sets_are_not_made_again(spark, tmp_path):
    records = spark.createDataFrame([(0, "x", "a b"), (1, "y", None)], "row_idx long, id string, text string")
    first = {r.id: (list(r.embedding), r.success) for r in J.embedded_set(records, E.HashedWords(8), f"{tmp_path}/s", 2).collect()}

    class Refuses(E.HashedWords):
        def load(self):
            raise RuntimeError("not again")

    again = {r.id: (list(r.embedding), r.success) for r in J.embedded_set(records, Refuses(8), f"{tmp_path}/s", 2).collect()}
    assert again == first and first["y"] == ([0.0] * 8, False)
    more = records.unionByName(records.select((F.col("row_idx") + 2).alias("row_idx"), "id", "text"))
    with pytest.raises(Exception, match="not again"):
        J.embedded_set(more, Refuses(8), f"{tmp_path}/s", 2).collect()
    with pytest.raises(ValueError, match="one name"):
        J.run_jobs(spark, [job(spark, "a"), job(spark, "a")], E.HashedWords(8), str(tmp_path), [1])
