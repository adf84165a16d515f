"""Array files read by ranges, written with a ledger, and lines numbered in split files."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.sources import arrays as A
from millrace.sources import jsonl as J


@pytest.fixture
def split_files(spark):
    key = "spark.sql.files.maxPartitionBytes"
    was = spark.conf.get(key)
    spark.conf.set(key, "2000")
    yield
    spark.conf.set(key, was)


def folder(tmp_path, n=500, d=6, ids=None):
    x = (np.arange(n * d).reshape(n, d) % 97 + 1).astype("<f2")
    x[3] = 0
    np.save(tmp_path / "embeddings.npy", x)
    (tmp_path / "ids.txt").write_text("\n".join(ids or ["" if i == 5 else f"d{i}" for i in range(n)]) + "\n")
    return x


def test_a_file_is_many_partitions(spark, tmp_path):
    x = folder(tmp_path)
    df = A.read_npy(spark, str(tmp_path / "embeddings.npy"), rangeBytes=1000)
    assert df.rdd.getNumPartitions() == -(-500 // (1000 // 12))
    got = {r.row_idx: r.embedding for r in df.collect()}
    assert len(got) == 500 and all(got[i] == x[i].tolist() for i in range(500))


def test_ids_are_those_of_the_rows(spark, tmp_path, split_files):
    folder(tmp_path)
    got = {r.row_idx: r for r in A.embedding_set(spark, str(tmp_path), "set", rangeBytes=1000).collect()}
    assert all(r.id == (None if i == 5 else f"set::d{i}") for i, r in got.items())
    assert [i for i, r in sorted(got.items()) if not r.success] == [3, 5]
    (tmp_path / "token_counts.jsonl").write_text('{"idx": 7, "success": false}\n\nno json\n{"success": false}\n{"idx": 8, "success": true}\n')
    told = A.embedding_set(spark, str(tmp_path))
    assert {r.row_idx for r in told.where(~F.col("success")).collect()} == {3, 5, 7}
    assert A.describe(told) == {"rows": 500, "usable": 497, "failed": 3}


def test_wrong_folders_are_errors(spark, tmp_path):
    folder(tmp_path, ids=["a", "b"])
    with pytest.raises(ValueError, match="2 lines.*500 rows"):
        A.embedding_set(spark, str(tmp_path))
    np.save(tmp_path / "flat.npy", np.zeros(4, "<f4"))
    with pytest.raises(ValueError, match="two-dimensional"):
        A.header(str(tmp_path / "flat.npy"))
    whole = (tmp_path / "embeddings.npy").read_bytes()
    (tmp_path / "cut.npy").write_bytes(whole[:-5])
    with pytest.raises(ValueError, match="bytes of data"):
        A.header(str(tmp_path / "cut.npy"))
    (tmp_path / "ids.txt").unlink()
    with pytest.raises(FileNotFoundError):
        A.embedding_set(spark, str(tmp_path))


def test_empty_array(spark, tmp_path):
    np.save(tmp_path / "none.npy", np.zeros((0, 4), "<f4"))
    assert A.read_npy(spark, str(tmp_path / "none.npy")).count() == 0


def test_written_parts_have_a_ledger(spark, tmp_path):
    rows = spark.range(300).select(F.col("id").alias("row_idx"), F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (F.col("id") + i).cast("float")).alias("embedding"))
    path = str(tmp_path / "array")
    A.write_npy(rows, path, 300, 3, rangeBytes=400)
    told = json.loads((tmp_path / "array" / A.LEDGER).read_text())["parts"]
    assert len(told) > 3 and A.gaps(told, 300) == []
    assert {r.row_idx: r.embedding[0] for r in A.read_npy(spark, path).collect()} == {i: float(i) for i in range(300)}
    for bad, what in ((rows.where("row_idx not between 20 and 29"), "rows 20 to 29 are missing"), (rows.unionByName(rows.where("row_idx = 7")), "twice"), (rows.where("row_idx < 299"), "rows 299 to 299 are missing"), (rows.withColumn("embedding", F.when(F.col("row_idx") == 4, F.slice("embedding", 1, 2)).otherwise(F.col("embedding"))), "dimensions")):
        with pytest.raises(Exception, match=what):
            A.write_npy(bad, path, 300, 3)
        # what was published stays, and no part of the failed write does
        assert A.read_npy(spark, path).count() == 300
        assert {p.name for p in (tmp_path / "array").glob("*.npy")} == {p["file"] for p in told}


def test_line_numbers_in_split_files(spark, tmp_path, split_files):
    lines = ["" if i % 7 == 0 else json.dumps({"n": i, "pad": "x" * (i % 50)}) for i in range(1, 901)]
    (tmp_path / "a.jsonl").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.jsonl").write_text('{"n": 1}\n')
    rows = J.numbered_lines(spark, str(tmp_path / "a.jsonl"), str(tmp_path / "b.jsonl"))
    assert rows.where("file = 0").select("number").distinct().count() == sum(x != "" for x in lines)
    got = J.parsed(rows).select("file", "number", J.field(F.col("v"), "n", "long").alias("n")).collect()
    assert all(r.number == r.n for r in got) and sum(r.file for r in got) == 1
    lines[500] = '{"n": '
    (tmp_path / "a.jsonl").write_text("\n".join(lines) + "\n")
    with pytest.raises(Exception, match=r"a\.jsonl:501: "):
        J.parsed(J.numbered_lines(spark, str(tmp_path / "a.jsonl"))).collect()


def test_threads_register_the_source_at_once(spark):
    """Jobs run side by side: none may fail because another one registers the source."""
    import threading
    import time
    from types import SimpleNamespace

    from millrace.sources import arrays

    seen, wrong = set(), []

    def register(source):
        if "npy" in seen:
            wrong.append("already exists")
        time.sleep(0.05)
        seen.add("npy")

    session = SimpleNamespace(dataSource=SimpleNamespace(register=register), read=spark.read)
    calls = []

    def read():
        calls.append(1)
        try:
            arrays.read_npy(session, "/no/such/array")
        except Exception:  # the array is not there
            pass

    threads = [threading.Thread(target=read) for _ in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(calls) == 4 and seen == {"npy"} and not wrong
