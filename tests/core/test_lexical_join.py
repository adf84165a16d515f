"""The tiled join against a join of all pairs by token."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import lexical as L
from millrace.operators import lexical_join as X
from millrace.storage import materialize


@pytest.fixture(scope="module")
def made(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(r.choices(words, [1 / (i + 1) for i in range(60)], k=r.randint(1, 25))) for _ in range(70)]
    texts += [texts[3], texts[3], "", None, "only here", "w0"]
    posts = materialize(L.postings(spark.createDataFrame(list(enumerate(texts)), "row long, text string")), "posts")
    return posts, L.frequencies(posts, min_cut=40)


def brute(made, measure="f1"):
    return {(r.i, r.j): round(r.score, 9) for r in L.similar(*made, measure=measure).collect()}


@pytest.mark.parametrize("measure", ["f1", "cosine"])
def test_pairs_from_a_least_score_on(made, measure):
    index, all_pairs = X.indexed(*made, measure=measure), brute(made, measure)
    for least, size in ((0.05, 7), (0.3, 7), (0.3, 1000), (0.8, 5), (1.0, 7)):
        want = {k: v for k, v in all_pairs.items() if v >= least}
        got = X.pairs(index, least, size=size).collect()
        assert {(r.i, r.j): round(r.score, 9) for r in got} == want and len(got) == len(want)


def test_neighbours_without_related_ones_and_copies(spark, made):
    related = {(i, j) for i in range(76) for j in (i + 1, i + 5) if j < 76} | {(3, 3), (4, 900)}
    index = X.indexed(*made, related=spark.createDataFrame(sorted(related), "i long, j long"))
    both = brute(made)
    both |= {(j, i): s for (i, j), s in both.items()}
    for most in (None, 0.9):
        want = {}
        for (i, j), s in both.items():
            if s >= 0.1 and (i, j) not in related and s <= (most or 1):
                want.setdefault(i, []).append((-s, j))
        want = {(i, j, n + 1) for i, found in want.items() for n, (_, j) in enumerate(sorted(found)[:4])}
        assert {(r.i, r.j, r.rank) for r in X.neighbours(index, 4, 0.1, most, size=9).collect()} == want
    seen = {}
    for (i, j), s in both.items():
        if s >= 0.1:
            k = 1 if s > 0.9 else 2 if (i, j) in related else 0
            seen.setdefault(i, [0, 0, 0])[k] += 1
    assert {r.i: [r.candidates, r.copies, r.related] for r in X.counts(index, 0.1, 0.9, size=9).collect()} == seen


def test_within_blocks(made):
    posts, _ = made
    blocks = L.blocks(posts, 20, min_df=2)
    of = {r.row: r.block for r in blocks.collect()}
    want = {k: v for k, v in brute(made).items() if v >= 0.2 and k[0] in of and of[k[0]] == of.get(k[1])}
    got = X.pairs(X.indexed(*made), 0.2, blocks=blocks)
    assert {(r.i, r.j): round(r.score, 9) for r in got.collect()} == want


def test_rarest_tokens_decide_who_meets(made):
    """A tile whose weights cannot meet is not made: few tiles at a high score, all at a low one."""
    packed = X.packed(X.indexed(*made), size=10)
    n = packed.count()
    tiles = {phi: {tuple(r.tile) for r in X._tiles(packed, phi).collect()} for phi in (0.001, 0.6)}
    assert len(tiles[0.001]) == n * (n + 1) // 2 and tiles[0.6] < tiles[0.001]


def test_empty_and_wrong(spark, made):
    empty = spark.createDataFrame([], "row long, token string")
    index = X.indexed(empty, L.frequencies(empty))
    assert X.pairs(index, 0.3).count() == 0 and X.neighbours(index, 3, 0.3).count() == 0
    with pytest.raises(ValueError):
        X.indexed(*made, measure="jaccard")
    with pytest.raises(ValueError):
        X.pairs(X.indexed(*made), 0.0)
    assert X.pairs(X.indexed(*made), 0.3).select(F.max("score")).first()[0] <= 1 + 1e-9


def test_no_tile_is_shuffled(spark, made):
    """A block is opened by the tasks that meet it, and a row's best are kept in its task: many blocks shuffle as little as one."""
    index = X.indexed(*made)
    for got in (X.neighbours(index, 4, 0.1, size=5), X.pairs(index, 0.1, size=5), X.counts(index, 0.1, 0.9, size=5)):
        plan = got._jdf.queryExecution().toString()
        assert "FlatMapGroups" not in plan and "Window" not in plan and "binary" not in plan


def test_dense_and_gathered_postings_agree(made, monkeypatch):
    table = X.indexed(*made).rows.withColumn("block", F.lit(0).cast("long")).toArrow()
    block = X._Block(X._pack(table).to_pylist()[0])
    want = X._dots(block, block)
    for share, gathered in ((0.0, 1 << 21), (9.0, 1 << 21), (9.0, 7), (0.01, 50)):
        monkeypatch.setattr(X, "DENSE", share)
        monkeypatch.setattr(X, "GATHERED", gathered)
        assert abs(X._dots(block, block) - want).max() < 1e-9
    assert want.max() > 0


def test_postings_are_joined_once_and_shuffled_once_to_their_block(spark, made, monkeypatch):
    """F2 to F9: weight and tokens come from one join, no array of structs is shuffled, and only (row, w) is sorted into blocks."""
    written = {}

    def noted(df, name):
        written[name] = df
        return materialize(df, name)

    monkeypatch.setattr(X, "materialize", noted)
    index = X.indexed(*made)
    plan = written["lexical"]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [row#") == 1 and "array<struct" not in written["lexical"].schema.simpleString()
    sorted_columns = []
    batches = X.batches
    monkeypatch.setattr(X, "batches", lambda rows, *more, **named: sorted_columns.append(rows.columns) or batches(rows, *more, **named))
    packed = X.packed(index, size=10)
    assert sorted_columns == [["row", "w"]]
    of = packed.orderBy("block").select("least_w", "most_w", F.length("id").alias("bytes")).collect()
    assert all(a.most_w <= b.least_w for a, b in zip(of, of[1:])) and all(r.bytes == 80 for r in of[:-1])


def test_hits_are_all_scores_from_a_bound_on(made):
    """Only what reaches a bound, one for all rows or one for each, is scored; strips of rows do not matter."""
    block = X._Block(X._pack(X.indexed(*made).rows.withColumn("block", F.lit(0).cast("long")).toArrow()).to_pylist()[0])
    scores = X._dots(block, block) / ((block.w[:, None] + block.w[None, :]) / 2)
    for low in (0.05, 0.3, np.linspace(0.0, 1.1, len(block.id))):
        for strip in (7, 64):
            with pytest.MonkeyPatch.context() as m:
                m.setattr(X, "STRIP", strip)
                i, j, score = X._hits(block, block, low, "f1")
            want = np.argwhere(scores >= (low if np.isscalar(low) else low[:, None]))
            assert np.array_equal(np.c_[i, j], want) and abs(score - scores[i, j]).max(initial=0) < 1e-12


@pytest.mark.parametrize("common", [0, 1, 20, 1000])
def test_tokens_beyond_the_broadcast_ones_are_joined(spark, made, monkeypatch, common):
    """F3 to F8: a row's pieces from broadcast and from joined tokens are one row, with related ones and in given blocks too."""
    monkeypatch.setattr(X, "COMMON", common)
    posts, freq = made
    dropped = posts.select("token").distinct().join(freq, "token", "left_anti")
    assert dropped.count() > 0
    want = {k: v for k, v in brute(made).items() if v >= 0.2}
    related = spark.createDataFrame([(i, i + 1) for i in range(80)], "i long, j long")
    for kwargs in ({}, {"dropped": dropped}, {"dropped": dropped, "related": related}):
        index = X.indexed(posts, freq, **kwargs)
        got = X.pairs(index, 0.2, size=9).collect()
        assert {(r.i, r.j): round(r.score, 9) for r in got} == want and len(got) == len(want)
    near = {(r.i, r.j) for r in X.neighbours(index, 100, 0.2, size=9).collect()}
    assert near == {(i, j) for p in want for i, j in (p, p[::-1]) if j != i + 1}
    one = spark.createDataFrame([(i, 0) for i in range(80)], "row long, block long")
    assert {(r.i, r.j) for r in X.pairs(index, 0.2, blocks=one).collect()} == set(want)


def test_runs_over_several_batches_are_one_piece():
    posts = [(7, 3, 1.0), (7, -1, 0.5), (7, 1, 2.0), (8, -1, 0.25), (9, 0, 4.0), (9, 2, 1.0)]
    for cut in range(1, 7):
        parts = [posts[at : at + cut] for at in range(0, 6, cut)] + [[]]
        batches = [X.pa.RecordBatch.from_pylist([dict(zip(("row", "tid", "s"), p)) for p in part], X.pa.schema([("row", "int64"), ("tid", "int32"), ("s", "float64")])) for part in parts]
        got = [r for b in X._gathered(batches) for r in b.to_pylist()]
        assert got == [{"row": 7, "w": 3.5, "token": [3, 1], "related": []}, {"row": 8, "w": 0.25, "token": [], "related": []}, {"row": 9, "w": 5.0, "token": [0, 2], "related": []}]


def test_common_postings_are_not_shuffled_before_their_block(made, monkeypatch):
    """F3 to F8: the postings' join and grouping by row shuffled each of them; now tokens are broadcast, and shuffled as numbers alone."""
    written = {}
    monkeypatch.setattr(X, "materialize", lambda df, name: written.setdefault(name, df) and materialize(df, name))
    index = X.indexed(*made)
    plan = written["lexical"]._jdf.queryExecution().executedPlan().toString()
    assert not any(f"hashpartitioning({c}#" in plan for c in ("token", "row")) and "BroadcastHashJoin" in plan
    assert index.pieces.dtypes == [("row", "bigint"), ("w", "double"), ("token", "array<int>"), ("related", "array<bigint>")]


def blocks_of(made, cuts=((0, 40), (40, 80))):
    pieces = X.indexed(*made).rows.toArrow().to_pylist()
    schema = X.pa.schema([("block", "int64"), ("row", "int64"), ("w", "float64"), ("token", X.pa.list_(X.pa.int32())), ("s", X.pa.list_(X.pa.float64())), ("related", X.pa.list_(X.pa.int64()))])
    for lo, hi in cuts:
        rows = [p | {"block": 0, "related": [p["row"] + 1, p["row"] + 40]} for p in pieces if lo <= p["row"] < hi]
        yield X._Block(X._pack(X.pa.Table.from_pylist(rows, schema)).to_pylist()[0])


def test_counts_of_a_tile_are_exact_for_both_blocks(made):
    """F2: the product has 4-byte numbers, yet scores at the very ends of the band are on the right side."""
    a, b = blocks_of(made)
    for x, y in ((a, b), (a, a)):
        scores = X._dots(x, y) / ((x.w[:, None] + y.w[None, :]) / 2)
        ends = np.unique(scores[scores > 0.05])
        for least, most in ((0.05, 0.9), (0.1, 1.001), *((ends[n] * (1 - 1e-12), ends[-n // 2] * (1 + 1e-12)) for n in range(2, len(ends) // 2, 40))):
            other = x.id[:, None] != y.id[None, :]
            low, high = (scores >= least) & (scores <= most) & other, (scores > most) & other
            got = X._tally(x, y, least, most, "f1")
            for side, (p, q) in enumerate(((x, y), (y, x)) if x is not y else ((x, y),)):
                inside, above = (low, high) if side == 0 else (low.T, high.T)
                kin = np.isin(q.id[None, :] - p.id[:, None], [1, 40])
                assert np.array_equal(got[side], [(inside & ~kin).sum(axis=1), above.sum(axis=1), (inside & kin).sum(axis=1)])


def test_hits_are_those_of_either_bound(made):
    """one tile serves the rows of both its blocks."""
    a, b = blocks_of(made)
    scores = X._dots(a, b) / ((a.w[:, None] + b.w[None, :]) / 2)
    for low, low_b in ((np.linspace(0.1, 1, len(a.id)), np.linspace(0.8, 0.2, len(b.id))), (np.full(len(a.id), 0.9), np.full(len(b.id), 0.15))):
        i, j, score = X._hits(a, b, low, "f1", low_b)
        assert np.array_equal(np.c_[i, j], np.argwhere(scores >= np.minimum(low[:, None], low_b))) and abs(score - scores[i, j]).max(initial=0) < 1e-12


def test_no_product_where_the_common_tokens_cannot_matter(made, monkeypatch):
    """cells that the rarer tokens and the most that common ones can add leave are few, and looked up one by one."""
    a, b = blocks_of(made)
    monkeypatch.setattr(X, "DENSE", 0.3)
    want = X._hits(a, b, 0.9, "f1")
    monkeypatch.setattr(X._Tile, "product", lambda *_: pytest.fail("a product was made"))
    assert all(np.array_equal(x, y) for x, y in zip(X._hits(a, b, 0.9, "f1"), want))


def test_each_tile_is_made_once(made, monkeypatch):
    """neighbours and counts made each tile of two blocks twice."""
    packed = X.packed(X.indexed(*made), size=5)
    n = packed.count()
    for group in (1, 3):
        monkeypatch.setattr(X, "GROUP", group)
        tasks = X._grouped(packed, 0.0).collect()
        tiles = [tuple(t) for r in tasks for t in r.tiles]
        assert len(tiles) == len(set(tiles)) == n * (n + 1) // 2 and all(a <= b for a, b in tiles)
        assert all(r.x >> r.level == r.y >> r.level for r in tasks) and {r.level for r in tasks if r.x == r.y} == {1}


def test_rows_of_one_kind_lie_together_and_meet_all_others(spark, monkeypatch):
    """F1 to F5: rows of two vocabularies were mixed in all blocks, so that every tile was dear; weights bound who meets in any order."""
    r = random.Random(8)
    texts = [" ".join(r.choices([f"{'ab'[i % 2]}{n}" for n in range(40)] + ["both"], k=r.randint(10, 40))) for i in range(90)]
    posts = materialize(L.postings(spark.createDataFrame(list(enumerate(texts)), "row long, text string")), "posts")
    freq = L.frequencies(posts, min_cut=80)
    monkeypatch.setattr(X, "KINDS", 2)
    index = X.indexed(posts, freq)
    blocks = [np.frombuffer(b.id, "<i8") % 2 for b in X.packed(index, size=10).collect()]
    assert sum(0 < x.mean() < 1 for x in blocks) <= 1 and len(blocks) == 9
    for least in (0.1, 0.5):
        want = {(r.i, r.j): round(r.score, 9) for r in L.similar(posts, freq).collect() if r.score >= least}
        assert {(r.i, r.j): round(r.score, 9) for r in X.pairs(index, least, size=10).collect()} == want
    near = {(r.i, r.j) for r in X.neighbours(index, 100, 0.5, size=10).collect()}
    assert near == {p for i, j in want for p in ((i, j), (j, i))}
