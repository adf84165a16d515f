"""Exact cosine retrieval, duplicate handling and rank metrics."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import vectors as V

#: Queries whose vectors one pass broadcasts at most.
QUERY_BLOCK = 20_000
#: Rows of either side of one matrix product.
TILE = 1024


def cut_offs(text: str | Sequence[int]) -> list[int]:
    """Sorted distinct positive cut-offs of "1,5,10" or a list."""
    ks = sorted({int(x) for x in (text.replace(" ", "").split(",") if isinstance(text, str) else text) if str(x) != ""})
    if not ks or ks[0] < 1:
        raise ValueError("cut-offs must be positive")
    return ks


def usable(vectors: DataFrame, id_col: str, vec: str, success: str | None = None) -> DataFrame:
    """Rows with an id whose embedding succeeded: by its flag, else by a length over zero."""
    ok = F.coalesce(F.col(success), F.lit(True)) if success else V.norm(F.col(vec)) > 0
    return vectors.where(F.col(id_col).isNotNull() & ok)


def scores(queries: DataFrame, corpus: DataFrame, qid: str = "q", did: str = "d", vec: str = "vec") -> DataFrame:
    """(q, d, score) of all pairs, as expressions; for small inputs and as the fast path's check."""
    left = queries.select(F.col(qid).alias("q"), V.normalise(F.col(vec)).alias("_a"))
    right = corpus.select(F.col(did).alias("d"), V.normalise(F.col(vec)).alias("_b"))
    return left.crossJoin(right).select("q", "d", V.dot(F.col("_a"), F.col("_b")).alias("score"))


def profile(queries: DataFrame, corpus: DataFrame, qid: str = "q", did: str = "d", vec: str = "vec") -> DataFrame:
    """(q, n, mean, best) of each query's cosines with the whole corpus, without its pairs.

    The mean cosine is the product with the mean unit vector, one row; the best is that of an exact search.
    """
    unit = corpus.select(F.posexplode(V.normalise(F.col(vec))).alias("p", "x")).groupBy("p").agg(F.avg("x").alias("m"), F.count("*").alias("n"))
    mean = unit.agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "m"))), lambda s: s["m"]).alias("_mean"), F.max("n").alias("n"))
    told = queries.select(F.col(qid).alias("q"), V.normalise(F.col(vec)).alias("_a")).crossJoin(F.broadcast(mean))
    best = search(queries, corpus, 1, qid, did, vec).select("q", F.col("score").alias("best"))
    return told.select("q", "n", V.dot(F.col("_a"), F.col("_mean")).alias("mean")).join(best, "q")


def best_k(scored: DataFrame, k: int, by: str = "q", item: str = "d", score: str = "score") -> DataFrame:
    """Rank 1 to k within each `by`: score descending, ties to the smaller item."""
    w = Window.partitionBy(by).orderBy(F.desc(score), item)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def best_per_document(scored: DataFrame) -> DataFrame:
    """One row for each query and document, at its best score."""
    return scored.groupBy("q", "d").agg(F.max("score").alias("score"))


def _keep(best, ids, scores, new, single: bool = False) -> None:
    """Merge the scores of new ids (ascending) into the best ones and their ids, in place; ties to the smaller id.

    single: the new ids differ; an id that is there already keeps the better score.
    """
    import numpy as np

    k = best.shape[1]
    better = np.flatnonzero((scores >= best[:, -1:]).any(axis=1))
    if not len(better):
        return
    top = np.argsort(-scores[better], axis=1, kind="stable")[:, :k]
    s = np.concatenate([best[better], np.take_along_axis(scores[better], top, 1)], axis=1)
    d = np.concatenate([ids[better], new[top]], axis=1)
    if single:
        by_score = np.argsort(-s, axis=1, kind="stable")
        s, d = np.take_along_axis(s, by_score, 1), np.take_along_axis(d, by_score, 1)
    by_id = np.argsort(d, axis=1, kind="stable")
    s, d = np.take_along_axis(s, by_id, 1), np.take_along_axis(d, by_id, 1)
    if single:
        s[:, 1:][d[:, 1:] == d[:, :-1]] = -np.inf
    order = np.argsort(-s, axis=1, kind="stable")[:, :k]
    best[better], ids[better] = np.take_along_axis(s, order, 1), np.take_along_axis(d, order, 1)


def search(queries: DataFrame, corpus: DataFrame, k: int, qid: str = "q", did: str = "d", vec: str = "vec", block: int = QUERY_BLOCK, single: bool = False) -> DataFrame:
    """(q, d, score, rank): exact top k by matrix products over Arrow batches of the corpus.

    single: of vectors that share an id only the best one counts.

    Every corpus partition keeps a running best k of each query, so k rows a query and
    partition are shuffled, and products are made in tiles of TILE x TILE scores. Queries
    go out in blocks of at most `block` vectors.
    """
    import numpy as np

    kind_q, kind_d = dict(queries.dtypes)[qid], dict(corpus.dtypes)[did]
    schema = f"q {kind_q}, d {kind_d}, score double"
    spark = queries.sparkSession
    out = None

    def blocks() -> Iterator[list]:
        part: list = []
        for r in queries.select(qid, V.doubles(F.col(vec))).toLocalIterator():
            part.append((r[0], r[1]))
            if len(part) == block:
                yield part
                part = []
        if part:
            yield part

    for part in blocks():
        q = np.array([v for _, v in part], dtype=np.float64)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        shared = spark.sparkContext.broadcast(([i for i, _ in part], q))

        def run(batches, shared=shared):
            import pandas as pd

            names, q = shared.value
            best = np.full((len(names), k), -np.inf)
            ids = None
            for pdf in batches:
                for at in range(0, len(pdf), TILE):
                    part = pdf.iloc[at : at + TILE]
                    d = np.array(part["v"].tolist(), dtype=np.float64)
                    d /= np.where((n := np.linalg.norm(d, axis=1, keepdims=True)) == 0, 1, n)
                    new = part["d"].to_numpy()
                    by_id = np.argsort(new, kind="stable")
                    new, d = new[by_id], d[by_id]
                    firsts = np.flatnonzero(np.r_[True, new[1:] != new[:-1]])
                    if ids is None:
                        ids = np.full((len(names), k), new[0], dtype=new.dtype)
                    for i in range(0, len(names), TILE):
                        scores = q[i : i + TILE] @ d.T
                        if single:
                            _keep(best[i : i + TILE], ids[i : i + TILE], np.maximum.reduceat(scores, firsts, axis=1), new[firsts], True)
                        else:
                            _keep(best[i : i + TILE], ids[i : i + TILE], scores, new)
            if ids is not None:
                rows, cols = np.nonzero(best > -np.inf)
                for i in range(0, len(rows), 1 << 16):
                    r, c = rows[i : i + (1 << 16)], cols[i : i + (1 << 16)]
                    yield pd.DataFrame({"q": [names[x] for x in r], "d": ids[r, c], "score": best[r, c]})

        near = corpus.select(F.col(did).alias("d"), F.col(vec).alias("v")).mapInPandas(run, schema)
        out = near if out is None else out.unionByName(near)
    if out is None:
        out = spark.createDataFrame([], schema)
    return best_k(best_per_document(out) if single else out, k)


def over_fetch(corpus: DataFrame, k: int, did: str = "d") -> DataFrame:
    """(n): how many vectors hold k documents for certain: k times the most of one document, all at most."""
    return duplicate_profile(corpus, did).select(F.least("n_rows", F.col("max_dup") * k).alias("n"))


def search_documents(queries: DataFrame, corpus: DataFrame, k: int, qid: str = "q", did: str = "d", vec: str = "vec") -> DataFrame:
    """(q, d, score, rank): the top k documents where several vectors may share an id.

    Each partition keeps the best k documents of a query, however many vectors one has.
    """
    return search(queries, corpus, k, qid, did, vec, single=True)


def relevance(pairs: DataFrame, q: str = "q", d: str = "d", rel: str = "rel") -> DataFrame:
    """One row for each query and document: the largest relevance given."""
    return pairs.groupBy(F.col(q).alias("q"), F.col(d).alias("d")).agg(F.max(F.col(rel).cast("double")).alias("rel"))


def query_status(queries: DataFrame, qrels: DataFrame, id_col: str = "q", ok: str = "ok") -> DataFrame:
    """queries with status: null id, then no relevance, then failed, else evaluated."""
    has = qrels.select(F.col("q").alias("_q")).distinct()
    met = queries.join(has, F.col(id_col) == F.col("_q"), "left")
    return met.withColumn("status", F.when(F.col(id_col).isNull(), "null_id").when(F.col("_q").isNull(), "no_qrels").when(~F.coalesce(F.col(ok), F.lit(False)), "failed").otherwise("evaluated")).drop("_q")


def gold_in_corpus(qrels: DataFrame, corpus: DataFrame, drop_missing: bool = False, did: str = "d") -> DataFrame:
    """qrels with in_corpus, or only those of documents that the corpus has."""
    have = corpus.select(F.col(did).alias("d")).distinct()
    if drop_missing:
        return qrels.join(have, "d", "left_semi")
    return qrels.join(have.withColumn("_h", F.lit(True)), "d", "left").withColumn("in_corpus", F.coalesce("_h", F.lit(False))).drop("_h")


def counted_gold(qrels: DataFrame, corpus: DataFrame, drop_missing: bool = False, did: str = "d") -> tuple[DataFrame, Observation]:
    """gold_in_corpus(), and counters of the pass that computes it: gold_total, gold_missing."""
    seen = Observation()
    told = gold_in_corpus(qrels, corpus, did=did).observe(seen, F.count(F.lit(1)).alias("gold_total"), F.count_if(~F.col("in_corpus")).alias("gold_missing"))
    return (told.where("in_corpus").drop("in_corpus") if drop_missing else told), seen


def counted_queries(queries: DataFrame, qrels: DataFrame, gold: DataFrame, drop_missing: bool = False, id_col: str = "q", ok: str = "ok") -> tuple[DataFrame, Observation]:
    """The queries to evaluate, and counters of the pass: total, null_id, no_qrels, failed, dropped, evaluated.

    gold: what counted_gold() left. With drop_missing a query whose gold documents the corpus all lacks is dropped.
    """
    seen = Observation()
    told = query_status(queries, qrels, id_col, ok)
    have = gold.select(F.col("q").alias("_g")).distinct()
    status = F.when((F.col("status") == "evaluated") & F.col("_g").isNull() & F.lit(drop_missing), "dropped").otherwise(F.col("status"))
    told = told.join(have, F.col(id_col) == F.col("_g"), "left").withColumn("status", status).drop("_g")
    names = ("null_id", "no_qrels", "failed", "dropped", "evaluated")
    told = told.observe(seen, F.count(F.lit(1)).alias("total"), *(F.count_if(F.col("status") == n).alias(n) for n in names))
    return told.where("status = 'evaluated'").drop("status"), seen


class Gold:
    """Relevance as rows (q, d, rel); see KeyedGold for one that follows from keys."""

    def __init__(self, pairs: DataFrame) -> None:
        self.pairs = pairs.where("rel > 0").select("q", "d", "rel")

    def hits(self, found: DataFrame) -> DataFrame:
        """Rows of found (q, d, ...) that are relevant, with rel."""
        return found.join(self.pairs, ["q", "d"])

    def grades(self) -> DataFrame:
        """(q, rel, n): how many documents a query has of each relevance."""
        return self.pairs.groupBy("q", "rel").agg(F.count("*").alias("n"))

    def named(self, name: Callable[[str], Column]) -> Gold:
        """The same with other ids: name(column) gives them."""
        return Gold(relevance(self.pairs.select(name("q").alias("q"), name("d").alias("d"), "rel")))


class KeyedGold(Gold):
    """Documents of a query's key are relevant to it, by both grades: its pairs, the product of a key's sides, are never made.

    queries (q, key, grade) and docs (d, key, grade) have an id once; rel(query's grade, document's grade) -> column.
    """

    def __init__(self, queries: DataFrame, docs: DataFrame, rel: Callable[[Column, Column], Column]) -> None:
        self.queries, self.docs, self.rel = queries.select("q", "key", "grade"), docs.select("d", "key", "grade"), rel

    def _rel(self) -> Column:
        return self.rel(F.col("_qg"), F.col("_dg")).cast("double").alias("rel")

    def hits(self, found: DataFrame) -> DataFrame:
        q = self.queries.select("q", F.col("key").alias("_qk"), F.col("grade").alias("_qg"))
        d = self.docs.select("d", F.col("key").alias("_dk"), F.col("grade").alias("_dg"))
        met = found.join(q, "q").join(d, "d").where("_qk = _dk")
        return met.select(*(F.col(c) for c in found.columns), self._rel()).where("rel > 0")

    def grades(self) -> DataFrame:
        d = self.docs.groupBy("key", F.col("grade").alias("_dg")).agg(F.count("*").alias("c"))
        q = self.queries.select("q", "key", F.col("grade").alias("_qg"))
        return q.join(d, "key").select("q", self._rel(), "c").where("rel > 0").groupBy("q", "rel").agg(F.sum("c").alias("n"))

    def named(self, name: Callable[[str], Column]) -> KeyedGold:
        return KeyedGold(self.queries.select(name("q").alias("q"), "key", "grade"), self.docs.select(name("d").alias("d"), "key", "grade"), self.rel)


class GoldUnion(Gold):
    """Several golds whose ids differ."""

    def __init__(self, golds: Sequence[Gold]) -> None:
        self.golds = list(golds)

    def _all(self, of: Callable[[Gold], DataFrame]) -> DataFrame:
        out = of(self.golds[0])
        for g in self.golds[1:]:
            out = out.unionByName(of(g))
        return out

    def hits(self, found: DataFrame) -> DataFrame:
        return self._all(lambda g: g.hits(found))

    def grades(self) -> DataFrame:
        return self._all(lambda g: g.grades())

    def named(self, name: Callable[[str], Column]) -> GoldUnion:
        return GoldUnion([g.named(name) for g in self.golds])


def as_gold(qrels: DataFrame | Gold) -> Gold:
    return qrels if isinstance(qrels, Gold) else Gold(qrels)


def ideal_gains(grades: DataFrame, ks: Sequence[int]) -> DataFrame:
    """(q, k, idcg) of grades (q, rel, n): a query's best documents first. A row for each grade, however many documents have it."""
    cuts = grades.sparkSession.createDataFrame([(k,) for k in ks], "k int")
    w = Window.partitionBy("q").orderBy(F.desc("rel")).rowsBetween(Window.unboundedPreceding, 0)
    placed = grades.withColumn("to", F.sum("n").over(w)).withColumn("after", F.col("to") - F.col("n")).join(F.broadcast(cuts), F.col("after") < F.col("k"))
    places = F.sequence(F.col("after") + 1, F.least("to", F.col("k").cast("long")))
    gain = F.aggregate(places, F.lit(0.0), lambda x, r: x + F.col("rel") / F.log2(r + 1))
    return placed.select("q", "k", gain.alias("gain")).groupBy("q", "k").agg(F.sum("gain").alias("idcg"))


METRICS = ["recall", "precision", "ndcg", "mrr", "map", "success"]


def per_query(ranked: DataFrame, qrels: DataFrame | Gold, queries: DataFrame, ks: Sequence[int]) -> DataFrame:
    """(q, k, recall, precision, ndcg, mrr, map, success) of every evaluated query, hit or not.

    ranked: (q, d, rank); qrels: (q, d, rel) or a Gold; queries: (q), those to evaluate.
    """
    spark = ranked.sparkSession
    cuts = spark.createDataFrame([(k,) for k in ks], "k int")
    gold = as_gold(qrels)
    grades = gold.grades()
    hits = gold.hits(ranked.select("q", "d", "rank")).withColumn("nth", F.count("*").over(Window.partitionBy("q").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)))
    gain = F.col("rel") / F.log2(F.col("rank") + 1)
    found = hits.join(F.broadcast(cuts), F.col("rank") <= F.col("k")).groupBy("q", "k").agg(F.count("*").alias("hits"), F.sum(gain).alias("dcg"), F.max(1 / F.col("rank")).alias("rr"), F.sum(F.col("nth") / F.col("rank")).alias("ap"))
    size = grades.groupBy("q").agg(F.sum("n").alias("p"))
    best = ideal_gains(grades, ks)
    zero = F.lit(0.0)
    out = queries.select("q").distinct().crossJoin(F.broadcast(cuts)).join(found, ["q", "k"], "left").join(best, ["q", "k"], "left").join(size, "q", "left")
    n = F.coalesce("hits", F.lit(0))
    return out.select(
        "q", "k",
        F.coalesce(n / F.col("p"), zero).alias("recall"),
        (n / F.col("k")).alias("precision"),
        F.coalesce(F.col("dcg") / F.col("idcg"), zero).alias("ndcg"),
        F.coalesce("rr", zero).alias("mrr"),
        F.coalesce(F.col("ap") / F.least("p", "k"), zero).alias("map"),
        F.when(n > 0, 1.0).otherwise(0.0).alias("success"),
    )


def means(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(*(F.avg(m).alias(m) for m in METRICS), F.countDistinct("q").alias("queries"))


def macro(per_dataset: DataFrame, by: str = "k") -> DataFrame:
    return per_dataset.groupBy(by).agg(*(F.avg(m).alias(m) for m in METRICS))


def micro(per_dataset: DataFrame, by: str = "k") -> DataFrame:
    return per_dataset.groupBy(by).agg(*((F.sum(F.col(m) * F.col("queries")) / F.sum("queries")).alias(m) for m in METRICS))


def foreign_rate(ranked: DataFrame, ks: Sequence[int], own: Column, other: Column) -> DataFrame:
    """(k, total, rate): share of retrieved rows of another dataset, pooled over all queries."""
    cuts = ranked.sparkSession.createDataFrame([(k,) for k in ks], "k int")
    met = ranked.withColumn("_f", (own != other).cast("double")).join(F.broadcast(cuts), F.col("rank") <= F.col("k"))
    return met.groupBy("k").agg(F.count("*").alias("total"), F.avg("_f").alias("rate"))


def duplicate_profile(corpus: DataFrame, did: str = "d") -> DataFrame:
    each = corpus.groupBy(did).agg(F.count("*").alias("c"))
    return each.agg(F.sum("c").alias("n_rows"), F.count("*").alias("unique_docs"), F.max("c").alias("max_dup"), (F.sum("c") - F.count("*")).alias("surplus"))


def strict_rank(scored: DataFrame, gold: DataFrame) -> DataFrame:
    """(q, rank): 1 + documents that are no gold and score strictly more than the best gold."""
    met = scored.join(gold.select("q", "d", F.lit(1).alias("g")), ["q", "d"], "left")
    best = met.where("g = 1").groupBy("q").agg(F.max("score").alias("best"))
    return met.join(best, "q").groupBy("q").agg((F.count_if(F.col("g").isNull() & (F.col("score") > F.col("best"))) + 1).alias("rank"))


def strict_ranks(queries: DataFrame, corpus: DataFrame, gold: DataFrame | KeyedGold, qid: str = "q", did: str = "d", vec: str = "vec", block: int = QUERY_BLOCK) -> DataFrame:
    """strict_rank() without the pairs: the best gold score of a query, then a count of what is over it in tiles.

    No gold document scores more than the best one, so all that do are others. Each corpus partition gives
    one row a query in each of the two passes; the best score of a KeyedGold is found in tiles as well.
    """
    import numpy as np

    spark = queries.sparkSession
    kind = dict(queries.dtypes)[qid]
    left = queries.select(F.col(qid).alias("q"), V.normalise(F.col(vec)).alias("_a"))
    right = corpus.select(F.col(did).alias("d"), V.normalise(F.col(vec)).alias("_b"))

    def in_tiles(asked: DataFrame, rows: DataFrame, start, step, schema: str) -> DataFrame:
        """For each partition of rows (v, x) and query (q, _a, x): start, then step(what is there, x of queries, scores, x of rows)."""
        out, part = spark.createDataFrame([], schema), []
        names = [c.split()[0] for c in schema.split(", ")]

        def told(part: list) -> DataFrame:
            shared = spark.sparkContext.broadcast(([r[0] for r in part], np.array([r[1] for r in part]), np.array([r[2] for r in part])))

            def run(batches):
                import pandas as pd

                ids, q, x = shared.value
                n = np.full(len(ids), start)
                for pdf in batches:
                    for at in range(0, len(pdf), TILE):
                        d, y = np.array(pdf["v"].iloc[at : at + TILE].tolist(), dtype=np.float64), pdf["x"].iloc[at : at + TILE].to_numpy()
                        for i in range(0, len(ids), TILE):
                            to = slice(i, i + TILE)
                            n[to] = step(n[to], x[to], q[to] @ d.T, y)
                yield pd.DataFrame(dict(zip(names, (ids, n))))

            return rows.mapInPandas(run, schema)

        for r in asked.toLocalIterator():
            part.append(r)
            if len(part) == block:
                out, part = out.unionByName(told(part)), []
        return out.unionByName(told(part)) if part else out

    if isinstance(gold, KeyedGold):

        def best_of(n, x, scores, y):
            return np.maximum(n, np.where(x[:, None] == y[None, :], scores, -np.inf).max(axis=1, initial=-np.inf))

        asked = left.join(gold.queries.select("q", "key"), "q").where("key is not null").select("q", "_a", "key")
        rows = right.join(gold.docs.select("d", "key"), "d").where("key is not null").select(F.col("_b").alias("v"), F.col("key").alias("x"))
        found = in_tiles(asked, rows, -np.inf, best_of, f"q {kind}, best double").where(F.col("best") > float("-inf"))
        best = found.groupBy("q").agg(F.max("best").alias("best"))
    else:
        best = gold.select("q", "d").distinct().join(left, "q").join(right, "d").groupBy("q").agg(F.max(V.dot(F.col("_a"), F.col("_b"))).alias("best"))
    # a sum in another order differs in the last places
    over = in_tiles(left.join(best, "q").select("q", "_a", "best"), right.select(F.col("_b").alias("v"), F.lit(0).alias("x")), 0, lambda n, x, scores, y: n + (scores > x[:, None] + 1e-12).sum(axis=1), f"q {kind}, n long")
    return over.groupBy("q").agg((F.sum("n") + 1).alias("rank"))


def run_file(ranked: DataFrame, n: int) -> DataFrame:
    """(q, docs): the top n of each query in rank order, as an array of structs."""
    return ranked.where(F.col("rank") <= n).groupBy("q").agg(F.array_sort(F.collect_list(F.struct("rank", "d", "score"))).alias("docs"))
