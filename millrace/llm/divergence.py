"""Divergence of the sources of a language, in exact integers.

Each language keeps the terms of enough of its documents. A source's share of a term is
p = 1 + floor(10^9 (count + 1) / (N + V)), smoothed over the V kept terms; a source that lacks
a term has p0, the same for all such terms. The divergence of source a from b sums
f = floor((p - q)^2 / q) over all kept terms. That is terms x sources^2, most of it pairs of
sources that both lack the term; so the terms are split:

* heavy, in more than half of a language's sources: dense tiles of terms x sources, f for every
  pair of two blocks of sources at once;
* light: for a and b without the term f is f(p0, p0), times the number of light terms. What a
  term in only one of the two adds depends on its p alone, so it comes from the source's
  histogram of p. Where both have it, posting pairs correct for what was counted twice:
  f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0).

Both are sums of int64, added at the end. Tiles and posting pairs are summed in a task before
anything is shuffled: per language and pair of blocks of BLOCK sources one matrix, at most
HELD of them at once, so memory is fixed whatever the number of terms, sources or documents.
The terms of a document are counted in the task that reads it, so a hot source is a matter of
partial sums.

Sums stay below 2^63 while V is below 5 * 10^8; beyond, Spark's sum raises instead of wrapping.

Defined results: a null text, lang or source is ''; repeated rows and ids are documents of
their own; a source without terms, and a language without kept terms, have pairs all the same
(value 0 where V is 0); a language with one source has no pairs; an empty table gives no rows;
equal values rank by the item's UTF-8; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.columns import col, small
from millrace.storage import materialize

SCALE = 1_000_000_000
#: Terms of fewer documents of a language are not kept.
LEAST_DOCUMENTS = 3
#: Ranks of a source's own terms that are reported.
TERMS = 200
#: A term is heavy in more than this share of its language's sources.
HEAVY = 0.5
#: Sources of a block, and matrices of a pair of blocks (512 kB each) that a task holds at once.
BLOCK, HELD = 256, 64
#: Terms of a dense tile are so many that it has at most so many cells in its cube of pairs.
CUBE = 1 << 21
#: Terms that a task counts before it hands them on.
COUNTED = 500_000

#: Bytes of terms as they are, A-Z lower-cased, all others as spaces. Terms hold all of U+0080 and above.
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def documents(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, text), null as ''."""
    return docs.select(*[F.coalesce(col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents, of each term of documents()."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, of) in seen.items():
                terms = list(n)
                if terms:
                    same = lambda v: pa.array([v] * len(terms), pa.string())
                    yield pa.RecordBatch.from_arrays([same(lang), same(source), pa.array([t.decode("utf-8", "replace") for t in terms], pa.string()), pa.array([n[t] for t in terms], pa.int64()), pa.array([of[t] for t in terms], pa.int64())], ["lang", "source", "term", "n", "docs"])
            seen.clear()

        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            groups: dict[tuple[str, str], list[int]] = {}
            for i, key in enumerate(keys):
                groups.setdefault(key, []).append(i)
            for key, rows in groups.items():
                n, of = seen.setdefault(key, (Counter(), Counter()))
                for a in range(0, len(rows), 64):
                    found = [(batch.column(2)[i].as_py() or b"").translate(_TERM).split() for i in rows[a : a + 64]]
                    n.update(chain.from_iterable(found))
                    of.update(chain.from_iterable(map(set, found)))
            if sum(len(n) for n, _ in seen.values()) > COUNTED:
                yield from out()
        yield from out()

    made = docs.select("lang", "source", F.col("text").cast("binary").alias("text")).mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return made.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (n + 1) / (N + V)), in decimals: the product leaves a long at 9 * 10^9 occurrences."""
    whole = (n + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return (F.lit(1) + F.call_function("div", whole, (total + terms).cast("decimal(20,0)"))).cast("long")


def f(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def tables(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> tuple[DataFrame, DataFrame]:
    """(groups, kept), both written.

    groups: (lang, source, at, n, terms, sources, p0, lang_n) of every source, numbered in its language.
    kept: (lang, source, term, n, m, lang_count) of kept terms; m sources have the term.
    """
    rows = documents(docs)
    counts = materialize(counted(rows), "counts")
    over = Window.partitionBy("lang", "term")
    wide = counts.withColumn("of", F.sum("docs").over(over)).withColumn("m", F.count("*").over(over)).withColumn("lang_count", F.sum("n").over(over))
    kept = materialize(wide.where(F.col("of") >= least).select("lang", "source", "term", "n", "m", "lang_count"), "kept")
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    terms = kept.groupBy("lang", "term").agg(F.max("lang_count").alias("n")).groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("lang_n"))
    every = rows.select("lang", "source").distinct()
    # one row for each source: numbered per language, which no language's sources outgrow a task for
    numbered = every.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).withColumn("sources", F.count("*").over(Window.partitionBy("lang")))
    joined = numbered.join(totals, ["lang", "source"], "left").join(terms, "lang", "left").fillna(0, ["n", "terms", "lang_n"])
    p0 = F.when(F.col("terms") > 0, share(F.lit(0).cast("long"), F.col("n"), F.col("terms")))
    return materialize(joined.withColumn("p0", p0), "groups"), kept


def shares(groups: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, at, term, m, p, p0, q, heavy): q is the language's own share."""
    g = small(groups.select("lang", "source", "at", "sources", "terms", "p0", "lang_n", F.col("n").alias("total")))
    met = kept.join(g, ["lang", "source"])
    return met.select("lang", "source", "at", "term", "m", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), "p0", share(F.col("lang_count"), F.col("lang_n"), F.col("terms")).alias("q"), (F.col("m") > F.col("sources") * HEAVY).alias("heavy"))


def own_terms(part: DataFrame, top: int = TERMS) -> DataFrame:
    """The terms that a source has more of than its language, the first ranks of each."""
    met = part.where(F.col("p") > F.col("q")).select("lang", "source", F.col("term").alias("item"), f(F.col("p"), F.col("q")).alias("value"))
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


class _Sums:
    """Sums of pairs of sources, a matrix for each language and pair of blocks."""

    def __init__(self, block: int) -> None:
        self.block = block
        self.of: dict[tuple[str, int, int], np.ndarray] = {}

    def add(self, lang: str, bi: int, bj: int) -> np.ndarray:
        return self.of.setdefault((lang, bi, bj), np.zeros((self.block, self.block), dtype=np.int64))

    def out(self) -> Iterator[pa.RecordBatch]:
        for (lang, bi, bj), m in self.of.items():
            i, j = np.nonzero(m)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(i), pa.string()), pa.array(i + bi * self.block, pa.int64()), pa.array(j + bj * self.block, pa.int64()), pa.array(m[i, j], pa.int64())], ["lang", "a", "b", "part"])
        self.of.clear()


_SUMS = "lang string, a long, b long, part long"


def dense(part: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, part) of heavy terms: every pair of sources, tile by tile, whether or not they have the term."""
    posts = part.where("heavy").groupBy("lang", "term").agg(F.collect_list(F.struct("at", "p")).alias("posts"))
    block = groups.where("terms > 0").withColumn("block", F.floor(F.col("at") / BLOCK)).groupBy("lang", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "p0"))), lambda x: x["p0"]).alias("p0"))
    block = materialize(block, "blocks")
    i, j = (small(block.select("lang", F.col("block").alias(n), F.col("p0").alias(f"p0_{n}"))) for n in ("bi", "bj"))
    of = lambda b: F.filter("posts", lambda x: F.floor(x["at"] / BLOCK) == F.col(b))
    rows = posts.join(i, "lang").join(j, "lang").select(
        "lang", "bi", "bj", "p0_bi", "p0_bj",
        *[of(b).getField(k).alias(f"{k}_{b}") for b in ("bi", "bj") for k in ("at", "p")],
    )

    def tile(p0: np.ndarray, at: pa.ListArray, p: pa.ListArray, first: int) -> np.ndarray:
        m = np.repeat(p0[None, :], len(at), axis=0)
        lengths = np.diff(at.offsets.to_numpy())
        m[np.repeat(np.arange(len(at)), lengths), at.flatten().to_numpy() - first * BLOCK] = p.flatten().to_numpy()
        return m

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums(BLOCK)
        for batch in batches:
            keys: dict[tuple, list[int]] = {}
            for r, key in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 2)))):
                keys.setdefault(key, []).append(r)
            for (lang, bi, bj), rows in keys.items():
                p0 = [np.array(batch.column(c)[rows[0]].as_py(), dtype=np.int64) for c in (3, 4)]
                size = max(1, CUBE // (len(p0[0]) * len(p0[1])))
                total = sums.add(lang, bi, bj)
                for a in range(0, len(rows), size):
                    take = pa.array(rows[a : a + size])
                    x = tile(p0[0], batch.column(5).take(take), batch.column(6).take(take), bi)
                    y = tile(p0[1], batch.column(7).take(take), batch.column(8).take(take), bj)
                    total[: len(p0[0]), : len(p0[1])] += _f(x[:, :, None], y[:, None, :]).sum(axis=0)
                if len(sums.of) > HELD:
                    yield from sums.out()
        yield from sums.out()

    return rows.mapInArrow(compute, _SUMS)


def sparse(part: DataFrame) -> DataFrame:
    """(lang, a, b, part): corrections of light terms for pairs of sources that both have the term."""
    posts = part.where(~F.col("heavy") & (F.col("m") > 1)).groupBy("lang", "term").agg(F.collect_list(F.struct("at", "p", "p0")).alias("posts"))

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums(BLOCK)
        for batch in batches:
            langs = batch.column(0).to_pylist()
            posts = batch.column(2)
            flat, ends = posts.flatten(), posts.offsets.to_numpy() - posts.offsets[0].as_py()
            at, p, p0 = (flat.field(k).to_numpy().astype(np.int64) for k in range(3))
            lengths = np.diff(ends)
            keys: dict[tuple, list[int]] = {}
            for r, key in enumerate(zip(langs, lengths.tolist())):
                keys.setdefault(key, []).append(r)
            for (lang, m), rows in keys.items():
                size = max(1, CUBE // (m * m))
                for a in range(0, len(rows), size):
                    pick = ends[rows[a : a + size]][:, None] + np.arange(m)[None, :]
                    x, y = pick[:, :, None], pick[:, None, :]
                    fix = _f(p[x], p[y]) - _f(p[x], p0[y]) - _f(p0[x], p[y]) + _f(p0[x], p0[y])
                    i, j = (np.broadcast_to(at[v], fix.shape).ravel() for v in (x, y))
                    blocks = (i // BLOCK) << 32 | j // BLOCK
                    for b in np.unique(blocks).tolist():
                        mine = blocks == b
                        np.add.at(sums.add(lang, b >> 32, b & 0xFFFFFFFF), (i[mine] % BLOCK, j[mine] % BLOCK), fix.ravel()[mine])
                        if len(sums.of) > HELD:
                            yield from sums.out()
        yield from sums.out()

    return posts.mapInArrow(compute, _SUMS)


def pairs(part: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of each two sources of a language.

    A row for each of the pairs that are returned; what is joined by language is one row for each source.
    """
    light = part.where(~F.col("heavy"))
    bars = light.groupBy("lang", "source", "p").agg(F.count("*").alias("n")).groupBy("lang", "source").agg(F.collect_list(F.struct("p", "n")).alias("bars"))
    terms = light.groupBy("lang", "term").agg(F.lit(1)).groupBy("lang").agg(F.count("*").alias("light"))
    g = groups.select("lang", "source", "at", "p0", "terms").join(bars, ["lang", "source"], "left").join(terms, "lang", "left").fillna(0, ["light"])
    g = materialize(g.withColumn("bars", F.coalesce("bars", F.expr("cast(array() as array<struct<p: bigint, n: bigint>>)"))), "bars")
    a, b = (g.select("lang", *[F.col(c).alias(f"{c}_{x}") for c in ("source", "at", "p0", "bars")], *(["terms", "light"] if x == "a" else [])) for x in "ab")
    met = a.join(small(b), "lang").where("source_a <> source_b")
    both = f(F.col("p0_a"), F.col("p0_b"))
    add = lambda bars, one: F.aggregate(bars, F.lit(0).cast("long"), lambda s, x: s + x["n"] * (one(x["p"]) - both))
    base = F.col("light") * both + add("bars_a", lambda p: f(p, F.col("p0_b"))) + add("bars_b", lambda q: f(F.col("p0_a"), q))
    more = dense(part, groups).unionByName(sparse(part)).groupBy("lang", "a", "b").agg(F.sum("part").alias("part"))
    out = met.withColumn("base", F.when(F.col("terms") > 0, base).otherwise(0)).select("lang", "source_a", "source_b", F.col("at_a").cast("long").alias("a"), F.col("at_b").cast("long").alias("b"), "base")
    return out.join(more, ["lang", "a", "b"], "left").select("lang", F.col("source_a").alias("source"), F.col("source_b").alias("item"), (F.col("base") + F.coalesce("part", F.lit(0))).alias("value"))


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): divergence of each source from each other one, and the terms that set it apart."""
    groups, kept = tables(docs, least)
    part = materialize(shares(groups, kept), "shares")
    between = pairs(part, groups)
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    between = between.withColumn("rank", F.row_number().over(w)).withColumn("part", F.lit("pair"))
    return between.unionByName(own_terms(part, top).withColumn("part", F.lit("term"))).select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), "rank")


def query(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The definition, term by term: no split, every pair of sources over all kept terms.
ORACLE = r"""
with d as (select row_number() over () as r, coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source from documents),
t as materialized (select r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
c as materialized (select lang, source, term, count(*) as n, count(distinct r) as docs from t group by all),
k as materialized (select lang, term, sum(n)::hugeint as n from c group by all having sum(docs) >= 3),
v as (select lang, count(*) as v, sum(n)::hugeint as n from k group by lang),
g as materialized (select g.lang, g.source, coalesce(v.v, 0) as v, coalesce(v.n, 0) as lang_n, coalesce(x.n, 0) as n from (select distinct lang, source from d) g left join v using (lang) left join (select c.lang, c.source, sum(c.n)::hugeint as n from c join k using (lang, term) group by all) x on x.lang = g.lang and x.source = g.source),
p as materialized (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, (1 + 1000000000::hugeint * (coalesce(c.n, 0) + 1) // (g.n + g.v))::bigint as p, (1 + 1000000000::hugeint * (k.n + 1) // (g.lang_n + g.v))::bigint as q from g join k using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
pr as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p)::bigint as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
al as (select x.lang, x.source, y.source as item, coalesce(pr.value, 0)::bigint as value from g x join g y on x.lang = y.lang and x.source <> y.source left join pr on pr.lang = x.lang and pr.source = x.source and pr.item = y.source),
tm as (select lang, source, term as item, (p - q) * (p - q) // q as value, row_number() over (partition by lang, source order by (p - q) * (p - q) // q desc, term) as rank from p where n > 0 and p > q)
select lang, source, 'pair' as part, item, value, (row_number() over (partition by lang, source order by value desc, item))::int as rank from al
union all select lang, source, 'term' as part, item, value::bigint as value, rank::int as rank from tm where rank <= 200
"""
