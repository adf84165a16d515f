"""Lexical similarity and hard-negative mining by token postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.text import tokens
from millrace.operators.order import batches, numbered


def postings(rows: DataFrame, row: str = "row", text: str = "text") -> DataFrame:
    """(row, token), each pair once."""
    return rows.select(F.col(row).alias("row"), F.explode(F.array_distinct(tokens(F.coalesce(F.col(text), F.lit(""))))).alias("token"))


def counted(posts: DataFrame) -> DataFrame:
    """(token, df, n): the rows of every token, and the non-empty rows."""
    n = posts.agg(F.countDistinct("row").alias("n"))
    return posts.groupBy("token").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n))


def _frequent(max_df_ratio: float, min_cut: int) -> Column:
    return F.col("df") > F.greatest(F.lit(min_cut), F.floor(F.col("n") * max_df_ratio))


def frequencies(posts: DataFrame | None, max_df_ratio: float = 0.3, min_cut: int = 20, of: DataFrame | None = None) -> DataFrame:
    """(token, df, idf) of tokens in at most max(min_cut, ratio of the non-empty rows) rows; of: what counted() gives, if it is written."""
    df = counted(posts) if of is None else of
    return df.where(~_frequent(max_df_ratio, min_cut)).select("token", "df", F.ln(1 + F.col("n") / F.col("df")).alias("idf"))


def too_frequent(of: DataFrame, max_df_ratio: float = 0.3, min_cut: int = 20) -> DataFrame:
    """(token) of counted() that frequencies() leaves out: at most some 1 / ratio for each token of a mean row."""
    return of.where(_frequent(max_df_ratio, min_cut)).select("token")


def weights(posts: DataFrame, freq: DataFrame) -> DataFrame:
    """(row, w, norm): sum of squared idf and its root."""
    return posts.join(freq, "token").groupBy("row").agg(F.sum(F.col("idf") * F.col("idf")).alias("w")).withColumn("norm", F.sqrt("w"))


def similar(posts: DataFrame, freq: DataFrame, min_df: int = 2, measure: str = "f1") -> DataFrame:
    """(i, j, score), i < j, of all pairs that share a token, by a join of the postings: for few rows, see lexical_join for many.

    Tokens below min_df join nothing; they count in the weights.
    """
    w = weights(posts, freq)
    useful = posts.join(freq.where(F.col("df") >= min_df), "token").select("row", "token", "idf")
    a, b = useful.withColumnRenamed("row", "i"), useful.select(F.col("row").alias("j"), "token")
    dots = a.join(b, "token").where("i < j").groupBy("i", "j").agg(F.sum(F.col("idf") * F.col("idf")).alias("dot"))
    met = dots.join(w.select(F.col("row").alias("i"), F.col("w").alias("wi"), F.col("norm").alias("ni")), "i").join(w.select(F.col("row").alias("j"), F.col("w").alias("wj"), F.col("norm").alias("nj")), "j")
    score = 2 * F.col("dot") / (F.col("wi") + F.col("wj")) if measure == "f1" else F.col("dot") / (F.col("ni") * F.col("nj"))
    return met.select("i", "j", score.alias("score"))


def directed(pairs: DataFrame) -> DataFrame:
    return pairs.unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), "score"))


def banded(pairs: DataFrame, low: float, high: float) -> DataFrame:
    """Pairs in the band, both ends in it."""
    return pairs.where(F.col("score").between(low, high))


def excluded(pairs: DataFrame, related: DataFrame) -> DataFrame:
    """Pairs without those that related (i, j) names."""
    return pairs.join(related.select("i", "j"), ["i", "j"], "left_anti")


def top(pairs: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("i").orderBy(F.desc("score"), "j")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def rarest_token(posts: DataFrame, freq: DataFrame, nth: int) -> DataFrame:
    """(row, token): the nth rarest token of a row (1 first), the last one if it has fewer.

    Only a row's nth first are ever shuffled: each task keeps so many of them.
    """
    rarest = F.row_number().over(Window.partitionBy("row").orderBy("df", "token"))
    ranked = posts.join(freq.select("token", "df").hint("shuffle_hash"), "token").withColumn("rn", rarest).where(F.col("rn") <= nth)
    return ranked.groupBy("row").agg(F.max_by("token", "rn").alias("token"))


def blocks(posts: DataFrame, size: int, rank: int = 0, min_df: int = 1) -> DataFrame:
    """(row, block): rows in blocks of `size` by a hash of their rank-th rarest token (0 first) of those in min_df rows.

    Rows that share rare tokens come together, so pairs of other blocks are mostly unlike. Another rank gives other
    blocks: rounds of ranks 0, 1, ... add up, see merged_rounds(). Rows without tokens are in none.
    """
    df = posts.groupBy("token").agg(F.count("*").alias("df")).where(F.col("df") >= min_df)
    rare = rarest_token(posts, df, rank + 1)
    return batches(rare.select("row", F.md5("token").alias("signature")), size, "signature", "row", name="block").select("row", "block")


def fingerprint(rows: DataFrame, row: str = "row", text: str = "text") -> str:
    """A key of what an index is made from: the same for the same rows and texts, in whatever order or files."""
    h = F.xxhash64(F.col(row), F.col(text).isNull(), F.col(text))
    r = rows.agg(F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).alias("s"), F.bit_xor(h).alias("x")).first()
    return f"{r.n}-{r.s}-{r.x}"


def progress(step: int, total: int) -> float:
    """Share of a run that is done, 0 to 1; a run of unknown length is at its start."""
    return min(1.0, max(0, step) / total) if total > 0 else 0.0


def ramp(p: float, kind: str = "linear") -> float:
    import math

    p = min(1.0, max(0.0, p))
    return (1 - math.cos(math.pi * p)) / 2 if kind == "cosine" else p


def band_start(n: Column, window: int, p: float, kind: str = "linear") -> Column:
    """First rank (from 0) of a difficulty window; halves go to the even number."""
    return F.bround(F.greatest(n - window, F.lit(0)) * F.lit(1 - ramp(p, kind))).cast("long")


def difficulty_band(ranked: DataFrame, window: int, p: float, kind: str = "linear", by: str = "i") -> DataFrame:
    """Rows whose rank (from 1) is in the window for progress p."""
    n = F.count("*").over(Window.partitionBy(by))
    met = ranked.withColumn("n", n).withColumn("start", band_start(F.col("n"), window, p, kind))
    return met.where((F.col("rank") > F.col("start")) & (F.col("rank") <= F.col("start") + window)).drop("n", "start")


def merged_rounds(*rounds: DataFrame) -> DataFrame:
    out = rounds[0]
    for r in rounds[1:]:
        out = out.unionByName(r)
    return out.groupBy("i", "j").agg(F.max("score").alias("score"))


def sampled(rows: DataFrame, pool: DataFrame, related: DataFrame, n: int, seed: int = 0, epoch: int = 0, slots: int = 16) -> DataFrame:
    """(row, doc, pos): n documents of pool (doc) for each row that are not its own or related (row, doc).

    Candidates are drawn by hash, `slots` for each wanted document, so cost is linear in
    rows and the pool is never ranked as a whole; a row may get fewer. A row's draws stay in one
    array, and only the n that are kept are looked up.
    """
    placed = numbered(pool.select("doc").distinct(), "doc", name="at")
    size = placed.count()

    def draw(s: Column) -> Column:
        h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("row").cast("string"), F.lit(str(epoch)), s.cast("string")))
        return F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), F.lit(max(1, size)))

    draws = F.transform(F.sequence(F.lit(0), F.lit(n * slots - 1)), draw)
    # of what is related only the drawn: no more than a row has draws
    hit = related.select("row", "doc").join(placed, "doc").where(F.array_contains(draws, F.col("at"))).groupBy("row").agg(F.collect_set("at").alias("barred"))
    # rows are short, the draws are work: more tasks than their size alone would give
    many = 4 * rows.sparkSession.sparkContext.defaultParallelism
    met = rows.select("row").repartition(many, "row").distinct().join(hit, "row", "left")
    left = F.array_except(draws, F.coalesce("barred", F.array().cast("array<bigint>")))
    picks = met.select("row", F.posexplode(F.slice(left, 1, n)).alias("pos", "at"))
    return picks.join(placed, "at").select("row", "doc", (F.col("pos") + 1).alias("pos"))
