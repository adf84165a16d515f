"""Which negatives a training row gets: its own, mined ones, or fillers. All draws are by hash, so they repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.operators.lexical import difficulty_band, ramp


def draw(seed: int, *parts: str) -> Column:
    """The key that draws are ordered by."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(p).cast("string") for p in parts)))


def mined_share(n: int, p: float, first: float, last: float, kind: str = "linear") -> int:
    """How many of n slots mined negatives take at progress p; halves go to the even number."""
    return min(n, round(n * (first + (last - first) * ramp(p, kind))))


def select(cands: DataFrame, n: int, strategy: str = "shuffle", fill: str = "repeat", seed: int = 0, fillers: DataFrame | None = None, rows: DataFrame | None = None) -> DataFrame:
    """(row, slot, doc, own): n negatives of each row from its candidates (row, doc, pos).

    strategy: topk takes the first by pos; shuffle and random_pool draw. Rows with fewer than n:
    drop leaves them so; repeat goes over their own again; random_pool takes fillers (row, doc, pos), and
    where these are too few both again. rows (row) names rows that may have no candidate.
    """
    if strategy not in ("topk", "shuffle", "random_pool") or fill not in ("drop", "repeat", "random_pool"):
        raise ValueError(f"unknown strategy or fill: {strategy}, {fill}")
    by = Window.partitionBy("row")
    # all of a short row keep their order; only where there is a choice it is drawn
    counted = cands.select("row", "doc", "pos").withColumn("n", F.count("*").over(by))
    order = F.when(F.col("n") >= n, draw(seed, "row", "doc")) if strategy != "topk" else F.lit(None).cast("string")
    own = counted.withColumn("slot", F.row_number().over(by.orderBy(order.asc_nulls_first(), "pos", "doc")) - 1).where(F.col("slot") < n).select("row", "slot", "doc", F.lit(True).alias("own"))
    if fill == "drop":
        return own
    pool = own
    if fill == "random_pool" and fillers is not None:
        have = own.groupBy("row").agg(F.count("*").alias("have"))
        more = fillers.select("row", "doc", F.row_number().over(by.orderBy("pos", "doc")).alias("k")).join(have, "row", "left").withColumn("slot", F.coalesce("have", F.lit(0)) + F.col("k") - 1)
        more = more.where(F.col("slot") < n) if rows is None else more.join(rows.select("row").distinct(), "row", "left_semi").where(F.col("slot") < n)
        pool = own.unionByName(more.select("row", F.col("slot").cast("int").alias("slot"), "doc", F.lit(False).alias("own")))
    # a row has at most n negatives here: the list is bounded
    held = pool.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("slot", "doc", "own"))).alias("xs"))
    return held.select("row", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.col("xs")[i % F.size("xs")])).alias("slot", "x")).select("row", "slot", "x.doc", (F.col("x.own") & (F.col("slot") == F.col("x.slot"))).alias("own"))


def mined(ranked: DataFrame, related: DataFrame, n: int, window: int, p: float, kind: str = "linear", seed: int = 0) -> DataFrame:
    """(i, j, pos): n mined negatives of each row at progress p, fewer where related ones are among those drawn.

    From the difficulty window of ranked (i, j, rank) max(2 n, n + 2) rows are drawn; those that
    related (i, j) names, and the row itself, go; the first n stay.
    """
    band = difficulty_band(ranked, window, p, kind)
    w = Window.partitionBy("i")
    tried = band.withColumn("o", F.row_number().over(w.orderBy(draw(seed, "i", "j")))).where(F.col("o") <= max(2 * n, n + 2))
    kept = tried.where("i <> j").join(related.select("i", "j"), ["i", "j"], "left_anti")
    return kept.withColumn("pos", F.row_number().over(w.orderBy("o"))).where(F.col("pos") <= n).select("i", "j", "pos")


def group_negatives(picks: DataFrame, views: DataFrame, related: DataFrame, k: int) -> DataFrame:
    """(row, src, view, uid): the first k views of each picked source row, as one negative of row.

    picks (row, src, ...); views (src, view, uid); related (row, uid). A source of which any view, kept or not, is related
    to the row goes as a whole, so that the views of those that stay are aligned; one without views has none to give.
    """
    hit = picks.select("row", "src").join(views.select("src", "uid"), "src").join(related.select("row", "uid"), ["row", "uid"], "left_semi").select("row", "src").distinct()
    free = picks.join(hit, ["row", "src"], "left_anti")
    nth = F.row_number().over(Window.partitionBy("src").orderBy("view"))
    first = views.withColumn("nth", nth).where(F.col("nth") <= k).select("src", (F.col("nth") - 1).alias("view"), "uid")
    return free.join(first, "src").select("row", "src", "view", "uid", *(c for c in picks.columns if c not in ("row", "src")))


def merged(mined: DataFrame, plain: DataFrame, n: int, share: int) -> DataFrame:
    """(row, slot, doc, mined): up to `share` mined ones (row, doc, pos), then plain ones (row, doc, pos) that are not among them, n in all."""
    w = Window.partitionBy("row").orderBy("pos", "doc")
    first = mined.groupBy("row", "doc").agg(F.min("pos").alias("pos")).withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= min(n, share)).select("row", "doc", "pos", F.lit(True).alias("mined"))
    rest = plain.groupBy("row", "doc").agg(F.min("pos").alias("pos")).join(first.select("row", "doc"), ["row", "doc"], "left_anti").select("row", "doc", "pos", F.lit(False).alias("mined"))
    order = Window.partitionBy("row").orderBy(F.desc("mined"), "pos", "doc")
    return first.unionByName(rest).withColumn("slot", F.row_number().over(order) - 1).where(F.col("slot") < n).select("row", "slot", "doc", "mined")
