"""How far the cells of a block, query views x document views, lie apart: a bias between modalities.

Everything is made from vectors by joins within a block or a batch, whose sizes are the
training batch's, and one aggregate by block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import vectors as V

#: A block of at most so many cells has a mean for each of them.
CELLS = 16


def cells(queries: DataFrame, docs: DataFrame, *on: str) -> DataFrame:
    """(on..., i, j, cos, valid) of query views (on..., i, vec, valid) and document views (on..., j, vec, valid)."""
    q = queries.select(*on, "i", V.normalise(F.col("vec")).alias("x"), F.col("valid").alias("qv"))
    d = docs.select(*on, "j", V.normalise(F.col("vec")).alias("y"), F.col("valid").alias("dv"))
    return q.join(d, list(on)).select(*on, "i", "j", V.dot(F.col("x"), F.col("y")).alias("cos"), (F.col("qv") & F.col("dv")).alias("valid"))


def _spread(center: str, metric: str) -> Column:
    """Spread of a block around its mean, its largest or its least cell."""
    if center not in ("mean", "max", "min") or metric not in ("variance", "std", "pairwise"):
        raise ValueError(f"unknown center or metric: {center}, {metric}")
    c = F.col({"mean": "mean", "max": "hi", "min": "lo"}[center])
    around = F.col("variance") if center == "mean" else F.greatest(F.lit(0.0), F.col("sq") - 2 * c * F.col("mean") + c * c)
    if metric == "pairwise":
        around = around * 2 * F.col("n") / (F.col("n") - 1)
    return F.sqrt(around + 1e-12) if metric == "std" else around


def spreads(cell: DataFrame, *by: str, center: str = "mean", metric: str = "variance", least: int = 2) -> DataFrame:
    """(by..., n, mean, range, spread) of blocks with two valid cells (`least`) or more."""
    c = F.col("cos")
    per = cell.where("valid").groupBy(*by).agg(F.count("*").alias("n"), F.avg(c).alias("mean"), F.max(c).alias("hi"), F.min(c).alias("lo"), F.var_pop(c).alias("variance"), F.avg(c * c).alias("sq")).where(F.col("n") >= least)
    return per.select(*by, "n", "mean", (F.col("hi") - F.col("lo")).alias("range"), _spread(center, metric).alias("spread"))


def diagnostics(cell: DataFrame, block: str = "block", ragged: bool = False) -> DataFrame:
    """(name, value): pos_range, pos_var, pos_mean and n_blocks over the blocks of two cells or more, and cell_i_j.

    The mean of each cell is given only if all blocks have one shape, of CELLS cells or less. ragged: blocks of one
    cell count too, and each cell's mean is given over the blocks that have it, whatever their shapes.
    """
    valid = cell.where("valid")
    shape = valid.groupBy(block).agg(F.max("i").alias("rows"), F.max("j").alias("cols"), F.count("*").alias("n")).where("n >= 2")
    one = shape.agg(F.countDistinct("rows", "cols", "n").alias("shapes"), F.max("n").alias("n")).where(f"shapes = 1 and n <= {CELLS}").select(F.lit(1).alias("one"))
    total = spreads(valid, block, least=1 if ragged else 2).agg(F.avg("range").alias("pos_range"), F.avg("spread").alias("pos_var"), F.avg("mean").alias("pos_mean"), F.count("*").cast("double").alias("n_blocks"))
    names = total.columns
    told = total.where("n_blocks > 0").select(F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in names))).alias("x")).select("x.*")
    # one row tells whether there are cell means at all
    kept = valid if ragged else valid.join(shape.select(block), block, "left_semi").join(F.broadcast(one), F.lit(True))
    each = kept.groupBy("i", "j").agg(F.avg("cos").alias("value"))
    return told.unionByName(each.select(F.concat_ws("_", F.lit("cell"), "i", "j").alias("name"), "value"))


def balance_terms(queries: DataFrame, docs: DataFrame, hard: DataFrame | None = None, pos_center: str = "mean", neg_center: str = "mean", metric: str = "variance", weight: float = 1.0) -> DataFrame:
    """(batch, pos, neg_cross, neg_hard, loss) of each batch.

    queries (batch, block, i, vec, valid) and docs (batch, block, j, vec, valid) are the views of the samples (block) of a
    batch; hard (batch, block, g, vec, valid) a sample's own negatives. pos is the mean spread of the samples' own blocks;
    neg_cross that of a sample's queries with another's documents; neg_hard that of its queries with one hard negative.
    loss = pos + weight x mean of the negative terms, which are 0 where no block has two cells.
    """
    own = spreads(cells(queries, docs, "batch", "block"), "batch", "block", center=pos_center, metric=metric)
    q = queries.select("batch", "block", "i", V.normalise(F.col("vec")).alias("x"), F.col("valid").alias("qv"))
    d = docs.select("batch", F.col("block").alias("other"), "j", V.normalise(F.col("vec")).alias("y"), F.col("valid").alias("dv"))
    cross = q.join(d, "batch").where("block <> other").select("batch", "block", "other", V.dot(F.col("x"), F.col("y")).alias("cos"), (F.col("qv") & F.col("dv")).alias("valid"))
    terms = [("pos", own), ("neg_cross", spreads(cross, "batch", "block", "other", center=neg_center, metric=metric))]
    if hard is not None:
        each = cells(queries, hard.withColumnRenamed("g", "j"), "batch", "block")
        terms.append(("neg_hard", spreads(each, "batch", "block", "j", center=neg_center, metric=metric)))
    out = queries.select("batch").distinct()
    for name, df in terms:
        out = out.join(df.groupBy("batch").agg(F.avg("spread").alias(name)), "batch", "left")
    out = out.fillna(0.0, [n for n, _ in terms])
    if hard is None:
        out = out.withColumn("neg_hard", F.lit(None).cast("double"))
    negative = (F.col("neg_cross") + F.col("neg_hard")) / 2 if hard is not None else F.col("neg_cross")
    return out.select("batch", "pos", "neg_cross", "neg_hard", (F.col("pos") + weight * negative).alias("loss"))
