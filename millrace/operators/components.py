"""Connected components by alternating star contraction, on DataFrames only.

Every round turns each node's neighbourhood into a star around its smallest
member: a partial min-aggregation per node and one equi-join, so a hub with a
third of all edges is pre-aggregated on the map side and its join partition is
split by AQE. Rounds grow with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from millrace.storage import materialize, release


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction: large links bigger neighbours to the minimum, small the smaller ones."""
    if large:
        near = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges
    least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    met = near.join(least, "u")
    if large:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _marked(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """edges, written, and a mark of their rows, taken while they are written."""
    seen = Observation()
    big = lambda c: F.sum(c.cast("decimal(38,0)"))
    out = materialize(edges.observe(seen, F.count(F.lit(1)).alias("n"), big(F.xxhash64("u", "v")).alias("a"), big(F.xxhash64("v")).alias("b")), "stars")
    return out, tuple(seen.get[k] for k in ("n", "a", "b"))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 40) -> DataFrame:
    """(node, component) for every node of an undirected edge list; component is the least node.

    Edges with a null end are dropped, self-loops keep their node as a component
    of its own, repeated edges count once, an empty list gives no rows.
    """
    ends = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(F.col(src).alias("a"), F.col(dst).alias("b"))
    ends = materialize(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    cur, seen = ends.where("u <> v"), None
    for _ in range(max_rounds):
        nxt, mark = _marked(_star(_star(cur, large=True), large=False))
        if cur is not ends:
            release(cur)
        cur = nxt
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle; raise max_rounds")
    roots = ends.select(F.col("v").alias("node")).unionByName(ends.select(F.col("u").alias("node"))).distinct()
    return roots.join(cur.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("component"))
