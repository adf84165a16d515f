"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint is cut into radius + 1 blocks: two fingerprints within the radius
agree on one block at least, so all close pairs meet in a join on (block, value).
Only distinct fingerprints are joined; exact copies follow theirs as members.
A block value that more than `hot` fingerprints share is not expanded into pairs:
its members are linked through the values within half the radius of them, which
two fingerprints share exactly if they are within the radius. That is exact too,
and grows with the number of members.

Defined results: a null or empty text has fingerprint zero and links like any
other; repeated rows and ids share a component; a null id never names a component
but by a group of null ids only; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import words as W
from millrace.operators.components import connected_components
from millrace.storage import materialize, small_batches

#: Fingerprints with one block value up to which they are compared pair by pair.
HOT = 48


def fingerprints(docs: DataFrame, size: int = 3, text: str = "text", out: str = "fp") -> DataFrame:
    """docs with the SimHash as a signed long."""

    @F.pandas_udf("long")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series([(x := W.simhash(t, size)) - (1 << 64 if x >> 63 else 0) for t in s], dtype="int64")

    return docs.withColumn(out, of(F.col(text)))


def layout(radius: int) -> list[tuple[int, int]]:
    """(shift, mask) of radius + 1 blocks of 64 bits as even as they go."""
    n = radius + 1
    cuts = [64 * i // n for i in range(n + 1)]
    return [(a, (1 << (b - a)) - 1) for a, b in zip(cuts, cuts[1:])]


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(distinct: DataFrame, radius: int = 2, hot: int = HOT) -> DataFrame:
    """Edges (src, dst) among distinct fingerprints `fp`: their components are those of all pairs within the radius.

    Between two fingerprints an edge is a verified pair. Members of a hot block value
    get an edge to the least member that shares a ball with them, at most
    radius bits away. The radius must be even: balls of half of it are used.
    """
    if radius % 2:
        raise ValueError("the radius must be even")
    blocks = F.array(*(F.struct(F.lit(i).alias("b"), F.shiftrightunsigned("fp", s).bitwiseAND(F.lit(m)).alias("v")) for i, (s, m) in enumerate(layout(radius))))
    keyed = distinct.select("fp", F.explode(blocks).alias("k")).select("fp", "k.b", "k.v")
    crowded = keyed.groupBy("b", "v").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("b", "v")
    few = keyed.join(crowded, ["b", "v"], "left_anti")
    pairs = few.alias("x").join(few.alias("y"), ["b", "v"]).where("x.fp < y.fp").where(hamming(F.col("x.fp"), F.col("y.fp")) <= radius).select(F.col("x.fp").alias("src"), F.col("y.fp").alias("dst"))
    half = radius // 2
    flips = [sum(1 << i for i in c) for k in range(half + 1) for c in combinations(range(64), k)]
    signed = [x - (1 << 64) if x >> 63 else x for x in flips]
    many = keyed.join(crowded, ["b", "v"], "left_semi").select("fp").distinct()
    balls = many.select("fp", F.explode(F.array(*(F.lit(x).cast("long") for x in signed))).alias("x")).select("fp", F.col("fp").bitwiseXOR(F.col("x")).alias("hub"))
    least = balls.groupBy("hub").agg(F.min("fp").alias("dst"), F.count("*").alias("n")).where("n > 1")
    stars = balls.join(least, "hub").where("fp <> dst").select(F.col("fp").alias("src"), "dst")
    return pairs.unionByName(stars).distinct()


def group(prints: DataFrame, doc_id: str = "doc_id", radius: int = 2, hot: int = HOT) -> DataFrame:
    """(fp, component): every distinct fingerprint with the least doc_id reachable from it."""
    least = materialize(prints.groupBy("fp").agg(F.min(doc_id).alias("least")), "fps")
    comp = connected_components(links(least.select("fp"), radius, hot)).withColumnRenamed("node", "fp")
    named = materialize(least.join(comp, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("c")), "fpcomp")
    return named.join(named.groupBy("c").agg(F.min("least").alias("component_id")), "c").select("fp", "component_id")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    with small_batches(spark):
        prints = materialize(fingerprints(docs).select("doc_id", "fp"), "prints")
    groups = group(prints)
    return prints.join(groups, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
