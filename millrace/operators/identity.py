"""Document and query identity: content keys, canonical ids, one-hop relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.components import connected_components
from millrace.operators.order import numbered


def canonical(records: DataFrame, declared: str = "declared", content: str = "content") -> DataFrame:
    """(node, canonical): every declared id and content key with its component's representative.

    A record ties its declared id to its content. Representative: the least declared id
    of the component, or the least content key where none is declared.
    """
    tied = records.select(F.concat(F.lit("d:"), F.col(declared)).alias("src"), F.col(content).alias("dst"))
    edges = tied.select(F.coalesce("src", "dst").alias("src"), "dst")
    comp = connected_components(edges.where("dst is not null"))
    name = F.when(F.col("node").startswith("d:"), F.substring("node", 3, 1 << 20))
    best = comp.groupBy("component").agg(F.min(name).alias("declared"), F.min(F.when(~F.col("node").startswith("d:"), F.col("node"))).alias("content"))
    return comp.join(best, "component").select(F.coalesce(name, F.col("node")).alias("node"), F.coalesce("declared", "content").alias("canonical"))


def relations(rows: DataFrame, query: str = "query", doc: str = "doc") -> DataFrame:
    """(query, doc): one hop, no closure, each pair once."""
    return rows.where(F.col(query).isNotNull() & F.col(doc).isNotNull()).select(F.col(query).alias("query"), F.col(doc).alias("doc")).distinct()


def relation_stats(rel: DataFrame, rows: DataFrame, query: str = "query") -> DataFrame:
    per = rel.groupBy("query").agg(F.count("*").alias("n"))
    stats = per.agg(F.count("*").alias("queries"), F.count_if(F.col("n") > 1).alias("multi_positive"), F.max("n").alias("max_positives"), F.avg("n").alias("mean_positives"))
    dup = rows.agg((F.count(query) - F.countDistinct(query)).alias("duplicate_rows"))
    return stats.crossJoin(dup)


def component_stats(canon: DataFrame) -> DataFrame:
    return canon.agg(F.countDistinct("node").alias("nodes"), F.countDistinct("canonical").alias("documents"))


def first_of_each(records: DataFrame, key: str, order: str) -> DataFrame:
    """(order, first, slot): every record's first equal one and that one's place among the distinct ones.

    Records meet on a digest of a string key, so its text is never shuffled.
    """
    digest = F.sha2(key, 256) if dict(records.dtypes)[key] == "string" else F.col(key)
    keyed = records.select(order, digest.alias("_key"))
    least = keyed.groupBy("_key").agg(F.min(order).alias("first"))
    slots = numbered(least, "first", "_key", name="slot").withColumnRenamed("_key", "_same")
    return keyed.join(slots, F.col("_key").eqNullSafe(F.col("_same"))).select(order, "first", "slot")


def pool_dedup(pool: DataFrame, order: str, uid: str = "uid", content: str = "content") -> DataFrame:
    """As first_of_each(), by the uid, or by the content of a record without one; the two kinds of key never meet."""
    own = F.nullif(F.col(uid).cast("string"), F.lit(""))
    key = F.coalesce(F.concat(F.lit("u:"), own), F.concat(F.lit("c:"), F.sha2(F.col(content), 256)))
    return first_of_each(pool.select(order, key.alias("_pool_key")), "_pool_key", order)


def gathered(firsts: DataFrame, results: DataFrame, order: str) -> DataFrame:
    """results, one row for each slot of first_of_each(), given back to every record that shares it."""
    return firsts.select(order, "slot").join(results, "slot").drop("slot")


def classes(rows: DataFrame, key: str, order: str) -> DataFrame:
    """(order, class, links): the least `order` that shares the key, and how many others do. A null key is shared with none.

    Counts of a key are added up before they meet, and no pair is made.
    """
    per = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_shared")).agg(F.min(order).alias("class"), F.count("*").alias("_n"))
    met = rows.select(order, F.col(key).alias("_key")).join(per, F.col("_key") == F.col("_shared"), "left")
    return met.select(order, F.coalesce("class", F.col(order)).alias("class"), F.coalesce(F.col("_n") - 1, F.lit(0)).cast("long").alias("links"))
