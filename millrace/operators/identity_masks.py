"""Which candidates of a training batch are no true negatives, and which there are.

Examples: (batch, example, group_id, query_id, positive_ids array); slots: (batch, example, slot, doc, positive).
Example numbers are told apart within a batch only. Every rule is an equi-join within a batch, and the rules'
pairs are united, so no pair is made that no rule holds for. An unknown (null) id masks nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A: another slot of the same example; B: of the same group; C: the document is among the anchor's positives; D: the same query.
RULES = ("A", "B", "C", "D")


def _chosen(rules) -> tuple[str, ...]:
    if unknown := [r for r in rules if r not in RULES]:
        raise ValueError(f"unknown rules: {unknown}")
    return tuple(rules)


def _groups(examples: DataFrame) -> DataFrame:
    """Examples with their group; one without a group is a group of its own."""
    own = F.concat(F.lit("e:"), F.col("example").cast("string"))
    return examples.select("batch", "example", F.coalesce(F.concat(F.lit("g:"), F.col("group_id").cast("string")), own).alias("group"), "query_id")


def _wanted(examples: DataFrame) -> DataFrame:
    """(batch, example, doc): each positive of an example once, none that is null."""
    return examples.select("batch", "example", F.explode(F.array_distinct("positive_ids")).alias("doc")).where("doc is not null")


def doc_side(examples: DataFrame, slots: DataFrame, rules=("A", "B", "C")) -> DataFrame:
    """(batch, anchor, example, slot): slots that are masked for the query of example `anchor`, no target among them.

    Targets are an example's own positive slots. A and B look at positive slots only, C at all.
    """
    found = []
    at = ["batch", "anchor", "example", "slot"]
    named = examples.select("batch", F.col("example").alias("anchor"), "positive_ids")
    positive = slots.where("positive").select("batch", "example", "slot")
    for rule in _chosen(rules):
        if rule == "B":
            g = _groups(examples)
            mates = g.select("batch", "group", F.col("example").alias("anchor")).join(g.select("batch", "group", "example"), ["batch", "group"]).where("anchor <> example")
            found.append(mates.join(positive, ["batch", "example"]).select(*at))
        elif rule == "C":
            wanted = _wanted(named.withColumnRenamed("anchor", "example")).withColumnRenamed("example", "anchor")
            met = slots.select("batch", "example", "slot", "doc", "positive").join(wanted, ["batch", "doc"])
            found.append(met.where("anchor <> example or not positive").select(*at))
        # A: an example's own positive slots are its targets, and D is of the other direction
    if not found:
        return positive.select("batch", F.col("example").alias("anchor"), "example", "slot").limit(0)
    return reduce(DataFrame.unionByName, found).distinct()


def query_side(examples: DataFrame, slots: DataFrame, rules=RULES) -> DataFrame:
    """(batch, example, slot, candidate): queries of examples that are masked for a positive slot as anchor, no target among them.

    The target is the slot's own example.
    """
    found = []
    at = ["batch", "example", "slot", "candidate"]
    anchors = slots.where("positive").select("batch", "example", "slot", "doc")
    for rule in _chosen(rules):
        if rule in ("B", "D"):
            key = "group" if rule == "B" else "query_id"
            g = _groups(examples).where(F.col(key).isNotNull())
            mates = g.select("batch", key, "example").join(g.select("batch", key, F.col("example").alias("candidate")), ["batch", key]).where("candidate <> example")
            found.append(anchors.join(mates, ["batch", "example"]).select(*at))
        elif rule == "C":
            met = anchors.join(_wanted(examples).withColumnRenamed("example", "candidate"), ["batch", "doc"])
            found.append(met.where("candidate <> example").select(*at))
    if not found:
        return anchors.select("batch", "example", "slot", F.col("example").alias("candidate")).limit(0)
    return reduce(DataFrame.unionByName, found).distinct()


def own_slots(examples: DataFrame, slots: DataFrame) -> DataFrame:
    """(batch, example, slot): own negatives that are among the own positives, where each row has its own slots only."""
    return slots.where("not positive").join(_wanted(examples), ["batch", "example", "doc"], "left_semi").select("batch", "example", "slot")


def candidates(slots: DataFrame, mode: str = "all") -> DataFrame:
    """(batch, anchor, example, slot, target): the candidates of each example's query.

    all: every slot of the batch; positives_only: every positive slot and the own negatives; own: the own slots. A
    batch has a bounded size, so its square is.
    """
    if mode not in ("all", "positives_only", "own"):
        raise ValueError(f"unknown mode: {mode}")
    s = slots.select("batch", "example", "slot", "positive")
    if mode == "own":
        met = s.withColumn("anchor", F.col("example"))
    else:
        met = s.join(s.select("batch", F.col("example").alias("anchor")).distinct(), "batch")
        if mode == "positives_only":
            met = met.where("positive or anchor = example")
    return met.select("batch", "anchor", "example", "slot", (F.col("positive") & (F.col("anchor") == F.col("example"))).alias("target"))
