"""One evaluation over several datasets: search, metrics by dataset, their means, interference."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import retrieval as R
from millrace.sources.embeddings import union_corpora


class Dataset(NamedTuple):
    """queries (q, vec), corpus (d, vec), qrels (q, d, rel) or a retrieval.Gold."""

    queries: DataFrame
    corpus: DataFrame
    qrels: DataFrame | R.Gold


def evaluate(sets: dict[str, Dataset], ks: Sequence[int], mixed: bool = True) -> DataFrame:
    """(dataset, k, the metrics, queries, foreign): a row for each dataset, and "macro" and "micro" ones.

    mixed searches the union of all corpora, otherwise each dataset its own. foreign is the
    share of retrieved documents of another dataset, over all queries (its macro row has it).
    """
    named = {tag: x.queries.select(T.namespaced(F.lit(tag), F.col("q").cast("string")).alias("q"), "vec") for tag, x in sets.items()}
    gold = R.GoldUnion([R.as_gold(x.qrels).named(lambda c, tag=tag: T.namespaced(F.lit(tag), F.col(c).cast("string"))) for tag, x in sets.items()])
    found, asked = None, None
    for tag, q in named.items():
        asked = q if asked is None else asked.unionByName(q)
        if not mixed:
            one = R.search_documents(q, union_corpora({tag: sets[tag].corpus.select("d", "vec")}), max(ks))
            found = one if found is None else found.unionByName(one)
    if mixed:
        found = R.search_documents(asked, union_corpora({tag: x.corpus.select("d", "vec") for tag, x in sets.items()}), max(ks))
    judged = asked.select("q").join(gold.grades().select("q").distinct(), "q", "left_semi")
    tag_of = lambda c: T.split_namespace(F.col(c))["tag"]
    each = R.means(R.per_query(found, gold, judged, ks).withColumn("dataset", tag_of("q")), "dataset", "k")
    total = each.groupBy("k").agg(F.sum("queries").alias("queries"))
    macro = R.macro(each).join(total, "k").withColumn("dataset", F.lit("macro"))
    micro = R.micro(each).join(total, "k").withColumn("dataset", F.lit("micro"))
    rate = R.foreign_rate(found, ks, tag_of("q"), tag_of("d")).select("k", F.col("rate").alias("foreign"), F.lit("macro").alias("dataset"))
    return each.unionByName(macro).unionByName(micro).join(rate, ["dataset", "k"], "left")
