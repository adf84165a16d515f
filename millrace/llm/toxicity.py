"""Toxicity by compression distance.

Two zstandard dictionaries are trained, each on texts of one class alone: toxic ones, and
ordinary ones. A window is compressed with the ordinary dictionary, and with the toxic one
put before it; what the toxic one saves is what toxic texts have and ordinary ones do
not. Calibrated thresholds on the windows' savings, fitted to held-back rows, turn them into a
probability for each text.

Training texts are given to zstandard whole and as they stand, repeats included. A quarter of the labelled texts, by
their hash, makes no dictionary but calibrates the thresholds; equal texts are on one side.

Defined results: a null text counts as empty; an empty text has the score of a
text without any suspect window; rows are scored one by one, so repeated rows and
ties get equal scores; with no toxic or no ordinary training row every score is
the share of toxic training rows (0 without any). Texts of any length are cut into
windows, all of which count. A labelled text over a class's whole byte bound is not learned from. Of texts too few
to train on (zstandard says so), the texts themselves are the dictionary.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm import words as W
from millrace.llm.columns import col, renamed
from millrace.storage import materialize, release

#: Bytes of a window, and how much two windows in a row share: longer than most words.
WINDOW, OVERLAP = 96, 14
#: Labelled rows of each class that the model is fitted on, at most, the first in hash order, and bytes of their whole texts.
MAX_TOXIC, MAX_ORDINARY = 4000, 8000
MAX_TOXIC_TEXT, MAX_ORDINARY_TEXT = 16 << 20, 32 << 20
#: Bytes of the dictionaries, and the lengths that zstandard selects their segments by.
TOXIC_BYTES, ORDINARY_BYTES = 16_000, 128_000
SEGMENT, PIECE = 12, 8
#: Ridge of the calibration, and the power of the classes' ratio that toxic rows are weighted by: a miss costs more than a false alarm.
RIDGE, BALANCE = 1.0, 0.5


def lower(text: str | None) -> bytes:
    return b" " + (text or "").encode("utf-8", "surrogatepass").lower() + b" "


def dictionary(samples: list[bytes], size: int) -> bytes:
    """A zstandard dictionary trained on the samples; of too few to train on, the samples themselves."""
    import zstandard as z

    try:
        return z.train_dictionary(size, samples, k=SEGMENT, d=PIECE).as_bytes()
    except z.ZstdError:
        return b"".join(samples)[:size]


class Model:
    """Both dictionaries and the calibration; small and bounded, so it travels in the closure."""

    def __init__(self, toxic: bytes, ordinary: bytes, prior: float):
        self.toxic, self.ordinary, self.prior = toxic, ordinary, prior
        self.weights, self.mean, self.std = None, None, None
        self._tools = None

    def __getstate__(self):
        return self.__dict__ | {"_tools": None}

    def tools(self):
        if self._tools is None:
            import zstandard as z

            # a window has its whole dictionary searched, so equal content costs equal bytes under both
            how = z.ZstdCompressionParameters(window_log=20, chain_log=18, hash_log=17, search_log=7, min_match=4, target_length=32, strategy=z.STRATEGY_LAZY, write_content_size=False, write_checksum=False, write_dict_id=False)
            of = lambda content: z.ZstdCompressor(compression_params=how, dict_data=z.ZstdCompressionDict(content or b" " * 16, dict_type=z.DICT_TYPE_RAWCONTENT)).compress
            self._tools = of(self.ordinary), of(self.toxic + self.ordinary)
        return self._tools

    def features(self, text: str | None) -> tuple[float, ...]:
        """The largest savings of the toxic dictionary in bytes, and how many windows save how much."""
        ordinary, toxic = self.tools()
        b = lower(text)
        gains = [len(ordinary(w)) - len(toxic(w)) for w in (b[i : i + WINDOW] for i in range(0, max(1, len(b) - OVERLAP), WINDOW - OVERLAP))]
        gains.sort(reverse=True)
        top = (gains + [0] * 4)[:4]
        n, counts = len(gains), [sum(g >= k for g in gains) for k in (2, 3, 4, 5, 6, 8)]
        losses = [sum(g <= -k for g in gains) for k in (1, 2)]
        size = math.log1p(n)
        return (*(min(max(g, -1), 10) for g in top), *(math.log1p(c) for c in counts), *(c / n for c in counts), *(c / n for c in losses), size, sum(gains) / n, *(math.log1p(c) * size for c in counts[1:4]))

    def fit(self, features: list, labels: list[int]) -> None:
        """Logistic regression on the features of rows that the dictionaries have not seen."""
        x, y = np.array(features, dtype=float), np.array(labels, dtype=float)
        self.mean, self.std = x.mean(0), x.std(0) + 1e-9
        x = np.c_[np.ones(len(x)), (x - self.mean) / self.std]
        w = np.zeros(x.shape[1])
        cost = np.where(y == 1, ((y == 0).sum() / max(1, (y == 1).sum())) ** BALANCE, 1.0)
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            grad = x.T @ (cost * (p - y)) + RIDGE * np.r_[0, w[1:]]
            h = (x * (cost * p * (1 - p))[:, None]).T @ x + np.diag(np.r_[1e-6, np.full(x.shape[1] - 1, RIDGE)])
            step = np.linalg.solve(h, grad)
            w -= step
            if np.abs(step).max() < 1e-6:
                break
        self.weights = w

    def score(self, text: str | None) -> float:
        if self.weights is None:
            return self.prior
        x = (np.array(self.features(text)) - self.mean) / self.std
        return float(1 / (1 + math.exp(-min(30.0, max(-30.0, self.weights[0] + float(x @ self.weights[1:]))))))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; rows of remainder 1 are never learned from. A null id counts as 0."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)), F.lit(0))


def fit(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_ordinary: int = MAX_ORDINARY, toxic_text: int = MAX_TOXIC_TEXT, ordinary_text: int = MAX_ORDINARY_TEXT) -> Model:
    """Learn from a bounded sample of the labelled rows outside the held-out fold.

    The sample is the first rows of each class in hash order, so many and as long as their whole texts stay within the
    bytes, by default 48 MB in all; of repeated ids the least text by hash. Ids with contradictory labels or null ones are
    left out. A task for each class trains its dictionary, so the driver gets the dictionaries and a few numbers of each
    row of the calibration, but no text.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.min("toxic").alias("lo"), F.max("toxic").alias("hi")).where("lo = hi and lo in (0, 1)").where(fold(F.col("doc_id")) != 1)
    picked = None
    for value, most in ((1, max_toxic), (0, max_ordinary)):
        one = known.where(F.col("lo") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id", F.col("lo").alias("label"))
        picked = one if picked is None else picked.unionByName(one)

    # at most max_toxic + max_ordinary ids: a proven bound; a repeated id is one row before anything else
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    firsts = rows.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("t"), "text")).alias("p")).select("doc_id", "label", "p.text")
    upto = F.sum(F.octet_length("text")).over(Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id"))
    most = F.when(F.col("label") == 1, F.lit(toxic_text)).otherwise(F.lit(ordinary_text))
    fits = F.octet_length("text") <= most
    bounded = firsts.where(fits).withColumn("upto", upto).where(F.col("upto") <= most)
    sample = materialize(bounded.select("doc_id", F.col("label").cast("int").alias("label"), "text", (F.pmod(F.xxhash64("text"), F.lit(4)) == 3).alias("back")), "labelled")
    seen = {(r.label, r.back): r.n for r in sample.groupBy("label", "back").agg(F.count("*").alias("n")).collect()}
    n = {k: seen.get((k, True), 0) + seen.get((k, False), 0) for k in (0, 1)}
    prior = n[1] / (n[0] + n[1]) if n[0] + n[1] else 0.0
    if not n[0] or not n[1]:
        release(sample)
        return Model(b"", b"", prior)
    # a class with rows on one side only has them on both
    alone = [k for k in (0, 1) if (k, True) not in seen or (k, False) not in seen]
    part = lambda back: sample.where((F.col("back") == back) | F.col("label").isin(alone))
    sizes = {1: TOXIC_BYTES, 0: ORDINARY_BYTES}

    def train(group):
        import pyarrow as pa

        label = group.column("label")[0].as_py()
        ordered = group.sort_by("doc_id").column("text").to_pylist()
        made = dictionary([lower(t) for t in ordered], sizes[label])
        return pa.table({"label": pa.array([label], pa.int32()), "made": pa.array([made], pa.binary())})

    dictionaries = part(False).select("doc_id", "label", "text").groupBy("label").applyInArrow(train, "label int, made binary")
    made = {r.label: bytes(r.made) for r in dictionaries.collect()}
    model = Model(made[1], made[0], prior)

    @F.pandas_udf("array<double>")
    def features(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series([list(model.features(t)) for t in s])

    held = sorted(part(True).select("doc_id", "label", features("text").alias("x")).collect(), key=lambda r: r.doc_id)
    model.fit([r.x for r in held], [r.label for r in held])
    release(sample)
    return model


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= threshold); one pass, no shuffle.

    A user's columns of these names are called score_in and predicted_in.
    """

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series([model.score(t if isinstance(t, str) else None) for t in s], dtype="float64")
        W.give_back()

    out = renamed(docs, "score", "predicted").withColumn("score", scored(col(text)))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def clean(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """docs without the rows that score the threshold or more, all columns as they are."""

    @F.pandas_udf("boolean")
    def free(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series([model.score(t if isinstance(t, str) else None) < threshold for t in s], dtype=bool)
        W.give_back()

    return docs.where(free(col(text)))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs, labels)
    return score(docs.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "text"), model).drop("text")
