"""Benchmark decontamination by SimHash windows.

A window has as many words as the benchmark item it is held against. Its SimHash
over five-word shingles is looked up in a multi-index: fingerprints are cut into
radius + 1 blocks, so every item within the radius shares one block value with the
window. Candidates are verified by the exact weighted similarity of the shingle
multisets (sum of minima over sum of maxima of shingle counts).

Which windows are made is lossless too. A window at the similarity holds at least
`need` of the item's n shingles, so it holds one of any n - need + 1 of them: only the
item's rarest ones are looked for. Where one is found, the windows of the item's length
that hold `need` of its shingles are made, at whatever place they start.

Defined results: null and empty texts or items give no rows; items or texts of
fewer words than a shingle have one shingle, of them all; of several windows the
most similar (then the first) is reported, one row per document row and item;
repeated rows are judged alike; an empty benchmark or table gives no rows. clean()
keeps all columns as they are, whatever their names.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import words as W
from millrace.llm.columns import col

SIZE, SIMILARITY, RADIUS = 5, 0.8, 20
#: Bytes of benchmark text that one pass holds; a larger benchmark takes several passes.
PASS_BYTES = 16 << 20


def _grams(words: list[bytes], size: int = SIZE) -> np.ndarray:
    """A cheap hash of every shingle, the same within one process: it only places windows."""
    n = len(words)
    h = np.fromiter(map(hash, words), dtype=np.int64, count=n).view(np.uint64)
    if n < size:
        size = n
    out = np.zeros(n - size + 1, dtype=np.uint64)
    for k in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : n - size + 1 + k]
    return out


def least_shared(mine: int, other: int, similarity: float) -> int:
    """Shingles that two multisets of these sizes have in common at least, at the similarity."""
    return max(1, int(np.ceil(similarity * (mine + other) / (1 + similarity) - 1e-9)))


class Index:
    """Items of one pass: rare shingles, fingerprints in blocks, shingle counts."""

    def __init__(self, items: list[tuple], radius: int, similarity: float = SIMILARITY):
        self.items = [(i, w) for i, t in items if (w := W.encoded(t).split())]
        self.radius, self.similarity = radius, similarity
        hashed = [W.hashes(w, SIZE) for _, w in self.items]
        self.counts = [Counter(h.tolist()) for h in hashed]
        prints = [W.majority(W.bit_counts(h), len(h)) for h in hashed]
        self.prints = np.array(prints, dtype=np.uint64)
        cuts = [64 * i // (radius + 1) for i in range(radius + 2)]
        self.cuts = list(zip(cuts, cuts[1:]))
        self.blocks: list[dict[int, list[int]]] = [defaultdict(list) for _ in self.cuts]
        for j, p in enumerate(prints):
            for table, (a, b) in zip(self.blocks, self.cuts):
                table[(p >> a) & ((1 << (b - a)) - 1)].append(j)
        self.sizes = sorted({min(SIZE, len(w)) for _, w in self.items} | {SIZE})
        self.longest = max((len(w) for _, w in self.items), default=0)
        self.grams = [_grams(w) for _, w in self.items]
        held: Counter = Counter()
        for g in self.grams:
            held.update(set(g.tolist()))
        self.rare: dict[int, list[int]] = defaultdict(list)
        for j, g in enumerate(self.grams):
            # a text shorter than the item has fewer shingles: the least any text can do with
            need = max(1, int(np.ceil(similarity * len(g) - 1e-9)))
            left = len(g)
            for x, c in sorted(Counter(g.tolist()).items(), key=lambda e: (held[e[0]], e[0])):
                if left < need:
                    break
                self.rare[x].append(j)
                left -= c
        self.bits = 22
        self.filter = np.zeros(1 << self.bits, dtype=bool)
        keys = np.array(list(self.rare), dtype=np.uint64)
        self.filter[(keys >> np.uint64(64 - self.bits)).astype(np.int64)] = True

    def near(self, fp: int) -> np.ndarray:
        """Items within the radius of a fingerprint: the union of its blocks' lists, by true distance."""
        met: set[int] = set()
        for table, (a, b) in zip(self.blocks, self.cuts):
            met.update(table.get((fp >> a) & ((1 << (b - a)) - 1), ()))
        found = np.fromiter(met, dtype=np.int64, count=len(met))
        if not len(found):
            return found
        return found[np.bitwise_count(self.prints[found] ^ np.uint64(fp)) <= self.radius]

    def meets(self, fp: int, j: int) -> bool:
        """Is item j in near(fp)? The same test for one item: a block in common, then the distance."""
        apart = int(self.prints[j]) ^ fp
        return any(not (apart >> a) & ((1 << (b - a)) - 1) for a, b in self.cuts) and apart.bit_count() <= self.radius

    def starts(self, grams: np.ndarray, hits: list[int], j: int, n_words: int) -> list[int]:
        """First words of all windows that can have the similarity with item j; hits: places of its rare shingles."""
        own, length = self.grams[j], len(self.items[j][1])
        if n_words <= length:
            shared = int(np.isin(grams, own).sum())
            return [0] if shared >= least_shared(len(own), len(grams), self.similarity) else []
        need, reach = least_shared(len(own), len(own), self.similarity), len(own) - 1
        found: set[int] = set()
        done = -1
        for p in hits:
            if p <= done:
                continue
            # windows that hold a hit lie within `reach` of it; hits within reach of each other share a stretch
            a, b = max(0, p - reach), min(len(grams), p + reach + 1)
            k = hits.index(p)
            while k + 1 < len(hits) and hits[k + 1] < b + reach:
                k += 1
                b = min(len(grams), hits[k] + reach + 1)
            done = hits[k]
            at = a + np.flatnonzero(np.isin(grams[a:b], own))
            if len(at) >= need:
                low = np.maximum(at[need - 1 :] - reach, 0)
                high = np.minimum(at[: len(at) - need + 1], n_words - length)
                for x, y in zip(low.tolist(), high.tolist()):
                    found.update(range(x, y + 1))
        return sorted(found)

    def search(self, text) -> Iterator[tuple]:
        """(item, similarity, Hamming distance, first word, words) of the best window of every item found."""
        best: dict[int, tuple] = {}
        for j, row in self.windows(text):
            if j not in best or row < best[j]:
                best[j] = row
        for j, (s, at, d, length) in sorted(best.items()):
            yield self.items[j][0], -s, d, at, length

    def windows(self, text) -> Iterator[tuple]:
        """(item number, (-similarity, first word, distance, words)) of every window at the similarity."""
        for first, words in W.pieces(W.encoded(text), 2 * self.longest + SIZE):
            if not words:
                continue
            for size in self.sizes:
                if size < SIZE and len(words) < size:
                    continue
                grams = _grams(words, size)
                hits: dict[int, list[int]] = defaultdict(list)
                for p in np.flatnonzero(self.filter[(grams >> np.uint64(64 - self.bits)).astype(np.int64)]).tolist():
                    for j in self.rare.get(int(grams[p]), ()):
                        # a short item's shingles are of all its words
                        if min(SIZE, len(self.items[j][1])) == size or len(words) < SIZE:
                            hits[j].append(p)
                for j, at in hits.items():
                    length = len(self.items[j][1])
                    for start in self.starts(grams, at, j, len(words)):
                        n = min(length, len(words) - start)
                        h = W.hashes(words[start : start + n], SIZE)
                        fp = W.majority(W.bit_counts(h), len(h))
                        if not self.meets(fp, j):
                            continue
                        mine = Counter(h.tolist())
                        low = sum((mine & self.counts[j]).values())
                        s = low / (mine.total() + self.counts[j].total() - low)
                        if s >= self.similarity:
                            yield j, (-s, first + start, (int(self.prints[j]) ^ fp).bit_count(), n)


def _passes(bench: DataFrame, limit: int) -> Iterator[list[tuple]]:
    """The benchmark in parts of at most `limit` bytes (or one item)."""
    part, size = [], 0
    for r in bench.toLocalIterator():
        n = len((r[1] or "").encode("utf-8", "surrogatepass"))
        if part and size + n > limit:
            yield part
            part, size = [], 0
        part.append((r[0], r[1]))
        size += n
    if part:
        yield part


def matches(docs: DataFrame, bench: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY, radius: int = RADIUS, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(doc_id, row_key, item_id, similarity, hamming, start_word, n_words): contaminated windows.

    The documents are never shuffled; each pass broadcasts at most pass_bytes of benchmark.
    row_key is the hash of the text, by which rows without an id are told apart.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = dict(bench.dtypes)[item_id]
    ids = dict(docs.dtypes)[doc_id]
    schema = f"doc_id {ids}, row_key long, item_id {kind}, similarity double, hamming int, start_word long, n_words int"
    nothing = docs.sparkSession.createDataFrame([], schema)
    target = to_arrow_schema(nothing.schema)
    out = None
    for part in _passes(bench.select(col(item_id), col(item_text)), pass_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(part)

        def run(batches, shared=shared):
            index = Index(shared.value, radius, similarity)
            for batch in batches:
                rows = []
                for i, k, t in zip(batch.column(0), batch.column(1), batch.column(2)):
                    for found in index.search(t.as_py()):
                        rows.append((i.as_py(), k.as_py(), *found))
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(target.names, r)) for r in rows], schema=target)

        found = docs.select(col(doc_id), F.xxhash64(col(text)).alias("k"), col(text)).mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else nothing


def _free(shared, radius: int, similarity: float):
    """Is a text free of all items of a broadcast part?"""

    @F.pandas_udf("boolean")
    def free(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = Index(shared.value, radius, similarity)
        for s in parts:
            yield pd.Series([next(index.windows(t), None) is None for t in s], dtype=bool)
        W.give_back()

    return free


def clean(docs: DataFrame, bench: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY, radius: int = RADIUS, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """docs without the rows that hold a benchmark passage: judged in the pass that reads them, without a shuffle."""
    for part in _passes(bench.select(col(item_id), col(item_text)), pass_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(part)

        docs = docs.where(_free(shared, radius, similarity)(col(text)))
    return docs


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return matches(docs, bench).select("doc_id", "item_id", F.round("similarity", 6).alias("similarity"), "hamming", "start_word", "n_words")
