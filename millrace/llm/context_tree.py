"""Language-model scoring by context-tree weighting over bytes.

A byte is decomposed into eight binary decisions, each with the tree of the bytes
before it as contexts. Every node keeps a Krichevsky-Trofimov estimate of the training
counts; a decision's probability is the mixture over all depths with the posterior
weights of context-tree weighting, bottom up:

    P_w(s) = 1/2 P_KT(s) + 1/2 prod over children c of P_w(cs),  P_w = P_KT at the leaves.

A context in which a decision was never met in training adds nothing: the mixture ends at the
longest one in which it was. Text ends with a byte that UTF-8 never has (0xFF), which also
stands before its start.

The tree has every context of the training texts, so it grows with them, and is nowhere
held as a whole. Byte grams (a byte and the DEPTH before it) are counted in the pass over the
texts and dealt into buckets by the two nearest context bytes. All contexts below those two
lie in one bucket, which a task solves on its own; what depths 0 and 1 need of the buckets is
256 x 256 numbers. The result is a probability for each gram. To score, a worker
loads at most PASS_GRAMS of them, from the shared folder; larger tables take
several passes, each of which scores the positions whose contexts it has. Grams of the
texts to score that training never met are solved along with the others, with count 0.

The base model is over words: frequent words, at most WORDS because each has that share of all
tokens, are broadcast; all others meet their counts in a join.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import words as W
from millrace.llm.columns import col
from millrace.storage import materialize, new_path, release, small_batches

DEPTH = 5
#: Words whose counts are broadcast at most.
WORDS = 1 << 17
#: Distinct words that a task counts before it hands them on, and a quarter of the grams.
HELD = 300_000
#: Bytes that are counted or scored at once.
STEP = 1 << 20
#: Characters of text for which a nearest byte's contexts get one more bucket, up to 256.
BUCKET_CHARS = 1 << 27
#: Grams whose probabilities a worker holds at once, 12 bytes each (or one bucket's).
PASS_GRAMS = 16_000_000
END = 0xFF
LN2 = math.log(2)


def streams(texts: Iterator[bytes], depth: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]]:
    """(bytes, positions that count, [(text number, bytes of it)]) of about STEP bytes.

    Every text is led by `depth` end bytes and followed by one; a long text goes over
    several streams, each led by the bytes before it.
    """
    parts: list[bytes] = []
    marks: list[tuple[int, int]] = []
    size = 0
    lead = bytes([END]) * depth

    def out():
        b = np.frombuffer(b"".join(parts), dtype=np.uint8)
        keep = np.ones(len(b), dtype=bool)
        at = 0
        for _, n in marks:
            keep[at : at + depth] = False
            at += depth + n
        return b, np.flatnonzero(keep), list(marks)

    for number, t in enumerate(texts):
        whole = t + bytes([END])
        before = lead
        for i in range(0, len(whole), STEP):
            piece = whole[i : i + STEP]
            parts += (before, piece)
            marks.append((number, len(piece)))
            size += len(piece)
            before = (before + piece)[-depth:] if depth else b""
            if size >= STEP:
                yield out()
                parts, marks, size = [], [], 0
    if parts:
        yield out()


def grams(b: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The byte at each position and the `depth` before it as one number.

    Digit k from the top, 1 to depth, is the k-th byte before; the lowest byte is the symbol.
    """
    code = np.zeros(len(at), dtype=np.int64)
    for k in range(1, depth + 1):
        code = (code << 8) | b[at - k]
    return (code << 8) | b[at]


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with the sums of their counts."""
    if not keys:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.empty(0, dtype=np.int64)
    return k[first], np.add.reduceat(c, first) if len(first) else c


class Grams:
    """Counts of byte grams, merged as they come: two arrays of the distinct ones."""

    def __init__(self, depth: int):
        self.depth = depth
        self.clear()

    def clear(self) -> None:
        self.keys, self.counts = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        self.held: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, texts: Iterator[bytes], learn: bool = True) -> None:
        """Count the grams of the texts; not to learn from them, with count 0."""
        for b, at, _ in streams(texts, self.depth):
            keys, counts = np.unique(grams(b, at, self.depth), return_counts=True)
            self.held.append((keys, counts if learn else np.zeros_like(counts)))
            if len(self.held) == 12:
                self.merge()

    def merge(self) -> int:
        if self.held:
            self.keys, self.counts = merged([self.keys, *(k for k, _ in self.held)], [self.counts, *(c for _, c in self.held)])
            self.held = []
        return len(self.keys)


def pack(keys: np.ndarray, counts: np.ndarray | None = None) -> bytes:
    """Ascending keys and their counts, compressed: the bytes of the keys' differences, place by place."""
    import zstandard

    parts = [np.diff(keys, prepend=0)] + ([counts.astype(np.int64)] if counts is not None else [])
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(p.view(np.uint8).reshape(-1, 8).T).tobytes() for p in parts))


def unpack(blob: bytes, n: int, counted: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    import zstandard

    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8)
    of = lambda b: np.ascontiguousarray(b.reshape(8, n).T).view(np.int64)[:, 0]
    return np.cumsum(of(flat[: 8 * n])), of(flat[8 * n :]) if counted else None


def buckets_of(prefix: np.ndarray, split: int) -> np.ndarray:
    """Bucket of a context by its two nearest bytes (the nearest one above): split buckets for each nearest byte."""
    return (prefix >> 8) * split + ((prefix & 255) * 167 + 13 & 255) % split


_SMALL = np.cumsum(np.r_[0.0, np.log(np.arange(0, 4095) + 0.5)]) + math.lgamma(0.5), np.cumsum(np.r_[0.0, np.log(np.arange(1, 4096))])


def _lgamma(n: np.ndarray, half: bool) -> np.ndarray:
    """log gamma of n + 1/2 or n + 1, for counts n: a table, or Stirling's series."""
    table = _SMALL[0 if half else 1]
    out = table[np.minimum(n, len(table) - 1)]
    large = n >= len(table)
    if large.any():
        x = n[large] + (0.5 if half else 1.0)
        out[large] = (x - 0.5) * np.log(x) - x + 0.918938533204672741 + 1 / (12 * x) - 1 / (360 * x**3)
    return out


def log_kt(n: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of n decisions, so many of them ones."""
    return _lgamma(n - ones, True) + _lgamma(ones, True) - _lgamma(n, False) - math.log(math.pi)


def weighted(kt: np.ndarray, split: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log P_w, weight of the node's own estimate) from log P_KT and the children's product."""
    return np.logaddexp(kt, split) - LN2, 1 / (1 + np.exp(np.clip(split - kt, -700, 700)))


def solve(keys: np.ndarray, counts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all grams under one nearest byte and some of the next: what contexts of two bytes and more predict.

    (probability of each gram's eight bits, NaN where no such context has met the decision; for the 255 decisions
    of the nearest byte's node, by 1 << level | upper bits, the sum of the children's log P_w; counts of its 256 symbols).
    """
    ks, cs, up = {depth: keys}, {depth: counts}, {}
    for d in range(depth - 1, 0, -1):
        ks[d], up[d] = np.unique((ks[d + 1] >> 16 << 8) | (ks[d + 1] & 255), return_inverse=True)
        cs[d] = np.bincount(up[d], weights=cs[d + 1], minlength=len(ks[d])).astype(np.int64)
    go = {depth: np.arange(len(keys))}
    for d in range(depth - 1, 0, -1):
        go[d] = up[d][go[d + 1]]
    probs = np.empty((len(keys), 8), dtype=np.float32)
    below, symbols = np.zeros(256), np.zeros(256, dtype=np.int64)
    symbols[ks[1] & 255] = cs[1]
    one = (keys[:, None] >> np.arange(7, -1, -1) & 1).astype(bool)
    for level in range(8):
        node, n, ones, stop, starts = {}, {}, {}, {}, {}
        lpw = None
        for d in range(depth, 0, -1):
            prefix = ks[d] >> (8 - level)
            new = np.r_[True, prefix[1:] != prefix[:-1]]
            starts[d], node[d] = np.flatnonzero(new), np.cumsum(new) - 1
            split = None if lpw is None else np.bincount(node[d][up[d][starts[d + 1]]], weights=lpw, minlength=len(starts[d]))
            if d == 1:
                below[(1 << level) | (ks[1][starts[1]] & 255) >> (8 - level)] = split
                break
            n[d] = np.add.reduceat(cs[d], starts[d])
            ones[d] = np.add.reduceat(cs[d] * (ks[d] >> (7 - level) & 1), starts[d])
            kt = log_kt(n[d], ones[d])
            lpw, stop[d] = (kt, None) if split is None else weighted(kt, split)
        f = np.full(len(keys), np.nan)
        for d in range(depth, 1, -1):
            at = node[d][go[d]]
            met = n[d][at] > 0
            own = (np.where(one[:, level], ones[d][at], n[d][at] - ones[d][at]) + 0.5) / (n[d][at] + 1)
            if d < depth:
                w = stop[d][at]
                own = np.where(np.isnan(f), own, w * own + (1 - w) * f)
            f = np.where(met, own, np.nan)
        probs[:, level] = f
    return probs, below, symbols


class Top:
    """The root and the contexts of one byte, from what all buckets gave."""

    def __init__(self, below: np.ndarray, symbols: np.ndarray):
        """below, symbols: [256, 256] by nearest byte: sums of log P_w by decision, counts of symbols."""
        n, ones = np.zeros((257, 256), dtype=np.int64), np.zeros((257, 256), dtype=np.int64)
        every = np.r_[symbols, symbols.sum(0, keepdims=True)]  # the last row is the root's
        for level in range(7, -1, -1):
            a = np.arange(1 << level) + (1 << level)
            if level == 7:
                ones[:, a], n[:, a] = every[:, 1::2], every[:, 0::2] + every[:, 1::2]
            else:
                ones[:, a], n[:, a] = n[:, 2 * a + 1], n[:, 2 * a] + n[:, 2 * a + 1]
        kt = log_kt(n, ones)
        lpw, stop = weighted(kt[:256], below)
        self.n, self.ones = n, ones
        self.stop = np.r_[stop, weighted(kt[256:], lpw.sum(0, keepdims=True))[1]]

    def logs(self, keys: np.ndarray, probs: np.ndarray, depth: int) -> np.ndarray:
        """log10 probability of each gram."""
        near, sym = keys >> (8 * depth), keys & 255
        out = np.zeros(len(keys))
        for level in range(8):
            node, one = (1 << level) | sym >> (8 - level), (sym >> (7 - level) & 1).astype(bool)
            f = probs[:, level].astype(np.float64)
            for row in (near, 256):
                n, ones = self.n[row, node], self.ones[row, node]
                own, w = (np.where(one, ones, n - ones) + 0.5) / (n + 1), self.stop[row, node]
                f = np.where(n > 0, np.where(np.isnan(f), own, w * own + (1 - w) * f), np.nan)
            out += np.log10(np.where(np.isnan(f), 0.5, f))
        return out


class Table:
    """Probabilities of grams that a worker holds: ascending keys and log10 probabilities."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray]], depth: int):
        """parts: (ascending keys, logs) of buckets, which have no context of two bytes in common."""
        runs = []
        for k, v in parts:
            prefix = k >> (8 * (depth - 1))
            cuts = np.r_[0, np.flatnonzero(prefix[1:] != prefix[:-1]) + 1, len(k)]
            runs += [(int(prefix[a]), k[a:b], v[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()) if b > a]
        runs.sort(key=lambda r: r[0])
        self.depth = depth
        self.has = np.zeros(1 << 16, dtype=bool)
        self.has[[r[0] for r in runs]] = True
        self.keys = np.concatenate([r[1] for r in runs]) if runs else np.empty(0, dtype=np.int64)
        self.logs = np.concatenate([r[2] for r in runs]) if runs else np.empty(0, dtype=np.float32)

    def score(self, texts: list[bytes], mine: np.ndarray) -> np.ndarray:
        """Sum of the log10 probabilities of each text's bytes and end, as far as their two nearest bytes are `mine`."""
        out = np.zeros(len(texts))
        for b, at, marks in streams(iter(texts), self.depth):
            code = grams(b, at, self.depth)
            here = mine[code >> (8 * (self.depth - 1))]
            distinct, which = np.unique(code[here], return_inverse=True)
            found = np.minimum(np.searchsorted(self.keys, distinct), max(0, len(self.keys) - 1))
            if len(distinct) and (not len(self.keys) or (self.keys[found] != distinct).any()):
                raise ValueError("a text to score was not among those given to train()")
            p = np.zeros(len(code))
            p[here] = self.logs[found][which]
            sums = np.add.reduceat(p, np.cumsum([0] + [n for _, n in marks])[:-1])
            for (number, _), s in zip(marks, sums):
                out[number] += s
        return out


@dataclass
class Trained:
    """What score() needs: passes are (folder of a gram table, which contexts of two bytes it answers for)."""

    depth: int
    passes: list[tuple[str, bytes]]
    words: DataFrame
    tokens: int
    distinct: int
    texts: int
    frequent: dict[bytes, int]


_loaded: dict[str, Table] = {}


def _table(path: str, depth: int) -> Table:
    """A pass's table, loaded once in each Python worker; the last one is held."""
    if path not in _loaded:
        import pyarrow.parquet as pq

        from millrace.llm.warc import store

        _loaded.clear()
        fs, where = store(path)
        from pyarrow import fs as pafs

        parts = []
        for f in fs.get_file_info(pafs.FileSelector(where)) if fs.get_file_info(where).type != pafs.FileType.NotFound else []:
            if f.path.endswith(".parquet"):
                with fs.open_input_file(f.path) as source:
                    for batch in pq.ParquetFile(source).iter_batches(batch_size=64):
                        for n, k, v in zip(batch["n"].to_pylist(), batch["keys"], batch["logs"]):
                            parts.append((unpack(k.as_py(), n, False)[0], np.frombuffer(v.as_py(), dtype=np.float32)))
        _loaded[path] = Table(parts, depth)
    return _loaded[path]


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 7; rows of remainder 2 are never learned from. A null id counts as 0."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(7)), F.lit(0))


def _texts(column) -> Iterator[bytes]:
    for x in column:
        yield W.encoded(x.as_py())


def _tallies(docs: DataFrame, depth: int, split: int) -> DataFrame:
    """(word, c, bucket, n, grams) of docs (text, learn): counts of each partition's words, or packed grams of a bucket."""

    def run(batches):
        import pyarrow as pa

        names = ["word", "c", "bucket", "n", "grams"]

        def of_words(found: Counter):
            words, counts = list(found.keys()), list(found.values())
            for i in range(0, len(words), 1 << 16):
                part = words[i : i + (1 << 16)]
                yield pa.record_batch([pa.array(part, pa.binary()), pa.array(counts[i : i + (1 << 16)], pa.int64()), pa.nulls(len(part), pa.int32()), pa.nulls(len(part), pa.int64()), pa.nulls(len(part), pa.binary())], names=names)

        def of_grams(found: Grams):
            found.merge()
            bucket = buckets_of(found.keys >> (8 * (depth - 1)), split)
            order = np.argsort(bucket, kind="stable")
            keys, counts, bucket = found.keys[order], found.counts[order], bucket[order]
            cuts = np.r_[0, np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(bucket)].tolist() if len(bucket) else [0]
            rows = [(int(bucket[a]), b - a, pack(keys[a:b], counts[a:b])) for a, b in zip(cuts[:-1], cuts[1:])]
            for i in range(0, len(rows), 512):
                part = rows[i : i + 512]
                yield pa.record_batch([pa.nulls(len(part), pa.binary()), pa.nulls(len(part), pa.int64()), *(pa.array([r[k] for r in part], kind) for k, kind in enumerate((pa.int32(), pa.int64(), pa.binary())))], names=names)

        words: Counter = Counter()
        found = Grams(depth)
        for batch in batches:
            learn = batch.column(1).to_pylist()
            texts = list(_texts(batch.column(0)))
            for t, wanted in zip(texts, learn):
                if wanted:
                    for _, w in W.pieces(t, 0):
                        words.update(w)
            for value in (True, False):
                if part := [t for t, wanted in zip(texts, learn) if wanted is value]:
                    found.add(iter(part), value)
            # handed on when they are many: memory does not follow the partition
            if len(words) > HELD:
                yield from of_words(words)
                words.clear()
            if len(found.keys) > 4 * HELD:
                yield from of_grams(found)
                found.clear()
        yield from of_words(words)
        yield from of_grams(found)

    return docs.mapInArrow(run, "word binary, c long, bucket int, n long, grams binary")


def _solved(tallies: DataFrame, depth: int) -> DataFrame:
    """(bucket, n, keys, probs, below, symbols): every bucket's grams with what solve() says of them, as bytes."""

    def run(table):
        import pyarrow as pa

        parts = [unpack(g.as_py(), n.as_py()) for g, n in zip(table.column("grams"), table.column("n"))]
        keys, counts = merged([k for k, _ in parts], [c for _, c in parts])
        del parts
        probs, below, symbols = solve(keys, counts, depth)
        return pa.table({"bucket": pa.array([table.column("bucket")[0].as_py()], pa.int32()), "n": pa.array([len(keys)], pa.int64()), **{k: pa.array([v], pa.binary()) for k, v in (("keys", pack(keys)), ("probs", probs.tobytes()), ("below", below.tobytes()), ("symbols", symbols.tobytes()))}})

    return tallies.where("bucket is not null").select("bucket", "n", "grams").groupBy("bucket").applyInArrow(run, "bucket int, n long, keys binary, probs binary, below binary, symbols binary")


def train(docs: DataFrame, text: str = "text", learn: Column | None = None, depth: int = DEPTH, words: int = WORDS, pass_grams: int = PASS_GRAMS) -> Trained:
    """Learn from the rows of docs where `learn` holds (all by default); score() takes texts of any of its rows.

    Null texts count as empty ones; a null condition as false. Of words, tokens is the count of all and one end for
    each text, distinct that of the distinct ones with the end.
    """
    if depth < 2:
        raise ValueError("the depth must be 2 at least")
    spark = docs.sparkSession
    plain = docs.select(col(text).alias("text"), (F.coalesce(learn, F.lit(False)) if learn is not None else F.lit(True)).alias("learn"))
    chars, texts = plain.agg(F.sum(F.char_length("text")), F.count(F.when(F.col("learn"), 1))).first()
    split = min(256, max(1, (chars or 0) // BUCKET_CHARS))
    with small_batches(spark):
        tallies = materialize(_tallies(plain, depth, split), "tallies")
    counts = materialize(tallies.where("word is not null").groupBy("word").agg(F.sum("c").alias("c")), "words")
    total = counts.agg(F.sum("c"), F.count("*")).first()
    tokens, distinct = (total[0] or 0) + texts, total[1] + (1 if texts else 0)
    frequent = counts.where(F.col("c") >= max(2, -(-tokens // words))).select("word", "c").toPandas()
    solved = materialize(_solved(tallies, depth), "solved")
    release(tallies)
    below, symbols = np.zeros((256, 256)), np.zeros((256, 256), dtype=np.int64)
    sizes: dict[int, int] = {}
    for r in solved.select("bucket", "n", "below", "symbols").toLocalIterator():  # one row for each bucket, 65,536 at most
        below[r.bucket // split] += np.frombuffer(r.below)
        symbols[r.bucket // split] += np.frombuffer(r.symbols, dtype=np.int64)
        sizes[r.bucket] = r.n
    passes: list[list[int]] = [[]]
    held = 0
    for bucket in sorted(sizes):
        if passes[-1] and held + sizes[bucket] > pass_grams:
            passes.append([])
            held = 0
        passes[-1].append(bucket)
        held += sizes[bucket]
    top = spark.sparkContext.broadcast(Top(below, symbols))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for n, k, p in zip(batch["n"].to_pylist(), batch["keys"], batch["probs"]):
                keys = unpack(k.as_py(), n, False)[0]
                out.append(top.value.logs(keys, np.frombuffer(p.as_py(), dtype=np.float32).reshape(n, 8), depth).astype(np.float32).tobytes())
            yield pa.record_batch([batch["n"], batch["keys"], pa.array(out, pa.binary())], names=["n", "keys", "logs"])

    every = buckets_of(np.arange(1 << 16), split)
    done = []
    for mine in passes:
        path = new_path(spark, "grams")
        with small_batches(spark, 16):
            part = solved if len(passes) == 1 else solved.where(F.col("bucket").between(mine[0], mine[-1]))
            part.select("n", "keys", "probs").mapInArrow(run, "n long, keys binary, logs binary").write.parquet(path)
        done.append((path, np.packbits(np.isin(every, mine) if len(passes) > 1 else np.ones(1 << 16, dtype=bool)).tobytes()))
    release(solved)
    return Trained(depth, done, counts, tokens, distinct, texts, dict(zip((bytes(w) for w in frequent["word"]), frequent["c"].tolist())))


def score(docs: DataFrame, trained: Trained, doc_id: str = "doc_id", text: str = "text", held_out: Column | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of docs.

    Nulls count as empty texts, which are one end; rows are told apart by their place in
    the pass, so repeated rows and ids are scored each; nothing learned: base and score are
    those of empty counts. Further passes over the gram table are added by the hash of the text, as
    equal texts have equal scores.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast({w: math.log10(c + 1) for w, c in trained.frequent.items()})
    kind = dict(docs.dtypes)[doc_id]
    schema = f"row string, doc_id {kind}, held_out boolean, h long, n_tokens long, n_known long, known double, score double, word binary, tf long"
    depth, passes = trained.depth, trained.passes
    mask = lambda bits: np.unpackbits(np.frombuffer(bits, dtype=np.uint8)).astype(bool)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        logs, table, mine = shared.value, _table(passes[0][0], depth), mask(passes[0][1])
        k = 0
        for batch in batches:
            texts = list(_texts(batch.column(3)))
            rows: dict[str, list] = {c: [] for c in ("row", "n_tokens", "n_known", "known")}
            rare: tuple[list, list, list] = ([], [], [])
            for t in texts:
                row, total, known, found = f"{part}-{k}", 0, 0.0, 0
                k += 1
                odd: Counter = Counter()
                for _, w in W.pieces(t, 0):
                    total += len(w)
                    got = [x for x in map(logs.get, w) if x is not None]
                    found += len(got)
                    known += math.fsum(got)
                    if len(got) < len(w):
                        odd.update(x for x in w if x not in logs)
                for w, c in odd.items():
                    rare[0].append(row)
                    rare[1].append(w)
                    rare[2].append(c)
                for c, x in zip(rows, (row, total, found, known)):
                    rows[c].append(x)
            m, r = len(texts), len(rare[0])
            cut = pa.RecordBatch.from_arrays
            names = ["row", "doc_id", "held_out", "h", "n_tokens", "n_known", "known", "score", "word", "tf"]
            yield cut([pa.array(rows["row"], pa.string()), batch.column(0), batch.column(1), batch.column(2), pa.array(rows["n_tokens"], pa.int64()), pa.array(rows["n_known"], pa.int64()), pa.array(rows["known"], pa.float64()), pa.array(table.score(texts, mine)), pa.nulls(m, pa.binary()), pa.nulls(m, pa.int64())], names=names)
            for i in range(0, r, 1 << 16):
                j = min(r, i + (1 << 16)) - i
                yield cut([pa.array(rare[0][i : i + j], pa.string()), pa.nulls(j, batch.column(0).type), pa.nulls(j, pa.bool_()), *(pa.nulls(j, pa.int64()) for _ in range(3)), pa.nulls(j, pa.float64()), pa.nulls(j, pa.float64()), pa.array(rare[1][i : i + j], pa.binary()), pa.array(rare[2][i : i + j], pa.int64())], names=names)

    held = held_out if held_out is not None else F.lit(False)
    hashed = F.xxhash64(col(text)).alias("h")
    with small_batches(spark):
        passed = materialize(docs.select(col(doc_id), held.alias("held_out"), hashed, col(text)).mapInArrow(run, schema), "scored")
    n, v, ends = trained.tokens, trained.distinct, trained.texts
    rare = passed.where("word is not null").select("row", "word", "tf").join(trained.words, "word").groupBy("row").agg(F.sum("tf").alias("more"), F.sum(F.col("tf") * F.log10(F.col("c") + 1)).alias("add"))
    out = passed.where("word is null").drop("word", "tf").join(rare, "row", "left")
    more = None
    for path, bits in passes[1:]:

        def other(batches, path=path, bits=bits):
            import pyarrow as pa

            table, mine = _table(path, depth), mask(bits)
            for batch in batches:
                yield pa.record_batch([batch.column(0), pa.array(table.score(list(_texts(batch.column(1))), mine))], names=["h", "part"])

        with small_batches(spark):
            one = materialize(docs.select(hashed, col(text)).mapInArrow(other, "h long, part double").groupBy("h").agg(F.first("part").alias("part")), "part")
        more = one if more is None else more.unionByName(one)
    if more is not None:
        out = out.join(more.groupBy("h").agg(F.sum("part").alias("part")), "h").withColumn("score", F.col("score") + F.col("part"))
    whole = math.log10(n + 1.0 * (v + 1))
    tokens = F.col("n_tokens") + 1
    return out.select("doc_id", "held_out", tokens.alias("n_tokens"), (F.col("n_known") + F.coalesce("more", F.lit(0)) + (1 if ends else 0)).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("known") + F.coalesce("add", F.lit(0.0)) + math.log10(ends + 1) - tokens * whole).alias("base_score"), "score")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    trained = train(docs, learn=fold(F.col("doc_id")) != 2)
    return score(docs, trained, held_out=fold(F.col("doc_id")) == 2)
