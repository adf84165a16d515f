"""Near copies at a shingle similarity, by SimHash blocks over buckets of the shingles.

64 bits of one SimHash cannot hold a similarity of 0.8 to a few differing bits. The
fingerprint is therefore made of many SimHashes: a text's set of five-word shingles is
dealt into buckets by hash, and each block of the fingerprint is the SimHash of one bucket.
Two texts at the similarity differ in at most a known number of shingles; there is one
bucket more than that, so by the pigeonhole principle a bucket is equal in both, and so is
its block. Texts of few shingles get blocks for all their buckets, several times over;
others for BLOCKS of them, of which one at least is shared but for about 1 pair in
1000 at exactly the similarity (see plan()), whatever kind of edit lies between. The
number of blocks does not grow with the corpus.

Pairs that share a block are compared by the Hamming distance of a long SimHash of the
whole set. Far ones go and surely close ones are linked (MARGIN, SURE); those between are
compared by their exact sets, so links are those of the similarity itself.

A block value shared by over HOT texts is not expanded into all pairs. Its members are
compared with a centre first, then, in rounds, those outside the largest component
with a few more members of it, and at last all that the components still leave apart.
So no link between different groups is lost, and few of those within one are made.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import words as W
from millrace.llm.columns import col, fresh, small
from millrace.operators.components import connected_components
from millrace.storage import materialize, release, small_batches

SIMILARITY = 0.8
VERIFY_BITS = 1024
BLOCKS = 16
HOT, ROUNDS, CENTRES = 16, 2, 8
#: Standard deviations of the Hamming distance at the similarity: beyond the first no link, under the second one for sure.
MARGIN, SURE = 3.0, 4.0
LONGS = VERIFY_BITS // 64


def share(similarity: float) -> float:
    """Expected share of differing bits of two texts whose shingle sets have this Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def plan(n: int, similarity: float = SIMILARITY) -> list[tuple[int, int, int]]:
    """(level, buckets, dealings) under which a text of n distinct shingles has blocks.

    Levels are powers of two, so that both texts of a pair have one level in common: a text
    near the top of its level has blocks for the next one too. A pair whose larger text
    has under 2 ** (level + 1) shingles differs in fewer than `buckets` of them.
    """
    own = max(0, n.bit_length() - 1)
    levels = [own] + ([own + 1] if n >= similarity * 2 ** (own + 1) else [])
    out = []
    for level in levels:
        buckets = max(1, math.ceil(2 ** (level + 1) * (1 - similarity) / similarity - 1e-9))
        out.append((level, buckets, 1 if buckets == 1 else max(1, BLOCKS // buckets)))
    return out


def bounds(similarity: float) -> tuple[int, int]:
    """(sure, most): Hamming distances up to which a pair is linked unseen, and beyond which it is not compared."""
    mean = VERIFY_BITS * share(similarity)
    sd = math.sqrt(mean * (1 - share(similarity)))
    return int(mean - SURE * sd), int(mean + MARGIN * sd)


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """k independent 64-bit words of every hash."""
    odd = np.arange(1, 2 * k, 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (h[:, None] ^ (h[:, None] >> np.uint64(31))) * (odd | np.uint64(1))[None, :]
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingle_set(text, size: int = 5) -> np.ndarray:
    """Distinct hashes of the shingles of a whole text, ascending."""
    out = np.empty(0, dtype=np.uint64)
    for first, words in W.pieces(W.encoded(text), size - 1):
        if not first or len(words) >= size:
            out = np.union1d(out, W.hashes(words, size))
    return out


def long_simhash(h: np.ndarray, bits: int = VERIFY_BITS) -> bytes:
    """SimHash of a set of shingle hashes: repeats count once, as in the similarity."""
    k = -(-bits // 64)
    counts = np.zeros(k * 64, dtype=np.int64)
    for i in range(0, len(h), 250):  # sums of up to 250 ones fit a byte
        ones = np.unpackbits(_mixed(h[i : i + 250], k).view(np.uint8), axis=1, bitorder="little")
        counts += np.add.reduce(ones, axis=0, dtype=np.uint8)
    return np.packbits((counts * 2 > len(h))[:bits].astype(np.uint8), bitorder="little").tobytes()


def blocks(h: np.ndarray, similarity: float = SIMILARITY) -> list[int]:
    """The SimHash of every bucket that has shingles, hashed with its place, as signed longs."""
    out = []
    for level, buckets, dealings in plan(len(h), similarity) if len(h) else []:
        for dealing in range(dealings):
            mixed = (h ^ np.uint64(dealing * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xD6E8FEB86659FD93)
            bucket = ((mixed ^ (mixed >> np.uint64(32))) >> np.uint64(7)) % np.uint64(buckets)
            chosen = np.flatnonzero(bucket < min(buckets, BLOCKS))
            order = chosen[np.argsort(bucket[chosen], kind="stable")]
            if not len(order):
                continue
            of = bucket[order]
            starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            ones = np.unpackbits(h[order].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            sizes = np.diff(np.r_[starts, len(order)])
            bits = np.add.reduceat(ones.astype(np.int32), starts, axis=0) * 2 > sizes[:, None]
            prints = np.packbits(bits.astype(np.uint8), axis=1, bitorder="little").view(np.uint64)[:, 0]
            for b, p in zip(of[starts].tolist(), prints.tolist()):
                out.append(xxhash.xxh64_intdigest(b"%d %d %d %d" % (level, dealing, b, p)) - (1 << 63))
    return out


def sig_and_blocks(text, similarity: float = SIMILARITY) -> tuple[bytes, list[int]]:
    h = shingle_set(text)
    return long_simhash(h), blocks(h, similarity)


def prints(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(id, t, sig, blocks) of docs (id, text): t is the hash of the text; texts with equal words have equal sig and blocks."""

    @F.pandas_udf("sig binary, blocks array<long>")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in parts:
            yield pd.DataFrame([sig_and_blocks(t, similarity) for t in s], columns=["sig", "blocks"])
        W.give_back()

    return docs.select("id", F.xxhash64("text").alias("t"), of("text").alias("p")).select("id", "t", "p.sig", "p.blocks")


def classes_of(marked: DataFrame) -> DataFrame:
    """(key, id, t, blocks, w0...): one row for each distinct signature; id (the least) and t name one text of it."""
    one = marked.groupBy("sig").agg(F.min(F.struct(F.col("id").isNull(), "id", "t")).alias("rep"), F.first("blocks").alias("blocks"))
    words = (F.conv(F.hex(F.substring("sig", 8 * i + 1, 8)), 16, -10).cast("long").alias(f"w{i}") for i in range(LONGS))
    return one.select(F.xxhash64("sig").alias("key"), "rep.id", "rep.t", "blocks", *words)


def _apart(a: str, b: str) -> Column:
    return F.expr(" + ".join(f"bit_count({a}.w{i} ^ {b}.w{i})" for i in range(LONGS)))


class Links:
    """Links found so far among the classes, and their components: (key, c), a class without a link being absent."""

    def __init__(self, classes: DataFrame, docs: DataFrame, similarity: float, repeats: bool):
        """repeats: may docs have a text of one id more than once?"""
        self.classes, self.docs, self.similarity, self.repeats = classes, docs, similarity, repeats
        self.sure, self.most = bounds(similarity)
        self.sigs = classes.select("key", *(f"w{i}" for i in range(LONGS)))
        self.comp: DataFrame | None = None

    def named(self, keyed: DataFrame) -> DataFrame:
        """keyed (key, ...) with its component c."""
        if self.comp is None:
            return keyed.withColumn("c", F.col("key"))
        return keyed.join(self.comp, "key", "left").withColumn("c", F.coalesce("c", "key"))

    def measured(self, pairs: DataFrame) -> DataFrame:
        """(src, dst, apart) of the pairs within `most`; the join compares and only gives what is close.

        Pairs that come with the words of src's signature are distinct already.
        """
        met = pairs if "w0" in pairs.columns else pairs.distinct().join(self.sigs.withColumnRenamed("key", "src"), "src")
        far = met.alias("a").join(self.sigs.withColumnRenamed("key", "dst").alias("b"), (F.col("a.dst") == F.col("b.dst")) & (_apart("a", "b") <= self.most))
        return far.select("a.src", "a.dst", _apart("a", "b").alias("apart"))

    def add(self, pairs: DataFrame) -> None:
        """Link those of the pairs (src, dst) that have the similarity."""
        near = materialize(self.measured(pairs), "near")
        new = near.where(F.col("apart") <= self.sure).select("src", "dst")
        doubt = near.where(F.col("apart") > self.sure).select("src", "dst")
        if not doubt.isEmpty():
            new = new.unionByName(self.exact(doubt))
        self.unite(new)
        release(near)

    def unite(self, new: DataFrame) -> None:
        """Take links (src, dst) into the components."""
        new = materialize(new, "links")
        if not new.isEmpty() and self.comp is None:
            self.comp = materialize(connected_components(new).select(F.col("node").alias("key"), F.col("component").alias("c")), "comp")
        elif not new.isEmpty():
            # only the components' own graph is searched again
            a = self.comp.select(F.col("key").alias("src"), F.col("c").alias("a"))
            b = self.comp.select(F.col("key").alias("dst"), F.col("c").alias("b"))
            over = new.join(a, "src", "left").join(b, "dst", "left").select(F.coalesce("a", "src").alias("src"), F.coalesce("b", "dst").alias("dst"))
            merged = materialize(connected_components(over).select("node", "component"), "merged")
            old = self.comp
            moved = old.join(merged.withColumnRenamed("node", "c"), "c", "left").select("key", F.coalesce("component", "c").alias("c"))
            first = merged.join(old.select(F.col("key").alias("node")), "node", "left_anti").select(F.col("node").alias("key"), F.col("component").alias("c"))
            self.comp = materialize(moved.unionByName(first), "comp")
            release(old, merged)
        release(new)

    def sets(self, keys: DataFrame) -> DataFrame:
        """(key, s, n): the shingle sets of the classes `keys`, each of them once.

        Only their texts are read again. The hashes have 32 bits: of two texts of 20,000
        words a tenth of a shingle is equal by chance.
        """
        wanted = materialize(self.classes.join(keys, "key", "left_semi").select("key", F.col("id").alias("i"), F.col("t").alias("k")), "ends")

        @F.pandas_udf("array<int>")
        def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in parts:
                yield pd.Series([np.unique(shingle_set(t).astype(np.uint32)).view(np.int32) for t in s])
            W.give_back()

        met = self.docs.join(small(wanted), F.expr("xxhash64(text) = k and id <=> i"))
        with small_batches(self.docs.sparkSession, 256):
            held = materialize(met.select("key", of("text").alias("s")).withColumn("n", F.size("s")), "sets")
        release(wanted)
        # repeated rows give one set
        return materialize(held.dropDuplicates(["key"]), "sets") if self.repeats else held

    def alike(self, a: str, b: str) -> Column:
        """Do two rows with s and n have the similarity? Unlike sizes are told without a look at the sets."""
        t = self.similarity
        return F.expr(f"least({a}.n, {b}.n) >= {t} * greatest({a}.n, {b}.n) and size(array_intersect({a}.s, {b}.s)) * {1 + t} >= {t} * ({a}.n + {b}.n) - 1e-6")

    def exact(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose texts' shingle sets have the similarity."""
        held = self.sets(pairs.select(F.col("src").alias("key")).unionByName(pairs.select(F.col("dst").alias("key"))).distinct())
        sizes = held.select("key", "n")
        fits = F.least("m", "n") >= self.similarity * F.greatest("m", "n")
        kept = pairs.join(sizes.select(F.col("key").alias("src"), F.col("n").alias("m")), "src").join(sizes.withColumnRenamed("key", "dst"), "dst").where(fits).select("src", "dst")
        both = kept.join(held.withColumnRenamed("key", "src").alias("a"), "src").alias("a").join(held.withColumnRenamed("key", "dst").alias("b"), (F.col("a.dst") == F.col("b.dst")) & self.alike("a", "b"))
        out = materialize(both.select("a.src", "a.dst"), "exact")
        release(held)
        return out


def components(classes: DataFrame, docs: DataFrame, similarity: float = SIMILARITY, hot: int | None = None, repeats: bool = True) -> DataFrame | None:
    """(key, c): the groups of classes that links at the similarity hold together; None without any link."""
    hot = HOT if hot is None else hot
    links = Links(classes, docs, similarity, repeats)
    keyed = materialize(classes.select("key", F.explode("blocks").alias("v")).distinct(), "blocks")
    shared = materialize(keyed.groupBy("v").agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).where("n > 1"), "shared")
    more = materialize(keyed.join(shared.where("n > 2").select("v", "n"), "v"), "more")
    few = more.where(F.col("n") <= hot)
    pairs = few.alias("a").join(few.alias("b"), "v").where("a.key < b.key").select(F.col("a.key").alias("src"), F.col("b.key").alias("dst"))
    links.add(pairs.unionByName(shared.where("n = 2").select(F.col("lo").alias("src"), F.col("hi").alias("dst"))))
    led = more.where(F.col("n") > hot)
    if not led.isEmpty():
        _crowded(links, led)
    release(keyed, shared, more)
    return links.comp


def _crowded(links: Links, led: DataFrame) -> None:
    """Link the members of crowded block values (v, key)."""
    typical = led.groupBy("key").agg(F.count("*").alias("t"))
    led = materialize(led.select("v", "key").join(typical, "key"), "led")
    for turn in range(ROUNDS + 1):
        placed = materialize(links.named(led), "placed")
        per = placed.groupBy("v", "c").agg(F.count("*").alias("n"), F.max_by("key", F.struct("t", F.xxhash64("key"))).alias("best"), F.max("t").alias("t"))
        if turn == 0:
            # the member with most crowded values is the likest to all others
            main = per.groupBy("v").agg(F.max_by(F.struct("c", F.array("best").alias("to")), F.struct("t", F.xxhash64("best"))).alias("m"), F.count("*").alias("parts")).where("parts > 1").select("v", "m.c", "m.to")
        else:
            main = per.groupBy("v").agg(F.max_by("c", F.struct("n", "c")).alias("c"), F.count("*").alias("parts")).where("parts > 1").select("v", "c")
        main = materialize(main.withColumnRenamed("c", "main"), "main")
        if main.isEmpty():
            release(placed, main)
            break
        if turn == ROUNDS:
            # what is outside the largest component against all others of the value. Signatures and sets go along, so
            # the join compares and only gives links; a pair is compared in the least value that both texts have
            split = materialize(placed.join(main, "v").join(links.sigs, "key"), "split")
            distance = _apart("a", "b")
            meets = F.expr("a.v = b.v and a.c <> b.c and (b.c = b.main or a.key < b.key)") & (distance <= links.most)
            # only texts with a partner within the distance are held against each other by their sets
            asks = materialize(split.where("c <> main").alias("a").join(split.alias("b"), meets, "left_semi"), "asks")
            answers = materialize(split.alias("b").join(asks.alias("a"), meets, "left_semi"), "answers")
            wanted = asks.select("key").unionByName(answers.select("key")).distinct()
            held = links.sets(wanted)
            own = split.select("key", "v").join(wanted, "key", "left_semi").groupBy("key").agg(F.collect_set("v").alias("vs"))  # at most a text's blocks
            extra = materialize(held.join(own, "key"), "extra")
            close = meets & ((distance <= links.sure) | links.alike("a", "b")) & F.expr("a.v = array_min(array_intersect(a.vs, b.vs))")
            late = asks.join(extra, "key").alias("a").join(answers.join(extra, "key").alias("b"), close)
            links.unite(late.select(F.col("a.key").alias("src"), F.col("b.key").alias("dst")).distinct())
            release(split, asks, answers, held, extra)
        else:
            if turn:
                inner = placed.join(main, "v").where("c = main")
                some = inner.groupBy("v").agg(F.array_distinct(F.array(*(F.min_by("key", F.xxhash64("key", F.lit(turn * CENTRES + i))) for i in range(CENTRES)))).alias("to"))
                led_by = main.join(some, "v")
            else:
                led_by = main
            # a text has few blocks, so the centres of all its values are few: each is met once
            met = placed.join(led_by, "v").where("c <> main").groupBy("key").agg(F.array_distinct(F.flatten(F.collect_set("to"))).alias("to"))
            near = met.join(links.sigs, "key").select(F.col("key").alias("src"), *(f"w{i}" for i in range(LONGS)), F.explode("to").alias("dst"))
            links.add(near)
        release(placed, main)
    release(led)


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each group of near copies: that of the least id.

    Null and empty texts are one group (equal signatures); repeated rows leave one;
    a null id stays only where its group has no other; an empty table stays empty. All
    columns stay as they are, whatever their names. Texts are never shuffled while the
    rows to drop are few enough to broadcast.
    """
    plain = docs.select(col(doc_id).alias("id"), col(text).alias("text"))
    with small_batches(docs.sparkSession):
        marked = materialize(prints(plain, similarity), "prints")
    classes = materialize(classes_of(marked), "classes")
    repeats = not marked.groupBy("id", "t").count().where("count > 1").isEmpty()
    comp = components(classes, plain, similarity, repeats=repeats)
    named = classes.select("key", "id", "t")
    named = named.withColumn("c", F.col("key")) if comp is None else named.join(comp, "key", "left").withColumn("c", F.coalesce("c", "key"))
    best = named.groupBy("c").agg(F.min(F.struct(F.col("id").isNull(), "id", "t")).alias("b")).select(F.col("b.id").alias("id"), F.col("b.t").alias("t"))
    rows = marked.groupBy("id", "t").agg(F.count("*").alias("n"))
    chosen = best.withColumn("stays", F.lit(True))
    judged = materialize(rows.alias("r").join(chosen.alias("b"), F.expr("r.id <=> b.id and r.t = b.t"), "left").select("r.id", "r.t", "r.n", F.coalesce("stays", F.lit(False)).alias("stays")), "judged")
    release(marked, classes, *([comp] if comp is not None else []))
    i, k = fresh(docs, "id", "t")
    key = (F.xxhash64(col(text)) == F.col(k)) & col(doc_id).eqNullSafe(F.col(i))
    off = judged.where("not stays").select(F.col("id").alias(i), F.col("t").alias(k))
    kept = docs.join(small(off), key, "left_anti")
    if repeats:
        again = small(judged.where("stays and n > 1").select(F.col("id").alias(i), F.col("t").alias(k)))
        # equal rows by id and text: one of them
        one = kept.join(again, key, "left_semi").withColumn(k, F.xxhash64(col(text))).dropDuplicates([doc_id, k]).drop(k)
        kept = kept.join(again, key, "left_anti").unionByName(one)
    return kept
