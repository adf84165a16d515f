"""Order MinHash fingerprints, in DataFrame operations only.

Every k-mer of a text is numbered by its occurrence, and the pair is hashed: occurrence c
of a k-mer has its own value, independent of those of the others. The SELECTED smallest
values of a text are taken, dealt into buckets by other bits of the value, and the smallest
of a bucket are hashed as a tuple in the order they have in the text. Two texts
share a tuple if they share its k-mers, as often and in the same order, so likeness falls
with edit distance and not only with the sets' overlap, and repeated text counts like any other.

The value of a first occurrence is the k-mer's hash itself. So one sort of (hash, place)
gives the first occurrences in the order of their values, and brings later ones
together, which alone are numbered and hashed again. The sort stands outside of
lambdas, where Spark sorts primitives in generated code; see with_tuples().

Defined results: a null text counts as empty; a text shorter than k is one k-mer, the
empty one too, so equal texts always have equal fingerprints; repeated rows get equal
ones; an empty table gives no rows; a text of over 2 ** PLACE / 4 code points is an
error, as its places cannot be told apart. K-mers are of code points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.columns import col, fresh, let
from millrace.storage import materialize

K, BUCKETS, TUPLE, SELECTED = 8, 32, 2, 128
#: Low bits that hold a k-mer's place in the text (its offset in UTF-32); the value's bits stand above.
PLACE = 30


def _runs(sorted_longs: Column, key: Callable[[Column], Column], then: Callable[[Column], Column]) -> Column:
    """then(slice) of every run of equal keys, as an array; of no elements, an empty one."""

    def of(a: Column) -> Column:
        last = F.size(a) - 1
        starts = F.filter(F.sequence(F.lit(0), last), lambda i: (i == 0) | (key(F.get(a, i)) != key(F.get(a, i - 1))))
        return let(starts, lambda s: F.transform(s, lambda x, j: then(F.slice(a, x + 1, F.coalesce(F.get(s, j + 1), last + 1) - x))))

    return let(sorted_longs, of)


def sorted_kmers(text: Column, k: int = K) -> Column:
    """array<long>: hash and place of every k-mer, ascending."""
    last = F.greatest(F.char_length(text) - k, F.lit(0)) * 4 + 1
    # four bytes for a code point: slices without a scan
    return F.sort_array(let(F.encode(text, "UTF-32"), lambda b: F.transform(F.sequence(F.lit(1), last, F.lit(4)), lambda i: F.shiftleft(F.xxhash64(F.substring(b, i, F.lit(4 * k))), PLACE).bitwiseOR(i.cast("long")))))


def whole(text: Column) -> Column:
    """text, null as empty; an error if its places do not fit."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.char_length(text) > (1 << PLACE) // 4, F.raise_error(F.lit("a text is too long for its places"))).otherwise(text)


def tuples(held: Column, buckets: int = BUCKETS, size: int = TUPLE, selected: int = SELECTED) -> Column:
    """array<long>: a hash for every bucket that has k-mers, by bucket. held: a column of sorted_kmers()."""
    place = F.lit((1 << PLACE) - 1)
    value = lambda x: F.shiftright(x, PLACE)

    def firsts(a: Column) -> Column:
        """First occurrences of k-mers: all of them, or the smallest `selected` at least."""
        of = lambda xs: F.filter(xs, lambda x, i: (i == 0) | (value(x) != value(F.get(xs, i - 1))))
        return let(let(F.slice(a, 1, 2 * selected), of), lambda f: F.when((F.size(f) >= selected) | (F.size(a) <= 2 * selected), f).otherwise(of(a)))

    def later(a: Column) -> Column:
        """Second and later occurrences, each with its own value."""
        again = lambda xs: F.filter(xs, lambda x, i: value(x) == value(F.get(xs, i - 1)))
        valued = lambda x, c: F.shiftleft(F.xxhash64(value(x), c), PLACE).bitwiseOR(x.bitwiseAND(place))
        seconds = lambda r: F.transform(F.filter(r, lambda x, i: (i == 0) | (value(x) != value(F.get(r, i - 1)))), lambda x: valued(x, F.lit(0)))
        thirds = lambda r: let(again(r), lambda q: F.when(F.size(q) == 0, q).otherwise(F.flatten(_runs(q, value, lambda run: F.transform(run, lambda x, c: valued(x, c + 1))))))
        return let(again(a), lambda r: F.when(F.size(r) == 0, r).otherwise(F.concat(seconds(r), thirds(r))))

    def hashed(e: Column) -> Column:
        # (bucket, rank) in order: the first `size` of every bucket stay, and are put in text order
        bits = (selected - 1).bit_length()
        dealt = F.sort_array(F.transform(e, lambda x, i: F.shiftleft(value(x).bitwiseAND(F.lit(buckets - 1)), bits).bitwiseOR(i.cast("long"))))
        bucket = lambda x: F.shiftright(x, bits + PLACE)
        rank = lambda x: x.bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
        least = let(dealt, lambda d: F.filter(d, lambda x, i: (i < size) | (F.shiftright(x, bits) != F.shiftright(F.get(d, i - size), bits))))
        # bucket, place, rank
        placed = F.sort_array(F.transform(least, lambda y: F.shiftleft(F.shiftright(y, bits), bits + PLACE).bitwiseOR(F.shiftleft(F.get(e, rank(y)).bitwiseAND(place), bits)).bitwiseOR(rank(y).cast("long"))))

        def of(q: Column) -> Column:
            starts = F.filter(F.sequence(F.lit(0), F.size(q) - 1), lambda i: (i == 0) | (bucket(F.get(q, i)) != bucket(F.get(q, i - 1))))
            # what is null is not hashed: beyond a bucket's last k-mer
            one = lambda i, j: F.when(bucket(F.get(q, i + j)) == bucket(F.get(q, i)), value(F.get(e, rank(F.get(q, i + j)))))
            return F.transform(starts, lambda i: F.xxhash64(bucket(F.get(q, i)), *(one(i, j) for j in range(size))))

        return let(placed, of)

    return let(held, lambda a: let(F.slice(F.sort_array(F.concat(firsts(a), later(a))), 1, selected), hashed))


def with_tuples(df: DataFrame, texts: dict[str, Column], k: int = K, buckets: int = BUCKETS, size: int = TUPLE, selected: int = SELECTED) -> DataFrame:
    """df with a column of tuples for each named text."""
    held = fresh(df, *(f"kmers_{name}" for name in texts))
    # always true, but not known to be: so the optimiser leaves the sort in a projection of its own
    here = F.monotonically_increasing_id() >= 0
    sorts = df.select("*", *(F.when(here, sorted_kmers(whole(t), k)).alias(h) for h, t in zip(held, texts.values())))
    return sorts.select(*(col(c) for c in df.columns), *(tuples(col(h), buckets, size, selected).alias(name) for h, name in zip(held, texts)))


def fingerprint(tuple_hashes: Column) -> Column:
    """Eight hexadecimal digits for each tuple."""
    return F.array_join(F.transform(tuple_hashes, lambda x: F.lower(F.lpad(F.hex(x.bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of tuples in common, 0 to 1."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b), F.lit(1))


def neighbours(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bucket_rows: int = 100_000) -> DataFrame:
    """(doc_id, h, n, next_id, next_h, prev_id, prev_h, prev_n): each distinct (id, text) and those next to it.

    Order: ascending id (nulls first), then the hash of the text; the last is followed by
    the first. Only ids, hashes and lengths are sorted, in ranges; the ranges' first rows
    meet in one task, a row for each bucket_rows documents.
    """
    ids = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("h"), F.coalesce(F.char_length(text), F.lit(0)).cast("long").alias("n")).distinct()
    total = ids.count()
    ranged = ids.repartitionByRange(max(1, total // bucket_rows), F.col("doc_id").asc_nulls_first(), "h").withColumn("pid", F.spark_partition_id())
    ranged = materialize(ranged, "ranged").withColumn("me", F.struct(F.col("doc_id").isNotNull().alias("k"), "doc_id", "h", "n"))
    here = Window.partitionBy("pid").orderBy(F.col("doc_id").asc_nulls_first(), "h")
    ends = ranged.groupBy("pid").agg(F.min("me").alias("first"), F.max("me").alias("last"))
    row = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    step = Window.orderBy("pid")
    ends = ends.select("pid", F.coalesce(F.lead("first").over(step), F.first("first").over(row)).alias("after"), F.coalesce(F.lag("last").over(step), F.last("last").over(row)).alias("before"))
    near = ranged.withColumn("nx", F.lead("me").over(here)).withColumn("pv", F.lag("me").over(here)).join(ends, "pid")
    nx, pv = F.coalesce("nx", "after"), F.coalesce("pv", "before")
    return near.select("doc_id", "h", "n", nx["doc_id"].alias("next_id"), nx["h"].alias("next_h"), pv["doc_id"].alias("prev_id"), pv["h"].alias("prev_h"), pv["n"].alias("prev_n"))


def edited(text: Column, n: Column, following: Column) -> Column:
    """text with its last n div 4 code points replaced by the first as many of the following text."""
    return F.concat(F.left(F.coalesce(text, F.lit("")), n - F.floor(n / 4)), F.left(F.coalesce(following, F.lit("")), F.floor(n / 4)))


def compare(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    A text is held against itself with its last quarter replaced, and against the next one.
    The next one is that of the next row by id (nulls first), of equal ids by the hash of the text; repeated
    rows count as one there, and the last is followed by the first.
    """
    spark = docs.sparkSession
    docs = docs.select(col(doc_id).alias("doc_id"), col(text).alias("text"))
    near = materialize(neighbours(docs), "neighbours")
    # a row's key is (i, z, h): its id or 0, whether that is null, the hash of its text. Keys are as good as unique, so
    # they are dealt out by number: there is no skew for AQE to split
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = ["i", "z", "h"]
    named = lambda name: [F.coalesce(f"{name}_id", F.lit(0)).alias("i"), F.col(f"{name}_id").isNull().alias("z"), F.col(f"{name}_h").alias("h")]
    keyed = docs.select(F.coalesce("doc_id", F.lit(0)).alias("i"), F.col("doc_id").isNull().alias("z"), F.xxhash64("text").alias("h"), F.coalesce("text", F.lit("")).alias("text"))
    by = near.select(F.coalesce("doc_id", F.lit(0)).alias("i"), F.col("doc_id").isNull().alias("z"), "h", "n", "next_id", "next_h", "prev_id", "prev_h", "prev_n")
    placed = keyed.repartition(n, *key).join(by.repartition(n, *key), key)
    # the head of each document that its predecessor's edit takes, once for each
    heads = placed.select(*named("prev"), F.left("text", F.floor(F.col("prev_n") / 4)).alias("head")).repartition(n, *key).dropDuplicates(key)
    met = placed.select(*key, "text", "n", "next_id", "next_h").join(heads, key)
    both = met.select(*key, "n", "next_id", "next_h", "text", edited(F.col("text"), F.col("n"), F.col("head")).alias("edited"))
    prints = with_tuples(both, {"a": F.col("text"), "e": F.col("edited")})
    prints = materialize(prints.select(*key, "n", "next_id", "next_h", F.sha2("edited", 256).alias("edited_sha256"), "a", "e"), "omh")
    following = prints.select(*key, F.col("a").alias("f")).repartition(n, *key).dropDuplicates(key)
    own = F.when(~F.col("own_z"), F.col("own_i")).alias("doc_id")
    out = prints.select(*named("next"), F.col("i").alias("own_i"), F.col("z").alias("own_z"), "n", "edited_sha256", "a", "e").repartition(n, *key).join(following, key)
    return out.select(own, F.col("n").alias("n_chars"), "edited_sha256", fingerprint(F.col("a")).alias("fingerprint"), fingerprint(F.col("e")).alias("edited_fingerprint"), likeness(F.col("a"), F.col("e")).alias("near_edited"), likeness(F.col("a"), F.col("f")).alias("near_next"))


def query(spark, sf_dir: str) -> DataFrame:
    return compare(spark.read.parquet(f"{sf_dir}/documents.parquet"))
