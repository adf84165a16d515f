"""Best-fit packing into sequences of several permitted lengths.

Pieces go, longest first, into the open bin that they leave least room in. If none
fits, a bin is opened: of all permitted capacities the one whose expected cost per
packed token is least, where what the remaining shorter pieces can still fill is no
waste. At last each bin is cut down to the smallest permitted length that holds it.

Pieces are dealt by a hash into groups of about GROUP_ROWS that are packed on their own, so
a task holds a bounded number of lengths and no text. Equal rows are counted first and told apart by
a number, which is part of the hash: an id that a third of all rows have is spread like any others.

Defined results: a null or empty text has length 0 and takes part as a piece of
length 0 in the first bin of its group; a longer text than the largest capacity is cut into
full sequences and a rest; repeated rows are packed each; ties go to the lower row
key and the bin opened first; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZES = (512, 1024, 2048, 4096, 8192)
GROUP_ROWS = 20_000
#: Cost of one more sequence, in tokens.
OVERHEAD = 16


def pack(lengths: list[int], sizes: tuple[int, ...] = SIZES, overhead: int = OVERHEAD) -> list[tuple[int, int, int]]:
    """(bin, offset, capacity) of each piece; lengths do not exceed the largest size."""
    sizes = tuple(sorted(sizes))
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    shorter = sorted(lengths)
    mass = [0]
    for n in shorter:
        mass.append(mass[-1] + n)
    placed_mass = 0
    total = mass[-1]
    room: list[tuple[int, int]] = []  # (room left, bin), sorted
    used: list[int] = []
    at: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    for i in order:
        n = lengths[i]
        k = bisect_left(room, (n, -1))
        if k < len(room):
            left, b = room.pop(k)
        else:
            rest = total - placed_mass - n  # what comes after; all of it is no longer than n
            best = None
            for size in sizes:
                if size < n:
                    continue
                gap = size - n
                fill = min(gap, rest, mass[bisect_left(shorter, gap + 1)])
                cost = (size - n - fill + overhead) / max(1, n + fill)
                if best is None or cost < best[0]:
                    best = (cost, size)
            b, left = len(used), best[1]
            used.append(0)
        at[i] = (b, used[b])
        used[b] += n
        placed_mass += n
        if left - n > 0:
            insort(room, (left - n, b))
    final = [sizes[min(bisect_left(sizes, u), len(sizes) - 1)] for u in used]
    return [(b, o, final[b]) for b, o in at]


def pieces(docs: DataFrame, length: str, sizes: tuple[int, ...]) -> DataFrame:
    """A row for each piece: texts over the largest size are cut into full sequences and a rest."""
    most = max(sizes)
    n = F.coalesce(F.col(length), F.lit(0))
    last = F.greatest(F.lit(0), F.ceil(n / most) - 1)
    return docs.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long")))).withColumn("start", F.col("piece") * most).withColumn("length", F.least(n - F.col("start"), F.lit(most)).cast("long"))


def pack_table(docs: DataFrame, doc_id: str = "doc_id", length: str = "n_tokens", sizes: tuple[int, ...] = SIZES, group_rows: int = GROUP_ROWS, overhead: int = OVERHEAD) -> DataFrame:
    """(doc_id, piece, start, length, bin, offset, capacity); bin is unique in the table.

    docs: ids and lengths, one row for each document.
    """
    sizes = tuple(sorted(sizes))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.greatest(F.coalesce(F.col(length).cast("long"), F.lit(0)), F.lit(0)).alias("n")).groupBy("doc_id", "n").agg(F.count("*").alias("copies"))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    cut = pieces(rows, "n", sizes)
    most = max(sizes)
    total = docs.agg(F.sum(F.greatest(F.lit(1), F.ceil(F.coalesce(F.col(length), F.lit(0)) / most)))).first()[0] or 0
    groups = max(1, round(total / group_rows))
    kind = dict(docs.dtypes)[doc_id]
    dealt = cut.withColumn("g", F.pmod(F.xxhash64("doc_id", "n", "copy", "piece"), F.lit(groups))).select("g", "doc_id", "piece", "start", "length")

    def run(key, rows):
        rows = rows.sort_values(["doc_id", "piece", "length"], kind="stable", na_position="last", ignore_index=True)
        at = pack(rows["length"].astype(int).tolist(), sizes, overhead)
        rows["bin"] = [f"{key[0]}-{b}" for b, _, _ in at]
        rows["offset"] = [o for _, o, _ in at]
        rows["capacity"] = [c for _, _, c in at]
        return rows[["doc_id", "piece", "start", "length", "bin", "offset", "capacity"]]

    return dealt.groupBy("g").applyInPandas(run, f"doc_id {kind}, piece long, start long, length long, bin string, offset long, capacity long")


def query(spark, sf_dir: str) -> DataFrame:
    """Documents in the byte vocabulary of byte-level models, with one end mark each."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_table(docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("n_tokens")))
