"""Forward-only contrastive analytics over stored similarities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import vectors as V
from millrace.storage import materialize, new_path, opened


def logit_scale(temperature: float, least: float = 0.01) -> float:
    return min(1 / temperature, 1 / least)


def masked(pairs: DataFrame, rules: list[Column]) -> DataFrame:
    """pairs with mask: any rule holds (a null rule does not) and the pair is no target."""
    any_rule = F.lit(False)
    for r in rules:
        any_rule = any_rule | F.coalesce(r, F.lit(False))
    return pairs.withColumn("mask", any_rule & ~F.col("target"))


def mask_ratio(pairs: DataFrame) -> DataFrame:
    return pairs.agg((F.count_if("mask") / F.nullif(F.count_if(~F.col("target")), F.lit(0))).alias("mask_ratio"))


def _lse(x: Column, where: Column, top: Column) -> Column:
    return top + F.ln(F.sum(F.when(where, F.exp(x - top))))


def info_nce(pairs: DataFrame, anchor: str = "anchor", logit: str = "logit", smoothing: float = 0.0) -> DataFrame:
    """(anchor, loss_mean, loss_joint, loss_sibling, hit, pos_sim, n_cand, n_pos).

    mean: every positive against all candidates; joint: all positives together; sibling:
    a positive against the negatives only. Masked pairs leave the denominators.
    """
    from pyspark.sql.window import Window

    kept = pairs.where(~F.coalesce(F.col("mask"), F.lit(False)))
    w = Window.partitionBy(anchor)
    x, t = F.col(logit), F.col("target")
    met = kept.withColumn("top", F.max(x).over(w))
    met = met.withColumn("neg", F.coalesce(F.sum(F.when(~t, F.exp(x - F.col("top")))).over(w), F.lit(0.0)))
    top = F.first("top")
    all_ = top + F.ln(F.sum(F.exp(x - F.col("top"))))
    pos = top + F.ln(F.sum(F.when(t, F.exp(x - F.col("top")))))
    sib = F.avg(F.when(t, F.col("top") + F.ln(F.exp(x - F.col("top")) + F.col("neg")) - x))
    base = all_ - F.avg(F.when(t, x))
    smooth = (1 - smoothing) * base + smoothing * (all_ - F.avg(x)) if smoothing else base
    best = F.max_by("target", F.struct(x, F.col("target")))
    return met.groupBy(anchor).agg(smooth.alias("loss_mean"), (all_ - pos).alias("loss_joint"), sib.alias("loss_sibling"), best.cast("int").alias("hit"), F.avg(F.when(t, x)).alias("pos_sim"), F.count("*").alias("n_cand"), F.count_if(t).alias("n_pos"))


def dispersion(cells: DataFrame, block: str = "block", value: str = "cos") -> DataFrame:
    """(block, n, range, variance, std, pairwise, center_mean, center_max, center_min) of blocks of two cells or more."""
    valid = cells.where(F.coalesce(F.col("valid"), F.lit(True))) if "valid" in cells.columns else cells
    c = F.col(value)
    per = valid.groupBy(block).agg(F.count("*").alias("n"), F.max(c).alias("hi"), F.min(c).alias("lo"), F.var_pop(c).alias("variance"), F.avg(c).alias("mean"), F.avg(c * c).alias("sq")).where("n >= 2")
    around = lambda m: F.col("sq") - 2 * F.col(m) * F.col("mean") + F.col(m) * F.col(m)
    return per.select(block, "n", (F.col("hi") - F.col("lo")).alias("range"), "variance", F.sqrt("variance").alias("std"), (F.col("variance") * 2 * F.col("n") / (F.col("n") - 1)).alias("pairwise"), F.col("mean").alias("center_mean"), around("hi").alias("center_max"), around("lo").alias("center_min"))


def balance(pos: Column, negatives: list[Column], weight: float) -> Column:
    """pos + weight x mean of the negative terms."""
    return pos + weight * sum(negatives[1:], negatives[0]) / len(negatives)


def collapse(vectors: DataFrame, key: str = "id", vec: str = "vec") -> DataFrame:
    """(mean_cos, max_cos, std): of all pairs, and the mean over dimensions of the sample deviation.

    With n unit vectors of sum S the cosines of all ordered pairs sum to |S|^2 - (squared
    norms), so the mean needs no pairs; the maximum is that of exact products of those tiles of
    vectors that may hold it. Null without a pair.
    """
    unit = vectors.select(F.col(key).alias("k"), V.normalise(F.col(vec)).alias("u"))
    per = unit.select(F.posexplode("u").alias("p", "x")).groupBy("p").agg(F.stddev_samp("x").alias("s"), F.sum("x").alias("t"), F.sum(F.col("x") * F.col("x")).alias("sq"), F.count("*").alias("n"))
    n = F.max("n")
    mean = F.when(n > 1, (F.sum(F.col("t") * F.col("t")) - F.sum("sq")) / (n * (n - 1)))
    spread = per.agg(mean.alias("mean_cos"), F.avg("s").alias("std"))
    best = _tile_maxima(unit).agg(F.max("top").alias("max_cos"))
    return spread.crossJoin(best).select("mean_cos", "max_cos", "std")


#: Vectors of a tile, and pivots that vectors are dealt to by nearness at most.
TILE, PIVOTS = 4096, 256
#: Tiles that a task opens, one after the other.
MEETINGS = 16


def _top(a, b, same: bool) -> float:
    """The largest product of a row of a with one of b, another one where they are the same rows."""
    import numpy as np

    top = -np.inf
    for i in range(0, len(a), 1024):
        scores = a[i : i + 1024] @ b.T
        if same:
            scores[np.arange(len(scores)), np.arange(i, i + len(scores))] = -np.inf
        top = max(top, scores.max(initial=-np.inf))
    return top


def _tile_maxima(unit: DataFrame, tile: int = TILE) -> DataFrame:
    """(top): the largest product of two different rows of unit (u), for each pair of tiles that can hold the largest of all."""
    return maxima(unit, tile)[0]


def maxima(unit: DataFrame, tile: int = TILE) -> tuple[DataFrame, int, int]:
    """((top) of each pair of tiles that was read, their number, the number of all pairs) of unit vectors (k, u).

    Vectors are dealt to tiles around pivots, drawn by hash. A tile is packed once, with the largest angle of its vectors
    to its pivot and its own largest product. Two vectors of tiles A and B are at least angle(A, B) - radius(A) -
    radius(B) apart, by the triangle inequality of angles; pairs of tiles whose bound stays under a product already found
    are skipped, so a vector travels only to tiles that may hold a better one. The driver gets a pivot and a radius of each tile.
    """
    import numpy as np

    spark, unit = unit.sparkSession, unit.where("u is not null")
    n = unit.count()
    m = min(PIVOTS, max(1, -(-n // tile)))
    pivots = [r.u for r in unit.orderBy(F.xxhash64("k"), "k").limit(m).select("u").collect()]  # PIVOTS vectors at most
    if not pivots:
        return spark.createDataFrame([], "top double"), 0, 0
    held = np.array(pivots, dtype=np.float64)
    d = held.shape[1]

    def near(batches):
        import pyarrow as pa

        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            yield pa.RecordBatch.from_arrays([pa.array(np.argmax(x @ held.T, axis=1), pa.int32()), batch.column(0), batch.column(1)], ["pivot", "h", "u"])

    placed = materialize(unit.select(F.xxhash64("k").alias("h"), F.col("u").cast("array<double>").alias("u")).mapInArrow(near, "pivot int, h long, u array<double>"), "placed")
    sizes = {r.pivot: r.c for r in placed.groupBy("pivot").agg(F.count("*").alias("c")).collect()}  # a row for each pivot
    parts = F.element_at(F.create_map(*(F.lit(x) for k, c in sorted(sizes.items()) for x in (k, -(-c // tile)))), F.col("pivot"))

    def pack(table):
        import pyarrow as pa

        x = table.column("u").combine_chunks().flatten().to_numpy().reshape(-1, d)
        pivot = table.column("pivot")[0].as_py()
        radius = float(np.arccos(np.clip((x @ held[pivot]).min(), -1, 1)))
        return pa.table({"pivot": pa.array([pivot], pa.int32()), "part": table.column("part").slice(0, 1), "radius": [radius], "top": [float(_top(x, x, True))], "rows": pa.array([x.tobytes()], pa.binary())})

    dealt = placed.withColumn("part", F.pmod(F.hash("h"), parts).cast("int"))
    made, path = dealt.groupBy("pivot", "part").applyInArrow(pack, "pivot int, part int, radius double, top double, rows binary"), new_path(spark, "tiles")
    made.write.partitionBy("pivot", "part").parquet(path)
    tiles = spark.read.schema(made.schema).parquet(path)
    told = tiles.select("pivot", "part", "radius", "top").orderBy("pivot", "part").collect()
    best = max(r.top for r in told)
    at = held[[r.pivot for r in told]]
    angle = np.arccos(np.clip(at @ at.T, -1, 1))
    radius = np.array([r.radius for r in told])
    bound = np.cos(np.maximum(0.0, angle - radius[:, None] - radius[None, :] - 1e-6))
    i, j = np.nonzero(np.triu(bound > best - 1e-9, 1))
    every = len(told) * (len(told) + 1) // 2
    own = tiles.where(F.col("top") > float("-inf")).select("top")
    if not len(i):
        return own, len(told), every
    # a tile opens those that it meets, MEETINGS in a task; half of its pairs are the other tile's task
    names = [f"pivot={r.pivot}/part={r.part}" for r in told]
    others: dict[int, list[int]] = {}
    for x, y in zip(i.tolist(), j.tolist()):
        a, b = (y, x) if (x + y) % 2 else (x, y)
        others.setdefault(a, []).append(b)
    wanted = [(names[a], [names[b] for b in bs[at : at + MEETINGS]]) for a, bs in others.items() for at in range(0, len(bs), MEETINGS)]

    def meet(batches):
        import pyarrow as pa

        record = opened(path, ["rows"])
        get = lambda name: np.frombuffer(record(name)["rows"]).reshape(-1, d)
        for batch in batches:
            for one in batch.to_pylist():
                own_rows = get(one["tile"])
                yield pa.RecordBatch.from_arrays([pa.array([float(_top(own_rows, get(name), False)) for name in one["met"]], pa.float64())], ["top"])

    met = spark.createDataFrame(wanted, "tile string, met array<string>").repartition(min(len(wanted), 2000)).mapInArrow(meet, "top double")
    return own.unionByName(met), len(told) + len(i), every


def weighted_dims(losses: DataFrame, weights: dict[int, float], dim: str = "dim", loss: str = "loss") -> DataFrame:
    w = losses.sparkSession.createDataFrame([(int(d), float(x)) for d, x in weights.items()], f"{dim} int, w double")
    return losses.join(F.broadcast(w), dim).agg((F.sum(F.col("w") * F.col(loss)) / F.sum("w")).alias("loss"))


def mean_vector(rows: DataFrame, bucket: str = "bucket", vec: str = "vec") -> DataFrame:
    """(bucket, n, mean): component-wise means; partial sums on the map side for each position."""
    per = rows.select(bucket, F.posexplode(vec).alias("p", "x")).groupBy(bucket, "p").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count("*").alias("n"))
    return per.groupBy(bucket).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("p", "m"))), lambda s: s["m"]).alias("mean"))


def min_pair_cosine(a: DataFrame, b: DataFrame, key: str = "id", vec: str = "vec") -> DataFrame:
    met = a.select(key, F.col(vec).alias("_x")).join(b.select(key, F.col(vec).alias("_y")), key)
    return met.agg(F.min(V.dot(V.normalise(F.col("_x")), V.normalise(F.col("_y")))).alias("min_cos"))


def running_means(rows: DataFrame, key: str, value: str) -> DataFrame:
    ok = ~F.isnan(value) & F.col(value).isNotNull() & (F.abs(value) != float("inf"))
    return rows.groupBy(key).agg(F.avg(F.when(ok, F.col(value))).alias("mean"), F.count_if(ok).alias("n"))
