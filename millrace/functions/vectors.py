"""Vector arithmetic on array columns, in double precision, without Python workers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def normalise(v: Column) -> Column:
    """Unit length; a zero vector stays zero. The length is evaluated once for each vector."""
    return F.transform(F.array(F.struct(v.alias("v"), norm(v).alias("n"))), lambda s: F.transform(s["v"], lambda x: F.when(s["n"] == 0, x.cast("double")).otherwise(x.cast("double") / s["n"])))[0]


def truncate(v: Column, dims: int) -> Column:
    """The first dims components, normalised again."""
    return normalise(F.slice(v, 1, dims))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") + y.cast("double"))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))


def scale(v: Column, by: float) -> Column:
    return F.transform(v, lambda x: x.cast("double") * F.lit(float(by)))


def fuse(text: Column, image: Column, alpha: float = 0.5, text_mean: Column | None = None, image_mean: Column | None = None) -> Column:
    """Late fusion: unit vectors, means taken off before the mix, unit length again."""
    t, i = normalise(text), normalise(image)
    t = t if text_mean is None else subtract(t, text_mean)
    i = i if image_mean is None else subtract(i, image_mean)
    return normalise(add(scale(i, alpha), scale(t, 1 - alpha)))


def fuse_masked(text: Column, image: Column, has_text: Column, has_image: Column, alpha: float = 0.5) -> Column:
    """Fusion where a side may be missing: the other side then, text if both are."""
    return F.when(has_text & has_image, fuse(text, image, alpha)).when(has_image & ~has_text, normalise(image)).otherwise(normalise(text))


def mean_of(vectors: Column) -> Column:
    """Unit-length average of an array of vectors."""
    n = F.size(vectors)
    summed = F.aggregate(F.slice(vectors, 2, F.greatest(n - 1, F.lit(0))), doubles(vectors[0]), lambda a, v: add(a, v))
    return normalise(F.transform(summed, lambda x: x / n))


def shift(v: Column, mean: Column) -> Column:
    """A mean taken off, unit length again."""
    return normalise(subtract(v, mean))
