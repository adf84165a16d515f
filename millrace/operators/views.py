"""Multi-view grouping, padding, instructions and conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def modality(text: Column, images: Column) -> Column:
    has_text, has_image = F.coalesce(text, F.lit("")) != "", F.coalesce(F.size(images), F.lit(0)) > 0
    return F.when(has_text & has_image, "mixed").when(has_image, "image").otherwise("text")


def group_count(n: Column, k: int, cap: int | None = None) -> Column:
    g = F.ceil(n / F.lit(k)).cast("int")
    return F.least(g, F.lit(cap)) if cap else g


def chunks(rows: DataFrame, views: str, k: int, pad: str = "mask") -> DataFrame:
    """rows with group (from 0), view (k of them) and valid: the last group is padded.

    mask repeats the last view as invalid; cycle goes on from the first view, valid.
    """
    n = F.size(views)
    out = rows.withColumn("group", F.explode(F.sequence(F.lit(0), F.greatest(group_count(n, k), F.lit(1)) - 1)))
    at = F.sequence(F.col("group") * k, F.col("group") * k + k - 1)
    if pad == "cycle":
        view, valid = F.transform(at, lambda i: F.get(F.col(views), F.pmod(i, F.size(views)))), F.transform(at, lambda i: F.lit(True))
    else:
        view, valid = F.transform(at, lambda i: F.get(F.col(views), F.least(i, F.size(views) - 1))), F.transform(at, lambda i: i < F.size(views))
    return out.withColumn("view", view).withColumn("valid", valid)


def padded(views: Column, n: int) -> tuple[Column, Column]:
    """(views[i % size] for n places, validity of each place)."""
    places = F.sequence(F.lit(0), F.lit(n - 1))
    return F.transform(places, lambda i: F.get(views, F.pmod(i, F.size(views)))), F.transform(places, lambda i: i < F.size(views))


def shuffled(views: Column, seed: Column) -> Column:
    """views in the order of a seeded hash."""
    keyed = F.transform(views, lambda v, i: F.struct(F.xxhash64(seed, i).alias("h"), i.alias("i"), v.alias("v")))
    return F.transform(F.array_sort(keyed), lambda s: s["v"])


def instruction(table: dict[str, str], role: Column, mod: Column, own: Column) -> Column:
    """A record's own instruction, else that of role_modality, else that of role; empty ones count as none."""
    m = F.create_map(*(x for k, v in table.items() if v for x in (F.lit(k), F.lit(v)))) if any(table.values()) else F.create_map(F.lit(""), F.lit(""))
    return F.coalesce(F.nullif(own, F.lit("")), F.try_element_at(m, F.concat_ws("_", role, mod)), F.try_element_at(m, role))


def task_instruction(tables: dict[str, dict[str, str]], task: Column, role: Column, mod: Column, own: Column) -> Column:
    """instruction() by the table of the task; of the task `default` where a task has none or an empty one."""
    none = F.lit(None).cast("string")
    named = {t: table for t, table in tables.items() if table}
    chosen = F.coalesce(task, F.lit("default"))
    said = F.when(F.lit(False), none)
    for name, table in named.items():
        said = said.when(chosen == name, instruction(table, role, mod, none))
    rest = instruction(named["default"], role, mod, none) if "default" in named else none
    # an own instruction goes first, an empty one too: it says that there is none
    return F.coalesce(own, said.otherwise(rest))


def conversation(system: Column, text: Column, images: Column, videos: Column) -> Column:
    """array<struct<role, kind, value>>: the system's instruction, then video, image and text of the user; NULL if none."""
    part = lambda kind, c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda v: F.struct(F.lit("user").alias("role"), F.lit(kind).alias("kind"), v.alias("value")))
    said = F.when(F.coalesce(text, F.lit("")) != "", F.array(text)).otherwise(F.array().cast("array<string>"))
    user = F.concat(part("video", videos), part("image", images), part("text", said))
    none = F.array(F.struct(F.lit("user").alias("role"), F.lit("text").alias("kind"), F.lit("NULL").alias("value")))
    return F.concat(F.array(F.struct(F.lit("system").alias("role"), F.lit("text").alias("kind"), system.alias("value"))), F.when(F.size(user) > 0, user).otherwise(none))


def pool(tokens: Column, mask: Column, how: str) -> Column:
    """One vector of array<array<double>> token states: last, first, mean, weighted (by place) or max of those with mask."""
    from millrace.functions import vectors as V

    kept = F.filter(F.transform(tokens, lambda t, i: F.struct(t.alias("t"), F.get(mask, i).alias("m"))), lambda s: s["m"])
    states = F.transform(kept, lambda s: s["t"])
    if how == "first":
        return F.get(states, F.lit(0))
    if how == "last":
        return F.element_at(states, -1)
    zero = F.transform(states[0], lambda x: F.lit(0.0))
    if how == "max":
        return F.aggregate(states, states[0], lambda a, t: F.zip_with(a, t, lambda x, y: F.greatest(x, y)))
    weighted = F.transform(states, lambda t, i: F.transform(t, lambda x: x * (i + 1 if how == "weighted" else F.lit(1))))
    n = F.size(states)
    parts = n * (n + 1) / 2 if how == "weighted" else n
    return F.transform(F.aggregate(weighted, zero, lambda a, t: V.add(a, t)), lambda x: x / parts)
