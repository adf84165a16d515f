"""Result tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def percent_table(results: DataFrame, datasets: list[str], row: str = "model", dataset: str = "dataset", value: str = "value") -> DataFrame:
    """A column for each dataset in percent, and their mean where none is missing, averaged before rounding."""
    wide = results.groupBy(row).pivot(dataset, datasets).agg(F.avg(value))
    full = sum((F.col(f"`{d}`").isNotNull().cast("int") for d in datasets), F.lit(0)) == len(datasets)
    mean = sum((F.col(f"`{d}`") for d in datasets), F.lit(0.0)) / len(datasets)
    return wide.select(row, *(F.round(F.col(f"`{d}`") * 100, 2).alias(d) for d in datasets), F.when(full, F.round(mean * 100, 2)).alias("avg"))


def dataset_order(found: list[str], wanted: list[str] | None, preferred: list[str]) -> list[str]:
    """The wanted ones, else the preferred ones, else by the alphabet; others found come after."""
    if wanted:
        return [d for d in wanted if d in found] + sorted(set(found) - set(wanted))
    first = [d for d in preferred if d in found]
    return first + sorted(set(found) - set(first))


def sheet_name(name: str, taken: set[str]) -> str:
    """At most 31 characters without []:*?/\\ and unlike any taken one."""
    import re

    base = re.sub(r"[\[\]:*?/\\]", "_", name)[:31] or "sheet"
    out, n = base, 2
    while out.lower() in taken:
        tail = f"_{n}"
        out, n = base[: 31 - len(tail)] + tail, n + 1
    taken.add(out.lower())
    return out


def fixed_width(rows: list[dict], columns: list[str]) -> str:
    """Lines of left-aligned columns."""
    cells = [[f"{r.get(c):.4f}" if isinstance(r.get(c), float) else str(r.get(c, "-")) for c in columns] for r in rows]
    widths = [max(len(c), *(len(x[i]) for x in cells)) if cells else len(c) for i, c in enumerate(columns)]
    line = lambda xs: "  ".join(x.ljust(w) for x, w in zip(xs, widths)).rstrip()
    return "\n".join([line(columns), line(["-" * w for w in widths]), *map(line, cells)])


#: How result files are called, and the one of all datasets searched together.
RESULT, MIX = "_result.json", "mix_result.json"


def write_result(spark: SparkSession, folder: str, name: str, payload: dict) -> None:
    """One small JSON object as <folder>/<name>_result.json, in place at once: written under another name and moved."""
    jvm = spark.sparkContext._jvm
    at, temp = (jvm.org.apache.hadoop.fs.Path(f"{folder}/{x}") for x in (f"{name}{RESULT}", f".{name}{RESULT}.part"))
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = store.create(temp, True)
    out.write(json.dumps(payload, sort_keys=True).encode())
    out.close()
    store.delete(at, False)
    if not store.rename(temp, at):
        raise OSError(f"cannot write {at}")


def result_payload(dataset: str | None, metrics: dict[str, float], stats: dict | None = None) -> dict:
    """What a result file holds; a dataset that is not named is that of the file's name."""
    return ({"dataset": dataset} if dataset else {}) | {"metrics": metrics} | ({"stats": stats} if stats else {})


def read_results(spark: SparkSession, folder: str, metric: str) -> DataFrame:
    """(part, dataset, value) of the result files of a folder: part Origin for a dataset's own file, Mix for those in mix_result.json.

    The metric must be in every file that has metrics; files without are passed over.
    """
    v = F.parse_json(F.col("value"))
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    files = spark.read.option("wholetext", True).option("pathGlobFilter", f"*{RESULT}").text(folder).select("value", F.col("_metadata.file_path").alias("path"))
    read = files.select(name.alias("file"), v.alias("v"))
    where = lambda w: F.raise_error(F.concat(F.lit(f"metric {metric} not found in "), w)).cast("double")
    value = lambda x, w: F.coalesce(F.try_variant_get(x, f"$.metrics['{metric}']", "double"), where(w))
    told = F.coalesce(F.nullif(F.try_variant_get("v", "$.dataset", "string"), F.lit("")), F.expr(f"left(file, length(file) - {len(RESULT)})"))
    has = F.try_variant_get("v", "$.metrics", "variant").isNotNull()
    own = read.where((F.col("file") != MIX) & has).select(F.lit("Origin").alias("part"), told.alias("dataset"), value(F.col("v"), F.col("file")).alias("value"))
    mixed = read.where(F.col("file") == MIX).select(F.explode(F.try_variant_get("v", "$.datasets", "map<string,variant>")).alias("dataset", "x"))
    return own.unionByName(mixed.select(F.lit("Mix").alias("part"), "dataset", value(F.col("x"), F.concat(F.lit(f"{MIX}["), F.col("dataset"), F.lit("]"))).alias("value")))
