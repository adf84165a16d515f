"""Names for helper columns that no table of the user's can have."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of ids and hashes that are broadcast at most; beyond, a join shuffles both sides.
BROADCAST_ROWS = 1_000_000


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until df has no such column (upper and lower case are one)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def renamed(df: DataFrame, *names: str) -> DataFrame:
    """df with its own columns of these names called <name>_in, so that an operator's results can have them."""
    for name in names:
        for c in df.columns:
            if c.lower() == name.lower():
                df = df.withColumnRenamed(c, fresh(df, f"{c}_in")[0])
    return df


def col(name: str) -> Column:
    """A column whatever signs its name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value written, and evaluated, once: lambdas evaluate what they refer to at each element."""
    return F.transform(F.array(value), then)[0]


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it has few rows; it should be a written table, as it is counted."""
    return F.broadcast(df) if df.count() <= rows else df
