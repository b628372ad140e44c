"""Functions of few values, computed once for each of them and not once for each row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_value(df: DataFrame, inputs: list[str], keep: list[str | Column], *computed: Column) -> DataFrame:
    """keep, and computed columns that depend on the inputs alone, for every row of df. They are computed for each distinct
    combination of the inputs, and joined to the rows. Nulls are values like others; repeated rows stay repeated."""
    names = [f"_in{k}" for k in range(len(inputs))]
    values = df.select(*inputs).distinct().select(*(F.col(c).alias(n) for c, n in zip(inputs, names)), F.struct(*computed).alias("_found"))
    rows = df.select(F.struct(*keep).alias("_kept"), *(F.col(c).alias(f"_row{k}") for k, c in enumerate(inputs)))
    same = reduce(lambda a, b: a & b, [F.col(f"_row{k}").eqNullSafe(F.col(n)) for k, n in enumerate(names)])
    return rows.join(values, same).select("_kept.*", "_found.*")
