"""Pure states as rows sys, k, re, im (amplitude of basis state k): gates are joins on the bits they touch."""

from __future__ import annotations

from math import sqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

S = 1 / sqrt(2)
#: One-qubit gates as rows of (re, im).
GATES = {
    "x": [[(0, 0), (1, 0)], [(1, 0), (0, 0)]], "y": [[(0, 0), (0, -1)], [(0, 1), (0, 0)]], "z": [[(1, 0), (0, 0)], [(0, 0), (-1, 0)]],
    "h": [[(S, 0), (S, 0)], [(S, 0), (-S, 0)]], "s": [[(1, 0), (0, 0)], [(0, 0), (0, 1)]], "t": [[(1, 0), (0, 0)], [(0, 0), (S, S)]],
}


def normalize(state: DataFrame) -> DataFrame:
    n = state.groupBy("sys").agg(F.sqrt(F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im"))).alias("n")).where("n > 0")
    return state.join(n, "sys").select("sys", "k", (F.col("re") / F.col("n")).alias("re"), (F.col("im") / F.col("n")).alias("im"))


def apply_gate(state: DataFrame, gate: str, qubit: int, control: int | None = None) -> DataFrame:
    """A gate on one qubit, for the basis states in which the control bit (if any) is set."""
    g = GATES[gate]
    bit = F.shiftright("k", qubit).bitwiseAND(F.lit(1))
    cells = lambda b: F.array(*(F.struct(F.lit(to).alias("to"), F.lit(float(g[to][b][0])).alias("gr"), F.lit(float(g[to][b][1])).alias("gi")) for to in (0, 1)))
    rows = state.withColumn("b", bit).withColumn("c", F.explode(F.when(F.col("b") == 0, cells(0)).otherwise(cells(1))))
    k = F.col("k") + F.shiftleft((F.col("c.to") - F.col("b")).cast("bigint"), qubit)
    moved = rows.select("sys", k.alias("to"), "k", (F.col("re") * F.col("c.gr") - F.col("im") * F.col("c.gi")).alias("re"), (F.col("re") * F.col("c.gi") + F.col("im") * F.col("c.gr")).alias("im"))
    if control is not None:
        on = F.shiftright("k", control).bitwiseAND(F.lit(1)) == 1
        moved = moved.where(on).unionByName(state.where(~on).select("sys", F.col("k").alias("to"), "k", "re", "im"))
    return moved.groupBy("sys", F.col("to").alias("k")).agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


def probabilities(state: DataFrame) -> DataFrame:
    return state.select("sys", "k", (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("p"))


def expect_z(state: DataFrame, qubit: int) -> DataFrame:
    """sys, z: the mean of +1 and -1 for the qubit's bit 0 and 1."""
    sign = 1 - 2 * F.shiftright("k", qubit).bitwiseAND(F.lit(1))
    return probabilities(state).groupBy("sys").agg(F.sum(sign * F.col("p")).alias("z"))


def fidelity(a: DataFrame, b: DataFrame) -> DataFrame:
    """sys, fidelity: the squared size of the inner product."""
    j = a.join(b.select("sys", "k", F.col("re").alias("r2"), F.col("im").alias("i2")), ["sys", "k"])
    return j.groupBy("sys").agg((F.pow(F.sum(F.col("re") * F.col("r2") + F.col("im") * F.col("i2")), F.lit(2)) + F.pow(F.sum(F.col("re") * F.col("i2") - F.col("im") * F.col("r2")), F.lit(2))).alias("fidelity"))
