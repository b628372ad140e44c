"""Matrices in coordinates i, j, v (absent entries are 0), as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers of a matrix that a task holds as an array at a time.
DENSE = 1 << 20


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """Products meet on the inner index and are summed before they are shuffled by (i, j)."""
    return a.select("i", F.col("j").alias("k"), F.col("v").alias("x")).join(b.select(F.col("i").alias("k"), "j", F.col("v").alias("y")), "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def _packed(a: DataFrame, columns: int, made, schema: str) -> DataFrame:
    """made(i, dense rows) of the rows of a, some at a time; a row has to be in one place first, and fits a task."""
    rows = a.select(F.col("i").alias("i"), "j", "v").repartition("i").groupBy("i").agg(F.collect_list(F.struct(F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v"))).alias("r"))

    def batches(it):
        import numpy as np
        import pyarrow as pa

        def dense():
            for b in it:
                lists = b.column("r")
                of, entries = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy()), lists.flatten()
                for at in range(0, b.num_rows, max(1, DENSE // columns)):
                    n = min(max(1, DENSE // columns), b.num_rows - at)
                    some = np.flatnonzero((of >= at) & (of < at + n))
                    m = np.zeros((n, columns))
                    np.add.at(m, (of[some] - at, entries.field("j").to_numpy()[some]), entries.field("v").to_numpy()[some])
                    yield b.column("i").slice(at, n), m

        yield from made(dense(), np, pa)

    return rows.mapInArrow(batches, schema)


def gram_of(a: DataFrame, columns: int) -> DataFrame:
    """The transpose of a by a, of a matrix with j from 0 to columns - 1: a task sends one row an entry of the product."""

    def products(dense, np, pa):
        g = np.zeros((columns, columns))
        for _, m in dense:
            g += m.T @ m
        i, j = np.nonzero(g)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(j, pa.int64()), pa.array(g[i, j])], ["i", "j", "v"])

    return _packed(a, columns, products, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))


def times(a: DataFrame, columns: int, m) -> DataFrame:
    """a by a small matrix, a numpy array with one row a column of a: every row of the product is made in one place, so
    nothing is added up by (i, j)."""

    def products(dense, np, pa):
        for i, rows in dense:
            out = rows @ m
            at = pa.array(np.repeat(np.arange(len(out)), m.shape[1]))
            yield pa.RecordBatch.from_arrays([i.take(at), pa.array(np.tile(np.arange(m.shape[1]), len(out)), pa.int64()), pa.array(out.ravel())], ["i", "j", "v"])

    return _packed(a, columns, products, f"i {a.schema['i'].dataType.simpleString()}, j long, v double")


def gram(a: DataFrame) -> DataFrame:
    """The transpose of a by a: rows are packed first, so that only one row of a is expanded at a time."""
    rows = a.groupBy("i").agg(F.collect_list(F.struct("j", "v")).alias("r"))
    pairs = rows.select(F.explode("r").alias("x"), "r").select("x", F.explode("r").alias("y"))
    return pairs.groupBy(F.col("x.j").alias("i"), F.col("y.j").alias("j")).agg(F.sum(F.col("x.v") * F.col("y.v")).alias("v"))


def tall_matmul(a: DataFrame, b: DataFrame, columns: int) -> DataFrame:
    """matmul of a tall matrix by a small one, columns by columns, which goes to the driver and to the tasks."""
    import numpy as np

    m = np.zeros((columns, columns))
    got = b.select("i", "j", "v").toArrow()
    np.add.at(m, (got["i"].to_numpy(), got["j"].to_numpy()), got["v"].to_numpy())
    return times(a, columns, m)


def add(a: DataFrame, b: DataFrame, scale: float = 1.0) -> DataFrame:
    return a.select("i", "j", "v").unionByName(b.select("i", "j", (F.col("v") * scale).alias("v"))).groupBy("i", "j").agg(F.sum("v").alias("v"))


def hadamard(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("i", "j", F.col("v").alias("_y")), ["i", "j"]).select("i", "j", (F.col("v") * F.col("_y")).alias("v"))


def matvec(a: DataFrame, x: DataFrame) -> DataFrame:
    """x: j, x. Gives i, v."""
    return a.join(x, "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("v"))


def kron(a: DataFrame, b: DataFrame, rows_b: int, cols_b: int) -> DataFrame:
    """Every entry of a by every entry of b: the result has that many entries by definition; b is packed in one row."""
    packed = b.agg(F.collect_list(F.struct("i", "j", "v")).alias("b"))
    both = a.join(F.broadcast(packed), F.lit(True)).select("i", "j", "v", F.explode("b").alias("y"))
    return both.select((F.col("i") * rows_b + F.col("y.i")).alias("i"), (F.col("j") * cols_b + F.col("y.j")).alias("j"), (F.col("v") * F.col("y.v")).alias("v"))


def norms(a: DataFrame) -> DataFrame:
    """frobenius, entry_sum (of absolute values), max_abs, trace."""
    v = F.col("v")
    return a.agg(F.sqrt(F.sum(v * v)).alias("frobenius"), F.sum(F.abs(v)).alias("entry_sum"), F.max(F.abs(v)).alias("max_abs"), F.coalesce(F.sum(F.when(F.col("i") == F.col("j"), v)), F.lit(0.0)).alias("trace"))


def tril(a: DataFrame, k: int = 0) -> DataFrame:
    return a.where(F.col("j") <= F.col("i") + k)


def triu(a: DataFrame, k: int = 0) -> DataFrame:
    return a.where(F.col("j") >= F.col("i") + k)


def power_iteration(a: DataFrame, n: int, rounds: int = 30):
    """The largest eigenvalue in size of a small symmetric matrix (n x n, brought to the driver; n is the caller's bound)."""
    import numpy as np

    m = np.zeros((n, n))
    for r in a.toLocalIterator():
        m[r["i"], r["j"]] = r["v"]
    x = np.ones(n) / np.sqrt(n)
    for _ in range(rounds):
        y = m @ x
        x = y / (np.linalg.norm(y) or 1)
    return float(x @ m @ x)


def einsum(spec: str, a: DataFrame, b: DataFrame) -> DataFrame:
    """Two operands with one-letter index columns and v, such as "ij,jk->ik": a join on shared letters, a sum over dropped ones."""
    left, out = spec.replace(" ", "").split("->")
    x, y = left.split(",")
    shared = [c for c in x if c in y]
    a, b = a.select(*x, F.col("v").alias("_x")), b.select(*y, F.col("v").alias("_y"))
    both = a.join(b, shared) if shared else a.join(F.broadcast(b), F.lit(True))
    return both.groupBy(*out).agg(F.sum(F.col("_x") * F.col("_y")).alias("v"))
