"""Iterative solvers for sparse matrices i, j, v (repeated entries add up, absent ones are 0) with vectors as tables.

The matrix is dealt by column once and stays where it is; each round moves a vector to it, adds up products by row, and
takes all its inner products in one aggregate; where unknowns hang together by few entries only, CG and gmres_by_parts() solve
these whole in tasks. Only numbers, and for GMRES a system of at most restart + 1 unknowns, come to
the driver. Vectors are written each round. Null indices or values are left out.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .parts import by_size, parted
from .running import checkpointed, dropped, written


class Solution(NamedTuple):
    """x: j, x. residual: the norm of b - A x (for lsqr of A'(b - A x)), as the recurrence has it."""

    x: DataFrame
    rounds: int
    residual: float


def _dealt(a: DataFrame, key: str) -> DataFrame:
    """The matrix with one row an entry, partitioned by key."""
    parts = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    e = a.where("i IS NOT NULL AND j IS NOT NULL AND v IS NOT NULL").groupBy("i", "j").agg(F.sum(F.col("v").cast("double")).alias("v"))
    return checkpointed(e.repartition(parts, key))


def _product(a: DataFrame, x: DataFrame, inner: str = "j", outer: str = "i") -> DataFrame:
    """k, ax: the product with a vector k, x; inner is the index that meets the vector."""
    meet = x.select(F.col("k").alias(inner), "x")
    return a.join(meet, inner).groupBy(F.col(outer).alias("k")).agg(F.sum(F.col("v") * F.col("x")).alias("ax"))


def _vector(b: DataFrame, index: str = "i") -> DataFrame:
    return b.where(F.col(index).isNotNull() & F.col("v").isNotNull()).groupBy(F.col(index).alias("k")).agg(F.sum(F.col("v").cast("double")).alias("b"))


def _numbers(df: DataFrame, *sums: Column) -> list[float]:
    return [x or 0.0 for x in df.agg(*(F.sum(s) for s in sums)).first()]


def _unknowns(a: DataFrame, b: DataFrame) -> DataFrame:
    """k, b: every index of a square system, with its right-hand side."""
    return a.select(F.col("i").alias("k")).unionByName(a.select(F.col("j").alias("k"))).distinct().join(_vector(b), "k", "full").fillna(0.0, ["b"])


def _tasks(solve: Callable):
    """Rows are i, j, v of the matrix and i, null, b of the right-hand side. x, and once the residual's square and the rounds,
    as solve gives them for A (as a function of a vector) and b."""

    def batches(it):
        import numpy as np
        import pyarrow as pa

        held = list(it)
        t = pa.Table.from_batches(held) if held else None
        if t is None or not t.num_rows:
            return
        i, v, right = t.column(0).to_numpy(), t.column(2).to_numpy(), t.column(1).is_null().to_numpy()
        entry = ~right
        j = t.column(1).fill_null(0).to_numpy()[entry]
        ids, at = np.unique(np.concatenate([i, j]), return_inverse=True)
        n, row, col, v, b = len(ids), at[: len(i)][entry], at[len(i) :], v[entry], np.bincount(at[: len(i)][right], v[right], len(ids))
        x, rr, rounds = solve(lambda p: np.bincount(row, v * p[col], n), b)
        once = np.zeros(n)
        once[0] = rr
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(x), pa.array(once), pa.array(np.full(n, rounds), pa.int64())], ["j", "x", "rr", "rounds"])

    return batches


def _cg(max_iter: int, tol: float):
    def solve(a, b):
        import numpy as np

        x, r, p, rr, rounds = np.zeros(len(b)), b.copy(), b.copy(), float(b @ b), 0
        while rr**0.5 >= tol and rounds < max_iter:
            q = a(p)
            if (pq := float(p @ q)) <= 0:
                break
            x += rr / pq * p
            r -= rr / pq * q
            after = float(r @ r)
            p = r + after / rr * p
            rr, rounds = after, rounds + 1
        return x, rr, rounds

    return solve


def _gmres(restart: int, max_iter: int, tol: float):
    def solve(a, b):
        import numpy as np

        x, rounds, last = np.zeros(len(b)), 0, float("inf")
        vs, h = np.empty((restart + 1, len(b))), np.zeros((restart + 1, restart))
        while True:
            r = b - a(x)
            norm = float(r @ r) ** 0.5
            if norm < tol or rounds >= max_iter or norm >= last * (1 - 1e-12):
                return x, norm**2, rounds
            last, vs[0] = norm, r / norm
            for m in range(min(restart, max_iter - rounds)):
                w, base = a(vs[m]), vs[: m + 1]
                first = base @ w
                w -= first @ base
                again = base @ w
                w -= again @ base
                h[: m + 1, m], h[m + 1, m] = first + again, float(w @ w) ** 0.5
                rounds += 1
                y, rest = _least(h[: m + 2, : m + 1], norm)
                if rest < tol or h[m + 1, m] <= 1e-14 * norm:
                    break
                vs[m + 1] = w / h[m + 1, m]
            x += y @ vs[: len(y)]

    return solve


def _by_parts(a: DataFrame, b: DataFrame, solve: Callable, by_rounds: Callable, tol: float) -> Solution:
    """Unknowns that hang together by few entries are solved in a task that holds them whole, by solve(tol) of that task; larger
    systems by by_rounds(a, b, tol), as are all whose indices are not numbers. rounds is the most of any."""
    kinds = dict(a.dtypes)
    if {kinds["i"], kinds["j"], dict(b.dtypes)["i"]} != {"bigint"}:
        return by_rounds(a, b, tol)
    entries = a.where("i IS NOT NULL AND j IS NOT NULL AND v IS NOT NULL").select("i", "j", F.col("v").cast("double").alias("v"))
    small, large, tasks = by_size(parted(entries))
    places = small.select(F.col("i").alias("k"), "_part").unionByName(small.select(F.col("j").alias("k"), "_part")).distinct()
    rhs = written(_vector(b).join(places, "k", "left").select("_part", F.col("k").alias("i"), F.lit(None).cast("long").alias("j"), F.col("b").alias("v")))
    dealt = small.select("_part", "i", "j", "v").unionByName(rhs.where("_part IS NOT NULL")).repartition(tasks, "_part").select("i", "j", "v")
    solved = written(dealt.mapInArrow(_tasks(solve(tol * (0.5 / tasks) ** 0.5)), "j long, x double, rr double, rounds long"))
    square, rounds = solved.agg(F.sum("rr"), F.max("rounds")).first()
    x, square, rounds = solved.select("j", "x"), square or 0.0, rounds or 0
    apart = rhs.where("_part IS NULL").select("i", "v")
    if not (large.isEmpty() and apart.isEmpty()):
        rest = by_rounds(large, apart, tol * 0.5**0.5)
        x, square, rounds = x.unionByName(rest.x), square + rest.residual**2, max(rounds, rest.rounds)
    return Solution(x, rounds, square**0.5)


def cg(a: DataFrame, b: DataFrame, max_iter: int = 1000, tol: float = 1e-10) -> Solution:
    """Conjugate gradients for a symmetric positive definite matrix; b: i, v. Ends when the residual's norm is below tol, or
    when a direction has no positive curvature, which such a matrix does not have.

    Unknowns that hang together by few entries are solved in a task that holds them whole, where such a direction ends only
    that task; larger systems by cg_by_rounds(), as are all whose indices are not numbers. rounds is the most of any."""
    return _by_parts(a, b, lambda tol: _cg(max_iter, tol), lambda a, b, tol: cg_by_rounds(a, b, max_iter, tol), tol)


def cg_by_rounds(a: DataFrame, b: DataFrame, max_iter: int = 1000, tol: float = 1e-10) -> Solution:
    """As cg, for systems of any size, with the vectors as tables."""
    a = _dealt(a, "j")
    s = written(_unknowns(a, b).select("k", F.lit(0.0).alias("x"), F.col("b").alias("r"), F.col("b").alias("p")))
    (rr,) = _numbers(s, F.col("r") * F.col("r"))
    rounds = 0
    while rr**0.5 >= tol and rounds < max_iter:
        q = s.join(_product(a, s.select("k", F.col("p").alias("x"))), "k", "left").fillna(0.0, ["ax"])
        q = written(q)
        pq, rq, qq = _numbers(q, F.col("p") * F.col("ax"), F.col("r") * F.col("ax"), F.col("ax") * F.col("ax"))
        if pq <= 0:
            break
        alpha = rr / pq
        # what the next residual's square will be, from the same aggregate
        after = max(rr - 2 * alpha * rq + alpha * alpha * qq, 0.0)
        beta = after / rr
        r = F.col("r") - alpha * F.col("ax")
        s = q.select("k", (F.col("x") + alpha * F.col("p")).alias("x"), r.alias("r"), (r + beta * F.col("p")).alias("p"))
        rounds += 1
        if rounds % 10 == 0 or after < 1e-6 * rr or after**0.5 < tol:  # the difference has lost digits: take it anew
            s = written(s)
            (after,) = _numbers(s, F.col("r") * F.col("r"))
        rr = after
    return Solution(s.select(F.col("k").alias("j"), "x"), rounds, rr**0.5)


def gmres(a: DataFrame, b: DataFrame, restart: int = 20, max_iter: int = 1000, tol: float = 1e-10) -> Solution:
    """Restarted GMRES for any square matrix; b: i, v. The basis is an array in each row of the vector's table, made
    orthogonal twice a step. Ends when the residual's norm is below tol, or does not fall over a restart."""
    import numpy as np

    a = _dealt(a, "j")
    s = written(_unknowns(a, b).withColumn("x", F.lit(0.0)))
    rounds, last, old = 0, float("inf"), s
    while True:
        s = written(s.join(_product(a, s.select("k", "x")), "k", "left").select("k", "b", "x", (F.col("b") - F.coalesce("ax", F.lit(0.0))).alias("r")))
        dropped(old)
        norm = _numbers(s, F.col("r") * F.col("r"))[0] ** 0.5
        if norm < tol or rounds >= max_iter or norm >= last * (1 - 1e-12):
            return Solution(s.select(F.col("k").alias("j"), "x"), rounds, norm)
        last = norm
        basis = written(s.select("k", "b", "x", F.array(F.col("r") / norm).alias("vs")))
        dropped(s)
        h = np.zeros((restart + 1, restart))
        size = 0
        for m in range(min(restart, max_iter - rounds)):
            w = basis.join(_product(a, basis.select("k", F.col("vs")[m].alias("x"))), "k", "left").select("k", "b", "x", "vs", F.coalesce("ax", F.lit(0.0)).alias("w"))
            w = product = written(w)
            first = _numbers(w, *(F.col("vs")[i] * F.col("w") for i in range(m + 1)))
            less = F.col("w") - sum((F.col("vs")[i] * c for i, c in enumerate(first)), F.lit(0.0))
            w = w.withColumn("w", less)
            *again, square = _numbers(w, *(F.col("vs")[i] * F.col("w") for i in range(m + 1)), F.col("w") * F.col("w"))
            w = w.withColumn("w", F.col("w") - sum((F.col("vs")[i] * c for i, c in enumerate(again)), F.lit(0.0)))
            h[: m + 1, m] = np.add(first, again)
            h[m + 1, m] = max(square - float(np.square(again).sum()), 0.0) ** 0.5
            size, rounds = m + 1, rounds + 1
            y, rest = _least(h[: m + 2, : m + 1], norm)
            if rest < tol or h[m + 1, m] <= 1e-14 * norm:
                dropped(product)
                break
            old, basis = basis, written(w.select("k", "b", "x", F.concat("vs", F.array(F.col("w") / float(h[m + 1, m]))).alias("vs")))
            dropped(old, product)
        y, _ = _least(h[: size + 1, :size], norm)
        s = basis.select("k", "b", (F.col("x") + sum((F.col("vs")[i] * float(c) for i, c in enumerate(y)), F.lit(0.0))).alias("x"))
        old = basis


def gmres_by_parts(a: DataFrame, b: DataFrame, restart: int = 20, max_iter: int = 1000, tol: float = 1e-10) -> Solution:
    """As gmres, but unknowns that hang together by few entries are solved in a task that holds them whole; larger systems by
    gmres(), as are all whose indices are not numbers. rounds is the most of any."""
    return _by_parts(a, b, lambda tol: _gmres(restart, max_iter, tol), lambda a, b, tol: gmres(a, b, restart, max_iter, tol), tol)


def _least(h, norm: float):
    import numpy as np

    e = np.zeros(len(h))
    e[0] = norm
    y = np.linalg.lstsq(h, e, rcond=None)[0]
    return y, float(np.linalg.norm(h @ y - e))


def lsqr(a: DataFrame, b: DataFrame, max_iter: int = 1000, tol: float = 1e-10) -> Solution:
    """Least squares of any matrix, by bidiagonalisation; b: i, v. Where several x are as good, the shortest. Ends when the
    norm of A'(b - A x) is below tol times its first value."""
    by_row, by_col = _dealt(a, "i"), _dealt(a, "j")
    rows = by_row.select(F.col("i").alias("k")).distinct().join(_vector(b), "k", "full").fillna(0.0, ["b"])
    u = written(rows.withColumnRenamed("b", "x"))
    beta = _numbers(u, F.col("x") * F.col("x"))[0] ** 0.5
    cols = by_col.select(F.col("j").alias("k")).distinct().withColumn("x", F.lit(0.0))
    if not beta:
        return Solution(cols.select(F.col("k").alias("j"), "x"), 0, 0.0)
    u = u.select("k", (F.col("x") / beta).alias("x"))
    v = written(cols.select("k").join(_product(by_row, u, "i", "j"), "k", "left").select("k", F.coalesce("ax", F.lit(0.0)).alias("x")))
    alpha = _numbers(v, F.col("x") * F.col("x"))[0] ** 0.5
    if not alpha:
        return Solution(cols.select(F.col("k").alias("j"), "x"), 0, 0.0)
    # in one table, by column: v (unit), w (direction), y (solution)
    s = v.select("k", (F.col("x") / alpha).alias("x"), (F.col("x") / alpha).alias("w"), F.lit(0.0).alias("y"))
    phi, rho, start, rounds, rest = beta, alpha, alpha * beta, 0, alpha * beta
    while rounds < max_iter:
        u = written(u.join(_product(by_col, s.select("k", "x")), "k", "left").select("k", (F.coalesce("ax", F.lit(0.0)) - alpha * F.col("x")).alias("x")))
        beta = _numbers(u, F.col("x") * F.col("x"))[0] ** 0.5
        if beta:
            u = u.select("k", (F.col("x") / beta).alias("x"))
        t = s.join(_product(by_row, u, "i", "j"), "k", "left").select("k", (F.coalesce("ax", F.lit(0.0)) - beta * F.col("x")).alias("x"), "w", "y")
        t = written(t)
        alpha = _numbers(t, F.col("x") * F.col("x"))[0] ** 0.5
        size = (rho * rho + beta * beta) ** 0.5
        c, sn = rho / size, beta / size
        theta, rho, step, phi = sn * alpha, -c * alpha, c * phi, sn * phi
        unit = F.col("x") / alpha if alpha else F.col("x")
        s = t.select("k", unit.alias("x"), (unit - theta / size * F.col("w")).alias("w"), (F.col("y") + step / size * F.col("w")).alias("y"))
        rounds += 1
        rest = abs(phi * alpha * c)
        if rest <= tol * start or not alpha or not beta:
            break
    return Solution(s.select(F.col("k").alias("j"), F.col("y").alias("x")), rounds, rest)
