"""Factors of sparse tensors and matrices: canonical polyadic by alternating least squares, and non-negative ones.

A tensor is a table of coordinates and a value; a factor is a table of one row a coordinate with a column a component. The
product of the tensor with all factors but one is joins and one aggregate; what goes to the driver is products of
components, rank squared of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .running import written

#: Factors of at most so many numbers, counted before, are sent to the tasks; others are shuffled.
BROADCAST_VALUES = 2_000_000


class _Tensor:
    """Cells m0, m1, ..., v and the current factors, each m<k>, a0, a1, ..."""

    def __init__(self, t: DataFrame, modes: list[str], value: str, rank: int, seed: int):
        if rank < 1:
            raise ValueError("rank has to be positive")
        self.rank, self.modes = rank, modes
        named = t.select(*(F.col(m).alias(f"m{k}") for k, m in enumerate(modes)), F.col(value).cast("double").alias("v")).dropna()
        self.keys = [f"m{k}" for k in range(len(modes))]
        self.cells = written(named.groupBy(*self.keys).agg(F.sum("v").alias("v")))
        self.squares, self.least = self.cells.agg(F.coalesce(F.sum(F.col("v") * F.col("v")), F.lit(0.0)), F.min("v")).first()
        self.factors, self.sizes = [], []
        for k in self.keys:
            start = [((F.pmod(F.xxhash64(F.lit(seed), F.lit(f"{k}/{r}"), F.col(k)), F.lit(1 << 20)) + 0.5) / (1 << 20)).alias(f"a{r}") for r in range(rank)]
            self.factors.append(written(self.cells.select(k).distinct().select(k, *start)))
            self.sizes.append(self.factors[-1].count())

    def product(self, mode: int) -> DataFrame:
        """m<mode>, p0, p1, ...: the cells times all factors but that of the mode, added up by its coordinate."""
        rows, parts = self.cells, [F.col("v")] * self.rank
        for k, f in enumerate(self.factors):
            if k != mode:
                other = f.select(self.keys[k], *(F.col(f"a{r}").alias(f"f{k}_{r}") for r in range(self.rank)))
                rows = rows.join(F.broadcast(other) if self.sizes[k] * self.rank <= BROADCAST_VALUES else other, self.keys[k])
                parts = [p * F.col(f"f{k}_{r}") for r, p in enumerate(parts)]
        return rows.groupBy(self.keys[mode]).agg(*(F.sum(p).alias(f"p{r}") for r, p in enumerate(parts)))

    def put(self, mode: int, made: DataFrame):
        """Makes m<mode>, a.., p.. the factor; returns its products of components and its inner product with p.."""
        import numpy as np

        made, n = written(made), self.rank
        self.factors[mode] = made.select(self.keys[mode], *(f"a{r}" for r in range(n)))
        pairs = [(r, q) for r in range(n) for q in range(r, n)]
        inner = sum((F.col(f"a{r}") * F.col(f"p{r}") for r in range(n)), F.lit(0.0))
        got = made.agg(F.sum(inner), *(F.sum(F.col(f"a{r}") * F.col(f"a{q}")) for r, q in pairs)).first()
        return self._square(np, pairs, got[1:]), got[0] or 0.0

    def gram(self, mode: int):
        import numpy as np

        pairs = [(r, q) for r in range(self.rank) for q in range(r, self.rank)]
        return self._square(np, pairs, self.factors[mode].agg(*(F.sum(F.col(f"a{r}") * F.col(f"a{q}")) for r, q in pairs)).first())

    def _square(self, np, pairs, values):
        g = np.zeros((self.rank, self.rank))
        for (r, q), x in zip(pairs, values):
            g[r, q] = g[q, r] = x or 0.0
        return g

    def error(self, grams, inner: float) -> float:
        """Root of the sum of squared differences of all cells, those of no value included."""
        import numpy as np

        both = np.prod(np.stack(grams), axis=0).sum()
        return float(max(self.squares - 2 * inner + both, 0.0)) ** 0.5

    def table(self, mode: int, scale) -> DataFrame:
        """The mode's coordinate, component (from 0), x."""
        columns = F.array(*(F.col(f"a{r}") * float(scale[r]) for r in range(self.rank)))
        return self.factors[mode].select(F.col(self.keys[mode]).alias(self.modes[mode]), F.posexplode(columns).alias("component", "x"))


def _settled(errors: list[float], tolerance: float) -> bool:
    return len(errors) > 1 and abs(errors[-2] - errors[-1]) <= tolerance * max(errors[0], 1e-300)


def cp(t: DataFrame, modes: list[str], rank: int, value: str = "v", rounds: int = 200, tolerance: float = 1e-6, seed: int = 0):
    """(factors, weights, errors): for each mode a table of its coordinate, component, x; the components' weights, as
    columns of factors have length 1; and the error after each round, which never rises.

    Cells that are not in t are 0; several rows of one cell add up; nulls are left out; an empty tensor has empty factors
    and weights of 0. A round solves for each mode in turn by least squares, rank unknowns a coordinate; a round that
    lowers the error by no more than tolerance times the first one is the last.
    """
    import numpy as np

    made = _Tensor(t, modes, value, rank, seed)
    grams, errors = [made.gram(k) for k in range(len(modes))], []
    while made.squares and len(errors) < rounds and not _settled(errors, tolerance):
        for k in range(len(modes)):
            inverse = np.linalg.pinv(np.prod(np.stack([g for q, g in enumerate(grams) if q != k]), axis=0), rcond=1e-12, hermitian=True)
            solved = [sum((F.col(f"p{q}") * float(inverse[q, r]) for q in range(rank)), F.lit(0.0)).alias(f"a{r}") for r in range(rank)]
            grams[k], inner = made.put(k, made.product(k).select("*", *solved))
        errors.append(made.error(grams, inner))
    lengths = [np.sqrt(np.diag(g)) for g in grams]
    weights = np.prod(np.stack(lengths), axis=0).tolist()
    return [made.table(k, 1 / np.maximum(n, 1e-300)) for k, n in enumerate(lengths)], weights, errors


def nmf(a: DataFrame, rank: int, row: str = "i", column: str = "j", value: str = "v", rounds: int = 500, tolerance: float = 1e-6, seed: int = 0):
    """(w, h, errors): row, component, x and column, component, x, none negative, by multiplicative updates; errors as in
    cp. Entries that are not in a are 0, several of one place add up, nulls are left out; a negative one is an error."""
    made = _Tensor(a, [row, column], value, rank, seed)
    if (made.least or 0) < 0:
        raise ValueError("negative entries")
    grams, errors = [made.gram(0), made.gram(1)], []
    while made.squares and len(errors) < rounds and not _settled(errors, tolerance):
        for k in (1, 0):
            g = grams[1 - k]
            under = [sum((F.col(f"a{q}") * float(g[q, r]) for q in range(rank)), F.lit(1e-12)) for r in range(rank)]
            joined = made.factors[k].join(made.product(k), made.keys[k])
            now = joined.select(made.keys[k], *(f"p{r}" for r in range(rank)), *((F.col(f"a{r}") * F.col(f"p{r}") / under[r]).alias(f"a{r}") for r in range(rank)))
            grams[k], inner = made.put(k, now)
        errors.append(made.error(grams, inner))
    ones = [1.0] * rank
    return made.table(0, ones), made.table(1, ones), errors


def reconstruct(factors: list[DataFrame], modes: list[str], weights: list[float] | None = None) -> DataFrame:
    """modes, v: all cells that the factors multiply to. As many as the product of the modes' sizes: for small tensors, or
    factors cut down to the coordinates that are asked for."""
    made = factors[0]
    for f in factors[1:]:
        made = made.withColumnRenamed("x", "_x").join(f, "component").withColumn("x", F.col("_x") * F.col("x")).drop("_x")
    if weights is not None:
        made = made.withColumn("x", F.col("x") * F.element_at(F.array(*map(F.lit, map(float, weights))), F.col("component") + 1))
    return made.groupBy(*modes).agg(F.sum("x").alias("v"))
