"""Queries over roots, complex maps, polynomial algebra and plane geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cplx, poly, roots
from ..operators import geo
from ..operators.by_value import by_value
from ..sources.tables import table
from .registry import query

P = "(SELECT p_partkey, p_size / 10.0 AS a, (p_partkey % 7 - 3) / 4.0 AS x, (p_partkey % 11 - 5) / 5.0 AS y FROM part)"
LIT = F.lit


def _part(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", (F.col("p_size") / 10.0).alias("a"), ((k % 7 - 3) / 4.0).alias("x"), ((k % 11 - 5) / 5.0).alias("y"))


@query("p_partkey", "bi il se ne ha fp gs", f"SELECT p_partkey, sqrt(a) AS bi, sqrt(a) AS il, sqrt(a) AS se, cbrt(a) AS ne, cbrt(a) AS ha, sqrt(a) AS fp, 0 + 0.0 AS gs FROM {P}", 5)
def optim_roots(spark, d):
    a = F.col("a")
    square, cube = lambda v: v * v - a, lambda v: v * v * v - a
    return by_value(_part(spark, d), ["a"], ["p_partkey"], roots.bisection(square, LIT(0.0), a + 1).alias("bi"), roots.illinois(square, LIT(0.0), a + 1).alias("il"), roots.secant(square, a, a + 1).alias("se"), roots.newton(cube, a + 1).alias("ne"),
                                  roots.halley(cube, lambda v: 3 * v * v, lambda v: 6 * v, a + 1).alias("ha"), roots.fixed_point(lambda v: (v + a / v) / 2, a + 1, 60).alias("fp"),
                                  F.round(roots.golden_section(lambda v: (v - a) * (v - a), LIT(0.0), a + 1) - a, 4).alias("gs"))


@query("p_partkey", "mr mi jr ji pk hd gf sr si", f"""SELECT p_partkey, ((x + 1) * (x + 3) + y * y) / (pow(x + 3, 2) + y * y) AS mr, (y * (x + 3) - (x + 1) * y) / (pow(x + 3, 2) + y * y) AS mi, (x + 3) + (x + 3) / (pow(x + 3, 2) + y * y) AS jr, y - y / (pow(x + 3, 2) + y * y) AS ji,
 (1 - x * x) / (1 - 2 * x * cos(a - y) + x * x) AS pk, ln((1 + q) / (1 - q)) AS hd, ln(q) / (2 * pi()) AS gf, 1 + 2 * x + 3 * (x * x - y * y) AS sr, 2 * y + 6 * x * y AS si
 FROM (SELECT *, sqrt(pow(x / 2 - 0.51, 2) + pow(y / 2 - 0.1, 2)) / sqrt(pow(1 - x / 2 * 0.51 - y / 2 * 0.1, 2) + pow(y / 2 * 0.51 - x / 2 * 0.1, 2)) AS q FROM {P})""")
def complex_maps(spark, d):
    x, y, a = F.col("x"), F.col("y"), F.col("a")
    z, one, three, zero, at = cplx.make(x, y), cplx.make(LIT(1.0), LIT(0.0)), cplx.make(LIT(3.0), LIT(0.0)), cplx.make(LIT(0.0), LIT(0.0)), cplx.make(LIT(0.51), LIT(0.1))
    m, j, s, h = cplx.moebius(one, one, one, three, z), cplx.joukowski(cplx.add(z, three)), cplx.power_series(F.array(LIT(1.0), LIT(2.0), LIT(3.0)), z), cplx.make(x / 2, y / 2)
    return _part(spark, d).select("p_partkey", m["re"].alias("mr"), m["im"].alias("mi"), j["re"].alias("jr"), j["im"].alias("ji"), cplx.poisson_kernel(a, y, x).alias("pk"), cplx.hyperbolic_distance(h, at).alias("hd"), cplx.green_function_disk(h, at).alias("gf"), s["re"].alias("sr"), s["im"].alias("si"))


@query("p_partkey", "q0 q1 r0 r1 c0 c2 c4 p0 p3 s0 s1 mo su", f"""SELECT p_partkey, x - a * y AS q0, a AS q1, y - (x - a * y) * y AS r0, 0.0 AS r1, y + x * y + a * y * y AS c0, x + 2 * a * y AS c2, a AS c4, pow(y, 3) AS p0, 1.0 AS p3, y + x * 2 + a * 4 AS s0, x + 4 * a AS s1, y / a AS mo, x - 1 AS su FROM {P}""")
def poly_algebra_more(spark, d):
    a, x, y = F.col("a"), F.col("x"), F.col("y")
    p, line = F.array(y, x, a), F.array(y, LIT(1.0))
    got = poly.divide(p, line)
    c, third, moved = poly.compose(p, F.array(y, LIT(0.0), LIT(1.0))), poly.power(line, 3), poly.shift(p, LIT(2.0))
    at = lambda arr, i: F.get(arr, LIT(i))
    return _part(spark, d).select("p_partkey", at(got["quotient"], 0).alias("q0"), at(got["quotient"], 1).alias("q1"), at(got["remainder"], 0).alias("r0"), at(got["remainder"], 1).alias("r1"), at(c, 0).alias("c0"), at(c, 2).alias("c2"), at(c, 4).alias("c4"),
                                  at(third, 0).alias("p0"), at(third, 3).alias("p3"), at(moved, 0).alias("s0"), at(moved, 1).alias("s1"), at(poly.monic(p), 0).alias("mo"), at(poly.subtract(p, line), 1).alias("su"))


@query("p_partkey box circle", "dl ds mx my vol cr hc", f"""SELECT p_partkey, x - 0.2 <= 1 AND x + 0.2 >= 0 AND y - 0.2 <= 1 AND y + 0.2 >= 0 AS box, pow(x - 0.5, 2) + pow(y - 0.5, 2) <= 0.36 AS circle, abs(y - x) / sqrt(2) AS dl,
 CASE WHEN x + y <= 0 THEN sqrt(x * x + y * y) WHEN x + y >= 2 THEN sqrt(pow(x - 1, 2) + pow(y - 1, 2)) ELSE abs(y - x) / sqrt(2) END AS ds, CASE WHEN abs(x + y) <= 2 AND abs(x - y) <= 2 THEN (x + y) / 2 END AS mx, CASE WHEN abs(x + y) <= 2 AND abs(x - y) <= 2 THEN (x + y) / 2 END AS my, a / 6 AS vol,
 x + (y - x) * t + 0.5 * (a + x - 2 * y) * t * t * (t - 1) AS cr, x + a * t + (3 * (y - x) - 2 * a - 1) * t * t + (2 * (x - y) + a + 1) * pow(t, 3) AS hc FROM (SELECT *, a / 6 AS t FROM {P})""", 10)
def geo_distances(spark, d):
    a, x, y, o, i = F.col("a"), F.col("x"), F.col("y"), LIT(0.0), LIT(1.0)
    met = geo.segments_meet(x - 2, y + 2, x + 2, y - 2, LIT(-1.0), LIT(-1.0), i, i)
    return _part(spark, d).select("p_partkey", geo.boxes_overlap((x - 0.2, y - 0.2, x + 0.2, y + 0.2), (o, o, i, i)).alias("box"), geo.circles_overlap(x, y, LIT(0.1), LIT(0.5), LIT(0.5), LIT(0.5)).alias("circle"), geo.distance_to_line(x, y, o, o, i, i).alias("dl"),
                                  geo.distance_to_segment(x, y, o, o, i, i).alias("ds"), met["x"].alias("mx"), met["y"].alias("my"), geo.tetrahedron_volume((o, o, o), (i, o, o), (x, i, o), (x, y, a)).alias("vol"),
                                  geo.catmull_rom(2 * x - y, x, y, a, a / 6).alias("cr"), geo.hermite_curve(x, a, y, i, a / 6).alias("hc"))
