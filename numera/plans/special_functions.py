"""Queries over special functions, orthogonal polynomials, distributions, prices and counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import counting, prob, series
from ..functions import orthogonal as ortho
from ..operators import finance
from ..operators.by_value import by_value
from ..sources.tables import table
from .registry import query

#: x in (-1, 1) and a degree n of 0 to 6.
XN = "(SELECT p_partkey, ((p_partkey * 37) % 199 - 99) / 100.5 AS x, p_size % 7 AS n FROM part)"
LIST = "list_sum(list_transform(range(0, {0} + 1), lambda k: {1}))"


def _sum(top: str, term: str) -> str:
    return LIST.format(top, term)


@query("p_partkey n", "ct cu cv cw lp hh he ll la gc jp", f"""SELECT p_partkey, n, cos(n * acos(x)) AS ct, sin((n + 1) * acos(x)) / sin(acos(x)) AS cu, cos((n + 0.5) * acos(x)) / cos(acos(x) / 2) AS cv, sin((n + 0.5) * acos(x)) / sin(acos(x) / 2) AS cw,
 {_sum('n', 'pow(factorial(n::INT) / factorial(k::INT) / factorial((n - k)::INT), 2) * pow(x - 1, n - k) * pow(x + 1, k)')} / pow(2, n) AS lp,
 factorial(n::INT) * {_sum('n // 2', 'pow(-1, k) * pow(2 * x, n - 2 * k) / factorial(k::INT) / factorial((n - 2 * k)::INT)')} AS hh, factorial(n::INT) * {_sum('n // 2', 'pow(-0.5, k) * pow(x, n - 2 * k) / factorial(k::INT) / factorial((n - 2 * k)::INT)')} AS he,
 {_sum('n', 'factorial(n::INT) / factorial(k::INT) / factorial((n - k)::INT) * pow(-x, k) / factorial(k::INT)')} AS ll, {_sum('n', 'factorial((n + 2)::INT) / factorial((n - k)::INT) / factorial((k + 2)::INT) * pow(-x, k) / factorial(k::INT)')} AS la,
 {_sum('n // 2', 'pow(-1, k) * gamma(n - k + 1.5) / gamma(1.5) / factorial(k::INT) / factorial((n - 2 * k)::INT) * pow(2 * x, n - 2 * k)')} AS gc,
 {_sum('n', 'factorial((n + 1)::INT) / factorial((n - k)::INT) / factorial((k + 1)::INT) * factorial((n + 2)::INT) / factorial(k::INT) / factorial((n + 2 - k)::INT) * pow((x - 1) / 2, k) * pow((x + 1) / 2, n - k)')} AS jp FROM {XN}""")
def special_orthogonal(spark, d):
    x, n = ((F.col("p_partkey") * 37) % 199 - 99) / 100.5, F.col("p_size") % 7
    return table(spark, d, "part").select("p_partkey", n.cast("bigint").alias("n"), ortho.chebyshev_t(n, x).alias("ct"), ortho.chebyshev_u(n, x).alias("cu"), ortho.chebyshev_v(n, x).alias("cv"), ortho.chebyshev_w(n, x).alias("cw"), ortho.legendre_p(n, x).alias("lp"),
                                          ortho.hermite_h(n, x).alias("hh"), ortho.hermite_he(n, x).alias("he"), ortho.laguerre_l(n, x).alias("ll"), ortho.laguerre_l(n, x, 2.0).alias("la"), ortho.gegenbauer_c(n, 1.5, x).alias("gc"), ortho.jacobi_p(n, 1.0, 2.0, x).alias("jp"))


@query("p_partkey", "lg g rg b po ff dg tg", """SELECT p_partkey, lgamma(x) AS lg, gamma(x / 5 - 3.05) AS g, 1 / gamma(x / 5 - 3.05) AS rg, exp(lgamma(x) + lgamma(x / 2) - lgamma(x * 1.5)) AS b, x * (x + 1) * (x + 2) * (x + 3) AS po, x * (x - 1) * (x - 2) * (x - 3) AS ff,
 ln(x + 30) - 1 / (2 * (x + 30)) - 1 / (12 * pow(x + 30, 2)) + 1 / (120 * pow(x + 30, 4)) - list_sum(list_transform(range(0, 30), lambda k: 1 / (x + k))) AS dg,
 1 / (x + 60) + 1 / (2 * pow(x + 60, 2)) + 1 / (6 * pow(x + 60, 3)) - 1 / (30 * pow(x + 60, 5)) + list_sum(list_transform(range(0, 60), lambda k: 1 / pow(x + k, 2))) AS tg FROM (SELECT p_partkey, p_size / 7.0 AS x FROM part)""")
def special_gamma_family(spark, d):
    x, y = F.col("p_size") / 7.0, F.col("p_size") / 7.0 / 5 - 3.05
    return table(spark, d, "part").select("p_partkey", series.log_gamma(x).alias("lg"), series.gamma_func(y).alias("g"), series.rgamma(y).alias("rg"), series.beta_func(x, x / 2).alias("b"), series.pochhammer(x, F.lit(4)).alias("po"),
                                          series.falling_factorial(x, F.lit(4)).alias("ff"), series.digamma(x).alias("dg"), series.trigamma(x).alias("tg"))


@query("p_partkey", "er ec gi gu bi ze hu et be pl", """SELECT p_partkey, e AS er, 1 - e AS ec, 1 - exp(-x) * (1 + x + x * x / 2) AS gi, exp(-x) * (1 + x + x * x / 2) AS gu, 6 * pow(u, 2) - 8 * pow(u, 3) + 3 * pow(u, 4) AS bi, z AS ze, h AS hu, (1 - pow(2, 1 - s)) * z AS et,
 list_sum(list_transform(range(0, 4000), lambda k: CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END * pow(2 * k + 1, -s))) + 0.5 * pow(8001, -s) + s / 2 * pow(8001, -s - 1) AS be, -ln(1 - u) AS pl
 FROM (SELECT *, 2 / sqrt(pi()) * list_sum(list_transform(range(0, 60), lambda k: pow(-1, k) * pow(x / 4, 2 * k + 1) / gamma(k + 1) / (2 * k + 1))) AS e,
  list_sum(list_transform(range(1, 61), lambda k: pow(k, -s))) + pow(60, 1 - s) / (s - 1) - pow(60, -s) / 2 + s * pow(60, -s - 1) / 12 - s * (s + 1) * (s + 2) * pow(60, -s - 3) / 720 + s * (s + 1) * (s + 2) * (s + 3) * (s + 4) * pow(60, -s - 5) / 30240 AS z,
  list_sum(list_transform(range(0, 61), lambda k: pow(k + x, -s))) + pow(60 + x, 1 - s) / (s - 1) - pow(60 + x, -s) / 2 + s * pow(60 + x, -s - 1) / 12 - s * (s + 1) * (s + 2) * pow(60 + x, -s - 3) / 720 + s * (s + 1) * (s + 2) * (s + 3) * (s + 4) * pow(60 + x, -s - 5) / 30240 AS h
  FROM (SELECT p_partkey, p_size / 7.0 AS x, p_size / 60.0 AS u, 1.5 + p_size / 10.0 AS s FROM part))""")
def special_sums(spark, d):
    n = F.col("p_size")
    x, u, s, lit = n / 7.0, n / 60.0, 1.5 + n / 10.0, F.lit
    return by_value(table(spark, d, "part"), ["p_size"], ["p_partkey"], series.erf(x / 4).alias("er"), series.erfc(x / 4).alias("ec"), series.gamma_inc_reg(lit(3.0), x).alias("gi"), series.gamma_inc_reg_upper(lit(3.0), x).alias("gu"), series.beta_inc_reg(lit(2.0), lit(3.0), u).alias("bi"),
                                          series.zeta(s).alias("ze"), series.zeta_hurwitz(s, x).alias("hu"), series.eta_dirichlet(s).alias("et"), series.beta_dirichlet(s).alias("be"), series.polylog(lit(1), u).alias("pl"))


@query("p_partkey", "j0 j1 jn bi y2 k e dd w", f"""SELECT p_partkey, {_sum('40', 'pow(-1, k) * pow(x / 2, 2 * k) / pow(gamma(k + 1), 2)')} AS j0, {_sum('40', 'pow(-1, k) * pow(x / 2, 2 * k + 1) / gamma(k + 1) / gamma(k + 2)')} AS j1, {_sum('40', 'pow(-1, k) * pow(x / 2, 2 * k + 3) / gamma(k + 1) / gamma(k + 4)')} AS jn,
 {_sum('40', 'pow(x / 2, 2 * k + 2) / gamma(k + 1) / gamma(k + 3)')} AS bi, (-3 / pow(x, 3) + 1 / x) * cos(x) - 3 / (x * x) * sin(x) AS y2, pi() / 2 * {_sum('400', 'c[k + 1] * pow(m, 2 * k)')} AS k, pi() / 2 * {_sum('400', 'c[k + 1] * pow(m, 2 * k) / (1 - 2 * k)')} AS e,
 pi() / 2 * ({_sum('400', 'c[k + 1] * pow(m, 2 * k)')} - {_sum('400', 'c[k + 1] * pow(m, 2 * k) / (1 - 2 * k)')}) / (m * m) AS dd, x AS w
 FROM (SELECT p_partkey, p_size / 7.0 AS x, p_size / 60.0 AS m FROM part), (SELECT list_transform(range(0, 401), lambda k: exp(2 * (lgamma(k + 0.5) - lgamma(k + 1))) / pi()) AS c)""")
def special_bessel_elliptic(spark, d):
    x, m = F.col("p_size") / 7.0, F.col("p_size") / 60.0
    return by_value(table(spark, d, "part"), ["p_size"], ["p_partkey"], series.bessel_j0(x).alias("j0"), series.bessel_j1(x).alias("j1"), series.bessel_j(F.lit(3), x).alias("jn"), series.bessel_i(F.lit(2), x).alias("bi"), series.spherical_yn(F.lit(2), x).alias("y2"),
                                          series.ellip_k(m).alias("k"), series.ellip_e(m).alias("e"), series.ellip_d(m).alias("dd"), series.lambert_w(x * F.exp(x)).alias("w"))


@query("p_partkey", "f0 e0 p0 d1", """SELECT p_partkey, asin(sin(u)) AS f0, u AS e0, pi() / 2 / sqrt(1 - u / 2) AS p0, 1 - u / 4 + list_sum(list_transform([1, 2, 3, 4, 5, 6, 7, 8], lambda i: [1/6.0, -1/30.0, 1/42.0, -1/30.0, 5/66.0, -691/2730.0, 7/6.0, -3617/510.0][i] * pow(u, 2 * i) / gamma(2 * i + 1) / (2 * i + 1))) AS d1
 FROM (SELECT p_partkey, p_size / 60.0 AS u FROM part)""")
def special_quadrature(spark, d):
    u, zero = F.col("p_size") / 60.0, F.lit(0.0)
    return by_value(table(spark, d, "part"), ["p_size"], ["p_partkey"], series.ellip_f(u, zero).alias("f0"), series.ellip_e_inc(u, zero).alias("e0"), series.ellip_pi(u / 2, zero).alias("p0"), series.debye(1, u).alias("d1"))


@query("p_partkey", "wp wq lp lq op oq gp gq cp cq pp pq rp rq", """SELECT p_partkey, 1.5 / 2 * sqrt(x / 2) * exp(-pow(x / 2, 1.5)) AS wp, 2 * pow(-ln(1 - p), 1 / 1.5) AS wq, exp(-abs(x - 1) / 2) / 4 AS lp, CASE WHEN p < 0.5 THEN 1 + 2 * ln(2 * p) ELSE 1 - 2 * ln(2 - 2 * p) END AS lq,
 1 / (8 * pow(cosh((x - 1) / 4), 2)) AS op, 1 + 2 * ln(p / (1 - p)) AS oq, exp(-(x - 1) / 2 - exp(-(x - 1) / 2)) / 2 AS gp, 1 - 2 * ln(-ln(p)) AS gq, 2 / pi() / (4 + pow(x - 1, 2)) AS cp, 1 - 2 / tan(pi() * p) AS cq,
 CASE WHEN x >= 0.5 THEN 3 * 0.125 / pow(x, 4) ELSE 0 END AS pp, 0.5 * pow(1 - p, -1 / 3.0) AS pq, x / 4 * exp(-x * x / 8) AS rp, 2 * sqrt(-2 * ln(1 - p)) AS rq FROM (SELECT p_partkey, p_size / 7.0 AS x, p_size / 51.0 AS p FROM part)""")
def prob_densities_quantiles(spark, d):
    x, p = F.col("p_size") / 7.0, F.col("p_size") / 51.0
    return table(spark, d, "part").select("p_partkey", prob.weibull_pdf(x, 1.5, 2.0).alias("wp"), prob.weibull_ppf(p, 1.5, 2.0).alias("wq"), prob.laplace_pdf(x, 1.0, 2.0).alias("lp"), prob.laplace_ppf(p, 1.0, 2.0).alias("lq"), prob.logistic_pdf(x, 1.0, 2.0).alias("op"), prob.logistic_ppf(p, 1.0, 2.0).alias("oq"),
                                          prob.gumbel_pdf(x, 1.0, 2.0).alias("gp"), prob.gumbel_ppf(p, 1.0, 2.0).alias("gq"), prob.cauchy_pdf(x, 1.0, 2.0).alias("cp"), prob.cauchy_ppf(p, 1.0, 2.0).alias("cq"), prob.pareto_pdf(x, 0.5, 3.0).alias("pp"), prob.pareto_ppf(p, 0.5, 3.0).alias("pq"),
                                          prob.rayleigh_pdf(x, 2.0).alias("rp"), prob.rayleigh_ppf(p, 2.0).alias("rq"))


@query("p_partkey", "bp bc pc gp gc xp xc ep ec tp tc fp fc", f"""SELECT p_partkey, factorial(12) / factorial(k) / factorial(12 - k) * pow(0.3, k) * pow(0.7, 12 - k) AS bp, {_sum('k', 'factorial(12) / factorial(k::INT) / factorial((12 - k)::INT) * pow(0.3, k) * pow(0.7, 12 - k)')} AS bc, exp(-2.5) * {_sum('k', 'pow(2.5, k) / factorial(k::INT)')} AS pc,
 x * x * exp(-x / 2) / 16 AS gp, 1 - exp(-x / 2) * (1 + x / 2 + x * x / 8) AS gc, x * x * exp(-x / 2) / 16 AS xp, 1 - exp(-x / 2) * (1 + x / 2 + x * x / 8) AS xc, 12 * u * pow(1 - u, 2) AS ep, 6 * pow(u, 2) - 8 * pow(u, 3) + 3 * pow(u, 4) AS ec,
 2 / (pi() * sqrt(3)) / pow(1 + y * y / 3, 2) AS tp, 0.5 + (y / sqrt(3) / (1 + y * y / 3) + atan(y / sqrt(3))) / pi() AS tc, 12 * v * pow(1 - v, 2) * 24 / pow(4 * x + 6, 2) AS fp, 6 * pow(v, 2) - 8 * pow(v, 3) + 3 * pow(v, 4) AS fc
 FROM (SELECT *, 4 * x / (4 * x + 6) AS v FROM (SELECT p_partkey, (p_size % 13)::INT AS k, p_size / 7.0 AS x, p_size / 51.0 AS u, (p_size - 25) / 9.0 AS y FROM part))""")
def prob_families(spark, d):
    n = F.col("p_size")
    k, x, u, y = n % 13, n / 7.0, n / 51.0, (n - 25) / 9.0
    return by_value(table(spark, d, "part"), ["p_size"], ["p_partkey"], prob.binom_pmf(k, F.lit(12), 0.3).alias("bp"), prob.binom_cdf(k, F.lit(12), 0.3).alias("bc"), prob.poisson_cdf(k, 2.5).alias("pc"), prob.gamma_pdf(x, 3.0, 2.0).alias("gp"), prob.gamma_cdf(x, 3.0, 2.0).alias("gc"),
                                          prob.chi2_pdf(x, 6.0).alias("xp"), prob.chi2_cdf(x, 6.0).alias("xc"), prob.beta_pdf(u, 2.0, 3.0).alias("ep"), prob.beta_cdf(u, 2.0, 3.0).alias("ec"), prob.t_pdf(y, 3.0).alias("tp"), prob.t_cdf(y, 3.0).alias("tc"),
                                          prob.f_pdf(x, 4.0, 6.0).alias("fp"), prob.f_cdf(x, 4.0, 6.0).alias("fc"))


@query("p_partkey", "md cx ytm iv pv fv cc cm cir", f"""SELECT p_partkey, {_sum('n', 'k * 0.05 / pow(1 + y, k)')} / b / (1 + y) + n / pow(1 + y, n + 1) / b AS md, ({_sum('n', 'k * (k + 1) * 0.05 / pow(1 + y, k + 2)')} + n * (n + 1) / pow(1 + y, n + 2)) / b AS cx, y AS ytm, y AS iv,
 -(7 * (1 - pow(1 + y, -n)) / y + 100 * pow(1 + y, -n)) AS pv, -(100 * pow(1 + y, n) + 7 * (pow(1 + y, n) - 1) / y) AS fv, 100 * exp(y * n) AS cc, 0.02 + 1.3 * (y - 0.02) AS cm,
 exp(4 * ln(2 * h * exp((0.5 + h) * n / 2) / ((h + 0.5) * (exp(h * n) - 1) + 2 * h)) - 2 * (exp(h * n) - 1) / ((h + 0.5) * (exp(h * n) - 1) + 2 * h) * y) AS cir
 FROM (SELECT *, {_sum('n', 'CASE WHEN k > 0 THEN 0.05 / pow(1 + y, k) ELSE 0 END')} + pow(1 + y, -n) AS b, sqrt(0.27) AS h FROM (SELECT p_partkey, 1 + p_size % 20 AS n, 0.01 + p_size / 300.0 AS y FROM part))""")
def finance_bonds(spark, d):
    n, y, lit = 1 + F.col("p_size") % 20, 0.01 + F.col("p_size") / 300.0, F.lit
    price = finance.black_scholes(lit(100.0), lit(95.0), lit(1.0), lit(0.02), y)
    return by_value(table(spark, d, "part"), ["p_size"], ["p_partkey"], finance.bond_modified_duration(lit(0.05), y, n).alias("md"), finance.bond_convexity(lit(0.05), y, n).alias("cx"), finance.bond_ytm(finance.bond_price(lit(100.0), lit(0.05), y, n), lit(100.0), lit(0.05), n).alias("ytm"),
                                          F.when(y > 0.06, finance.implied_volatility(price, lit(100.0), lit(95.0), lit(1.0), lit(0.02))).otherwise(y).alias("iv"), finance.present_value(y, n, lit(7.0), lit(100.0)).alias("pv"), finance.future_value(y, n, lit(7.0), lit(100.0)).alias("fv"),
                                          finance.continuous_compound(lit(100.0), y, n).alias("cc"), finance.capm(lit(0.02), lit(1.3), y).alias("cm"), finance.cir_bond_price(y, 0.5, 0.04, 0.1, n).alias("cir"))


@query("p_partkey", "eu pa am irr", """SELECT p_partkey, exp(-0.03) * list_sum(list_transform(range(0, 13), lambda i: exp(lgamma(13) - lgamma(i + 1) - lgamma(13 - i)) * pow(q, i) * pow(1 - q, 12 - i) * greatest(s * pow(u, 2 * i - 12) - 100, 0))) AS eu,
 exp(-0.03) * list_sum(list_transform(range(0, 13), lambda i: exp(lgamma(13) - lgamma(i + 1) - lgamma(13 - i)) * pow(q, i) * pow(1 - q, 12 - i) * (greatest(s * pow(u, 2 * i - 12) - 100, 0) - s * pow(u, 2 * i - 12) + 100))) AS pa,
 exp(-0.03) * list_sum(list_transform(range(0, 13), lambda i: exp(lgamma(13) - lgamma(i + 1) - lgamma(13 - i)) * pow(q, i) * pow(1 - q, 12 - i) * greatest(s * pow(u, 2 * i - 12) - 100, 0))) AS am, r AS irr
 FROM (SELECT p_partkey, 80.0 + p_size AS s, 0.01 + p_size / 200.0 AS r, exp(0.25 * sqrt(1 / 12.0)) AS u, (exp(0.03 / 12) - exp(-0.25 * sqrt(1 / 12.0))) / (exp(0.25 * sqrt(1 / 12.0)) - exp(-0.25 * sqrt(1 / 12.0))) AS q FROM part)""")
def finance_trees(spark, d):
    s, r, lit = 80.0 + F.col("p_size"), 0.01 + F.col("p_size") / 200.0, F.lit
    tree = lambda **kw: finance.binomial_option(s, lit(100.0), lit(1.0), lit(0.03), lit(0.25), 12, **kw)
    # an American call on a stock without dividends is worth as much as a European one
    return by_value(table(spark, d, "part"), ["p_size"], ["p_partkey"], tree().alias("eu"), tree(call=False).alias("pa"), tree(american=True).alias("am"), finance.irr(F.array(lit(-100.0), 100 * r, 100 * r, 100 + 100 * r)).alias("irr"))


@query("p_partkey df cr mu s1 s2 eu mo iv rp ne br gc", "", """SELECT p_partkey, list_product(list_transform(range(1, n + 1), lambda i: CASE WHEN (n - i) % 2 = 0 THEN i ELSE 1 END))::BIGINT AS df, ((n + 2) * (n + 1) * n // 6)::BIGINT AS cr, (factorial((m + 3)::INT) / factorial(m::INT) / 2)::BIGINT AS mu,
 [0, 2, 3, 1, 0][m + 1]::BIGINT AS s1, [0, 1, 3, 1, 0][m + 1]::BIGINT AS s2, [1, 4, 1, 0, 0][m + 1]::BIGINT AS eu, [1, 1, 2, 4, 9][m + 1]::BIGINT AS mo, [1, 1, 2, 4, 10][m + 1]::BIGINT AS iv, [0, 1, 3, 3, 2][m + 1]::BIGINT AS rp,
 round(list_sum(list_transform(range(1, n + 1), lambda i: pow(2, gcd(i, n)))) / n)::BIGINT AS ne, round((list_sum(list_transform(range(1, n + 1), lambda i: pow(2, gcd(i, n)))) / n + CASE WHEN n % 2 = 1 THEN pow(2, (n + 1) // 2) ELSE 0.75 * pow(2, n // 2 + 1) END) / 2)::BIGINT AS br, xor(p_partkey, p_partkey // 2)::BIGINT AS gc
 FROM (SELECT p_partkey, 1 + p_size % 16 AS n, p_size % 5 AS m FROM part)""")
def combo_more_counts(spark, d):
    n, m, lit = (1 + F.col("p_size") % 16).cast("bigint"), (F.col("p_size") % 5).cast("bigint"), F.lit
    return by_value(table(spark, d, "part"), ["p_size"], ["p_partkey", counting.gray_code(F.col("p_partkey")).cast("bigint").alias("gc")], counting.double_factorial(n).alias("df"), counting.combinations_with_rep(n, lit(3)).alias("cr"), counting.multinomial(F.array(m, lit(2), lit(1))).alias("mu"), counting.stirling1(lit(3), m).alias("s1"), counting.stirling2(lit(3), m).alias("s2"),
                                          counting.eulerian_number(lit(3), m).alias("eu"), counting.motzkin_num(m).cast("bigint").alias("mo"), counting.involutions(m).cast("bigint").alias("iv"), counting.restricted_partitions(lit(6), m).alias("rp"), counting.necklaces(n, 2).alias("ne"), counting.bracelets(n, 2).alias("br")).select("p_partkey", "df", "cr", "mu", "s1", "s2", "eu", "mo", "iv", "rp", "ne", "br", "gc")


@query("p_partkey inv js lu mo", "", """SELECT p_partkey, list_filter(range(0, 97), lambda k: k * (1 + p_partkey % 96) % 97 = 1)[1]::BIGINT AS inv, CASE WHEN p_partkey % 19 = 0 THEN 0 WHEN len(list_filter(range(1, 19), lambda k: k * k % 19 = p_partkey % 19)) > 0 THEN 1 ELSE -1 END::BIGINT AS js,
 (pow(2, p_size) - 1)::BIGINT AS lu, (SELECT min(k) FROM (SELECT unnest(range(1, 17)) AS k) WHERE list_reduce(list_transform(range(0, k), lambda i: 1 + p_partkey % 16), lambda a, b: a * b % 17) % 17 = 1)::BIGINT AS mo FROM part""")
def number_residues(spark, d):
    a = F.col("p_partkey").cast("bigint")
    return table(spark, d, "part").select("p_partkey", counting.mod_inv(1 + a % 96, F.lit(97)).alias("inv"), counting.jacobi_symbol(a, F.lit(19)).alias("js"), counting.lucas_sequence(F.col("p_size"), 3, 2).alias("lu"), counting.multiplicative_order(1 + a % 16, F.lit(17)).alias("mo"))
