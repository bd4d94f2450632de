"""Column expressions shared by the operators. All stay inside JVM code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TRADING_DAYS = 252
EPS = 1e-12

# Rational approximation of the normal quantile, Wichura (1988), AS 241, PPND16.
PPF_CENTRE_NUM = (2.5090809287301226727e3, 3.3430575583588128105e4, 6.7265770927008700853e4, 4.5921953931549871457e4,
                  1.3731693765509461125e4, 1.9715909503065514427e3, 1.3314166789178437745e2, 3.3871328727963666080e0)
PPF_CENTRE_DEN = (5.2264952788528545610e3, 2.8729085735721942674e4, 3.9307895800092710610e4, 2.1213794301586595867e4,
                  5.3941960214247511077e3, 6.8718700749205790830e2, 4.2313330701600911252e1, 1.0)
PPF_TAIL_NUM = (7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1,
                1.27045825245236838258e0, 3.64784832476320460504e0, 5.76949722146069140550e0,
                4.63033784615654529590e0, 1.42343711074968357734e0)
PPF_TAIL_DEN = (1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2,
                1.48103976427480074590e-1, 6.89767334985100004550e-1, 1.67638483018380384940e0,
                2.05319162663775882187e0, 1.0)
PPF_FAR_NUM = (2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3,
               2.65321895265761230930e-2, 2.96560571828504891230e-1, 1.78482653991729133580e0,
               5.46378491116411436990e0, 6.65790464350110377720e0)
PPF_FAR_DEN = (2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5,
               7.86869131145613259100e-4, 1.48753612908506148525e-2, 1.36929880922735805310e-1,
               5.99832206555887937690e-1, 1.0)

# Cumulative normal in double precision, Hart (1968) as given by West (2005).
CDF_NUM = (3.52624965998911e-2, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871,
           221.213596169931, 220.206867912376)
CDF_DEN = (8.83883476483184e-2, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674,
           637.333633378831, 793.826512519948, 440.413735824752)


def poly(x: Column, coefficients: tuple[float, ...]) -> Column:
    """Polynomial in Horner form, highest power first."""
    return reduce(lambda acc, c: acc * x + F.lit(c), coefficients[1:], F.lit(coefficients[0]))


def norm_cdf(z: Column) -> Column:
    """Standard normal distribution function as a Column (Spark SQL has no erf)."""
    a = F.abs(z)
    e = F.exp(-a * a / 2)
    near = e * poly(a, CDF_NUM) / poly(a, CDF_DEN)
    fraction = a + F.lit(0.65)
    for k in (4.0, 3.0, 2.0, 1.0):
        fraction = a + F.lit(k) / fraction
    tail = F.when(a > 37.0, F.lit(0.0)).when(a < 7.07106781186547, near).otherwise(e / fraction / 2.506628274631)
    return F.when(z > 0, 1 - tail).otherwise(tail)


def norm_ppf(p: Column) -> Column:
    """Standard normal quantile as a Column; null outside (0, 1)."""
    q = p - 0.5
    centre = F.lit(0.180625) - q * q
    r = F.sqrt(-F.ln(F.when(q <= 0, p).otherwise(1 - p)))
    tail = F.when(r <= 5.0, poly(r - 1.6, PPF_TAIL_NUM) / poly(r - 1.6, PPF_TAIL_DEN)).otherwise(
        poly(r - 5.0, PPF_FAR_NUM) / poly(r - 5.0, PPF_FAR_DEN))
    value = F.when(F.abs(q) <= 0.425, q * poly(centre, PPF_CENTRE_NUM) / poly(centre, PPF_CENTRE_DEN)).otherwise(
        F.when(q < 0, -tail).otherwise(tail))
    return F.when((p > 0) & (p < 1), value)


# Response surface for the residual test of two series with a constant, MacKinnon (1994), tables 3 and 4:
# powers of the statistic, lowest first, below and above the turning point; limits beyond which the probability is 0 or 1.
RESIDUAL_SMALL = (2.92, 1.5012, 0.039796)
RESIDUAL_LARGE = (2.1945, 0.64695, -0.29198, -0.042377)
RESIDUAL_TURN, RESIDUAL_LEAST, RESIDUAL_MOST = -2.62, -18.86, 0.92


def residual_test_p(t: Column) -> Column:
    """Probability of a residual unit-root statistic as low as ``t`` without cointegration."""
    p = norm_cdf(F.when(t <= RESIDUAL_TURN, poly(t, RESIDUAL_SMALL[::-1])).otherwise(poly(t, RESIDUAL_LARGE[::-1])))
    return F.when(t.isNull(), F.lit(None)).when(t < RESIDUAL_LEAST, F.lit(0.0)).when(t > RESIDUAL_MOST, F.lit(1.0)).otherwise(p)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null when b is zero (ANSI mode raises otherwise)."""
    return a / F.nullif(b, F.lit(0.0))


def clean_number(x: Column) -> Column:
    """NaN to null: the rest of the library only knows null as missing."""
    return F.when(~F.isnan(x), x)


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def sharpe(mean: Column, sd: Column, periods: int = TRADING_DAYS) -> Column:
    """Annual Sharpe ratio with the guarded denominator used by the metric record."""
    return mean * periods / (sd * F.sqrt(F.lit(float(periods))) + EPS)


def flat_safe_sharpe(mean: Column, sd: Column, periods: int = TRADING_DAYS) -> Column:
    """Annual Sharpe ratio of a resample: 0 when the series is flat."""
    return F.when(sd > 0, mean / (sd + EPS) * F.sqrt(F.lit(float(periods)))).otherwise(F.lit(0.0))


def years_between(first: Column, last: Column) -> Column:
    return F.datediff(last, first) / 365.25


def whole_lots(shares: Column, lot: int) -> Column:
    """Nearest whole number of lots, halves up."""
    return (F.floor(shares / lot + 0.5) * lot).cast("long")


def affordable_lots(cash: Column, price: Column, lot: int) -> Column:
    """Largest whole number of lots that cash pays for."""
    return F.greatest(F.floor(ratio(cash, price * lot)) * lot, F.lit(0)).cast("long")


# Exchange suffix by first digit of the code, and daily price limits by code.
SHANGHAI_FIRST_DIGITS = ("5", "6")
LIMIT_BY_CODE = {"159915": 0.20}
LIMIT_BY_PREFIX = {"588": 0.20}
LIMIT_DEFAULT = 0.10


def market_suffix(code: Column) -> Column:
    sh = F.substring(code, 1, 1).isin(*SHANGHAI_FIRST_DIGITS)
    return F.concat(code, F.when(sh, F.lit(".SH")).otherwise(F.lit(".SZ")))


def limit_by_rule(code: Column) -> Column:
    """Daily limit where no explicit table row exists: prefix rule, then the default."""
    rule = F.lit(LIMIT_DEFAULT)
    for prefix, pct in LIMIT_BY_PREFIX.items():
        rule = F.when(code.startswith(prefix), F.lit(pct)).otherwise(rule)
    return rule


def sql_text(value: str) -> str:
    """A string literal for SQL text, whatever characters a name has."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
