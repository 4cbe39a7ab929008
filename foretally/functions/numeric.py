"""Numeric column macros."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nan_to_null(x: Column) -> Column:
    """NaN counts as missing, as everywhere in this library."""
    return F.when(~F.isnan(x), x)


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def number(x: Column) -> Column:
    """Text or number to a finite double, else null."""
    y = x.try_cast("double")
    return F.when(finite(y), y)


#: Added before rounding: halves go up whatever the order of the sums behind them.
NUDGE = 1e-9


def rounded(x: Column, digits: int) -> Column:
    return F.round(x + F.lit(NUDGE), digits)


def r6(x: Column) -> Column:
    """Six digits after the point: sums of doubles differ by their order."""
    return rounded(x, 6)


def pct(k: Column, n: Column, digits: int = 2) -> Column:
    """100 k / n, 0 if there is nothing to divide by."""
    return F.coalesce(rounded(F.try_divide(F.lit(100.0) * k, n), digits), F.lit(0.0))


def _poly(x: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


# Rational approximations of erf and erfc (W. J. Cody, Math. Comp. 1969), highest power first.
_ERF_P = (1.85777706184603153e-1, 3.16112374387056560e0, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3)
_ERF_Q = (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3)
_ERFC_P = (2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3)
_ERFC_Q = (1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3)
_TAIL_P = (1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4)
_TAIL_Q = (1.0, 2.56852019228982242e0, 1.87295284992346725e0, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3)
_SQRT_PI = 1.7724538509055160273


def erfc(x: Column) -> Column:
    """The complementary error function of x >= 0."""
    small = F.lit(1.0) - x * _poly(x * x, _ERF_P) / _poly(x * x, _ERF_Q)
    middle = F.exp(-x * x) * _poly(x, _ERFC_P) / _poly(x, _ERFC_Q)
    y = F.lit(1.0) / (x * x)
    tail = F.exp(-x * x) / x * (F.lit(1 / _SQRT_PI) - y * _poly(y, _TAIL_P) / _poly(y, _TAIL_Q))
    return F.when(x <= 0.46875, small).when(x <= 4.0, middle).otherwise(tail)


def _poly_sql(x: str, coefficients: tuple[float, ...]) -> str:
    out = repr(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r})"
    return out


def erfc_sql(x: str) -> str:
    """The same in SQL, for oracles."""
    q, y = f"({x} * {x})", f"(1.0::double / ({x} * {x}))"
    return (
        f"case when {x} <= 0.46875 then 1.0 - {x} * {_poly_sql(q, _ERF_P)} / {_poly_sql(q, _ERF_Q)}"
        f" when {x} <= 4.0 then exp(-{q}) * {_poly_sql(x, _ERFC_P)} / {_poly_sql(x, _ERFC_Q)}"
        f" else exp(-{q}) / {x} * ({1 / _SQRT_PI!r} - {y} * {_poly_sql(y, _TAIL_P)} / {_poly_sql(y, _TAIL_Q)}) end"
    )


def two_sided_p(z: Column) -> Column:
    """The two-sided normal p-value of a statistic."""
    return erfc(F.abs(z) / F.sqrt(F.lit(2.0)))


def as_bool(x: Column) -> Column:
    """true, 1, yes, y are true, all else (also null) false."""
    return F.coalesce(F.lower(F.trim(x.cast("string"))).isin("true", "1", "yes", "y"), F.lit(False))


def coerce_bool(x: Column) -> Column:
    """Three-valued: null stays null, the false words are false, any other text is true."""
    s = F.lower(F.trim(x.cast("string")))
    return F.when(x.isNull(), None).when(s.isin("false", "0", "no", "n", "f", ""), False).otherwise(True)


def minmax_quality(x: Column, low: Column, high: Column, lower_is_better: bool) -> Column:
    """0 to 1 between low and high, 0.5 where they are equal."""
    q = (x - low) / F.nullif(high - low, F.lit(0.0))
    return F.coalesce(1 - q if lower_is_better else q, F.when(x.isNotNull(), F.lit(0.5)))
