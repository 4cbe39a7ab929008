"""Accuracy metrics of forecasts and the status of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretally.functions.numeric import finite, rounded

METRICS = ("mae", "rmse", "smape", "mase", "r2")
#: All but r2 are better when lower.
HIGHER_IS_BETTER = ("r2",)


def accuracy(actual: Column, forecast: Column, scale: Column | None = None) -> dict[str, Column]:
    """Aggregates over the pairs where both are finite; null where none is."""
    ok = finite(actual) & finite(forecast)
    a, f = F.when(ok, actual), F.when(ok, forecast)
    e, d = a - f, F.abs(a) + F.abs(f)
    mae = F.avg(F.abs(e))
    out = {
        "n": F.count(e),
        "mae": mae,
        "rmse": F.sqrt(F.avg(e * e)),
        "smape": 100 * F.avg(F.when(d == 0, 0.0).otherwise(2 * F.abs(e) / d)),
        "r2": 1 - F.sum(e * e) / F.nullif(F.count(e) * F.var_pop(a), F.lit(0.0)),
    }
    if scale is not None:
        out["mase"] = mae / F.nullif(F.max(scale), F.lit(0.0))
    return out


def naive_scale(series: DataFrame, *keys: str, season: int) -> DataFrame:
    """keys, scale, n_lagged: the mean absolute difference at lag `season` over the train part, after values that aren't finite are left out."""
    clean = F.filter(F.slice("ys", 1, F.col("n_train")), finite)
    s = series.select(*keys, clean.alias("c"))
    later = F.slice("c", season + 1, F.greatest(F.size("c") - season, F.lit(0)))
    diffs = F.zip_with(later, F.slice("c", 1, F.greatest(F.size("c") - season, F.lit(0))), lambda a, b: F.abs(a - b))
    total = F.aggregate(diffs, F.lit(0.0), lambda x, y: x + y)
    return s.select(*keys, F.size(diffs).cast("long").alias("n_lagged"), (total / F.nullif(F.size(diffs), F.lit(0))).alias("scale"))


def evaluate(forecasts: DataFrame, *keys: str, scale: DataFrame | None = None, on: tuple[str, ...] = (), digits: int | None = 6) -> DataFrame:
    """keys, n and the metrics, rounded unless digits is None; scale (on, scale) gives mase."""
    f = forecasts
    if scale is not None:
        f = f.join(scale.select(*on, "scale"), list(on), "left")
    aggs = accuracy(F.col("actual"), F.col("forecast"), F.col("scale") if scale is not None else None)
    return f.groupBy(*keys).agg(*[(c if k == "n" or digits is None else rounded(c, digits)).alias(k) for k, c in aggs.items()])


def envelope(found: Column, expected: Column, metric: Column) -> tuple[Column, Column]:
    """(execution_status, error) of a run: its forecast must exist, have the expected length, and be finite somewhere."""
    error = (
        F.when(found == 0, F.lit("No Python forecast list found"))
        .when(found != expected, F.format_string("Forecast length mismatch: expected %d, got %d", expected, found))
        .when(metric.isNull(), F.lit("No valid forecast/actual pairs"))
    )
    return F.when(error.isNull(), "OK").otherwise("FAIL"), F.coalesce(error, F.lit(""))
