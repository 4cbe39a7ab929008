"""Time series: assembly from facts, time index, train and test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: season m, block B and horizon by series family.
SPECS = {"monthly": (12, 12), "weekly": (52, 52), "daily": (365, 30), "hourly": (24, 24)}


def totals(facts: DataFrame, keys: dict[str, Column], period: Column, value: Column) -> DataFrame:
    """keys, period, y: money is summed as whole cents, so that the order of the sum doesn't matter."""
    cents = F.sum(F.round(value * 100).cast("long"))
    return facts.groupBy(*[c.alias(k) for k, c in keys.items()], period.alias("period")).agg((cents / F.lit(100.0)).alias("y"))


def assembled(points: DataFrame, *keys: str) -> DataFrame:
    """One row per series: keys, ys (in period order), periods, n and n_train = 80 % of n, rounded down."""
    s = points.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("period", "y"))).alias("s"))
    n = F.size("s")
    return s.select(*keys, F.col("s.y").alias("ys"), F.col("s.period").alias("periods"), n.alias("n"), F.floor(n * 4 / 5).cast("int").alias("n_train"))


def points(series: DataFrame, *keys: str) -> DataFrame:
    """keys, t, period, y, n, n_train, part ('train' or 'test')."""
    rows = series.select(*keys, "n", "n_train", F.posexplode(F.arrays_zip("periods", "ys")).alias("t", "p"))
    return rows.select(*keys, "t", F.col("p.periods").alias("period"), F.col("p.ys").alias("y"), "n", "n_train", F.when(F.col("t") < F.col("n_train"), "train").otherwise("test").alias("part"))
