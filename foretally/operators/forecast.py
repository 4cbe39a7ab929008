"""Forecasts under four protocols.

S1 static: one forecast of the whole test part.  S2 rolling and S3 multi-step rolling:
one step ahead from all that is known.  S4 block-wise: a block of B steps at a time.
For the naive models each forecast is one earlier value, so its place is arithmetic and no
model is fitted.  Autoregressions move with the origin in one pass; a seasonal ARIMA is fitted anew at each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretally.operators import autoregression, statespace

SCENARIOS = ("S1", "S2", "S3", "S4")
MODELS = ("naive-flat", "naive-seasonal")


def place(scenario: Column, model: Column, t: Column, n_train: Column, season: int, block: int) -> Column:
    """Index of the earlier value that is the forecast of step t."""
    start = n_train + F.floor((t - n_train) / block).cast("int") * block
    known = F.when(scenario == "S1", n_train).when(scenario == "S4", start).otherwise(t)
    seasonal = known - season + (t - known) % season
    return F.when((model == "naive-flat") | (known < season), known - 1).otherwise(seasonal)


def naive(series: DataFrame, *keys: str, season: int = 12, block: int = 12, scenarios=SCENARIOS, models=MODELS) -> DataFrame:
    """keys, scenario, model, t, actual, forecast for the test part of each assembled series."""
    unknown = (set(scenarios) - set(SCENARIOS)) | (set(models) - set(MODELS))
    if unknown or season < 1 or block < 1:
        raise ValueError(f"unsupported: {sorted(unknown)}, season {season}, block {block}")
    runs = series.where("n_train > 0 and n_train < n").withColumn("scenario", F.explode(F.array(*map(F.lit, scenarios)))).withColumn("model", F.explode(F.array(*map(F.lit, models))))
    step = F.transform(
        F.sequence("n_train", F.col("n") - 1),
        lambda t: F.struct(t.alias("t"), F.get("ys", t).alias("actual"), F.get("ys", place(F.col("scenario"), F.col("model"), t, F.col("n_train"), season, block)).alias("forecast")),
    )
    return runs.select(*keys, "scenario", "model", F.inline(step))


def _origins(n_train: int, n: int, block: int, scenarios: tuple[str, ...], first: int = 0, last: int | None = None) -> dict[int, dict[str, int]]:
    """From `first` up to before `last`: the places at which a forecast starts, with how far each scenario looks from there."""
    out: dict[int, dict[str, int]] = {}
    for s in scenarios:
        stride = {"S1": n - n_train, "S4": block}.get(s, 1)
        for a in range(n_train, n, max(stride, 1)):
            if first <= a < (n if last is None else last):
                out.setdefault(a, {})[s] = min(stride, n - a)
    return dict(sorted(out.items()))


def _rows(row: dict, keys: tuple[str, ...], model: str, origin: int, looks: dict[str, int], values: np.ndarray) -> Iterator[pd.DataFrame]:
    for s, steps in looks.items():
        t = np.arange(origin, origin + steps)
        yield pd.DataFrame({**{k: row[k] for k in keys}, "scenario": s, "model": model, "t": t, "actual": np.asarray(row["ys"], float)[t], "forecast": values[:steps]})


def _schema(series: DataFrame, keys: tuple[str, ...]) -> str:
    kinds = dict(series.dtypes)
    return ", ".join(f"{k} {kinds[k]}" for k in keys) + ", scenario string, model string, t int, actual double, forecast double"


def autoregressive(series: DataFrame, *keys: str, season: int = 12, block: int = 12, scenarios=SCENARIOS, shapes=autoregression.SHAPES, model: str = "auto-ar") -> DataFrame:
    """As naive(), by the best autoregression of all that is known at each origin; a task passes over a series once, whatever the protocol."""
    wanted = tuple(scenarios)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.to_dict("records"):
                y = np.asarray(row["ys"], float)
                looks = _origins(row["n_train"], row["n"], block, wanted)
                for (a, own), fit in zip(looks.items(), autoregression.fits(y, list(looks), season, shapes), strict=True):
                    yield from _rows(row, keys, model, a, own, autoregression.ahead(y[:a], fit, max(own.values()), season))

    return series.where("n_train > 0 and n_train < n").select(*keys, "ys", "n", "n_train").mapInPandas(run, _schema(series, keys))


def arima(series: DataFrame, *keys: str, season: int = 12, block: int = 12, scenarios=SCENARIOS, batch: int = 4) -> DataFrame:
    """As naive(), by the likeliest seasonal ARIMA, searched and fitted anew at each origin.

    Protocols that start at the same origin know the same and share its fit.  Origins are dealt in batches, so that one long
    series is work for many tasks.
    """
    wanted = tuple(scenarios)
    dealt = series.where("n_train > 0 and n_train < n").select(*keys, "ys", "n", "n_train", F.explode(F.sequence("n_train", F.col("n") - 1, F.lit(batch))).alias("first"))
    dealt = dealt.repartition(int(series.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "first")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.to_dict("records"):
                y = np.asarray(row["ys"], float)
                for a, own in _origins(row["n_train"], row["n"], block, wanted, row["first"], row["first"] + batch).items():
                    yield from _rows(row, keys, "auto-arima", a, own, statespace.forecast(statespace.auto_arima(y[:a], season), y[:a], max(own.values())))

    return dealt.mapInPandas(run, _schema(series, keys))
