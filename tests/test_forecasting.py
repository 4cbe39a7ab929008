"""Autoregressions against refitting, ARIMA against the normal density and simulated series."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foretally.operators import autoregression as A
from foretally.operators import forecast, series
from foretally.operators import statespace as S

ORDERS = [S.Order(1, 0, 0), S.Order(0, 0, 1), S.Order(3, 0, 3), S.Order(3, 0, 1, 1, 0, 1, 12), S.Order(1, 0, 3, 0, 0, 1, 4, False), S.Order(0, 0, 0), S.Order(2, 0, 0, 1, 0, 0, 7)]


def density(o, z, w):
    """The likelihood by the whole covariance matrix, whose entries are sums over the weights of past shocks."""
    phi, theta = (x[0] for x in S.polynomials(np.atleast_2d(z), o))
    psi = np.zeros(6000)
    for k in range(len(psi)):
        psi[k] = (1.0 if k == 0 else theta[k - 1] if k <= len(theta) else 0.0) + phi[: min(k, len(phi))] @ psi[:k][::-1][: len(phi)]
    n = len(w)
    gamma = np.array([psi[: len(psi) - k] @ psi[k:] for k in range(n)])
    cov = gamma[np.abs(np.subtract.outer(np.arange(n), np.arange(n)))]
    one, inv = np.ones(n), np.linalg.inv(cov)
    e = w - (one @ inv @ w / (one @ inv @ one) if o.mean else 0.0)
    return -0.5 * (n * (np.log(2 * np.pi * (e @ inv @ e) / n) + 1) + np.linalg.slogdet(cov)[1])


@pytest.mark.parametrize("o", ORDERS)
def test_likelihood_is_the_normal_density(o):
    for seed in range(3):
        r = np.random.RandomState(seed)
        z, w = r.uniform(-0.8, 0.8, o.size), r.randn(50).cumsum() * 0.4 + 2
        assert S.log_likelihood(z, o, w) == pytest.approx(density(o, z, w), rel=1e-9)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(-2, 2), min_size=1, max_size=4))
def test_parameters_are_stationary_and_come_back(z):
    phi = S.coefficients(np.array([z]))[0]
    assert (np.abs(np.roots(np.append(1, -phi))) < 1).all()
    assert np.allclose(np.tanh(S.free(phi)), np.clip(np.tanh(z), -0.95, 0.95), atol=1e-6) or max(map(abs, z)) > np.arctanh(0.95)


def simulated(phi, theta, n, seed, d=0):
    r = np.random.RandomState(seed)
    e, y = r.randn(n + 200), np.zeros(n + 200)
    for t in range(10, n + 200):
        y[t] = sum(p * y[t - 1 - i] for i, p in enumerate(phi)) + e[t] + sum(p * e[t - 1 - i] for i, p in enumerate(theta))
    y = y[200:]
    for _ in range(d):
        y = y.cumsum()
    return y


@pytest.mark.parametrize("phi, theta, d", [([0.5], [], 0), ([0.5], [], 1), ([0.5], [], 2), ([], [0.8], 1), ([], [], 1), ([1.2, -0.5], [], 0)])
def test_orders_of_simulated_series_come_back(phi, theta, d):
    """Of five series most have the order that made them or one that holds it, and the likelihood is no worse than at the truth."""
    right = 0
    for seed in range(5):
        y = simulated(phi, theta, 500, seed, d)
        f = S.auto_arima(y, 1)
        right += f.order.d == d and f.order.p >= len(phi) and f.order.q >= len(theta)
        true = S.Order(len(phi), f.order.d, len(theta), mean=f.order.mean)
        if f.order.d == d:
            z = np.concatenate((S.free(np.array(phi)), S.free(-np.array(theta))))
            w = S.differenced(y, true)
            assert f.aic <= 2 * (true.size + true.mean + 1) - 2 * S.log_likelihood(z, true, w) + 1e-6
    assert right >= 3


def test_seasons_and_differences():
    t = np.arange(96)
    y = 50 + 0.5 * t + 10 * np.sin(2 * np.pi * t / 12) + np.random.RandomState(0).randn(96)
    f = S.auto_arima(y[:84], 12)
    assert f.order.D == 1 and np.abs(S.forecast(f, y[:84], 12) - y[84:]).mean() < 2
    assert S.differences(np.random.RandomState(1).randn(120), 12) == (0, 0)
    assert S.differences(np.random.RandomState(1).randn(300).cumsum().cumsum(), 1) == (2, 0)
    assert S.auto_arima(np.ones(30), 12) is None and list(S.forecast(None, np.array([1.0, 4.0]), 2)) == [4, 4]
    quadratic = np.arange(40.0) ** 2
    assert np.allclose(S.forecast(S.auto_arima(quadratic, 1), quadratic, 3), np.arange(40.0, 43) ** 2, rtol=0.02)


@pytest.mark.parametrize("o", [S.Order(1, 1, 1, mean=False), S.Order(0, 2, 1, mean=False), S.Order(1, 0, 0, 1, 1, 0, 4), S.Order(0, 1, 1, 0, 1, 1, 4, False)])
def test_forecasts_are_conditional_expectations(o):
    """The forecast is the regression of the next values on all past ones under the fitted covariance."""
    y = np.random.RandomState(5).randn(48).cumsum() + 3
    w = S.differenced(y, o)
    f = S.fit(o, w, 5)
    n, h = len(w), 6
    gamma, _ = S.autocovariances(*S.polynomials(f.z[None], o), n + h)
    cov = gamma[0][np.abs(np.subtract.outer(np.arange(n + h), np.arange(n + h)))]
    ahead = f.mean + cov[n:, :n] @ np.linalg.solve(cov[:n, :n], w - f.mean)
    got = S.forecast(f, y, h)
    assert np.allclose(S.differenced(np.append(y, got), o)[n:], ahead, atol=1e-8)


def refitted(y, origin, season, last):
    """Each shape by one regression over the window."""
    best, window = None, y[max(0, origin - last) : origin]
    for d, s, p in A.SHAPES:
        if s and not (1 < season <= 24 and 3 * season < len(window) < 3000):
            continue
        z = window[season:] - window[:-season] if s else window
        z = np.diff(z, n=d) if d else z
        if len(z) - p < 2 * p + 5:
            continue
        a = np.stack([*[z[p - k : len(z) - k] for k in range(1, p + 1)], np.ones(len(z) - p)], axis=1)
        w = np.linalg.lstsq(a, z[p:], rcond=None)[0]
        value = A.criterion(float(((z[p:] - a @ w) ** 2).mean()), p, len(z) - p)
        if best is None or value < best[0]:
            best = (value, (d, s, p), w)
    return best[1:] if best else None


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([1, 4, 12]), st.sampled_from([30, 60, 5000]), st.sampled_from([1, 5]))
def test_moving_fits_equal_refitting(seed, season, last, stride):
    r = np.random.RandomState(seed)
    y = r.randn(110).cumsum() * 10.0 ** r.randint(-2, 3) + 5 * np.sin(np.arange(110))
    origins = list(range(3, 110, stride))
    for origin, got in zip(origins, A.fits(y, origins, season, last=last), strict=True):
        want = refitted(y, origin, season, last)
        if want is None:
            assert got is None
            continue
        assert got[0] == want[0]
        assert np.allclose(A.ahead(y[:origin], got, 3, season), A.ahead(y[:origin], want, 3, season), rtol=1e-9, atol=1e-9 * np.abs(y).max())


def test_protocols_share_origins(spark):
    """Each protocol's forecasts are those of fits to just what it knows."""
    r = np.random.RandomState(3)
    ys = {"a": r.randn(40).cumsum(), "b": np.arange(30) + r.randn(30), "c": np.ones(10)}
    df = series.assembled(spark.createDataFrame([(k, i, float(v)) for k, y in ys.items() for i, v in enumerate(y)], "series_id string, period int, y double"), "series_id")
    for model, one in ((forecast.autoregressive, lambda h, n: A.ahead(h, refitted(h, len(h), 4, 5000), n, 4)), (forecast.arima, lambda h, n: S.forecast(S.auto_arima(h, 4), h, n))):
        got = {(r["series_id"], r["scenario"], r["t"]): (r["actual"], r["forecast"]) for r in model(df, "series_id", season=4, block=3).collect()}
        assert len(got) == 4 * sum(len(y) - len(y) * 4 // 5 for y in ys.values())
        for k, y in ys.items():
            n = len(y) * 4 // 5
            for s, origins, steps in (("S1", [n], len(y)), ("S2", range(n, len(y)), 1), ("S3", range(n, len(y)), 1), ("S4", range(n, len(y), 3), 3)):
                for a in origins:
                    for t, v in enumerate(one(y[:a], min(steps, len(y) - a)), a):
                        assert got[k, s, t][0] == y[t] and got[k, s, t][1] == pytest.approx(v, rel=1e-8, abs=1e-8)
    assert model(df.limit(0), "series_id").count() == 0 and model(df.withColumn("n_train", F.lit(0)), "series_id").count() == 0


@pytest.mark.parametrize("size", [16, 50, 1000])
def test_chunks_equal_whole_arrays(spark, size):
    from foretally.operators import chunks, stats

    r = np.random.RandomState(7)
    ys = {"a": r.randn(333), "b": r.randn(48), "c": r.randn(3), "d": r.randn(1), None: r.randn(49)}
    rows = [(k, i, float(v)) for k, y in ys.items() for i, v in enumerate(y)]
    points = spark.createDataFrame(rows, "k string, t int, y double").repartition(3)
    whole = series.assembled(points.withColumnRenamed("t", "period"), "k")
    kinds = sorted(tuple(x) for x in forecast.naive(whole, "k", season=7, block=5).collect() if x["k"]) + sorted(tuple(x)[1:] for x in forecast.naive(whole, "k", season=7, block=5).collect() if not x["k"])
    out = chunks.naive(points, "k", season=7, block=5, size=size).collect()
    assert sorted(tuple(x) for x in out if x["k"]) + sorted(tuple(x)[1:] for x in out if not x["k"]) == kinds
    want = {x["k"]: x["v"] for x in whole.select("k", stats.newey_west(F.col("ys"), F.least(F.lit(6), F.size("ys") - 1)).alias("v")).collect()}
    got = {x["k"]: x["variance"] for x in chunks.newey_west(points, "k", lag=6, size=size, value="y").collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], rel=1e-9, abs=1e-12) for k in got)
    with pytest.raises(ValueError):
        chunks.chunked(points, "k", halo=9, size=8)


def test_one_long_series_is_work_for_many_tasks(spark):
    from foretally.operators import chunks

    points = spark.range(300_000).select(F.lit("k").alias("k"), F.col("id").cast("int").alias("t"), (F.col("id") % 1000).cast("double").alias("y"))
    c = chunks.chunked(points, "k", halo=24, size=10_000)
    assert c.count() == 30 and c.agg(F.max(F.size("ys"))).first()[0] == 10_024
    f = chunks.naive(points, "k", season=1000, block=24, models=("naive-seasonal",), size=10_000)
    assert f.count() == 4 * 60_000 and f.where("actual <> forecast").count() == 0
