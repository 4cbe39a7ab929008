"""Ranks by ranges against sorting everything."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foretally.operators import order, stats, summary, transcripts
from foretally.sources import tables


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.RandomState(0)
    p = [None if x < 0.1 else round(x, 2) if x < 0.6 else 1.0 for x in r.rand(700).tolist()]
    return [(i, v, f"n{i % 50:02d}") for i, v in enumerate(p)]


@pytest.mark.parametrize("parts", [1, 2, 7, 200])
def test_places(spark, rows, parts):
    df = spark.createDataFrame(rows, "i int, p double, name string").repartition(3)
    got = {r["i"]: (r["n"], r["t"]) for r in order.numbered(order.numbered(df, "n", F.col("name"), F.col("i"), start=0, parts=parts), "t", F.col("name"), ties=True, parts=parts).collect()}
    names = sorted(x[2] for x in rows)
    for n, (i, _, name) in enumerate(sorted(rows, key=lambda x: (x[2], x[0]))):
        assert got[i] == (n, names.index(name) + 1)
    with_nulls = order.numbered(df, "n", F.col("p"), F.col("i"), parts=parts).collect()
    assert [r["i"] for r in sorted(with_nulls, key=lambda r: r["n"])] == [x[0] for x in sorted(rows, key=lambda x: (-1.0 if x[1] is None else x[1], x[0]))]
    assert order.numbered(df.limit(0), "n", F.col("p"), parts=parts).count() == 0


@pytest.mark.parametrize("parts", [1, 3, 64])
def test_discovery_rates(spark, rows, parts):
    df = spark.createDataFrame(rows, "i int, p double, name string").repartition(3)
    got = {r["i"]: r["q"] for r in order.discovery_rates(df, "p", "q", "name", "i", parts=parts).collect()}
    known = sorted((x for x in rows if x[1] is not None), key=lambda x: (x[1], x[2], x[0]))
    least = math.inf
    for k in range(len(known), 0, -1):
        i, p, _ = known[k - 1]
        least = min(least, p * len(known) / k)
        assert got[i] == pytest.approx(least, rel=1e-12)
    assert all(got[i] is None for i, p, _ in rows if p is None) and len(got) == len(rows)
    assert {r["q"] for r in order.discovery_rates(df.where("p is null"), "p", "q", "i", parts=parts).collect()} == {None}


def test_no_task_sees_all_rows(spark):
    """No plan of these has a window or an exchange into a single partition over the rows."""
    df = spark.range(1000).select("id", (F.col("id") * 7 % 1000 / 1000).alias("p"), F.lit("s").alias("s"))
    plans = [
        stats.benjamini_hochberg(df, "p", "id"), summary.quality(df, {"p": True}, "p"), transcripts.prompt_csv(df, "full", "id"), tables.markdown(df, "id", "p"), tables.series_of(df, "x", "p", "id"),
    ]
    for df in plans:
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert not [line for line in plan.splitlines() if "Window [" in line and "_range" not in line], plan


def test_csv_lines_of_both_ends(spark):
    df = spark.range(25).select("id", (F.col("id") * 2).alias("v")).repartition(4)
    lines = lambda d: [r["line"] for r in d.orderBy("n").collect()]
    assert lines(transcripts.prompt_csv(df, "full", "id")) == [str(2 * i) for i in range(25)]
    assert lines(transcripts.prompt_csv(df, "head_tail", "id", 6)) == ["0", "2", "4", "...", "44", "46", "48"]


@pytest.mark.parametrize("parts", [1, 5, 50])
def test_quantiles_are_those_of_percentile(spark, parts):
    r = np.random.RandomState(2)
    rows = [(k, float(v) if v is not None else None) for k, n in (("a", 900), (None, 31), ("c", 1), ("d", 40)) for v in (r.randint(0, 30, n) if k != "d" else r.randn(n)).tolist()] + [("a", None), ("e", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    at = (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)
    want = {x["k"]: x["q"] for x in df.where("v is not null").groupBy("k").agg(F.percentile("v", F.array(*map(F.lit, at))).alias("q")).collect()}
    got = {x["k"]: (x["n"], x["quantiles"]) for x in order.quantiles(df, ("k",), "v", at, parts).collect()}
    assert set(got) == set(want) == {"a", None, "c", "d"} and got["a"][0] == 900
    assert all(np.allclose(got[k][1], want[k], rtol=1e-12, atol=1e-12) for k in want)
    everything = order.quantiles(df, (), "v", (0.5,), parts).first()
    assert everything["n"] == 972 and everything["quantiles"] == [df.agg(F.percentile("v", F.lit(0.5))).first()[0]]


def test_running_weights_of_one_key_fill_many_ranges(spark):
    df = spark.range(5000).select(F.lit("k").alias("k"), (F.col("id") * 7919 % 5000).alias("v"), F.lit(2).cast("long").alias("w")).repartition(4)
    got = order.cumulated(df, ("k",), "v", "w", "before", 20)
    assert all(r["before"] == 2 * r["v"] for r in got.collect())
    spread = order.dealt(df, F.col("k"), F.col("v"), parts=20).groupBy("_range").count().collect()
    assert len(spread) == 20 and max(r["count"] for r in spread) < 400


def test_spread_wilcoxon_equals_the_other(spark):
    r = np.random.RandomState(5)
    rows = [(g, float(a), float(b)) for g, n in (("x", 700), ("y", 3), ("z", 5)) for a, b in zip(r.randint(0, 9, n), r.randint(0, 12, n) if g != "z" else [1] * n)] + [("w", 2.0, 2.0)]
    rows += [("w", None, 1.0)]
    df = spark.createDataFrame(rows, "g string, base double, challenger double")
    for keys in (("g",), ()):
        one, two = (sorted(map(tuple, stats.wilcoxon(df, *keys, spread=s).collect())) for s in (False, True))
        assert one == two and len(one) == (4 if keys else 1)


def test_no_task_of_spearman_ranks_a_group(spark):
    """Ranks are those of sorting everything, and no window lies over a group's rows; ties, null keys, a constant, frequent and rare values."""
    r = np.random.RandomState(7)
    rows = [("a", float(u), float(v)) for u, v in zip(r.randint(0, 400, 900), r.randint(0, 4, 900))] + [(None, float(u), float(u + v)) for u, v in zip(r.randn(300), r.randn(300))]
    rows += [("c", 1.0, float(v)) for v in range(5)] + [("d", 2.0, 3.0), ("e", None, 1.0), ("a", math.nan, 2.0), ("a", 3.0, math.inf)]
    df = spark.createDataFrame(rows, "k string, x double, y double").repartition(3)
    found = stats.spearman(df, "x", "y", "k")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Window [" in line and "_range" not in line], plan
    got = {q["k"]: (q["n"], q["rho"]) for q in found.collect()}
    assert set(got) == {"a", None, "c", "d"} and got["c"] == (5, None) and got["d"] == (1, None)
    for k, n in (("a", 900), (None, 300)):
        f = pd.DataFrame([q[1:] for q in rows if q[0] == k and q[1] is not None and np.isfinite(q[1]) and np.isfinite(q[2])])
        assert got[k] == (n, pytest.approx(f[0].rank().corr(f[1].rank()), abs=1e-6))


@pytest.mark.parametrize("spread", [False, True])
def test_wilcoxon_of_millions_of_equal_differences(spark, spread):
    """The cube of a number of ties passes the greatest long from 2,097,152 on."""
    n = 3_000_000
    df = spark.range(n).select(F.lit("k").alias("k"), F.lit(1.0).alias("base"), F.when(F.col("id") % 3 == 0, 0.0).otherwise(2.0).alias("challenger"))
    got = stats.wilcoxon(df, "k", spread=spread).first()
    w, var = n // 3 * (n + 1) / 2, n * (n + 1) * (2 * n + 1) / 24 - (n**3 - n) / 48
    assert (got["n_pairs"], got["n_nonzero"], got["w"]) == (n, n, w)
    assert got["z"] == pytest.approx((w - n * (n + 1) / 4) / math.sqrt(var), abs=1e-6)


def test_sketches_merge_within_their_error(spark):
    df = spark.range(200_000).select((F.col("id") % 3).alias("k"), (F.col("id") % 7).alias("day"), F.pow(F.rand(3), F.lit(3.0)).alias("v")).cache()
    at = (0.01, 0.25, 0.5, 0.75, 0.99)
    whole = {r["k"]: r for r in order.sketched_quantiles(order.sketches(df, ("k",), "v"), ("k",), at).collect()}
    merged = {r["k"]: r for r in order.sketched_quantiles(order.merged_sketches(order.sketches(df, ("k", "day"), "v"), ("k",)), ("k",), at).collect()}
    for k in range(3):
        values = np.sort([r["v"] for r in df.where(F.col("k") == k).collect()])
        for found in (whole[k], merged[k]):
            assert found["n"] == len(values)
            ranks = np.searchsorted(values, found["quantiles"]) / len(values)
            assert np.abs(ranks - at).max() < 0.0133 * 200 / order.SKETCH * 1.5
    size = order.sketches(df, (), "v").select(F.octet_length("sketch")).first()[0]
    assert size < 20_000
