"""Forecast, accuracy and test queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foretally.functions.numeric import erfc_sql, r6
from foretally.operators import chunks, forecast, metrics, series, stats
from foretally.sources.tables import table

SEASON = BLOCK = 12
HORIZON = 12

MONTHLY_SQL = """
m as (select o_orderpriority as series_id, strftime(o_orderdate, '%Y-%m') as period, sum(cast(round(o_totalprice * 100) as bigint)) / 100.0 as y from orders group by 1, 2),
s as (select *, cast(row_number() over (partition by series_id order by period) - 1 as int) as t, cast(count(*) over (partition by series_id) as int) as n from m),
p as (select *, cast((n * 4) // 5 as int) as n_train from s)
"""

HOURLY_SQL = """
m as (select event_type as series_id, strftime(ts, '%Y-%m-%d %H') as period, sum(cast(round(value * 100) as bigint)) / 100.0 as y from events group by 1, 2),
s as (select *, cast(row_number() over (partition by series_id order by period) - 1 as int) as t, cast(count(*) over (partition by series_id) as int) as n from m),
p as (select *, cast((n * 4) // 5 as int) as n_train from s)
"""

RUNS_SQL = """
m as (select o_orderstatus as llm, cast(substr(o_orderpriority, 1, 1) as int) as run, strftime(o_orderdate, '%Y-%m') as period, sum(cast(round(o_totalprice * 100) as bigint)) / 100.0 as y from orders group by 1, 2, 3),
s as (select *, cast(row_number() over (partition by llm, run order by period) - 1 as int) as t, cast(count(*) over (partition by llm, run) as int) as n from m),
p as (select *, cast((n * 4) // 5 as int) as n_train from s)
"""


def forecast_sql(keys: str, season: int, block: int) -> str:
    """CTE f: keys, scenario, model, t, n, n_train, actual, forecast, from CTE p."""
    ks = [k.strip() for k in keys.split(",")]
    same = " and ".join(f"a.{k} = b.{k}" for k in ks)
    return f"""
k as (
  select p.*, scenario, model, case scenario when 'S1' then n_train when 'S4' then n_train + ((t - n_train) // {block}) * {block} else t end as known
  from p, (values ('S1'), ('S2'), ('S3'), ('S4')) sc(scenario), (values ('naive-flat'), ('naive-seasonal')) mo(model) where t >= n_train and n_train > 0
),
g as (select *, case when model = 'naive-flat' or known < {season} then known - 1 else known - {season} + (t - known) % {season} end as src from k),
f as (select {", ".join("a." + k for k in ks)}, a.scenario, a.model, a.t, a.n, a.n_train, a.y as actual, b.y as forecast from g a join p b on {same} and b.t = a.src)
"""


PLAIN_METRICS = """count(*) as n, avg(abs(actual - forecast)) as mae, sqrt(avg((actual - forecast) * (actual - forecast))) as rmse,
  100 * avg(case when abs(actual) + abs(forecast) = 0 then 0 else 2 * abs(actual - forecast) / (abs(actual) + abs(forecast)) end) as smape,
  1 - sum((actual - forecast) * (actual - forecast)) / nullif(count(*) * var_pop(actual), 0) as r2"""
METRICS_SQL = """count(*) as n, round(avg(abs(actual - forecast)), 6) as mae, round(sqrt(avg((actual - forecast) * (actual - forecast))), 6) as rmse,
  round(100 * avg(case when abs(actual) + abs(forecast) = 0 then 0 else 2 * abs(actual - forecast) / (abs(actual) + abs(forecast)) end), 6) as smape,
  round(1 - sum((actual - forecast) * (actual - forecast)) / nullif(count(*) * var_pop(actual), 0), 6) as r2"""


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return series.assembled(series.totals(o, {"series_id": F.col("o_orderpriority")}, F.date_format("o_orderdate", "yyyy-MM"), F.col("o_totalprice")), "series_id")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return series.assembled(series.totals(e, {"series_id": F.col("event_type")}, F.date_format("ts", "yyyy-MM-dd HH"), F.col("value")), "series_id")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    keys = {"llm": F.col("o_orderstatus"), "run": F.substring("o_orderpriority", 1, 1).cast("int")}
    return series.assembled(series.totals(o, keys, F.date_format("o_orderdate", "yyyy-MM"), F.col("o_totalprice")), "llm", "run")


def run_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """llm, run, scenario, branch, t, actual, forecast: flat is the base, seasonal and the mean of both are the challengers."""
    f = forecast.naive(runs(spark, sf_dir), "llm", "run", season=SEASON, block=BLOCK)
    wide = f.groupBy("llm", "run", "scenario", "t").agg(F.max("actual").alias("actual"), F.max(F.when(F.col("model") == "naive-flat", F.col("forecast"))).alias("flat"), F.max(F.when(F.col("model") == "naive-seasonal", F.col("forecast"))).alias("seasonal"))
    branches = F.array(
        F.struct(F.lit("Base").alias("branch"), F.col("flat").alias("forecast")), F.struct(F.lit("ChalML").alias("branch"), F.col("seasonal").alias("forecast")),
        F.struct(F.lit("ChalDL").alias("branch"), ((F.col("flat") + F.col("seasonal")) / 2).alias("forecast")),
    )
    return wide.select("llm", "run", "scenario", "t", "actual", F.inline(branches))


RUN_FORECASTS_SQL = (
    RUNS_SQL
    + ","
    + forecast_sql("llm, run", SEASON, BLOCK)
    + """,
w as (select llm, run, scenario, t, max(actual) as actual, max(case when model = 'naive-flat' then forecast end) as flat, max(case when model = 'naive-seasonal' then forecast end) as seasonal from f group by all),
rf as (select llm, run, scenario, t, actual, 'Base' as branch, flat as forecast from w union all select llm, run, scenario, t, actual, 'ChalML', seasonal from w union all select llm, run, scenario, t, actual, 'ChalDL', (flat + seasonal) / 2 from w)
"""
)


def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """llm, run, scenario, branch and the metrics."""
    scale = metrics.naive_scale(runs(spark, sf_dir), "llm", "run", season=SEASON)
    return metrics.evaluate(run_forecasts(spark, sf_dir), "llm", "run", "scenario", "branch", scale=scale, on=("llm", "run"), digits=None)


RUN_METRICS_SQL = (
    RUN_FORECASTS_SQL
    + f""",
sc as (select llm, run, avg(d) as scale from (select llm, run, abs(y - lag(y, {SEASON}) over (partition by llm, run order by t)) as d from p where t < n_train) group by 1, 2),
rm as (select llm, run, scenario, branch, {PLAIN_METRICS}, avg(abs(actual - forecast)) / nullif(max(scale), 0) as mase from rf join sc using (llm, run) group by 1, 2, 3, 4)
"""
)


def series_monthly(spark, sf_dir):
    return series.points(monthly(spark, sf_dir), "series_id").select("series_id", "t", "period", r6(F.col("y")).alias("y"))


def series_hourly(spark, sf_dir):
    return series.points(hourly(spark, sf_dir), "series_id").select("series_id", "t", "period", r6(F.col("y")).alias("y"))


def split_train_test(spark, sf_dir):
    return series.points(monthly(spark, sf_dir), "series_id").groupBy("series_id", "part").agg(F.count("*").alias("n_points"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), r6(F.avg("y")).alias("mean_y"))


def _one_model(model):
    def query(spark, sf_dir):
        return forecast.naive(monthly(spark, sf_dir), "series_id", season=SEASON, block=BLOCK, models=(model,)).select("series_id", "scenario", "t", "actual", "forecast")

    return query


def forecast_hourly_block(spark, sf_dir):
    return forecast.naive(hourly(spark, sf_dir), "series_id", season=24, block=24, scenarios=("S4",)).select("series_id", "model", "t", "actual", "forecast")


def forecast_arima(spark, sf_dir):
    return forecast.arima(monthly(spark, sf_dir), "series_id", season=SEASON, block=BLOCK)


def forecast_chunked(spark, sf_dir):
    """Hourly series in chunks of 64 values: all protocols, of which the static one reaches back over many chunks."""
    points = series.points(hourly(spark, sf_dir), "series_id").select("series_id", "t", "y")
    return chunks.naive(points, "series_id", season=24, block=24, size=64)


def newey_west_chunked(spark, sf_dir):
    points = series.points(monthly(spark, sf_dir), "series_id").select("series_id", "t", (F.col("y") / 1e6).alias("d"))
    return chunks.newey_west(points, "series_id", lag=6, size=16).select("series_id", r6(F.col("variance")).alias("variance"))


def forecast_ar(spark, sf_dir):
    return forecast.autoregressive(monthly(spark, sf_dir), "series_id", season=SEASON, block=BLOCK)


def forecast_ar1(spark, sf_dir):
    """A first-order autoregression in millions, fitted again at each origin; one step and blocks."""
    s = monthly(spark, sf_dir).withColumn("ys", F.transform("ys", lambda y: y / 1e6))
    f = forecast.autoregressive(s, "series_id", season=SEASON, block=BLOCK, shapes=((0, 0, 1),), model="ar1")
    return f.select("series_id", "scenario", "t", r6(F.col("actual")).alias("actual"), r6(F.col("forecast")).alias("forecast"))


def metrics_models(spark, sf_dir):
    """Accuracy of the autoregressions beside the naive models of the same series."""
    m = monthly(spark, sf_dir)
    both = forecast.naive(m, "series_id", season=SEASON, block=BLOCK).unionByName(forecast.autoregressive(m, "series_id", season=SEASON, block=BLOCK))
    return metrics.evaluate(both, "series_id", "scenario", "model")


def metrics_naive(spark, sf_dir):
    return metrics.evaluate(forecast.naive(monthly(spark, sf_dir), "series_id", season=SEASON, block=BLOCK), "series_id", "scenario", "model")


def metrics_mase(spark, sf_dir):
    m = monthly(spark, sf_dir)
    scale = metrics.naive_scale(m, "series_id", season=SEASON)
    return metrics.evaluate(forecast.naive(m, "series_id", season=SEASON, block=BLOCK), "series_id", "scenario", "model", scale=scale, on=("series_id",)).select("series_id", "scenario", "model", "mase")


def metrics_envelope(spark, sf_dir):
    """Runs whose forecasts are cut short: by run number, none, one or all of the steps are missing."""
    m = runs(spark, sf_dir)
    f = forecast.naive(m, "llm", "run", season=SEASON, block=BLOCK, scenarios=("S1",), models=("naive-flat",))
    given = f.withColumn("keep", F.when(F.col("run") == 2, F.col("t") % 2 == 0).when(F.col("run") == 4, F.lit(False)).otherwise(F.lit(True)))
    g = given.groupBy("llm", "run").agg(F.count(F.when(F.col("keep"), 1)).alias("found"), F.count("*").alias("expected"), r6(F.avg(F.when(F.col("keep"), F.abs(F.col("actual") - F.col("forecast"))))).alias("mae"))
    status, error = metrics.envelope(F.col("found"), F.col("expected"), F.col("mae"))
    return g.select("llm", "run", "found", "expected", status.alias("execution_status"), error.alias("error"), F.when(status == "OK", F.col("mae")).alias("mae"))


def naive_scale(spark, sf_dir):
    a = metrics.naive_scale(monthly(spark, sf_dir), "series_id", season=SEASON)
    b = metrics.naive_scale(hourly(spark, sf_dir), "series_id", season=24)
    return a.unionByName(b).select("series_id", "n_lagged", r6(F.col("scale")).alias("scale"))


def dm_tests(spark, sf_dir):
    f = run_forecasts(spark, sf_dir)
    base = f.where("branch = 'Base'").select("llm", "run", "scenario", "t", F.col("actual").alias("ref_actual"), F.col("forecast").alias("ref_forecast"))
    pairs = f.where("branch <> 'Base'").join(base, ["llm", "run", "scenario", "t"])
    keys = ("llm", "run", "scenario", "branch")
    return stats.diebold_mariano(stats.loss_differences(pairs, *keys), *keys, horizon=HORIZON)


def _dm_sql(pairs: str, keys: str) -> str:
    """CTEs from pairs (keys, t, d) up to dm: the test of each group of keys."""
    return f""",
d0 as ({pairs}),
d1 as (select *, row_number() over w1 as i, count(*) over w2 as n, avg(d) over w2 as mu from d0 window w1 as (partition by {keys} order by t), w2 as (partition by {keys})),
lg as (select {keys}, max(n) as n, max(mu) as mu, least({HORIZON - 1}, max(n) - 1) as lag from d1 group by {keys}),
cv as (select {", ".join("a." + k.strip() for k in keys.split(","))}, a.i - b.i as k, sum((a.d - a.mu) * (b.d - b.mu)) as c from d1 a join d1 b using ({keys}) where a.i - b.i between 0 and {HORIZON - 1} group by all),
lr as (select {keys}, max(n) as dm_n, max(lag) as dm_lag, max(mu) as mu, sum(case when k = 0 then 1 else 2 * (1 - k / (lag + 1.0)) end * c / n) as lrv, max(case when k = 0 then c / n end) + max(mu) * max(mu) as sq from cv join lg using ({keys}) where k <= lag group by {keys}),
st as (select *, case when lrv > 1e-12 * sq then mu / sqrt(lrv / dm_n) end as z from lr),
dm as (select *, {erfc_sql("(abs(z) / sqrt(2.0))")} as dm_p from st)
"""


_DM_SQL = RUN_FORECASTS_SQL + _dm_sql(
    """select c.llm, c.run, c.scenario, c.branch, c.t, (c.actual - c.forecast) * (c.actual - c.forecast) - (b.actual - b.forecast) * (b.actual - b.forecast) as d
       from rf c join rf b on b.branch = 'Base' and c.branch <> 'Base' and c.llm = b.llm and c.run = b.run and c.scenario = b.scenario and c.t = b.t""",
    "llm, run, scenario, branch",
)


def _vs_models(spark, sf_dir):
    """Every run against every baseline model of its series and scenario."""
    keys = ("llm", "run", "scenario", "branch", "baseline")
    models = forecast.naive(runs(spark, sf_dir), "llm", "run", season=SEASON, block=BLOCK).withColumnRenamed("model", "baseline")
    pairs = stats.beside_models(run_forecasts(spark, sf_dir), models, "baseline", "llm", "run", "scenario", "t")
    return stats.benjamini_hochberg(stats.diebold_mariano(stats.loss_differences(pairs, *keys), *keys, horizon=HORIZON), "dm_p", *keys)


def dm_vs_models(spark, sf_dir):
    d = _vs_models(spark, sf_dir)
    return d.select("llm", "run", "scenario", "branch", "baseline", F.col("dm_n").cast("long").alias("dm_n"), r6(F.col("dm_mean") / 1e12).alias("dm_mean"), r6(F.col("dm_statistic")).alias("dm_statistic"), r6(F.col("dm_p")).alias("dm_p"), r6(F.col("q")).alias("dm_q"))


def models_win_tie_loss(spark, sf_dir):
    """How often each branch is better than each baseline model at a false discovery rate of 5 %."""
    d = _vs_models(spark, sf_dir)
    win, loss = (F.col("q") < 0.05) & (F.col("dm_mean") < 0), (F.col("q") < 0.05) & (F.col("dm_mean") > 0)
    k = lambda c: F.count(F.when(c, 1))
    return d.groupBy("branch", "baseline").agg(F.count("*").alias("n"), k(win).alias("wins"), k(loss).alias("losses"), (F.count("*") - k(win) - k(loss)).alias("ties"))


_VS_SQL = RUN_FORECASTS_SQL + _dm_sql(
    """select c.llm, c.run, c.scenario, c.branch, b.model as baseline, c.t, (c.actual - c.forecast) * (c.actual - c.forecast) - (b.actual - b.forecast) * (b.actual - b.forecast) as d
       from rf c join f b on c.llm = b.llm and c.run = b.run and c.scenario = b.scenario and c.t = b.t""",
    "llm, run, scenario, branch, baseline",
) + """,
rk as (select *, row_number() over (order by dm_p, llm, run, scenario, branch, baseline) as rk, count(*) over () as m from dm where dm_p is not null),
bh as (select llm, run, scenario, branch, baseline, min(dm_p * m / rk) over (order by dm_p desc, llm desc, run desc, scenario desc, branch desc, baseline desc rows between unbounded preceding and current row) as q from rk)
"""


def newey_west(spark, sf_dir):
    """Long-run variance of each monthly series' changes, in millions squared."""
    s = monthly(spark, sf_dir).select("series_id", F.transform("ys", lambda y: y / 1e6).alias("d"), "n")
    return s.select("series_id", r6(stats.newey_west(F.col("d"), F.lit(6))).alias("variance"))


def dm_vs_base(spark, sf_dir):
    d = dm_tests(spark, sf_dir)
    return d.select("llm", "run", "scenario", "branch", F.col("dm_n").cast("long").alias("dm_n"), F.col("dm_lag").cast("long").alias("dm_lag"), r6(F.col("dm_mean") / 1e12).alias("dm_mean"), r6(F.col("dm_statistic")).alias("dm_statistic"), F.coalesce((F.col("dm_p") < 0.05) & (F.col("dm_mean") < 0), F.lit(False)).alias("dm_better"))


def dm_pvalues(spark, sf_dir):
    return dm_tests(spark, sf_dir).select("llm", "run", "scenario", "branch", r6(F.col("dm_p")).alias("dm_p"))


def _with_q(spark, sf_dir):
    return stats.benjamini_hochberg(dm_tests(spark, sf_dir), "dm_p", "llm", "run", "scenario", "branch")


def dm_bh_fdr(spark, sf_dir):
    return _with_q(spark, sf_dir).select("llm", "run", "scenario", "branch", r6(F.col("q")).alias("dm_q"))


_BH_SQL = """,
rk as (select *, row_number() over (order by dm_p, llm, run, scenario, branch) as rk, count(*) over () as m from dm where dm_p is not null),
bh as (select *, min(dm_p * m / rk) over (order by dm_p desc, llm desc, run desc, scenario desc, branch desc rows between unbounded preceding and current row) as q from rk)
"""


def dm_win_tie_loss(spark, sf_dir):
    q = _with_q(spark, sf_dir)
    win, loss = (F.col("q") < 0.05) & (F.col("dm_mean") < 0), (F.col("q") < 0.05) & (F.col("dm_mean") > 0)
    k = lambda c: F.count(F.when(c, 1))
    return q.groupBy("branch", "scenario").agg(F.count("*").alias("n"), k(win).alias("wins"), k(loss).alias("losses"), (F.count("*") - k(win) - k(loss)).alias("ties"), r6(F.avg("dm_p")).alias("mean_p"))


def _with(sql: str, select: str) -> str:
    return f"with {sql} {select}"


_MF = MONTHLY_SQL + "," + forecast_sql("series_id", SEASON, BLOCK)
QUERIES = {
    "series_monthly": series_monthly, "series_hourly": series_hourly, "split_train_test": split_train_test, "forecast_flat_all": _one_model("naive-flat"), "forecast_seasonal_all": _one_model("naive-seasonal"),
    "forecast_hourly_block": forecast_hourly_block, "forecast_arima": forecast_arima, "forecast_ar": forecast_ar, "forecast_chunked": forecast_chunked, "newey_west_chunked": newey_west_chunked, "forecast_ar1": forecast_ar1, "metrics_models": metrics_models, "metrics_naive": metrics_naive, "metrics_mase": metrics_mase, "metrics_envelope": metrics_envelope, "naive_scale": naive_scale,
    "newey_west": newey_west, "dm_vs_base": dm_vs_base, "dm_pvalues": dm_pvalues, "dm_bh_fdr": dm_bh_fdr, "dm_win_tie_loss": dm_win_tie_loss,
    "dm_vs_models": dm_vs_models, "models_win_tie_loss": models_win_tie_loss,
}
SQL = {
    "series_monthly": _with(MONTHLY_SQL, "select series_id, t, period, round(y, 6) as y from p"),
    "series_hourly": _with(HOURLY_SQL, "select series_id, t, period, round(y, 6) as y from p"),
    "split_train_test": _with(MONTHLY_SQL, "select series_id, case when t < n_train then 'train' else 'test' end as part, count(*) as n_points, min(t) as first_t, max(t) as last_t, round(avg(y), 6) as mean_y from p group by 1, 2"),
    "forecast_flat_all": _with(_MF, "select series_id, scenario, t, actual, forecast from f where model = 'naive-flat'"),
    "forecast_seasonal_all": _with(_MF, "select series_id, scenario, t, actual, forecast from f where model = 'naive-seasonal'"),
    "forecast_hourly_block": _with(HOURLY_SQL + "," + forecast_sql("series_id", 24, 24), "select series_id, model, t, actual, forecast from f where scenario = 'S4'"),
    "forecast_ar1": _with(
        MONTHLY_SQL + f""",
l as (select series_id, t, n, n_train, y / 1e6 as y, lag(y / 1e6) over (partition by series_id order by t) as x from p),
w as (select *, regr_slope(y, x) over known as b, regr_intercept(y, x) over known as a from l window known as (partition by series_id order by t rows between unbounded preceding and 1 preceding)),
o as (select *, scenario, case scenario when 'S1' then n_train when 'S4' then n_train + ((t - n_train) // {BLOCK}) * {BLOCK} else t end as origin from w, (values ('S1'), ('S2'), ('S3'), ('S4')) sc(scenario) where t >= n_train)""",
        # h steps of y = a + b y by the sum of the geometric series
        "select o.series_id, o.scenario, o.t, round(o.y, 6) as actual, round(w.a * (1 - w.b ** (o.t - o.origin + 1)) / (1 - w.b) + w.b ** (o.t - o.origin + 1) * w.x, 6) as forecast from o join w on w.series_id = o.series_id and w.t = o.origin",
    ),
    "metrics_naive": _with(_MF, f"select series_id, scenario, model, {METRICS_SQL} from f group by 1, 2, 3"),
    "metrics_mase": _with(_MF + f", sc as (select series_id, avg(d) as scale from (select series_id, abs(y - lag(y, {SEASON}) over (partition by series_id order by t)) as d from p where t < n_train) group by 1)", "select series_id, scenario, model, round(avg(abs(actual - forecast)) / nullif(max(scale), 0), 6) as mase from f join sc using (series_id) group by 1, 2, 3"),
    "metrics_envelope": _with(
        RUNS_SQL + "," + forecast_sql("llm, run", SEASON, BLOCK) + """,
e as (select llm, run, count(*) filter (case when run = 2 then t % 2 = 0 when run = 4 then false else true end) as found, count(*) as expected,
      round(avg(abs(actual - forecast)) filter (case when run = 2 then t % 2 = 0 when run = 4 then false else true end), 6) as mae from f where scenario = 'S1' and model = 'naive-flat' group by 1, 2),
r as (select *, case when found = 0 then 'No Python forecast list found' when found <> expected then 'Forecast length mismatch: expected ' || expected || ', got ' || found when mae is null then 'No valid forecast/actual pairs' end as err from e)""",
        "select llm, run, found, expected, case when err is null then 'OK' else 'FAIL' end as execution_status, coalesce(err, '') as error, case when err is null then mae end as mae from r",
    ),
    "naive_scale": f"""with {MONTHLY_SQL}, a as (select series_id, abs(y - lag(y, 12) over (partition by series_id order by t)) as d from p where t < n_train)
select series_id, count(d) as n_lagged, round(avg(d), 6) as scale from a group by 1 union all
(with {HOURLY_SQL}, a as (select series_id, abs(y - lag(y, 24) over (partition by series_id order by t)) as d from p where t < n_train) select series_id, count(d), round(avg(d), 6) from a group by 1)""",
    "newey_west": _with(
        MONTHLY_SQL + """,
z as (select series_id, t, n, y / 1e6 - avg(y / 1e6) over (partition by series_id) as c from p),
cv as (select a.series_id, a.t - b.t as k, max(a.n) as n, sum(a.c * b.c) as s from z a join z b using (series_id) where a.t - b.t between 0 and 6 group by 1, 2)""",
        "select series_id, round(sum(case when k = 0 then 1 else 2 * (1 - k / 7.0) end * s / n), 6) as variance from cv group by 1",
    ),
    "dm_vs_base": _with(_DM_SQL, "select llm, run, scenario, branch, dm_n, dm_lag, round(mu / 1e12, 6) as dm_mean, round(z, 6) as dm_statistic, coalesce(dm_p < 0.05 and mu < 0, false) as dm_better from dm"),
    "dm_pvalues": _with(_DM_SQL, "select llm, run, scenario, branch, round(dm_p, 6) as dm_p from dm"),
    "dm_bh_fdr": _with(_DM_SQL + _BH_SQL, "select llm, run, scenario, branch, round(q, 6) as dm_q from dm left join bh using (llm, run, scenario, branch)"),
    "dm_win_tie_loss": _with(_DM_SQL + _BH_SQL, "select dm.branch, dm.scenario, count(*) as n, count(*) filter (q < 0.05 and dm.mu < 0) as wins, count(*) filter (q < 0.05 and dm.mu > 0) as losses, count(*) - count(*) filter (q < 0.05 and dm.mu < 0) - count(*) filter (q < 0.05 and dm.mu > 0) as ties, round(avg(dm.dm_p), 6) as mean_p from dm left join bh using (llm, run, scenario, branch) group by 1, 2"),
    "dm_vs_models": _with(_VS_SQL, "select llm, run, scenario, branch, baseline, dm_n, round(mu / 1e12, 6) as dm_mean, round(z, 6) as dm_statistic, round(dm_p, 6) as dm_p, round(q, 6) as dm_q from dm left join bh using (llm, run, scenario, branch, baseline)"),
    "models_win_tie_loss": _with(_VS_SQL, "select branch, baseline, count(*) as n, count(*) filter (q < 0.05 and mu < 0) as wins, count(*) filter (q < 0.05 and mu > 0) as losses, count(*) - count(*) filter (q < 0.05 and mu < 0) - count(*) filter (q < 0.05 and mu > 0) as ties from dm left join bh using (llm, run, scenario, branch, baseline) group by 1, 2"),
}
SQL["forecast_chunked"] = _with(HOURLY_SQL + "," + forecast_sql("series_id", 24, 24), "select series_id, scenario, model, t, actual, forecast from f")
SQL["newey_west_chunked"] = SQL["newey_west"]
