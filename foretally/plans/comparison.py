"""Comparison, summary and ranking queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from foretally.functions.numeric import erfc_sql, r6
from foretally.functions.text import k_of_n, p_text
from foretally.operators import order, stats, summary
from foretally.plans.forecasting import RUN_METRICS_SQL, run_metrics
from foretally.sources.tables import table

METRICS = ["mae", "rmse", "smape", "mase", "r2"]


def stats_sql(value: str, prefix: str) -> str:
    q = lambda p: f"quantile_cont({value}, {p})"
    std = f"case when count({value}) > 0 then coalesce(stddev_samp({value}), 0) end"
    return f"""count({value}) as {prefix}_count, round(avg({value}), 6) as {prefix}_mean, round({std}, 6) as {prefix}_std, round({q(0.5)}, 6) as {prefix}_median, round({q(0.25)}, 6) as {prefix}_q1,
  round({q(0.75)}, 6) as {prefix}_q3, round({q(0.75)} - {q(0.25)}, 6) as {prefix}_iqr, round(avg({value}) - 1.96 * {std} / sqrt(count({value})::double), 6) as {prefix}_ci_low,
  round(avg({value}) + 1.96 * {std} / sqrt(count({value})::double), 6) as {prefix}_ci_high"""


def comparison_long(spark, sf_dir):
    """Means over the runs of each challenger beside the base, metric by metric."""
    m = run_metrics(spark, sf_dir)
    means = m.groupBy("llm", "scenario", "branch").agg(*[F.avg(c).alias(c) for c in METRICS])
    pairs = summary.paired(means, "Base", ["llm", "scenario"], METRICS)
    rows = summary.long_metrics(pairs, METRICS, "llm", "scenario", "branch")
    return rows.select("llm", "scenario", "branch", "metric", r6(F.col("base")).alias("base"), r6(F.col("challenger")).alias("challenger"), r6(F.col("difference")).alias("delta"), summary.outcome(r6(F.col("difference")), F.col("metric")).alias("outcome"))


_LONG_SQL = ", ".join(f"('{m}', base_{m}, {m})" for m in METRICS)
_COMPARISON_SQL = (
    "with "
    + RUN_METRICS_SQL
    + ", gm as (select llm, scenario, branch, "
    + ", ".join(f"avg({m}) as {m}" for m in METRICS)
    + " from rm group by 1, 2, 3), pr as (select c.llm, c.scenario, c.branch, "
    + ", ".join(f"c.{m}, b.{m} as base_{m}" for m in METRICS)
    + " from gm c join gm b on b.branch = 'Base' and c.branch <> 'Base' and c.llm = b.llm and c.scenario = b.scenario),"
    + " lo as (select llm, scenario, branch, u.metric, u.base, u.challenger, u.challenger - u.base as d from pr, lateral (values "
    + _LONG_SQL
    + ") u(metric, base, challenger)),"
    + " oc as (select *, case when abs(round(d, 6)) <= 1e-12 then 'tie' when (metric = 'r2' and round(d, 6) > 0) or (metric <> 'r2' and round(d, 6) < 0) then 'win' else 'loss' end as outcome from lo)"
)


def win_tie_loss(spark, sf_dir):
    return summary.win_tie_loss(comparison_long(spark, sf_dir), "branch", "metric")


def _run_pairs(spark, sf_dir):
    return summary.paired(run_metrics(spark, sf_dir), "Base", ["llm", "run", "scenario"], METRICS)


_PAIRS_SQL = (
    "with "
    + RUN_METRICS_SQL
    + ", pr as (select c.llm, c.run, c.scenario, c.branch, "
    + ", ".join(f"c.{m}, b.{m} as base_{m}" for m in METRICS)
    + " from rm c join rm b on b.branch = 'Base' and c.branch <> 'Base' and c.llm = b.llm and c.run = b.run and c.scenario = b.scenario),"
    + f" lo as (select llm, run, scenario, branch, u.metric, u.base, u.challenger, u.challenger - u.base as d from pr, lateral (values {_LONG_SQL}) u(metric, base, challenger))"
)


def wilcoxon_approx(spark, sf_dir):
    rows = summary.long_metrics(_run_pairs(spark, sf_dir), METRICS, "branch", "scenario", "run", "llm")
    return stats.wilcoxon(rows, "branch", "scenario", "metric")


_WILCOXON_SQL = (
    _PAIRS_SQL
    + f""",
md as (select branch, scenario, metric, count(*) as n_pairs, quantile_cont(base, 0.5) as mb, quantile_cont(challenger, 0.5) as mc from lo where base is not null and challenger is not null group by 1, 2, 3),
nz as (select *, printf('%.9e', abs(d))::double as a from lo where abs(d) > 1e-12 * greatest(abs(base), abs(challenger))),
rk as (select *, rank() over (partition by branch, scenario, metric order by a) + (count(*) over (partition by branch, scenario, metric, a) - 1) / 2.0 as r, count(*) over (partition by branch, scenario, metric, a) as ties from nz),
su as (select branch, scenario, metric, count(*) as n, sum(case when d > 0 then r else 0 end)::double as plus, sum(case when d < 0 then r else 0 end)::double as minus, sum(ties * ties - 1) as tied from rk group by 1, 2, 3),
zz as (select *, (least(plus, minus) - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - tied / 48.0) as z from md left join su using (branch, scenario, metric))
select branch, scenario, metric, n_pairs, coalesce(n, 0) as n_nonzero, coalesce(least(plus, minus), 0.0) as w, round(z, 6) as z, coalesce(round({erfc_sql("(abs(z) / sqrt(2.0))")}, 6), 1.0) as p, round(mb, 6) as median_base, round(mc, 6) as median_other from zz
"""
)


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.lit("all").alias("k"), "l_returnflag", F.col("l_quantity").cast("double").alias("base"), (F.col("l_linenumber") * 8.0).alias("challenger"), F.col("l_extendedprice").cast("double").alias("price"))


def wilcoxon_one_group(spark, sf_dir):
    """All lines in one group, whose ranks are dealt over ranges of values."""
    return stats.wilcoxon(_lines(spark, sf_dir), "k", spread=True)


def quantiles_of_large_groups(spark, sf_dir):
    """Exact quartiles and tails of prices, by running counts over ranges of values."""
    q = order.quantiles(_lines(spark, sf_dir), ("l_returnflag",), "price", (0.01, 0.25, 0.5, 0.75, 0.99))
    return q.select("l_returnflag", "n", *[r6(F.col("quantiles")[i]).alias(c) for i, c in enumerate(("p01", "q1", "median", "q3", "p99"))])


def wilcoxon_exact(spark, sf_dir):
    rows = summary.long_metrics(_run_pairs(spark, sf_dir), METRICS, "branch", "scenario", "run", "llm")
    return stats.wilcoxon_exact(rows, "branch", "scenario", "metric")


def _labelled(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")


def point_biserial(spark, sf_dir):
    return stats.point_biserial(_labelled(spark, sf_dir), F.col("quality") == 1, F.col("n_chars").cast("double"), "lang")


def point_biserial_p(spark, sf_dir):
    return point_biserial(spark, sf_dir).withColumn("p", r6(stats.correlation_p("r", "n")))


def spearman(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("x"), F.col("l_quantity").cast("double").alias("y"))
    return stats.spearman(rows, "x", "y", "l_returnflag")


def trend_line(spark, sf_dir):
    return stats.trend_line(table(spark, sf_dir, "lineitem"), F.col("l_quantity").cast("double"), F.col("l_extendedprice"), "l_returnflag", "l_linestatus")


def box_stats(spark, sf_dir):
    return stats.box_stats(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice"), F.col("l_extendedprice"), "l_returnflag")


def metric_summary(spark, sf_dir):
    return summary.metric_summary(run_metrics(spark, sf_dir), ["mae", "r2"], "llm", "branch")


def metric_summary_grouping_sets(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", (F.col("l_extendedprice") * 100).cast("long").cast("double").alias("cents"))
    return summary.grouping_sets_summary(rows, [("l_returnflag",), ("l_linestatus",), ("l_returnflag", "l_linestatus")], "cents")


def _ledger(spark, sf_dir):
    """Runs with success by a rule: a run fails if its sMAPE is above 60."""
    return run_metrics(spark, sf_dir).withColumn("ok", F.coalesce(F.col("smape") <= 60, F.lit(False)))


def run_coverage(spark, sf_dir):
    return summary.run_coverage(_ledger(spark, sf_dir), ("Base", "ChalML", "ChalDL"), "llm", "scenario")


_IDS = "coalesce(array_to_string(list_transform(list_sort(list_distinct({0})), lambda x: x::varchar), ','), '')"


def _coverage_sql() -> str:
    b = ("Base", "ChalML", "ChalDL")
    sets = ", ".join(f"coalesce(list(distinct run) filter (branch = '{x}' and smape <= 60), []) as s_{x}" for x in b)
    both = "list_intersect(list_intersect(s_Base, s_ChalML), s_ChalDL)"
    return (
        "with " + RUN_METRICS_SQL + f", gm as (select llm, scenario, count(*) as n_runs, {sets} from rm group by 1, 2) select llm, scenario, n_runs, "
        + ", ".join(f"len(s_{x}) as n_{x}" for x in b) + ", " + ", ".join(f"{_IDS.format('s_' + x)} as ids_{x}" for x in b) + ", "
        + ", ".join(f"len(list_intersect(s_Base, s_{x})) as pairs_{x}" for x in b[1:]) + f", len({both}) as n_complete, {_IDS.format(both)} as ids_complete from gm"
    )


def paired_summary(spark, sf_dir):
    return summary.paired_summary(_run_pairs(spark, sf_dir), METRICS, "scenario")


def report_paired(spark, sf_dir):
    """Median deltas with test and formatted p, as printed."""
    w = wilcoxon_approx(spark, sf_dir)
    return w.select("branch", "scenario", "metric", r6(F.col("median_other") - F.col("median_base")).alias("median_delta"), "n_pairs", p_text(F.col("p")).alias("p_text"))


def status_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kinds = ["click", "error", "purchase", "signup", "view"]
    return summary.status_summary(e.withColumn("day", F.date_format("ts", "yyyy-MM-dd")), {k: F.col("event_type") == k for k in kinds}, "day")


def category_share(spark, sf_dir):
    return summary.category_share(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority")


def category_pivot(spark, sf_dir):
    return summary.category_pivot(table(spark, sf_dir, "lineitem"), "l_linestatus", ("F", "O"), "l_returnflag")


def failure_adjusted_rank(spark, sf_dir):
    m = _ledger(spark, sf_dir)
    g = m.groupBy("llm", "branch").agg(r6(F.avg("mae")).alias("mae"), r6(F.avg("rmse")).alias("rmse"), r6(F.avg("smape")).alias("smape"), r6(F.avg("r2")).alias("r2"), r6(F.avg(F.col("ok").cast("int"))).alias("success_rate"))
    return summary.quality(g, {"mae": True, "rmse": True, "smape": True, "r2": False}, "success_rate").select("llm", "branch", "success_rate", "quality_mae", "quality_rmse", "quality_smape", "quality_r2", "conditional", "adjusted", "rank")


def _quality_sql() -> str:
    q = lambda m, lower: f"round(coalesce({'1 - ' if lower else ''}({m} - min({m}) over ()) / nullif(max({m}) over () - min({m}) over (), 0), 0.5), 6) as quality_{m}"
    ms = {"mae": True, "rmse": True, "smape": True, "r2": False}
    mean = "(" + " + ".join(f"quality_{m}" for m in ms) + ") / 4"
    return (
        "with " + RUN_METRICS_SQL + ", gm as (select llm, branch, " + ", ".join(f"round(avg({m}), 6) as {m}" for m in ms)
        + ", round(avg(case when smape <= 60 then 1 else 0 end), 6) as success_rate from rm group by 1, 2), q as (select *, " + ", ".join(q(m, lo) for m, lo in ms.items())
        + f" from gm), c as (select *, round({mean}, 6) as conditional, round({mean} * success_rate, 6) as adjusted from q) select llm, branch, success_rate, "
        + ", ".join(f"quality_{m}" for m in ms) + ", conditional, adjusted, rank() over (order by adjusted desc) as rank from c"
    )


def robustness_cv(spark, sf_dir):
    return summary.robustness(run_metrics(spark, sf_dir), "mase", ["llm", "scenario"], ["branch"])


def stage_failure_share(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    k = F.get_json_object("props", "$.k").cast("int")
    return summary.stage_failure_share(e, {"format": k % 2 == 0, "scenario": k % 3 == 0, "code": k % 5 > 0, "model": F.when(k > 10, k > 50)})


def dataset_profile(spark, sf_dir):
    out = None
    for name in ("customer", "events", "lineitem", "nation", "orders", "part", "region", "supplier"):
        p = summary.profile(table(spark, sf_dir, name), name)
        out = p if out is None else out.unionByName(p)
    return out


_PROFILE = {"customer": 5, "events": 6, "lineitem": 11, "nation": 3, "orders": 6, "part": 6, "region": 2, "supplier": 4}


def count_labels(spark, sf_dir):
    """How many runs of each model succeed in every scenario, as 'k / n'."""
    m = _ledger(spark, sf_dir).groupBy("llm", "branch").agg(k_of_n(F.count(F.when(F.col("ok"), 1)), F.count("*")).alias("succeeded"))
    return m


QUERIES = {
    "comparison_long": comparison_long, "win_tie_loss": win_tie_loss, "wilcoxon_approx": wilcoxon_approx, "wilcoxon_one_group": wilcoxon_one_group, "quantiles_of_large_groups": quantiles_of_large_groups, "wilcoxon_exact": wilcoxon_exact, "point_biserial": point_biserial, "point_biserial_p": point_biserial_p,
    "spearman": spearman, "trend_line": trend_line, "box_stats": box_stats, "metric_summary": metric_summary, "metric_summary_grouping_sets": metric_summary_grouping_sets, "run_coverage": run_coverage,
    "paired_summary": paired_summary, "report_paired": report_paired, "status_summary": status_summary, "category_share": category_share, "category_pivot": category_pivot, "failure_adjusted_rank": failure_adjusted_rank,
    "robustness_cv": robustness_cv, "stage_failure_share": stage_failure_share, "dataset_profile": dataset_profile, "count_labels": count_labels,
}
_KINDS = ["click", "error", "purchase", "signup", "view"]
SQL = {
    "comparison_long": _COMPARISON_SQL + " select llm, scenario, branch, metric, round(base, 6) as base, round(challenger, 6) as challenger, round(d, 6) as delta, outcome from oc",
    "win_tie_loss": _COMPARISON_SQL + " select branch, metric, count(*) as n, count(*) filter (outcome = 'win') as wins, count(*) filter (outcome = 'tie') as ties, count(*) filter (outcome = 'loss') as losses, round(100.0 * count(*) filter (outcome = 'win') / count(*), 2) as win_rate from oc group by 1, 2",
    "wilcoxon_approx": _WILCOXON_SQL,
    "wilcoxon_one_group": f"""with d as (select l_quantity::double as base, l_linenumber * 8.0 as challenger, l_linenumber * 8.0 - l_quantity as d from lineitem),
r as (select d, rank() over (order by abs(d)) + (count(*) over (partition by abs(d)) - 1) / 2.0 as rk, count(*) over (partition by abs(d)) as t from d where d <> 0),
s as (select count(*)::bigint as n, least(sum(rk) filter (d > 0), sum(rk) filter (d < 0)) as w, sum(t * t - 1) as tied from r), z as (select *, (w - n * (n + 1) / 4.0) / sqrt(n * (n + 1.0) * (2 * n + 1) / 24.0 - tied / 48.0) as z from s)
select 'all' as k, (select count(*) from d) as n_pairs, n as n_nonzero, w, round(z, 6) as z, round({erfc_sql("(abs(z) / sqrt(2.0))")}, 6) as p, (select round(median(base), 6) from d) as median_base, (select round(median(challenger), 6) from d) as median_other from z""",
    "quantiles_of_large_groups": "select l_returnflag, count(*) as n, round(quantile_cont(l_extendedprice, 0.01), 6) as p01, round(quantile_cont(l_extendedprice, 0.25), 6) as q1, round(quantile_cont(l_extendedprice, 0.5), 6) as median, round(quantile_cont(l_extendedprice, 0.75), 6) as q3, round(quantile_cont(l_extendedprice, 0.99), 6) as p99 from lineitem group by 1",
    "report_paired": "with w as (" + _WILCOXON_SQL + ") select branch, scenario, metric, round(median_other - median_base, 6) as median_delta, n_pairs, case when p < 0.001 then '< 0.001' else printf('%.4f', p) end as p_text from w",
    "point_biserial": """select lang, count(*) as n, round(corr(quality, n_chars::double), 6) as r, round(avg(n_chars) filter (quality = 1), 6) as mean_true, round(avg(n_chars) filter (quality = 0), 6) as mean_false,
  round(avg(n_chars) filter (quality = 1) - avg(n_chars) filter (quality = 0), 6) as difference from documents join labels using (doc_id) where quality is not null group by 1""",
    "spearman": """with r as (select l_returnflag, rank() over (partition by l_returnflag order by l_extendedprice) + (count(*) over (partition by l_returnflag, l_extendedprice) - 1) / 2.0 as rx,
  rank() over (partition by l_returnflag order by l_quantity) + (count(*) over (partition by l_returnflag, l_quantity) - 1) / 2.0 as ry from lineitem) select l_returnflag, count(*) as n, round(corr(rx::double, ry::double), 6) as rho from r group by 1""",
    "trend_line": "select l_returnflag, l_linestatus, round(regr_slope(l_extendedprice, l_quantity::double), 9) as slope, round(regr_intercept(l_extendedprice, l_quantity::double), 6) as intercept from lineitem group by 1, 2",
    "box_stats": """with q as (select l_returnflag, quantile_cont(l_extendedprice, 0.25) as q1, quantile_cont(l_extendedprice, 0.5) as median, quantile_cont(l_extendedprice, 0.75) as q3 from lineitem group by 1),
j as (select *, l_extendedprice between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) as inside from lineitem join q using (l_returnflag))
select l_returnflag, round(q1, 6) as q1, round(median, 6) as median, round(q3, 6) as q3, round(min(l_extendedprice) filter (inside), 6) as low, round(max(l_extendedprice) filter (inside), 6) as high, count(*) filter (not inside) as n_outside from j group by 1, q1, median, q3""",
    "metric_summary": "with " + RUN_METRICS_SQL + f" select llm, branch, {stats_sql('mae', 'mae')}, {stats_sql('r2', 'r2')} from rm group by 1, 2",
    "metric_summary_grouping_sets": """with c as (select l_returnflag, l_linestatus, trunc(l_extendedprice * 100)::bigint::double as cents from lineitem)
select l_returnflag, l_linestatus, concat_ws('+', case when grouping(l_returnflag) = 0 then 'l_returnflag' end, case when grouping(l_linestatus) = 0 then 'l_linestatus' end) as level, count(cents) as n, round(avg(cents), 6) as mean, round(min(cents), 6) as low, round(max(cents), 6) as high
from c group by grouping sets ((l_returnflag), (l_linestatus), (l_returnflag, l_linestatus))""",
    "run_coverage": _coverage_sql(),
    "paired_summary": _PAIRS_SQL + f", ag as (select scenario, branch, metric, {stats_sql('base', 'base')}, {stats_sql('challenger', 'challenger')}, {stats_sql('d', 'difference')} from lo where base is not null and challenger is not null group by 1, 2, 3) select *, coalesce(case when metric = 'r2' then difference_mean > 0 else difference_mean < 0 end, false) as better from ag",
    "status_summary": "select strftime(ts, '%Y-%m-%d') as day, count(*) as n, " + ", ".join(f"count(*) filter (event_type = '{k}') as {k}_count" for k in _KINDS) + ", " + ", ".join(f"round(100.0 * count(*) filter (event_type = '{k}') / count(*), 2) as {k}_pct" for k in _KINDS) + " from events group by 1",
    "category_share": "with g as (select o_orderpriority, o_orderstatus, count(*) as n from orders group by 1, 2) select *, (sum(n) over (partition by o_orderpriority))::bigint as total, round(100.0 * n / sum(n) over (partition by o_orderpriority), 2) as share from g",
    "category_pivot": "select l_returnflag, count(*) filter (l_linestatus = 'F') as F, count(*) filter (l_linestatus = 'O') as O from lineitem group by 1",
    "failure_adjusted_rank": _quality_sql(),
    "robustness_cv": "with " + RUN_METRICS_SQL + ", c as (select llm, scenario, branch, stddev_samp(mase) / nullif(avg(mase), 0) as cv from rm group by 1, 2, 3) select branch, count(*) as groups, round(quantile_cont(cv, 0.5), 6) as median_cv, round(avg(cv), 6) as mean_cv from c where cv is not null group by 1",
    "stage_failure_share": """with k as (select cast(json_extract_string(props, '$.k') as int) as k from events where event_type = 'error'),
u as (select u.* from k, lateral (values ('format', k % 2 = 0), ('scenario', k % 3 = 0), ('code', k % 5 > 0), ('model', case when k > 10 then k > 50 end)) u(stage, flag))
select stage, count(*) filter (not coalesce(flag, false)) as failed, count(*) as n, round(100.0 * count(*) filter (not coalesce(flag, false)) / count(*), 2) as share from u group by 1""",
    "dataset_profile": " union all ".join(f"select '{t}' as table_name, {n - 1}::bigint as variables, count(*) as n_rows, 0::bigint as missing, 0.0::double as missing_pct from {t}" for t, n in _PROFILE.items()),
    "count_labels": "with " + RUN_METRICS_SQL + " select llm, branch, count(*) filter (smape <= 60) || ' / ' || count(*) as succeeded from rm group by 1, 2",
}
