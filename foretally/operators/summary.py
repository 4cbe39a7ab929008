"""Grouped reports: metric summaries, coverage, pairing, shares, rankings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foretally.functions.numeric import minmax_quality, nan_to_null, pct, r6
from foretally.operators.order import numbered


def metric_stats(value: Column, prefix: str) -> list[Column]:
    """count, mean, std (0 for one value), median, quartiles, IQR and a normal 95 % interval; without values only the count."""
    v = nan_to_null(value)
    n, mean = F.count(v), F.avg(v)
    std = F.when(n > 0, F.coalesce(F.stddev_samp(v), F.lit(0.0)))
    q = {p: F.percentile(v, F.lit(p)) for p in (0.25, 0.5, 0.75)}
    half = 1.96 * std / F.sqrt(n.cast("double"))
    parts = {"mean": mean, "std": std, "median": q[0.5], "q1": q[0.25], "q3": q[0.75], "iqr": q[0.75] - q[0.25], "ci_low": mean - half, "ci_high": mean + half}
    return [n.alias(f"{prefix}_count"), *[r6(c).alias(f"{prefix}_{k}") for k, c in parts.items()]]


def metric_summary(rows: DataFrame, metrics: list[str], *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(*[c for m in metrics for c in metric_stats(F.col(m), m)])


def grouping_sets_summary(rows: DataFrame, sets: list[tuple[str, ...]], metric: str) -> DataFrame:
    """The same summary for several key lists in one pass; `level` names the keys of a row."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    level = F.concat_ws("+", *[F.when(F.grouping(k) == 0, F.lit(k)) for k in keys])
    v = nan_to_null(F.col(metric))
    return rows.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in keys]).agg(level.alias("level"), F.count(v).alias("n"), r6(F.avg(v)).alias("mean"), r6(F.min(v)).alias("low"), r6(F.max(v)).alias("high"))


def id_list(condition: Column, ident: Column) -> Column:
    return F.array_join(F.array_sort(F.collect_set(F.when(condition, ident))), ",")


def run_coverage(runs: DataFrame, branches: tuple[str, ...], *keys: str) -> DataFrame:
    """keys, for each branch the number and list of its successful runs, and those that all branches share."""
    sets = {b: F.collect_set(F.when((F.col("branch") == b) & F.col("ok"), F.col("run"))) for b in branches}
    g = runs.groupBy(*keys).agg(F.count("*").alias("n_runs"), *[c.alias(f"s_{b}") for b, c in sets.items()])
    base, *others = branches
    shared = reduce(F.array_intersect, [F.col(f"s_{b}") for b in branches])
    text = lambda a: F.array_join(F.array_sort(F.transform(a, lambda x: x.cast("string"))), ",")
    return g.select(
        *keys, "n_runs", *[F.size(f"s_{b}").cast("long").alias(f"n_{b}") for b in branches], *[text(F.col(f"s_{b}")).alias(f"ids_{b}") for b in branches],
        *[F.size(F.array_intersect(f"s_{base}", f"s_{b}")).cast("long").alias(f"pairs_{b}") for b in others], F.size(shared).cast("long").alias("n_complete"), text(shared).alias("ids_complete"),
    )


def paired(runs: DataFrame, base: str, keys: list[str], values: list[str]) -> DataFrame:
    """Each challenger's run beside the base run of the same keys."""
    b = runs.where(F.col("branch") == base).select(*keys, *[F.col(v).alias(f"base_{v}") for v in values])
    return runs.where(F.col("branch") != base).join(b, keys)


def long_metrics(pairs: DataFrame, metrics: list[str], *keys: str) -> DataFrame:
    """keys, metric, base, challenger, difference."""
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"base_{m}").alias("base"), F.col(m).alias("challenger")) for m in metrics])
    return pairs.select(*keys, F.inline(rows)).withColumn("difference", F.col("challenger") - F.col("base"))


def paired_summary(pairs: DataFrame, metrics: list[str], *keys: str) -> DataFrame:
    """Statistics of base, challenger and difference by keys and metric, and whether the challenger is better on average."""
    rows = long_metrics(pairs, metrics, *keys, "branch").where("base is not null and challenger is not null")
    g = rows.groupBy(*keys, "branch", "metric").agg(*metric_stats(F.col("base"), "base"), *metric_stats(F.col("challenger"), "challenger"), *metric_stats(F.col("difference"), "difference"))
    d = F.col("difference_mean")
    return g.withColumn("better", F.coalesce(F.when(F.col("metric") == "r2", d > 0).otherwise(d < 0), F.lit(False)))


def outcome(delta: Column, metric: Column) -> Column:
    """win, tie or loss of a difference to a baseline; only as good as zero is a tie."""
    better = F.when(metric == "r2", delta > 0).otherwise(delta < 0)
    return F.when(F.abs(delta) <= 1e-12, "tie").when(better, "win").otherwise("loss")


def win_tie_loss(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, n, wins, ties, losses, win_rate of rows with `outcome`."""
    count = lambda o: F.count(F.when(F.col("outcome") == o, 1))
    n = F.count("outcome")
    return rows.groupBy(*keys).agg(n.alias("n"), count("win").alias("wins"), count("tie").alias("ties"), count("loss").alias("losses"), pct(count("win"), n).alias("win_rate"))


def status_summary(runs: DataFrame, statuses: dict[str, Column], *keys: str) -> DataFrame:
    """keys, n, for each status its count and percentage."""
    n = F.count("*")
    k = {s: F.count(F.when(c, 1)) for s, c in statuses.items()}
    return runs.groupBy(*keys).agg(n.alias("n"), *[c.alias(f"{s}_count") for s, c in k.items()], *[pct(c, n).alias(f"{s}_pct") for s, c in k.items()])


def category_share(rows: DataFrame, category: str, *keys: str) -> DataFrame:
    """keys, category, n, total of the group, share in percent."""
    total = F.sum("n").over(Window.partitionBy(*keys))
    return rows.groupBy(*keys, category).agg(F.count("*").alias("n")).withColumn("total", total).withColumn("share", pct(F.col("n"), F.col("total")))


def category_pivot(rows: DataFrame, category: str, values: tuple[str, ...], *keys: str) -> DataFrame:
    """keys and a count column for each value, 0 where absent."""
    return rows.groupBy(*keys).agg(*[F.count(F.when(F.col(category) == v, 1)).alias(v) for v in values])


def quality(groups: DataFrame, metrics: dict[str, bool], success: str) -> DataFrame:
    """groups with quality_<metric> (0 to 1 over all groups; True: lower is better), conditional and failure-adjusted scores and rank.

    The extremes are one row, which goes to all; the ranks are dealt by ranges.
    """
    ends = groups.agg(*[f(m).alias(f"_{k}_{m}") for m in metrics for k, f in (("low", F.min), ("high", F.max))])
    out = groups.crossJoin(F.broadcast(ends)).withColumns({f"quality_{m}": r6(minmax_quality(F.col(m), F.col(f"_low_{m}"), F.col(f"_high_{m}"), lower)) for m, lower in metrics.items()}).drop(*ends.columns)
    mean = sum((F.col(f"quality_{m}") for m in metrics), F.lit(0.0)) / len(metrics)
    out = out.withColumn("conditional", r6(mean)).withColumn("adjusted", r6(mean * F.col(success)))
    return numbered(out, "rank", F.col("adjusted").isNull(), -F.col("adjusted"), ties=True)


def robustness(rows: DataFrame, value: str, keys: list[str], over: list[str]) -> DataFrame:
    """over, groups, median_cv, mean_cv: the coefficient of variation between the rows of each (keys, over)."""
    cv = rows.groupBy(*keys, *over).agg((F.stddev_samp(value) / F.nullif(F.avg(value), F.lit(0.0))).alias("cv")).where("cv is not null")
    return cv.groupBy(*over).agg(F.count("*").alias("groups"), r6(F.percentile("cv", F.lit(0.5))).alias("median_cv"), r6(F.avg("cv")).alias("mean_cv"))


def stage_failure_share(rows: DataFrame, stages: dict[str, Column]) -> DataFrame:
    """stage, failed, n, share: among failed runs, how many miss each stage's flag."""
    pairs = F.array(*[F.struct(F.lit(s).alias("stage"), c.alias("flag")) for s, c in stages.items()])
    return rows.select(F.inline(pairs)).groupBy("stage").agg(F.count(F.when(~F.coalesce(F.col("flag"), F.lit(False)), 1)).alias("failed"), F.count("*").alias("n")).withColumn("share", pct(F.col("failed"), F.col("n")))


def profile(df: DataFrame, name: str) -> DataFrame:
    """table, columns less one (the key), rows, missing cells and their percentage; NaN is missing."""
    missing = [F.count(F.when(F.col(c).isNull() | (F.isnan(c) if t in ("double", "float") else F.lit(False)), 1)) for c, t in df.dtypes]
    n = F.count("*")
    lost = reduce(lambda a, b: a + b, missing)
    return df.agg(n.alias("n_rows"), lost.alias("missing")).select(F.lit(name).alias("table_name"), F.lit(len(df.columns) - 1).cast("long").alias("variables"), "n_rows", "missing", pct(F.col("missing"), F.col("n_rows") * len(df.columns)).alias("missing_pct"))


def columns_by_total(table: DataFrame, key: str) -> DataFrame:
    """A table with its other columns ordered by their sums, largest first; equal ones by name.  The sums are one row."""
    others = [c for c in table.columns if c != key]
    total = table.agg(*[F.coalesce(F.sum(F.col(c).cast("double")), F.lit(0.0)).alias(c) for c in others]).first()
    return table.select(key, *sorted(others, key=lambda c: (-total[c], c)))
