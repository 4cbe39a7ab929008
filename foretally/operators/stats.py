"""Statistical comparison of forecasts and scores."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from foretally.functions.numeric import finite, r6, rounded, two_sided_p
from foretally.operators.order import cumulated, discovery_rates, quantiles


#: What of a value's size is rounding.
NOISE = 1e-12


def difference(a: Column, b: Column) -> Column:
    """a - b, or null where that is only rounding."""
    return F.when(F.abs(a - b) > NOISE * F.greatest(F.abs(a), F.abs(b)), a - b)


def significant(x: Column) -> Column:
    """x to ten significant digits, so that values that differ by rounding are ties, however small they are."""
    return F.format_string("%.9e", x).cast("double")


def correlation(x: Column, y: Column) -> Column:
    """Pearson's, null where either doesn't vary."""
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def loss_differences(pairs: DataFrame, *keys: str) -> DataFrame:
    """pairs (keys, t, actual, forecast, ref_actual, ref_forecast) as keys, d (squared loss minus the reference's, in order of t).

    Groups whose actual values differ from the reference's are left out, and so are pairs that aren't finite.
    """
    same = (F.abs(F.col("actual") - F.col("ref_actual")) <= 1e-8 + 1e-5 * F.abs(F.col("ref_actual"))) | (F.col("actual").isNull() & F.col("ref_actual").isNull())
    e, r = F.col("actual") - F.col("forecast"), F.col("actual") - F.col("ref_forecast")
    d = e * e - r * r
    rows = F.collect_list(F.when(finite(d), F.struct("t", d.alias("d"))))
    return pairs.groupBy(*keys).agg(F.bool_and(F.coalesce(same, F.lit(False))).alias("aligned"), F.array_sort(rows).alias("s")).where("aligned").select(*keys, F.col("s.d").alias("d"))


def beside_models(runs: DataFrame, models: DataFrame, model: str, *on: str) -> DataFrame:
    """runs (on, actual, forecast, ...) beside each model's forecast of the same point, many to many: with `model`, ref_actual and ref_forecast."""
    return runs.join(models.select(*on, model, F.col("actual").alias("ref_actual"), F.col("forecast").alias("ref_forecast")), list(on))


def newey_west(d: Column, lag: Column) -> Column:
    """Long-run variance of an ordered array with Bartlett weights; covariances divide by n."""
    n = F.size(d)
    mean = F.aggregate(d, F.lit(0.0), lambda a, x: a + x) / n
    centred = F.transform(d, lambda x: x - mean)

    def at(k: Column) -> Column:
        later, earlier = F.slice(centred, k + 1, n - k), F.slice(centred, F.lit(1), n - k)
        return F.aggregate(F.zip_with(later, earlier, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x) / n

    weight = lambda k: F.when(k == 0, 1.0).otherwise(2.0 * (1.0 - k / (lag + 1.0)))
    return F.aggregate(F.sequence(F.lit(0), lag), F.lit(0.0), lambda a, k: a + weight(k) * at(k))


def diebold_mariano(differences: DataFrame, *keys: str, horizon: int | Column = 1) -> DataFrame:
    """keys, dm_n, dm_lag, dm_mean, dm_statistic, dm_p: two-sided normal test of equal squared loss.

    Fewer than two differences give no statistic; neither does a variance that isn't positive, beside the size of the differences.
    """
    h = F.lit(horizon) if isinstance(horizon, int) else horizon
    n = F.size("d")
    rows = differences.select(*keys, "d", n.alias("dm_n"), F.least(F.greatest(h - 1, F.lit(0)), F.greatest(n - 1, F.lit(0))).alias("dm_lag"))
    rows = rows.select(*keys, "dm_n", "dm_lag", F.when(F.col("dm_n") >= 2, F.aggregate("d", F.lit(0.0), lambda a, x: a + x) / F.col("dm_n")).alias("mean"), F.when(F.col("dm_n") >= 2, newey_west(F.col("d"), F.col("dm_lag"))).alias("lrv"), F.aggregate("d", F.lit(0.0), lambda a, x: a + x * x).alias("squares"))
    stat = F.when(F.col("lrv") > NOISE * F.col("squares") / F.col("dm_n"), F.col("mean") / F.sqrt(F.col("lrv") / F.col("dm_n")))
    return rows.select(*keys, "dm_n", "dm_lag", F.col("mean").alias("dm_mean"), stat.alias("dm_statistic")).withColumn("dm_p", two_sided_p(F.col("dm_statistic")))


def benjamini_hochberg(tests: DataFrame, p: str, *order: str) -> DataFrame:
    """tests with q, the false discovery rate of p over all tests; null p stays null and doesn't count."""
    return discovery_rates(tests, p, "q", *order)


def average_rank(value: Column, *partition: str) -> Column:
    """Rank within the partition, ties sharing the mean of their ranks."""
    w = Window.partitionBy(*partition)
    return F.rank().over(w.orderBy(value)) + (F.count("*").over(w.partitionBy(*partition, value)) - 1) / 2.0


def wilcoxon(pairs: DataFrame, *keys: str, base: str = "base", other: str = "challenger", spread: bool = False) -> DataFrame:
    """keys, n_pairs, n_nonzero, w, z, p and the medians: signed-rank test, zeros dropped, ties corrected, by the normal approximation.

    If all differences are as good as zero, w is 0 and p is 1.  spread: for few groups of very many rows; equal differences are
    counted first, and ranks and medians come from ranges of values, so that no task holds a group.
    """
    d = difference(F.col(other), F.col(base))
    rows = pairs.where(F.col(base).isNotNull() & F.col(other).isNotNull()).withColumn("d", d)
    nonzero = rows.where("d is not null").withColumn("a", significant(F.abs("d")))
    plus, n = F.count(F.when(F.col("d") > 0, 1)), F.count(F.lit(1))
    if spread:
        middle = lambda c, name: quantiles(rows, keys, c, (0.5,)).select(*keys, F.col("n").alias("n_pairs"), F.col("quantiles")[0].alias(name))
        medians = _joined(middle(base, "median_base"), middle(other, "median_other").drop("n_pairs"), keys)
        values = cumulated(nonzero.groupBy(*keys, "a").agg(n.alias("ties"), plus.alias("n_plus")), keys, "a", "ties", "before")
    else:
        medians = rows.groupBy(*keys).agg(n.alias("n_pairs"), F.percentile(base, F.lit(0.5)).alias("median_base"), F.percentile(other, F.lit(0.5)).alias("median_other"))
        counts = nonzero.groupBy(*keys, "a").agg(n.alias("ties"), plus.alias("n_plus"))
        values = counts.withColumn("before", F.coalesce(F.sum("ties").over(Window.partitionBy(*keys).orderBy("a").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # equal differences share the mean of their ranks; each of t tied values adds t**2 - 1, together t**3 - t, which a long holds up to two million only
    whole = lambda c: c.cast("decimal(19,0)")
    twice, ties = whole(2 * F.col("before") + F.col("ties") + 1), F.col("ties")
    half = lambda c: F.sum(twice * whole(c)).cast("double") / 2.0
    sums = values.groupBy(*keys).agg(F.sum("ties").alias("n_nonzero"), half(F.col("n_plus")).alias("plus"), half(ties - F.col("n_plus")).alias("minus"), F.sum(whole(ties) * whole(ties) * whole(ties) - whole(ties)).cast("double").alias("tied"))
    n = F.col("n_nonzero")
    var = n * (n + 1.0) * (2 * n + 1) / 24.0 - F.col("tied") / 48.0
    z = (F.least("plus", "minus") - n * (n + 1) / 4.0) / F.sqrt(var)
    return _joined(medians, sums, keys).select(
        *keys, "n_pairs", F.coalesce(n, F.lit(0)).alias("n_nonzero"), F.coalesce(F.least("plus", "minus"), F.lit(0.0)).alias("w"), r6(z).alias("z"),
        F.coalesce(r6(two_sided_p(z)), F.lit(1.0)).alias("p"), r6(F.col("median_base")).alias("median_base"), r6(F.col("median_other")).alias("median_other"),
    )


def _joined(left: DataFrame, right: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return left.join(right, list(keys), "left") if keys else left.crossJoin(right)


def exact_signed_rank_p(w: float, ranks: np.ndarray) -> float:
    """Two-sided p of the smaller rank sum, by counting sign patterns; ranks may be tied (halves)."""
    doubled = np.round(2 * ranks).astype(int)
    ways = np.zeros(doubled.sum() + 1)
    ways[0] = 1.0
    for r in doubled:
        ways[r:] += ways[: len(ways) - r].copy()
    return float(min(1.0, 2 * ways[: int(round(2 * w)) + 1].sum() / 2.0 ** len(doubled)))


def wilcoxon_exact(pairs: DataFrame, *keys: str, base: str = "base", other: str = "challenger", most: int = 50) -> DataFrame:
    """keys, n, w, p, method: 'exact' by counting sign patterns for groups of at most `most` nonzero differences, 'approximate' as by wilcoxon() for larger ones."""
    rows = pairs.select(*keys, difference(F.col(other), F.col(base)).alias("d")).where("d is not null")
    # one more than `most` is enough to know that a group is too large
    w = Window.partitionBy(*keys).orderBy("d")
    kept = rows.withColumn("i", F.row_number().over(w)).where(F.col("i") <= most + 1).groupBy(*keys).agg(F.collect_list(significant(F.col("d"))).alias("ds")).where(F.size("ds") <= most)
    kinds = dict(rows.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for ds in f["ds"]:
                x = np.asarray(ds, float)
                ranks = pd.Series(np.abs(x)).rank().to_numpy()
                least = min(ranks[x > 0].sum(), ranks[x < 0].sum())
                out.append((len(x), float(least), exact_signed_rank_p(least, ranks)))
            yield f[list(keys)].assign(n=[o[0] for o in out], w=[o[1] for o in out], p=[o[2] for o in out])

    exact = kept.mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", n long, w double, p double").withColumn("method", F.lit("exact"))
    large = wilcoxon(pairs, *keys, base=base, other=other).where(F.col("n_nonzero") > most)
    return exact.unionByName(large.select(*keys, F.col("n_nonzero").alias("n"), "w", "p", F.lit("approximate").alias("method")))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, by the modified Lentz method."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def student_p(r: float, n: int) -> float | None:
    """Two-sided p of a correlation r of n pairs."""
    if r is None or n is None or n < 3 or math.isnan(r):
        return None
    if abs(r) >= 1:
        return 0.0
    df = n - 2
    x = df / (df + r * r * df / (1 - r * r))
    a, b = df / 2.0, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


@F.pandas_udf(DoubleType())
def correlation_p(r: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([student_p(a, int(b)) if pd.notna(a) and pd.notna(b) else None for a, b in zip(r, n, strict=True)], dtype="float64")


def point_biserial(rows: DataFrame, flag: Column, value: Column, *keys: str) -> DataFrame:
    """keys, n, r, mean_true, mean_false, difference of a score between two groups."""
    ok = rows.where(flag.isNotNull() & finite(value))
    yes, no = F.avg(F.when(flag, value)), F.avg(F.when(~flag, value))
    return ok.groupBy(*keys).agg(F.count("*").alias("n"), r6(correlation(flag.cast("int"), value)).alias("r"), r6(yes).alias("mean_true"), r6(no).alias("mean_false"), r6(yes - no).alias("difference"))


#: A value with more than 1 / HOT of all rows is a frequent one: there are fewer than HOT of these.
HOT = 2000


def spearman(rows: DataFrame, x: str, y: str, *keys: str) -> DataFrame:
    """keys, n, rho: the correlation of average ranks.

    Equal pairs are counted first; ranks come from running counts over ranges of values, so that no task holds a group.  Sums are
    of whole numbers, twice the ranks, and exact."""
    ok = rows.where(finite(F.col(x)) & finite(F.col(y))).select(*keys, F.col(x).alias("_x"), F.col(y).alias("_y"))
    whole = lambda c: c.cast("decimal(19,0)")
    count = F.count(F.lit(1)).alias("_t")

    def twice(value: str, name: str) -> DataFrame:
        placed = cumulated(ok.groupBy(*keys, value).agg(count), keys, value, "_t", "_before")
        return placed.select(*[F.col(k).alias(f"{name}{i}") for i, k in enumerate(keys)], F.col(value).alias(f"{name}v"), F.col("_t").alias(f"{name}t"), whole(2 * F.col("_before") + F.col("_t") + 1).alias(name))

    def beside(left: DataFrame, right: DataFrame, value: str, name: str, how: str = "inner") -> DataFrame:
        on = F.col(value) == F.col(f"{name}v")
        for i, k in enumerate(keys):
            on = on & F.col(k).eqNullSafe(F.col(f"{name}{i}"))
        return left.join(right, on, how)

    # a frequent y stands beside very many x: its rank is sent to these
    joint, ry, most = ok.groupBy(*keys, "_x", "_y").agg(count), twice("_y", "_b"), ok.count() / HOT
    some = beside(joint, F.broadcast(ry.where(F.col("_bt") > most)), "_y", "_b", "left").select(*keys, "_x", "_y", "_t", "_b")
    rest = beside(some.where("_b is null").drop("_b"), ry.where(F.col("_bt") <= most), "_y", "_b").select(*keys, "_x", "_y", "_t", "_b")
    b, t = F.col("_b"), whole(F.col("_t"))
    of_x = some.where("_b is not null").unionByName(rest).groupBy(*keys, "_x").agg(F.sum(t * b).alias("_tb"), F.sum(t * b * b).alias("_tbb"))
    both = beside(of_x, twice("_x", "_a"), "_x", "_a")
    a = F.col("_a")
    sums = both.groupBy(*keys).agg(F.sum("_at").alias("n"), F.sum(F.col("_tb") * a).alias("ab"), F.sum(whole(F.col("_at")) * a * a).alias("aa"), F.sum("_tbb").alias("bb"))
    # twice the ranks of n rows add to n (n + 1)
    n = whole(F.col("n"))
    about = lambda c: (F.col(c) - n * (n + 1) * (n + 1)).cast("double")
    rho = about("ab") / F.nullif(F.sqrt(about("aa")) * F.sqrt(about("bb")), F.lit(0.0))
    return sums.select(*keys, "n", r6(rho).alias("rho"))


def trend_line(rows: DataFrame, x: Column, y: Column, *keys: str) -> DataFrame:
    """keys, slope, intercept of the least-squares line."""
    return rows.groupBy(*keys).agg(rounded(F.regr_slope(y, x), 9).alias("slope"), r6(F.regr_intercept(y, x)).alias("intercept"))


def box_stats(rows: DataFrame, value: Column, *keys: str) -> DataFrame:
    """keys, q1, median, q3 and the whiskers: the extreme values within 1.5 interquartile ranges.

    Values are counted on the map side first; ranks come from running sums over the different values of a key, sorted and not held.
    """
    counts = rows.select(*keys, value.alias("v")).where("v is not null").groupBy(*keys, "v").agg(F.count("*").alias("n"))
    all_of = Window.partitionBy(*keys)
    upto = all_of.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.withColumns({"upto": F.sum("n").over(upto), "total": F.sum("n").over(all_of)})

    def quantile(share: float) -> Column:
        at = (F.col("total") - 1) * share
        of = lambda r: F.max(F.when((F.col("upto") > r) & (F.col("upto") - F.col("n") <= r), F.col("v"))).over(all_of)
        low, high = of(F.floor(at)), of(F.ceil(at))
        return low + (high - low) * (at - F.floor(at))

    q = ranked.withColumns({"q1": quantile(0.25), "median": quantile(0.5), "q3": quantile(0.75)})
    span = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col("v").between(F.col("q1") - span, F.col("q3") + span)
    out = q.groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in ("q1", "median", "q3")], F.min(F.when(inside, F.col("v"))).alias("low"), F.max(F.when(inside, F.col("v"))).alias("high"), F.coalesce(F.sum(F.when(~inside, F.col("n"))), F.lit(0)).alias("n_outside"),
    )
    return out.select(*keys, *[r6(F.col(c)).alias(c) for c in ("q1", "median", "q3", "low", "high")], "n_outside")
