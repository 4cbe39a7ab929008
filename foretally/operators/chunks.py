"""Series that are longer than a task should hold: chunks of time with a halo.

A chunk is an array of `size` successive values of a series, with the last values of the chunk before in front of it, so that whatever looks back a
bounded way is one array transform a chunk.  What reaches further (the end of the training part, a mean) is a short array or a
number a series, carried to its chunks by a join.  The results are those of the forms that hold a series in one array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretally.operators.forecast import MODELS, SCENARIOS, place

SIZE = 65_536


def chunked(points: DataFrame, *keys: str, halo: int, size: int = SIZE, value: str = "y") -> DataFrame:
    """keys, chunk, at (the t of the array's first value), own (the t of the chunk's first), ys: from points (keys, t, value), whose t counts from 0 without gaps."""
    if not 0 <= halo <= size:
        raise ValueError(f"a halo of {halo} doesn't fit chunks of {size}")
    chunk = F.floor(F.col("t") / size).cast("int")
    also = F.when(F.col("t") % size >= size - halo, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))
    rows = points.select(*keys, "t", F.col(value).alias("y"), F.explode(also).alias("chunk"))
    whole = rows.groupBy(*keys, "chunk").agg(F.array_sort(F.collect_list(F.struct("t", "y"))).alias("s")).withColumn("own", F.col("chunk") * size)
    return whole.where(F.element_at("s", -1)["t"] >= F.col("own")).select(*keys, "chunk", F.col("s")[0]["t"].alias("at"), "own", F.col("s.y").alias("ys"))


def _beside(rows: DataFrame, each: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    other = each.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in each.columns if c not in keys])
    return rows.join(other, on).drop(*[f"_k{i}" for i in range(len(keys))])


def naive(points: DataFrame, *keys: str, season: int = 12, block: int = 12, scenarios=SCENARIOS, models=MODELS, size: int = SIZE) -> DataFrame:
    """What forecast.naive() gives, from points (keys, t, y): the first 80 % train."""
    n = points.groupBy(*keys).agg((F.max("t") + 1).cast("int").alias("n")).withColumn("n_train", F.floor(F.col("n") * 4 / 5).cast("int")).where("n_train > 0 and n_train < n")
    known = _beside(points.select(*keys, "t", "y"), n, keys).where(F.col("t").between(F.col("n_train") - season, F.col("n_train") - 1))
    # the end of the training part, which a static forecast repeats however far it looks
    ends = known.groupBy(*keys, "n", "n_train").agg(F.array_sort(F.collect_list(F.struct("t", "y"))).alias("e"))
    ends = ends.select(*keys, "n", "n_train", F.col("e")[0]["t"].alias("end_at"), F.col("e.y").alias("end_ys"))
    runs = _beside(chunked(points, *keys, halo=season + block, size=size), ends, keys).where(F.col("own") + size > F.col("n_train"))
    runs = runs.withColumn("scenario", F.explode(F.array(*map(F.lit, scenarios)))).withColumn("model", F.explode(F.array(*map(F.lit, models))))
    last = F.least(F.col("own") + size, F.col("n")) - 1

    def step(t: Column) -> Column:
        source = place(F.col("scenario"), F.col("model"), t, F.col("n_train"), season, block)
        value = F.when(F.col("scenario") == "S1", F.get("end_ys", (source - F.col("end_at")).cast("int"))).otherwise(F.get("ys", (source - F.col("at")).cast("int")))
        return F.struct(t.alias("t"), F.get("ys", (t - F.col("at")).cast("int")).alias("actual"), value.alias("forecast"))

    return runs.select(*keys, "scenario", "model", F.inline(F.transform(F.sequence(F.greatest("n_train", "own").cast("int"), last.cast("int")), step)))


def newey_west(points: DataFrame, *keys: str, lag: int, size: int = SIZE, value: str = "d") -> DataFrame:
    """keys, n, mean, variance (the long-run variance with Bartlett weights up to `lag`, or n - 1) of points (keys, t, value)."""
    each = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    rows = _beside(chunked(points, *keys, halo=lag, size=size, value=value), each, keys).withColumn("c", F.transform("ys", lambda y: y - F.col("mean")))
    first = (F.col("own") - F.col("at")).cast("int")  # of the array's values, those that the chunk before owns

    def product(k: Column) -> Column:
        """The sum of each own value times that k before, where there is one."""
        at = F.greatest(first, k)
        later, earlier = F.slice("c", at + 1, F.size("c")), F.slice("c", at - k + 1, F.size("c"))
        both = F.zip_with(later, F.slice(earlier, F.lit(1), F.size(later)), lambda a, b: a * b)
        return F.struct(k.alias("_lag"), F.aggregate(both, F.lit(0.0), lambda s, v: s + v).alias("_sum"))

    sums = rows.select(*keys, "n", "mean", F.inline(F.transform(F.sequence(F.lit(0), F.lit(lag)), product))).groupBy(*keys, "n", "mean", "_lag").agg(F.sum("_sum").alias("_sum"))
    most = F.least(F.lit(lag), F.col("n") - 1)
    weight = F.when(F.col("_lag") == 0, 1.0).when(F.col("_lag") <= most, 2 * (1 - F.col("_lag") / (most + 1.0))).otherwise(0.0)
    return sums.groupBy(*keys, "n", "mean").agg(F.sum(weight * F.col("_sum") / F.col("n")).alias("variance"))
