"""Order over whole tables without a task that sees all of one.

Rows go into ranges of the order, a range a task; what a range needs of the others is how many rows those below
hold (or their least value), a number a range.  The bounds come from a sample and are fixed before anything is ranked: they
decide only how evenly the rows are dealt, never a rank.  Equal keys share a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of the sample, about.
SAMPLE = 10_000


def dealt(df: DataFrame, *order: Column, parts: int | None = None) -> DataFrame:
    """df with _key, a struct of the order (ascending, nulls first), and _range, the number of its range; a range lies in one partition."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.withColumn("_key", F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)]))
    rows = keyed.select("_key")
    total = rows.count()
    some = rows if total <= SAMPLE else rows.sample(SAMPLE / total, seed=1)
    sample = some.agg(F.array_sort(F.collect_list("_key")).alias("s"))
    at = F.transform(F.sequence(F.lit(1), F.lit(n - 1)), lambda i: F.get("s", F.floor(i * F.size("s") / n).cast("int"))) if n > 1 else F.slice("s", 1, 0)
    bounds = [b for b in sample.select(at.alias("b")).first()["b"] if b is not None]
    held = df.sparkSession.createDataFrame([(bounds,)], T.StructType([T.StructField("_bounds", T.ArrayType(keyed.schema["_key"].dataType))]))
    below = F.size(F.filter("_bounds", lambda b: b < F.col("_key")))
    return keyed.crossJoin(F.broadcast(held)).withColumn("_range", below).drop("_bounds").repartition(n, "_range")


def _beside(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """rows with `name`, an array of (_range, v): the value of each range, a number each."""
    each = rows.groupBy("_range").agg(value.alias("v")).agg(F.collect_list(F.struct("_range", "v")).alias(name))
    return rows.crossJoin(F.broadcast(each))


def _sum_below(name: str) -> Column:
    return F.aggregate(F.filter(name, lambda r: r["_range"] < F.col("_range")), F.lit(0).cast("long"), lambda a, r: a + r["v"])


def numbered(df: DataFrame, name: str, *order: Column, start: int = 1, ties: bool = False, parts: int | None = None) -> DataFrame:
    """df with its place in the order, from `start` on; with ties, equal keys share the first of their places."""
    rows = _beside(dealt(df, *order, parts=parts), F.count(F.lit(1)), "_sizes")
    w = Window.partitionBy("_range").orderBy("_key")
    place = (F.rank() if ties else F.row_number()).over(w)
    return rows.withColumn(name, place + _sum_below("_sizes") + (start - 1)).drop("_key", "_range", "_sizes")


def discovery_rates(df: DataFrame, p: str, name: str, *order: str, parts: int | None = None) -> DataFrame:
    """df with the least of p times the number of tests over its rank, from each test on; null p has none and doesn't count."""
    known = F.col(p).isNotNull()
    rows = dealt(df, (~known).alias("no"), F.col(p), *map(F.col, order), parts=parts)
    rows = _beside(rows, F.count(p), "_sizes")
    w = Window.partitionBy("_range").orderBy("_key")
    total = F.aggregate("_sizes", F.lit(0).cast("long"), lambda a, r: a + r["v"])
    # nulls come last, so that they move no rank
    rows = rows.withColumn("_value", F.when(known, F.col(p) * total / (F.row_number().over(w) + _sum_below("_sizes")))).drop("_sizes")
    rows = _beside(rows, F.min("_value"), "_least")
    own = F.min("_value").over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    later = F.array_min(F.transform(F.filter("_least", lambda r: r["_range"] > F.col("_range")), lambda r: r["v"]))
    return rows.withColumn(name, F.when(known, F.least(own, later))).drop("_key", "_range", "_value", "_least")


def cumulated(df: DataFrame, keys: tuple[str, ...], value: str, weight: str, name: str, parts: int | None = None) -> DataFrame:
    """df (a row a key and value) with the weight of all lesser values of its key; a key's values may fill many ranges."""
    rows = dealt(df, *map(F.col, keys), F.col(value), parts=parts)
    sizes = rows.groupBy(*keys, "_range").agg(F.sum(weight).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sizes.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ahead"))
    on = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inside = F.sum(weight).over(Window.partitionBy(*keys, "_range").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("_inside", F.coalesce(inside, F.lit(0))).join(ahead, on).withColumn(name, F.col("_inside") + F.col("_ahead")).drop("_key", "_range", "_r", "_ahead", "_inside", *[f"_k{i}" for i in range(len(keys))])


def _bounds(df: DataFrame, keys: tuple[str, ...], x: Column, ranges: int) -> DataFrame | None:
    """_k0, ..., _b: up to ranges - 1 bounds of x for each key that has a hundredth of a sample's rows, at most about 100 keys; None if there are none.

    They are fixed here, so that each later pass sees the same ranges."""
    total = df.count()
    some = df if total <= SAMPLE else df.sample(SAMPLE / total, seed=1)
    sample = some.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.array_sort(F.collect_list(x)).alias("s")).where(F.size("s") >= min(total, SAMPLE) / 100)
    at = F.transform(F.sequence(F.lit(1), F.lit(ranges - 1)), lambda i: F.get("s", F.floor(i * F.size("s") / ranges).cast("int"))) if ranges > 1 else F.slice("s", 1, 0)
    fixed = sample.select(*[f"_k{i}" for i in range(len(keys))], at.alias("_b"))
    held = fixed.collect() if total else []
    return df.sparkSession.createDataFrame(held, fixed.schema) if held else None


def _placed(rows: DataFrame, x: Column, ranges: int) -> DataFrame:
    """rows with _range: how many of _b, an ascending array of ranges - 1 bounds, are less than x, by halving; 0 without an array."""
    rows, step = rows.withColumns({"_x": x, "_range": F.lit(0)}), ranges // 2
    while step:
        rows, step = rows.withColumn("_range", F.col("_range") + F.when(F.get("_b", F.col("_range") + (step - 1)) < F.col("_x"), step).otherwise(0)), step // 2
    return rows.drop("_x")


def _on(keys: tuple[str, ...]) -> Column:
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return on


#: Ranges of a key's values, a power of two.
RANGES = 64


def quantiles(df: DataFrame, keys: tuple[str, ...], value: str, at: tuple[float, ...], parts: int | None = None) -> DataFrame:
    """keys, n, quantiles (an array in the order of `at`) of the values that aren't null, between neighbours by their distance: what percentile() gives, without a task that holds a key's values.

    The rows of each range of a key's values are counted in a first pass; the ranges that hold the wanted places are
    counted value by value in a second, and only these are shuffled.  A key with less than about a hundredth of all rows is one range."""
    rows = df.where(F.col(value).isNotNull()).select(*keys, value)
    ranges, x = 1 << ((parts or RANGES) - 1).bit_length(), F.col(value).cast("double")
    wanted = lambda n: F.array(*[F.struct(F.lit(i).alias("i"), ((n - 1) * q).alias("pos")) for i, q in enumerate(at)])
    holds = lambda p, before, count: (before <= p) & (p < before + count)
    bounds, names = _bounds(rows, keys, x, ranges), [f"_k{i}" for i in range(len(keys))]
    if bounds is None:
        kept = rows.select(*keys, value, F.lit(0).alias("_range"), F.lit(None).cast("long").alias("_ahead"), F.lit(None).cast("long").alias("_n"))
    else:
        large = F.broadcast(bounds.withColumn("_large", F.lit(True)))
        ranged = _placed(rows.join(large, _on(keys), "left"), x, ranges).select(*keys, value, "_large", "_range")
        sizes = ranged.where("_large").groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_s"))
        w = Window.partitionBy(*keys, F.lit(0))
        ahead = F.coalesce(F.sum("_s").over(w.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        placed = sizes.withColumns({"_ahead": ahead, "_n": F.sum("_s").over(w)})
        hit = F.exists(wanted(F.col("_n")), lambda p: holds(F.floor(p["pos"]), F.col("_ahead"), F.col("_s")) | holds(F.ceil(p["pos"]), F.col("_ahead"), F.col("_s")))
        near = placed.where(hit).select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col("_range").alias("_r"), "_ahead", "_n")
        kept = ranged.join(F.broadcast(near), _on(keys) & (F.col("_range") == F.col("_r")), "left").where("_large is null or _ahead is not null")
    counts = kept.groupBy(*keys, "_range", value).agg(F.count(F.lit(1)).alias("_c"), F.first("_ahead").alias("_ahead"), F.first("_n").alias("_n"))
    inside = Window.partitionBy(*keys, "_range")
    before = F.coalesce("_ahead", F.lit(0)) + F.coalesce(F.sum("_c").over(inside.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    both = counts.withColumns({"_before": before, "n": F.coalesce("_n", F.sum("_c").over(inside))})
    own = lambda p: holds(p, F.col("_before"), F.col("_c"))
    hits = both.select(*keys, "n", value, "_before", "_c", F.inline(wanted(F.col("n")))).where(own(F.floor("pos")) | own(F.ceil("pos")))
    pick = lambda p: F.max(F.when(own(p), F.col(value)))
    found = hits.groupBy(*keys, "n", "i", "pos").agg(pick(F.floor("pos")).alias("low"), pick(F.ceil("pos")).alias("high"))
    part = F.col("pos") - F.floor("pos")
    one = found.select(*keys, "n", F.struct("i", (F.col("low") * (1 - part) + F.col("high") * part).alias("v")).alias("q"))
    return one.groupBy(*keys, "n").agg(F.transform(F.array_sort(F.collect_list("q")), lambda q: q["v"]).alias("quantiles"))


#: Size of a sketch: ranks are within about 1.7 % divided by (SKETCH / 200) of the rows, with 99 % confidence.
SKETCH = 800


def sketches(df: DataFrame, keys: tuple[str, ...], value: str, size: int = SKETCH) -> DataFrame:
    """keys, sketch (KLL) of the values; state a key is bounded whatever its rows."""
    return df.groupBy(*keys).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), size).alias("sketch"))


def merged_sketches(stored: DataFrame, keys: tuple[str, ...], size: int = SKETCH) -> DataFrame:
    """keys, sketch of stored sketches (keys, sketch): of parts, days or finer keys."""
    return stored.groupBy(*keys).agg(F.kll_merge_agg_double("sketch", size).alias("sketch"))


def sketched_quantiles(stored: DataFrame, keys: tuple[str, ...], at: tuple[float, ...]) -> DataFrame:
    """keys, n, quantiles (near `at` in rank) of sketches."""
    values = F.array(*[F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))) for q in at])
    return stored.select(*keys, F.kll_sketch_get_n_double("sketch").alias("n"), values.alias("quantiles"))
