"""Run ledger: plan, keys, skipping, upserts and votes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Statuses that end a run.
SUCCESS = ("OK_FORECAST_LIST", "OK_FORECAST_SCRIPT")
COMPLETED = (*SUCCESS, "CHAT_DONE", "OK", "INVALID_LIST_LENGTH")


def run_plan(*dimensions: DataFrame) -> DataFrame:
    """Every combination of the dimensions: lists of names, as small as a plan's arguments."""
    return reduce(lambda a, b: a.crossJoin(b), dimensions)


def run_key(*parts: Column, run: Column) -> Column:
    """Twelve hex digits that identify a run whoever plans it."""
    return F.substring(F.md5(F.concat_ws("|", *parts, F.lpad(run.cast("string"), 2, "0"))), 1, 12)


def pending(plan: DataFrame, log: DataFrame, key: str = "run_key") -> DataFrame:
    """Planned runs that the ledger doesn't have as completed."""
    return plan.join(log.where(F.col("run_status").isin(*COMPLETED)).select(key), key, "left_anti")


def unseen(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """old with those rows of new whose key it lacks."""
    return old.unionByName(new.join(old.select(key), key, "left_anti"), allowMissingColumns=True)


def upsert(old: DataFrame, new: DataFrame, *keys: str, order: str) -> DataFrame:
    """Rows of both; of those with equal keys the last stays, new after old, then by `order`."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc("_new"), F.desc(order))
    return both.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_new")


def top_vote(rows: DataFrame, value: str, order: str, *keys: str) -> DataFrame:
    """keys, value, votes, total: the commonest value, the first seen of equals."""
    g = rows.groupBy(*keys, value).agg(F.count("*").alias("votes"), F.min(order).alias("_first"))
    w = Window.partitionBy(*keys)
    rank = F.row_number().over(w.orderBy(F.desc("votes"), "_first"))
    return g.withColumn("total", F.sum("votes").over(w)).withColumn("_rn", rank).where("_rn = 1").drop("_rn", "_first")


def two_level_vote(rows: DataFrame, order: str, *keys: str, least: int = 3) -> DataFrame:
    """keys, model, model_votes, parameters, parameter_votes, level, total.

    The commonest model first; then its commonest exact parameters if they have `least` votes, else
    its commonest core parameters and the commonest exact ones among those.
    """
    # one count of all that is told apart, then windows within a key
    g = rows.groupBy(*keys, "model", "core", "parameters").agg(F.count("*").alias("n"), F.min(order).alias("at"))
    by = lambda *more: Window.partitionBy(*keys, *more)
    g = g.withColumns({"total": F.sum("n").over(by()), "model_votes": F.sum("n").over(by("model")), "model_at": F.min("at").over(by("model"))})
    g = g.withColumn("top", F.first("model").over(by().orderBy(F.desc("model_votes"), "model_at"))).where(F.col("model").eqNullSafe(F.col("top")))
    sums = {f"{c}_{k}": f("n" if k == "votes" else "at").over(by(c)) for c in ("parameters", "core") for k, f in (("votes", F.sum), ("at", F.min))}
    g = g.withColumns(sums).withColumn("best_core", F.first(F.struct("core", "core_votes")).over(by().orderBy(F.desc("core_votes"), "core_at")))
    own = F.col("core").eqNullSafe(F.col("best_core.core"))
    out = g.groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in ("model", "model_votes", "best_core", "total")],
        F.min(F.struct((-F.col("parameters_votes")).alias("v"), "parameters_at", "parameters")).alias("exact"), F.min(F.when(own, F.struct((-F.col("n")).alias("v"), "at", "parameters"))).alias("inside"),
    )
    strict = -F.col("exact.v") >= least
    return out.select(
        *keys, "model", "model_votes", F.when(strict, F.col("exact.parameters")).otherwise(F.col("inside.parameters")).alias("parameters"), F.when(strict, -F.col("exact.v")).otherwise(F.col("best_core.core_votes")).alias("parameter_votes"),
        F.when(strict, "exact").otherwise("core").alias("level"), "total",
    )


def last_lookup(rows: DataFrame, known: DataFrame, order: str, *keys: str) -> DataFrame:
    """rows with the columns of `known` for their keys, null where there are none; of several rows of a key, the last by `order` counts."""
    values = [c for c in known.columns if c not in keys and c != order]
    last = known.groupBy(*keys).agg(F.max_by(F.struct(*values), order).alias("_last"))
    return rows.join(last, list(keys), "left").select(*rows.columns, *[F.col(f"_last.{c}").alias(c) for c in values])


def token_budget(expected: Column) -> Column:
    """Tokens that a last turn may take for a forecast of this length."""
    return F.least(F.lit(8192), 2400 + 20 * expected)


def seconds_limit(turn: Column, slow: Column) -> Column:
    return F.when(turn < 3, F.when(slow, 300).otherwise(120)).otherwise(F.when(slow, 600).otherwise(300))
