"""Protocol scores and scenario compliance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretally.functions.numeric import pct, rounded
from foretally.functions.text import any_marker, normalize_text, strip

#: Names in what was asked for, and what code of that kind has; the first name that occurs decides.
MODEL_KEYWORDS = (
    ("sarima", (r"\bsarimax\b", r"\bsarima\b", r"\barima\b")),
    ("sarimax", (r"\bsarimax\b",)),
    ("arima", (r"\barima\b", r"\bsarimax\b")),
    ("exponential smoothing", (r"\bexponentialsmoothing\b", r"\bholtwinters\b", r"\bholt-winters\b")),
    ("holt-winters", (r"\bexponentialsmoothing\b", r"\bholtwinters\b", r"\bholt-winters\b")),
    ("lightgbm", (r"\blgbmregressor\b", r"\blightgbm\b", r"\blgb\b")),
    ("xgboost", (r"\bxgbregressor\b", r"\bxgboost\b", r"\bxgb\b")),
    ("randomforest", (r"\brandomforestregressor\b", r"\brandom forest\b")),
    ("random forest", (r"\brandomforestregressor\b", r"\brandom forest\b")),
    ("lstm", (r"\blstm\b", r"\bnn\.lstm\b")),
    ("gru", (r"\bgru\b", r"\bnn\.gru\b")),
    ("tcn", (r"\btcn\b", r"\bconv1d\b", r"\bdilated")),
    ("prophet", (r"\bprophet\b",)),
)


def share_true(flags: list[Column]) -> Column:
    """Percentage of true among the flags that aren't null; null without any."""
    known = F.filter(F.array(*[f.cast("int") for f in flags]), lambda x: x.isNotNull())
    return rounded(100.0 * F.aggregate(known, F.lit(0), lambda a, x: a + x) / F.nullif(F.size(known), F.lit(0)), 2)


def mean_score(scores: list[Column]) -> Column:
    known = F.filter(F.array(*scores), lambda x: x.isNotNull())
    return rounded(F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(known), F.lit(0)), 2)


def family_matches(model: Column, code: Column) -> Column:
    """Whether the code uses the family that the model's name tells; null for unknown names and without a name or code.  Both are read in plain words."""
    name, plain = normalize_text(model), normalize_text(code)
    out = F.when((F.coalesce(name, F.lit("")) == "") | (F.coalesce(plain, F.lit("")) == ""), F.lit(None).cast("boolean"))
    for word, patterns in MODEL_KEYWORDS:
        out = out.when(F.contains(name, F.lit(word)), F.regexp_like(plain, F.lit("|".join(patterns))))
    return out


SCENARIO_FLAGS = ("model_named", "parameters_named", "blockwise", "retraining", "ground_truth")
CODE_FLAGS = ("t3_parsed", "t3_seed", "t3_csv", "t3_split", "t3_block", "t3_retraining", "t3_truth", "t3_remainder", "t3_prints")
MODEL_FLAGS = ("family_ok", "model_ok", "parameters_ok")


def scores(checks: DataFrame, *keep: str) -> DataFrame:
    """keep and the eight scores of each row of flags, with `strict`: all four turns at 100."""
    c = lambda names: [F.col(n) for n in names]
    extra = ~F.col("t3_extra")
    script, is_list = F.col("output_type") == "SCRIPT", F.col("output_type") == "LIST"
    parsed = share_true(c(CODE_FLAGS[:1]))
    code = F.when(script, share_true(c(CODE_FLAGS))).when(is_list, parsed).otherwise(0.0)
    model = F.when(script, share_true(c(MODEL_FLAGS)))
    out = {
        "format_score": share_true([*c(("t0_format", "t1_format", "t1_previous", "t2_format", "t2_previous")), extra]),
        "scenario_score": share_true(c(SCENARIO_FLAGS)),
        "code_score": code,
        "model_score": model,
        "turn0_score": share_true(c(("t0_format",))),
        "turn1_score": share_true([*c(("t1_format", "t1_previous")), ~F.col("t1_overcleaned")]),
        "turn2_score": share_true(c(("t2_format", "t2_previous", *SCENARIO_FLAGS))),
        "turn3_score": F.when(script, share_true([extra, *c(CODE_FLAGS), *c(MODEL_FLAGS)])).when(is_list, share_true([extra, *c(CODE_FLAGS[:1])])).otherwise(share_true([extra, F.lit(False)])),
    }
    rows = checks.select(*keep, *[v.alias(k) for k, v in out.items()])
    rows = rows.withColumn("overall_score", mean_score(c(("format_score", "scenario_score", "code_score", "model_score"))))
    strict = F.lit(True)
    for i in range(4):
        strict = strict & (F.col(f"turn{i}_score") == 100)
    return rows.withColumn("strict", strict)


def score_summary(rows: DataFrame, columns: list[str], *keys: str) -> DataFrame:
    """keys, n, mean of each score (0 without any), share of strict passes."""
    means = [F.coalesce(rounded(F.avg(c), 2), F.lit(0.0)).alias(f"mean_{c}") for c in columns]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *means, pct(F.count(F.when(F.col("strict"), 1)), F.count("*")).alias("strict_pct"))


#: The columns of the protocol's summary that are means of scores, shares of flags (a missing flag is false), and shares of flags that are known.
MEANS = {
    "format_follow_score": "format_score", "scenario_understanding_score": "scenario_score", "code_structure_score": "code_score", "model_hyperparam_score": "model_score", "turn0_score": "turn0_score", "turn1_score": "turn1_score",
    "turn2_score": "turn2_score", "turn3_score": "turn3_score", "overall_protocol_score": "overall_score",
}
RATES = {
    "strict_protocol_pass_rate_pct": "strict", "t0_format_follow_rate_pct": "t0_format_followed", "t1_format_follow_rate_pct": "t1_format_followed", "t2_format_follow_rate_pct": "t2_format_followed",
    "understands_blockwise_rate_pct": "t2_understands_blockwise", "understands_retraining_rate_pct": "t2_understands_retraining", "understands_groundtruth_rate_pct": "t2_understands_groundtruth",
}
KNOWN_RATES = {"code_model_match_rate_pct": "code_model_matches_expected", "code_hyperparam_match_rate_pct": "code_hyperparams_match_expected"}


def bool_rate(flag: Column, known: bool = False) -> Column:
    """The percentage of true flags of a group: of all its rows, or of those where the flag is known; 0 without any."""
    n = F.count(flag) if known else F.count(F.lit(1))
    return F.coalesce(rounded(100.0 * F.count(F.when(flag, 1)) / F.nullif(n, F.lit(0)), 2), F.lit(0.0))


def group_summary(details: DataFrame, *keys: str) -> DataFrame:
    """keys and 25 columns: runs, counts of kinds of output, mean scores and shares of flags.  Null keys are a group."""
    n, kind = F.count(F.lit(1)), lambda k: F.count(F.when(F.col("output_type") == k, 1))
    return details.groupBy(*keys).agg(
        n.alias("total_runs"), kind("SCRIPT").alias("script_rows"), pct(kind("SCRIPT"), n).alias("script_rate_pct"), kind("LIST").alias("list_rows"), pct(kind("LIST"), n).alias("list_rate_pct"),
        kind("ERROR").alias("model_error_rows"), kind("TEXT").alias("text_rows"), *[F.coalesce(rounded(F.avg(c), 2), F.lit(0.0)).alias(k) for k, c in MEANS.items()],
        *[bool_rate(F.col(c)).alias(k) for k, c in RATES.items()], *[bool_rate(F.col(c), known=True).alias(k) for k, c in KNOWN_RATES.items()],
    )


#: How each scenario forecasts.
DESIGN = (
    ("S1", "One-step", "Static", "No", "No", "Recursive"),
    ("S2", "One-step", "Rolling", "Yes, each step", "Every step", "Continuous retraining"),
    ("S3", "Multi-step", "Rolling", "Yes, each step", "Every step", "Continuous retraining"),
    ("S4", "Multi-step", "Block-wise rolling", "Yes, each block", "Every block", "Periodic retraining"),
)


def scenario_design(runs: DataFrame) -> DataFrame:
    """How each scenario forecasts, and how many runs and datasets (scenario, dataset) it has; a scenario without runs has 0."""
    counts = runs.groupBy("scenario").agg(F.count("*").alias("runs"), F.count_distinct("dataset").alias("datasets"))
    rows = runs.sparkSession.createDataFrame(list(DESIGN), "scenario string, forecast_mode string, update_mode string, ground_truth string, retraining string, inference string")
    return rows.join(counts, "scenario", "left").fillna(0, ["runs", "datasets"])


REQUIREMENTS = ("retraining", "ground_truth", "blockwise", "multistep")
SUPPORTED = ("retraining", "ground_truth", "blockwise")


#: Words of a scenario's description, in lower case, and what each asks for.
DEMANDS = {
    "retraining": ((("model retraining: not performed",), False), (("model retraining: performed", "retrain after each", "retrained after each"), True)),
    "ground_truth": ((("use of ground truth during inference: disabled", "disabled (no updates"), False), (("use of ground truth during inference: enabled", "enabled"), True)),
    "blockwise": ((("block-wise rolling update", "block size:", "blockwise"), True),),
    "multistep": ((("multi-step ahead prediction", "forecast multiple steps ahead"), True),),
}


def requirements(text: Column) -> dict[str, Column]:
    """What a scenario's description asks for: true, false, or null where it says nothing."""
    out = {}
    for name, rules in DEMANDS.items():
        value = F.when(F.lit(False), F.lit(None).cast("boolean"))
        for marks, meaning in rules:
            value = value.when(any_marker(text, marks), meaning)
        out[name] = value
    return out


def scenario_requirements(prompts: DataFrame, *keep: str) -> DataFrame:
    """keep, scenario, expected_<r> from prompts (text), whose scenarios each begin with a line `Scenario <n>:`."""
    blocks = prompts.select(*keep, F.explode(F.split(F.trim("text"), r"\n(?=Scenario\s+\d+:)")).alias("block"))
    number = F.regexp_extract(strip(F.col("block")), r"(?i)^Scenario\s+(\d+):", 1)
    return blocks.where(number != "").select(*keep, F.concat(F.lit("S"), number).alias("scenario"), *[c.alias(f"expected_{k}") for k, c in requirements(F.col("block")).items()])


def compliance(runs: DataFrame, *keep: str) -> DataFrame:
    """keep, semantic and implementation percentages, their full flags, and the supported requirements.

    runs have expected_<r>, t2_<r> and t3_<r>; a missing observation isn't correct, a requirement without expectation doesn't count.
    """
    said = F.array(*[F.struct(F.lit(r).alias("r"), F.col(f"expected_{r}").alias("e"), F.col(f"t2_{r}").alias("s"), F.col(f"t3_{r}").alias("i")) for r in SUPPORTED])
    counted = F.filter(said, lambda x: x["e"].isNotNull())
    right = lambda k: F.size(F.filter(counted, lambda x: F.coalesce(x["e"] == x[k], F.lit(False))))
    n = F.size(counted)
    score = lambda k: rounded(100.0 * right(k) / F.nullif(n, F.lit(0)), 1)
    return runs.select(
        *keep, score("s").alias("semantic"), score("i").alias("implementation"), F.coalesce(right("s") == n, F.lit(False)).alias("full_semantic"), (right("i") == n).alias("full_implementation"),
        F.array_join(F.transform(counted, lambda x: x["r"]), ",").alias("supported"), F.array_join(F.transform(F.filter(said, lambda x: x["e"].isNull()), lambda x: x["r"]), ",").alias("unsupported"),
    )


def compliance_summary(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, n, means, full counts as 'k / n', and how often understanding leads to implementation and that to success."""
    k = lambda c: F.count(F.when(c, 1))
    s, i, ok = F.col("full_semantic"), F.col("full_implementation"), F.coalesce(F.col("ok"), F.lit(False))
    ratio = lambda a, b: rounded(100.0 * a / F.nullif(b, F.lit(0)), 1)
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), rounded(F.avg("semantic"), 1).alias("mean_semantic"), rounded(F.avg("implementation"), 1).alias("mean_implementation"),
        F.concat_ws(" / ", k(s).cast("string"), F.count("*").cast("string")).alias("full_semantic"), F.concat_ws(" / ", k(i).cast("string"), F.count("*").cast("string")).alias("full_implementation"),
        ratio(k(s & i), k(s)).alias("implemented_given_semantic"), ratio(k(i & ok), k(i)).alias("success_given_implemented"),
    )


def requirement_summary(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, requirement, n, and the percentages of right understanding and implementation (null where nothing is expected)."""
    long = F.array(*[F.struct(F.lit(r).alias("requirement"), F.col(f"expected_{r}").alias("e"), F.col(f"t2_{r}").alias("s"), F.col(f"t3_{r}").alias("i")) for r in SUPPORTED])
    k = lambda c: F.count(F.when(F.coalesce(F.col("e") == F.col(c), F.lit(False)), 1))
    n = F.count("e")
    return rows.select(*keys, F.inline(long)).groupBy(*keys, "requirement").agg(n.alias("n"), rounded(100.0 * k("s") / F.nullif(n, F.lit(0)), 1).alias("semantic_pct"), rounded(100.0 * k("i") / F.nullif(n, F.lit(0)), 1).alias("implementation_pct"))
