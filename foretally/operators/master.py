"""From stored chat logs to one record a run, and from records to protocol checks.

A log is a file name and a text.  The text's turns are found by their marks, or, in chats exported from a
browser, by header lines; each turn's answer is parsed into its columns, and the last
answer decides what the run gave.  All of it is one projection, without a shuffle; the tables of
expected lengths, blocks and setups are small and joined to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretally.functions import text as T
from foretally.operators import protocol, records, transcripts

#: Columns of the data inspection and the labels of their lines.
TURN0 = {
    "t0_rows": "Rows", "t0_columns": "Columns", "t0_time_index": "Time Index", "t0_primary_target": "Primary Target", "t0_frequency": "Frequency", "t0_missing_values": "Missing Values",
    "t0_duplicated_timestamps": "Duplicated Timestamps", "t0_irregularities": "Raw Data Irregularities", "t0_trend": "Trend", "t0_seasonality": "Seasonality", "t0_noise": "Noise", "t0_split_rule": "Split Rule",
    "t0_train_size": "Train Size", "t0_test_size": "Test Size", "t0_train_period": "Train Period", "t0_test_period": "Test Period",
}
#: Names of the other turns' columns.
TURN1 = ("t1_issues_detected", "t1_preprocessing_steps", "t1_zerovalue_treatment", "t1_justification")
FLAGS3 = {
    "t3_has_seed": "seed", "t3_reads_csv": "reads_csv", "t3_correct_split_80_20": "split", "t3_retraining_implemented": "retraining", "t3_uses_ground_truth": "ground_truth", "t3_remainder_handled": "remainder", "t3_prints_forecasts": "prints",
    "t3_uses_torch": "torch", "t3_uses_sklearn": "sklearn", "t3_uses_statsmodels": "statsmodels", "t3_uses_xgboost": "xgboost", "t3_uses_prophet": "prophet",
}
#: Branches and their tracks.
TRACKS = {"Base": "baseline", "ChalML": "challenger_ml", "ChalDL": "challenger_dl"}


def turn0(answer: Column) -> list[Column]:
    """The data inspection: 16 labelled values and whether its heading is there."""
    return [*[T.field(answer, label).alias(k) for k, label in TURN0.items()], T.has_header(answer, "Dataset Inspection").alias("t0_format_followed")]


def turn1(answer: Column) -> list[Column]:
    """The preprocessing decision."""
    needed, issues, steps, zeros, why, summary, followed, over = records.turn1(answer)
    names = ("t1_preprocessing_needed", *TURN1, "t1_has_previous_summary", "t1_format_followed", "t1_overcleaned_flag")
    return [c.alias(n) for c, n in zip((needed, issues, steps, zeros, why, summary, followed, over), names, strict=True)]


def turn2(answer: Column) -> list[Column]:
    """The understanding of the setup."""
    names = ("t2_scenario_understanding", "t2_model_confirmed", "t2_hyperparams_confirmed", "t2_key_implication", "t2_has_previous_summary", "t2_format_followed", "t2_understands_blockwise", "t2_understands_retraining", "t2_understands_groundtruth")
    return [c.alias(n) for c, n in zip(records.turn2(answer), names, strict=True)]


def turn3(answer: Column, kind: Column, code: Column, numbers: Column, scenario: Column, block: Column) -> list[Column]:
    """The last answer: its kind, its code or list, and what the code does.  block is the expected block size, null where none is known."""
    return [
        answer.alias("t3_raw_response"), code.alias("t3_script_content"), numbers.alias("t3_forecast_list"), kind.alias("t3_output_type"), kind.isin("SCRIPT", "LIST").alias("t3_parse_success"),
        ((kind == "SCRIPT") & records.extra_text(answer)).alias("t3_extra_text_flag"), F.when(numbers != "", T.literal_length(numbers)).alias("t3_forecast_length"),
        *[F.regexp_like(code, F.lit(transcripts.CODE_FLAGS[k])).alias(n) for n, k in FLAGS3.items()],
        F.coalesce(transcripts.block_size_ok(code, scenario, block), F.lit(True)).alias("t3_correct_block_size"),
    ]


def answers(marked: Column, log: Column) -> Column:
    """texts (the four answers, '' where one is missing) and n, the number of turns, or null if the log has none.

    marked has the answers that have marks (transcripts.turn_list); the log itself is looked at only where there are none."""
    at = lambda i: F.coalesce(F.get(F.filter(marked, lambda e: e["turn"] == i), F.lit(0))["text"], F.lit(""))
    third = F.coalesce(F.get(F.filter(marked, lambda e: e["turn"] == 3), F.lit(0))["text"], F.try_element_at(marked, F.lit(-1))["text"])
    result = lambda texts, n: F.struct(F.transform(F.array(*texts), T.strip).alias("texts"), n.alias("n"))
    # an exported chat opens with an answer that no turn asked for
    later = lambda told, i: F.coalesce(F.get(told, F.lit(i)), F.lit(""))
    by_header = lambda told: F.when(F.size(told) > 0, result([later(told, 1), later(told, 2), later(told, 3), F.try_element_at(told, F.lit(-1))], F.size(told)))
    told = lambda header: F.when(header.isNotNull(), F.transform(F.array(records.chat_turns(log, header)), by_header)[0])
    return F.when(F.size(marked) > 0, result([at(0), at(1), at(2), third], F.size(marked))).otherwise(F.transform(F.array(records.chat_header(log)), told)[0])


def assembled(logs: DataFrame, lengths: DataFrame, blocks: DataFrame) -> DataFrame:
    """logs (file_id, log) as a record each; logs without an answer are left out.

    lengths (dataset, expected) and blocks (dataset, block) hold the expected forecast length and the block size of the block-wise scenario.
    """
    stem = F.col("file_id")
    names = ("experiment_part", "dataset", "scenario", "branch", "llm_version", "run_id")
    parts = [c.alias(n) for c, n in zip(records.file_parts(stem), names, strict=True)]
    # behind generators, outer ones, so that what is found is a column and no filter or later step finds it again
    cut = logs.select("file_id", "log", F.inline_outer(F.array(F.struct(transcripts.turn_list(F.col("log")).alias("marked")))))
    found = cut.select("file_id", *parts, F.inline_outer(F.array(answers(F.col("marked"), F.col("log"))))).where("n is not null").join(lengths, "dataset", "left").join(blocks, "dataset", "left")
    text = lambda i: F.col("texts")[i]
    # step by step, so that each is worked out once
    known = found.withColumn("kind", transcripts.output_type(text(3))).withColumn("numbers", F.when(F.col("kind") == "LIST", T.forecast_literal(text(3))).otherwise(""))
    known = known.withColumn("code", F.when(F.col("kind") == "SCRIPT", transcripts.code_of(text(3))).otherwise(""))
    rows = known.select(
        "file_id", *names, F.concat(stem, F.lit(".txt")).alias("chat_log_file"), F.col("n").alias("n_llm_turns"), "expected",
        *turn0(text(0)), *turn1(text(1)), *turn2(text(2)), *turn3(text(3), F.col("kind"), F.col("code"), F.col("numbers"), F.upper(T.scenario_name(F.col("scenario"))), F.col("block")),
    )
    kind = F.col("t3_output_type")
    count = F.size(F.coalesce(T.number_list(F.col("t3_raw_response")), T.number_list(F.col("t3_forecast_list"))))
    status = transcripts.analysis_status(F.lit(""), kind, F.when(count >= 0, count), F.col("expected"))
    script = F.when((kind == "SCRIPT") & (F.col("t3_script_content") != ""), F.concat(F.lit("scripts-output/"), stem, F.lit(".py"))).otherwise("")
    raw = F.when(kind == "LIST", F.concat(F.lit("raw-forecasts/"), stem, F.lit(".json"))).otherwise("")
    return rows.withColumns({"script_file": script, "raw_file": raw, "analysis_status": status}).drop("expected")


#: Flags of a record that the protocol looks at, and their names in the scores.
CHECKS = {
    "t0_format_followed": "t0_format", "t1_format_followed": "t1_format", "t1_has_previous_summary": "t1_previous", "t1_overcleaned_flag": "t1_overcleaned", "t2_format_followed": "t2_format", "t2_has_previous_summary": "t2_previous",
    "t2_model_confirmed_nonempty": "model_named", "t2_hyperparams_confirmed_nonempty": "parameters_named", "t2_understands_blockwise": "blockwise", "t2_understands_retraining": "retraining", "t2_understands_groundtruth": "ground_truth",
    "t3_parse_success": "t3_parsed", "t3_extra_text_flag": "t3_extra", "t3_has_seed": "t3_seed", "t3_reads_csv": "t3_csv", "t3_correct_split_80_20": "t3_split", "t3_correct_block_size": "t3_block", "t3_retraining_implemented": "t3_retraining",
    "t3_uses_ground_truth": "t3_truth", "t3_remainder_handled": "t3_remainder", "t3_prints_forecasts": "t3_prints",
    "code_model_matches_expected": "model_ok", "code_hyperparams_match_expected": "parameters_ok", "script_uses_expected_family": "family_ok",
}


def checked(runs: DataFrame, setups: DataFrame) -> DataFrame:
    """runs (records) with track, expected_model, expected_hyperparameters and the 24 checks of CHECKS.

    setups (dataset, scenario, track, model, hyperparameters) says what was to be used; a run without a setup, or
    with an empty one, is held to what its own Turn 2 confirmed.
    """
    s = setups.select(F.lower("dataset").alias("_d"), F.col("scenario").alias("_s"), F.col("track").alias("_t"), F.col("model").alias("_m"), F.col("hyperparameters").alias("_h"))
    track = T.mapped(F.col("branch"), TRACKS, F.lit(""))
    r = runs.withColumn("track", track)
    on = (F.lower("dataset") == F.col("_d")) & (F.col("scenario") == F.col("_s")) & (F.coalesce(F.nullif("track", F.lit("")), F.lit("baseline")) == F.col("_t"))
    given = lambda a, b: F.coalesce(F.nullif(T.strip(F.col(a)), F.lit("")), T.strip(F.col(b)))
    r = r.join(s, on, "left").withColumns({"expected_model": given("_m", "t2_model_confirmed"), "expected_hyperparameters": given("_h", "t2_hyperparams_confirmed")}).drop("_d", "_s", "_t", "_m", "_h")
    code, script = F.col("t3_script_content"), F.col("t3_output_type") == "SCRIPT"
    family = F.when(script, protocol.family_matches(F.col("expected_model"), code))
    tokens = T.hyperparameter_tokens(F.col("expected_hyperparameters"))
    matching = F.when(script & (code != "") & (F.col("expected_hyperparameters") != ""), T.token_coverage(tokens, code) >= 0.6)
    return r.withColumns({
        "t2_model_confirmed_nonempty": T.strip(F.col("t2_model_confirmed")) != "", "t2_hyperparams_confirmed_nonempty": T.strip(F.col("t2_hyperparams_confirmed")) != "",
        "code_model_matches_expected": family, "code_hyperparams_match_expected": matching, "script_uses_expected_family": family,
    })


def flags(checks: DataFrame, *keep: str) -> DataFrame:
    """keep, output_type and the checks under the names that protocol.scores reads."""
    return checks.select(*keep, F.col("t3_output_type").alias("output_type"), *[F.col(k).alias(v) for k, v in CHECKS.items()])


def details(runs: DataFrame, setups: DataFrame) -> DataFrame:
    """The protocol's detail table: a run's names, what it was to use, its checks and its scores."""
    c = checked(runs, setups)
    names = ("file_id", "dataset", "scenario", "branch", "track", "llm_version", "run_id")
    scores = protocol.scores(flags(c, "file_id"), "file_id")
    return c.select(*names, F.col("t3_output_type").alias("output_type"), "expected_model", "expected_hyperparameters", *CHECKS).join(scores, "file_id")
