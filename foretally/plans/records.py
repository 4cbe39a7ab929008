"""Queries over records of stored chats, with their SQL; as in texts.py, each renders what it parses."""

from __future__ import annotations

from pyspark.sql import functions as F

from foretally.operators import records
from foretally.sources.tables import table

_NL = "chr(10)"
STEM = "'Part2-' || source || '-S' || (doc_id % 4 + 1) || '-' || case when doc_id % 3 = 0 then 'Base' else 'ChalML' end || '-' || lang || case when doc_id % 5 > 0 then '-Run' || (doc_id % 3 + 1) else '' end"
STEM1 = "case when doc_id % 7 = 0 then 'notes-' || doc_id else 'Part1-' || source || '-x-v' || (2 + doc_id % 2) || '-S' || (doc_id % 4 + 1) || '-' || lang || '-Run' || (doc_id % 30) end"
CHAT = f"""case when doc_id % 6 = 0 then 'plain talk without a header' else 'preface' || {_NL} || 'You asked' || {_NL} || 'q1' || {_NL} || {_NL} || 'ChatGPT said:' || {_NL} || 'answer ' || doc_id || {_NL} || 'the claude response was fine' || {_NL} || 'you asked' || {_NL} || 'q2'
 || case when doc_id % 2 = 0 then {_NL} || '  chatgpt said  ' || {_NL} || 'second ' || lang else '' end end"""
_MODEL = "case doc_id % 5 when 0 then 'SARIMAX' when 1 then 'Holt-Winters' when 2 then 'XGBoost v2' when 3 then 'N-BEATS' else 'Oracle' end"
ADVICE = f"""'you asked' || {_NL} || 'Pick a model.' || {_NL} || 'claude response' || {_NL} || 'Some talk. Trend: none' || {_NL} || 'Data Characteristics Summary:' || {_NL} || '- Trend: ' || lang || {_NL}
 || case when doc_id % 3 > 0 then '- Seasonality: ' || source || {_NL} else '' end || '- Noise: low' || {_NL} || 'Primary target column: [' || lang || ']' || {_NL} || 'Recommended Model: ' || {_MODEL} || {_NL}
 || case when doc_id % 4 > 0 then 'Hyperparameters: {{"order": (1, ' || (doc_id % 3) || ', 1), "trend": None}}' || {_NL} else '' end || 'Justification: because of' || {_NL} || 'seasons' || {_NL} || {_NL} || 'The end.' || {_NL}
 || 'you asked' || {_NL} || 'More?' || {_NL} || 'claude response' || {_NL} || 'Recommended Model: other'"""
TURN1 = f"""case when doc_id % 5 > 0 then 'Preprocessing Decision' else 'Answer' end || {_NL} || 'Needed: ' || case when doc_id % 2 = 0 then 'Yes, some' else 'no' end || {_NL} || 'Issues Detected: ' || source || {_NL}
 || 'Preprocessing Steps: ' || case doc_id % 3 when 0 then 'standardize all' when 1 then 'none' else 'log transform' end || {_NL} || 'Justification - ' || lang"""
TURN2 = f"""'Setup Understanding' || {_NL} || 'Scenario Understanding: ' || case doc_id % 4 when 0 then 'Block-wise rolling with refit after each block' when 1 then 'static forecast' when 2 then 'retrain the model at every step' else 'observed values are extended later' end || {_NL}
 || 'Key Implication: none' || {_NL} || 'Fixed Model: ' || lang || case when doc_id % 3 = 0 then {_NL} || 'Previous Decisions Summary' else '' end"""
PROMPT = "'Forecast {target} of {dataset} with {steps} steps; keep {this}.'"


def _docs(spark, sf_dir, **columns):
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", *[F.expr(e).alias(k) for k, e in columns.items()])


def file_names(spark, sf_dir):
    return _docs(spark, sf_dir, stem=STEM).select("doc_id", *records.file_parts(F.col("stem")))


def recommendation_files(spark, sf_dir):
    rows = _docs(spark, sf_dir, stem=STEM1).select("doc_id", *records.recommendation_parts(F.col("stem")))
    return rows.where("run is not null")


def legacy_turns(spark, sf_dir):
    d = _docs(spark, sf_dir, chat=CHAT).withColumn("header", records.chat_header(F.col("chat")))
    t = d.withColumn("turns", records.chat_turns(F.col("chat"), F.col("header")))
    return t.select("doc_id", F.col("header.name").alias("name"), F.col("header.style").alias("style"), F.size("turns").alias("n_turns"), F.try_element_at("turns", F.lit(1)).alias("first_turn"), F.try_element_at("turns", F.lit(-1)).alias("last_turn"))


def recommendations(spark, sf_dir):
    d = _docs(spark, sf_dir, advice=ADVICE, version="'v' || (2 + doc_id % 2)")
    parsed = d.select("doc_id", *records.recommendation(F.col("advice"), F.col("version"), F.lit("EN")))
    return parsed.withColumn("errors", F.array_join("errors", " | "))


def preprocessing_records(spark, sf_dir):
    return _docs(spark, sf_dir, r=TURN1).select("doc_id", *records.turn1(F.col("r")))


def understanding_records(spark, sf_dir):
    return _docs(spark, sf_dir, r=TURN2).select("doc_id", *records.turn2(F.col("r")))


def extra_text_flags(spark, sf_dir):
    x = f"repeat('note ', cast(doc_id % 30 as int)) || {_NL} || 'import numpy as np' || {_NL} || 'from x import y'"
    return _docs(spark, sf_dir, r=x).select("doc_id", records.extra_text(F.col("r")).alias("extra"))


def prompt_fill(spark, sf_dir):
    values = {"target": F.col("lang"), "dataset": F.col("source"), "steps": (F.col("doc_id") % 9).cast("string")}
    return _docs(spark, sf_dir, t=PROMPT).select("doc_id", records.filled(F.col("t"), values).alias("prompt"))


QUERIES = {f.__name__: f for f in (file_names, recommendation_files, legacy_turns, recommendations, preprocessing_records, understanding_records, extra_text_flags, prompt_fill)}
SQL = {
    "file_names": "select doc_id, 'Part2' as part, source as dataset, 'S' || (doc_id % 4 + 1) as scenario, case when doc_id % 3 = 0 then 'Base' else 'ChalML' end as branch, lang as llm, case when doc_id % 5 > 0 then (doc_id % 3 + 1)::varchar else 'NA' end as run from documents",
    "recommendation_files": "select doc_id, source || '-x' as dataset, 'v' || (2 + doc_id % 2) as version, 'S' || (doc_id % 4 + 1) as scenario, lang as llm, (doc_id % 30)::int as run from documents where doc_id % 7 <> 0",
    "legacy_turns": f"""select doc_id, case when doc_id % 6 > 0 then 'chatgpt' end as name, case when doc_id % 6 > 0 then 'said' end as style, case when doc_id % 6 = 0 then 0 when doc_id % 2 = 0 then 2 else 1 end as n_turns,
  case when doc_id % 6 > 0 then 'answer ' || doc_id || {_NL} || 'the claude response was fine' end as first_turn, case when doc_id % 6 = 0 then null when doc_id % 2 = 0 then 'second ' || lang else 'answer ' || doc_id || {_NL} || 'the claude response was fine' end as last_turn from documents""",
    "recommendations": f"""select doc_id, case when doc_id % 2 = 1 then lang else '' end as target, doc_id % 2 = 1 and lang = 'en' as target_ok, lang as trend, case when doc_id % 3 > 0 then source else '' end as seasonality, 'low' as noise, {_MODEL} as model,
  case doc_id % 5 when 0 then 'Multivariate Statistical' when 1 then 'Statistical' when 2 then 'ML' when 3 then 'Deep Learning' else 'Unknown' end as category,
  case when doc_id % 4 > 0 then '{{"order": [1, ' || (doc_id % 3) || ', 1], "trend": null}}' else '' end as hyperparameters, 'because of' || {_NL} || 'seasons' as justification,
  concat_ws(' | ', case when doc_id % 3 = 0 then 'Seasonality field not found' end, case when doc_id % 4 = 0 then 'Hyperparameters field not found or not a valid dict' end) as errors, doc_id % 3 = 0 or doc_id % 4 = 0 as error_flag from documents""",
    "preprocessing_records": """select doc_id, doc_id % 2 = 0 as needed, source as issues, case doc_id % 3 when 0 then 'standardize all' when 1 then 'none' else 'log transform' end as steps, '' as zeros, lang as justification, false as has_summary, doc_id % 5 > 0 as format_followed,
  doc_id % 2 = 0 and doc_id % 3 <> 1 as overcleaned from documents""",
    "understanding_records": """select doc_id, case doc_id % 4 when 0 then 'Block-wise rolling with refit after each block' when 1 then 'static forecast' when 2 then 'retrain the model at every step' else 'observed values are extended later' end as understanding, lang as model, '' as hyperparameters,
  'none' as implication, doc_id % 3 = 0 as has_summary, true as format_followed, doc_id % 4 = 0 as understands_blockwise, doc_id % 4 in (0, 2) as understands_retraining, doc_id % 4 = 3 as understands_ground_truth from documents""",
    "extra_text_flags": "select doc_id, doc_id % 30 >= 16 as extra from documents",
    "prompt_fill": "select doc_id, 'Forecast ' || lang || ' of ' || source || ' with ' || (doc_id % 9) || ' steps; keep {this}.' as prompt from documents",
}
