"""Records of whole chat logs and the protocol's checks of them, with their SQL.

The logs are rendered from `documents` by an expression that both engines read: the question of Turn 0 holds
the document's whole text, and the answers' lines vary with its columns.  The SQL then
parses the same logs by itself; no expected value is written down.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from foretally.functions import text as T
from foretally.operators import master, transcripts
from foretally.operators.records import UNDERSTOOD
from foretally.operators.protocol import MODEL_KEYWORDS
from foretally.plans.records import STEM, TURN1
from foretally.plans.texts import rendered
from foretally.sources.tables import table

_NL, _Q = "chr(10)", "chr(39) || chr(39) || chr(39)"
FILE = f"{STEM} || '-' || doc_id"
TURN0 = f"""case when doc_id % 7 > 0 then 'Dataset Inspection' else 'A look' end || {_NL} || 'Rows: ' || n_chars || {_NL} || 'Columns - ' || (doc_id % 5 + 2) || {_NL} || 'time index :  day ' || {_NL} || 'Primary Target: ' || lang || {_NL}
 || case when doc_id % 3 > 0 then 'Frequency: ' || source || {_NL} else '' end || 'Missing Values:' || {_NL} || 'Duplicated Timestamps: ' || (doc_id % 2) || {_NL} || 'Raw Data Irregularities - some' || {_NL} || 'Trend: up' || {_NL}
 || case when doc_id % 4 = 0 then '' else 'Seasonality: ' || (doc_id % 12) || {_NL} end || 'Noise: low' || {_NL} || 'Split Rule: 80/20' || {_NL} || 'Train Size: ' || (doc_id % 100) || {_NL} || 'Test Size: ' || (doc_id % 25) || {_NL} || 'Train Period: a - b' || {_NL} || 'Test Period: b'"""
_MODEL = "case doc_id % 8 when 0 then 'SARIMA' when 1 then 'Holt-Winters' when 2 then 'XGBoost' when 3 then 'Random_Forest' when 4 then 'LSTM' when 5 then 'Prophet' when 6 then 'Oracle' else '' end"
_PARAMS = "case doc_id % 5 when 0 then 'order=(1, ' || (doc_id % 3) || ', 1), trend=None' when 1 then 'n_lags=7 alpha=0.3 depth=9 units=64 rate=0.01 10 12' when 2 then 'n_estimators = 50' when 3 then '' else 'max_depth=6, 24' end"
TURN2 = f"""case when doc_id % 9 > 0 then 'Setup Understanding' else 'Setup' end || {_NL} || 'Scenario Understanding: ' || case doc_id % 6 when 0 then 'Block-wise rolling with refit after each block' when 1 then 'static forecast' when 2 then 'retrain the model at every step' when 3 then 'observed values are extended later'
 when 4 then 'true values append the training data' else 'fit again by one block' end || {_NL} || 'Key Implication: ' || case when doc_id % 4 = 0 then 'ground truth is added after the window' else 'none' end || {_NL} || 'Fixed Model: ' || {_MODEL} || {_NL} || 'Fixed Hyperparameters: ' || {_PARAMS} || {_NL} || 'End: x'
 || case when doc_id % 3 = 0 then {_NL} || 'Previous Decisions Summary' else '' end"""
_SCRIPT = f"""case doc_id % 7 when 0 then repeat('We explain. ', 9) || {_NL} when 1 then {_Q} || 'python' || {_NL} when 2 then {_Q} || {_NL} else '' end || 'import numpy as np' || {_NL} || case when doc_id % 2 = 0 then 'np.random.seed(1)' || {_NL} else '' end || case when doc_id % 3 = 0 then 'df = pd.read_csv(x)' || {_NL} else '' end
 || case doc_id % 8 when 0 then 'from statsmodels.tsa import SARIMAX' when 1 then 'ExponentialSmoothing(y)' when 2 then 'import xgboost' when 3 then 'RandomForestRegressor(n_estimators=50)' when 4 then 'import torch' || {_NL} || 'nn.LSTM(7, 64)' when 5 then 'from prophet import Prophet' else 'from sklearn import svm' end || {_NL}
 || case when doc_id % 5 > 2 then 'n_train = ' || n_chars || {_NL} else '' end || case when doc_id % 4 > 1 then 'for i in range(9):' || {_NL} || '    model.fit(x)' || {_NL} else '' end || case when doc_id % 6 > 2 then 'history.append(y_test[i])' || {_NL} else '' end || 'block_size = ' || (11 + doc_id % 3) || {_NL}
 || case when doc_id % 10 > 4 then 'rest = n % block_size' || {_NL} else '' end || 'order=(1, ' || (doc_id % 2) || ', 1); alpha = 0.3' || {_NL} || case when doc_id % 11 > 2 then 'print( forecasts )' else 'print(x)' end || case doc_id % 7 when 1 then {_NL} || {_Q} when 2 then {_NL} || {_Q} || {_NL} when 3 then {_NL} || '```' || {_NL} else '' end"""
TURN3 = f"""case when doc_id % 12 < 7 then {_SCRIPT} when doc_id % 12 = 7 then '[1.5, np.float64(' || (doc_id % 9) || '.0), 3' || case when doc_id % 5 = 0 then ',' else '' end || ']' when doc_id % 12 = 8 then 'Here: [' || (doc_id % 7) || ', 2, 4, 5] and [x]'
 when doc_id % 12 = 9 then ' Error ' when doc_id % 12 = 10 then 'It will rise.' else '[1, [2, 3]]' end"""
_TURNS = {0: TURN0, 1: TURN1, 2: TURN2, 3: TURN3}


def _mark(i: int, who: str) -> str:
    return f"'===== TURN {i} {who} =====' || {_NL}"


#: Some runs answered the last turn twice; what was said first is dropped.
_AGAIN = f"case when doc_id % 17 = 4 then '===== TURN 3 ASSISTANT (first) =====' || {_NL} || {_NL} || 'import draft' || {_NL} else '' end || "
_MARKED = f" || {_NL} || ".join(f"{_mark(i, 'USER')} || {'text' if i == 0 else chr(39) + 'go on' + chr(39)} || {_NL} || {_AGAIN if i == 3 else ''}{_mark(i, 'ASSISTANT')} || " + (f"({t})" if i != 3 else f"({t}) || {_NL}") for i, t in _TURNS.items())
_TOLD = f"'You asked' || {_NL} || 'hello' || {_NL} || 'ChatGPT said:' || {_NL} || 'hi'" + "".join(f" || {_NL} || 'You asked' || {_NL} || 'go on' || {_NL} || 'ChatGPT said:' || {_NL} || ({t})" for t in _TURNS.values())
LOG = f"case when doc_id % 13 = 12 then 'nothing' when doc_id % 11 = 10 then {_TOLD} else {_MARKED} end"


def _setups(docs):
    """What a third of the datasets were to use; the others are held to what Turn 2 confirmed."""
    d = docs.where("source in ('src0', 'src3', 'src6', 'src9', 'src12')").select("source").distinct()
    both = d.select(F.upper("source").alias("dataset"), F.explode(F.array(*[F.struct(F.lit(f"S{i}").alias("scenario"), F.lit(t).alias("track")) for i in (1, 2, 3, 4) for t in ("baseline", "challenger_ml")])).alias("x"))
    return both.select("dataset", "x.*", F.when(F.col("x.track") == "baseline", "SARIMAX").otherwise("Random Forest").alias("model"), F.when(F.col("x.scenario") == "S1", "").otherwise("order=(1, 1, 1)").alias("hyperparameters"))


def _parts(spark, sf_dir):
    """The logs, and how long a list and how large a block each dataset expects: the test part of its documents, and 12."""
    d = table(spark, sf_dir, "documents")
    logs = rendered(d, "doc_id", file_id=FILE, log=LOG)
    n = d.groupBy(F.col("source").alias("dataset")).agg(F.count("*").alias("rows"))
    lengths = n.select("dataset", F.expr("cast(case when rows % 2 = 0 then 3 else 4 end as int)").alias("expected"))
    return logs, lengths, n.select("dataset", F.lit(12).alias("block")), _setups(d)


def runs(spark, sf_dir):
    """The records, the setups, and a run's success: whether its forecast has an error measure."""
    logs, lengths, blocks, setups = _parts(spark, sf_dir)
    records = master.assembled(logs, lengths, blocks)
    numbers = T.number_list(F.col("t3_forecast_list"))
    rmse = F.sqrt(F.aggregate(numbers, F.lit(0.0), lambda a, x: a + (x - 3) * (x - 3)) / F.size(numbers))
    return records.withColumn("ok", F.coalesce(rmse, F.lit(None).cast("double")).isNotNull()), setups


def turn0_records(spark, sf_dir):
    return runs(spark, sf_dir)[0].select("file_id", *master.TURN0, "t0_format_followed")


def turn3_records(spark, sf_dir):
    names = ["t3_output_type", "t3_parse_success", "t3_extra_text_flag", "t3_forecast_list", "t3_forecast_length", *master.FLAGS3, "t3_correct_block_size"]
    return runs(spark, sf_dir)[0].select("file_id", F.md5("t3_raw_response").alias("raw_digest"), F.md5("t3_script_content").alias("script_digest"), *names)


def master_record(spark, sf_dir):
    rows = runs(spark, sf_dir)[0].drop("ok")
    return rows.withColumns({c: F.md5(c) for c in ("t3_raw_response", "t3_script_content")})


def protocol_details(spark, sf_dir):
    return master.details(*runs(spark, sf_dir))


QUERIES = {f.__name__: f for f in (turn0_records, turn3_records, master_record)}


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def field(x: str, label: str) -> str:
    return strip(rf"regexp_extract({x}, '(?i){label}\s*[:\-]\s*(.+)', 1)")


def plain(x: str) -> str:
    return rf"trim(regexp_replace(lower(replace({x}, '_', ' ')), '\s+', ' ', 'g'))"


def _q(p: str) -> str:
    return p.replace("'", "''")


_START = r"(?m)^(?:import\s+\w+|from\s+\w+\s+import|class\s+\w+\s*[\(:]|def\s+\w+\s*\(|(?:random|np|torch|pd|plt)\.\w+\s*\(|(?:np|torch)\.random\.\w+)"
_NUM = r"[+-]?(?:\d[\d_]*\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
_LIST = rf"\[\s*{_NUM}\s*(?:,\s*{_NUM}\s*)*\]"
_UNWRAP = r"regexp_replace(regexp_replace(a3, 'np\.float64\(([^()]+)\)', '\1', 'g'), ',\s*\]', ']', 'g')"
_CLOSED = f"case when lower({strip('before')}) in ({_Q}, 'python' || {_Q}, {_Q} || 'python') then regexp_replace(rest, '\\s*' || {_Q} || '\\s*$', '') else rest end"
_TOKENS = (r"\b[a-z_][a-z0-9_]*\s*=\s*[-+]?\d+(?:\.\d+)?", r"\b(?:order|seasonal_order)\s*[:=]\s*\(?\s*\d+\s*,\s*\d+\s*,\s*\d+", r"\b[-+]?\d+(?:\.\d+)?\b")
_FAMILY = "case when m = '' or c = '' then null " + " ".join(f"when contains(m, '{name}') then regexp_matches(c, '{'|'.join(ps)}')" for name, ps in MODEL_KEYWORDS) + " end"
_NOISY = ", ".join(f"'{x}'" for x in T.NOISY)
#: CTEs up to r: a record a run, and k: the records with their checks.
CTES = rf"""with g as (select doc_id, source, {FILE} as file_id, {LOG} as log from documents),
p0 as (select *, list_filter(string_split_regex(log, '(?m)^===== TURN +'), lambda x: regexp_matches(x, '^\d+ ASSISTANT')) as marked, string_split_regex(log, '(?im)^you asked$')[2:] as told from g),
p as (select *, case when len(marked) > 0 then list_transform(marked, lambda x: {strip("regexp_replace(x, '^[^\n]*\n', '')")}) else list_transform(told, lambda x: {strip("regexp_replace(x, '(?is)^.*?chatgpt said:', '')")}) end as s, len(marked) > 0 as by_mark from p0),
a as (select doc_id, file_id, string_split(file_id, '-') as f, case when by_mark then len(list_distinct(list_transform(marked, lambda x: regexp_extract(x, '^\d+')))) else len(s) end as n_llm_turns, case when by_mark then s[1] else s[2] end as a0, case when by_mark then s[2] else s[3] end as a1, case when by_mark then s[3] else s[4] end as a2, s[-1] as a3 from p where len(s) > 0),
b as (select *, f[2] as dataset, f[3] as scenario, case when upper({strip("a3")}) = 'ERROR' then 'ERROR' when regexp_matches({strip("a3")}, '{_START}') then 'SCRIPT' when regexp_matches({_UNWRAP}, '{_LIST}') then 'LIST' else 'TEXT' end as kind,
  {strip("a3")} as x3, {_UNWRAP} as u3 from a),
d as (select *, case when kind = 'SCRIPT' then strpos(x3, regexp_extract(x3, '{_START}')) else 0 end as k0 from b),
e as (select *, substr(x3, 1, k0 - 1) as before, {strip("substr(x3, k0)")} as rest from d),
h as (select *, case when kind = 'SCRIPT' then regexp_replace(regexp_replace({_CLOSED}, '(?:\s*\n\s*```\s*)+$', ''), '\s+$', '') else '' end as code, case when kind = 'LIST' then regexp_extract(u3, '{_LIST}') else '' end as numbers from e),
w as (select *, case when kind = 'LIST' then len(string_split(numbers, ',')) end as k3, {field("a2", "Scenario Understanding")} as said, {field("a2", "Key Implication")} as implied, case when (select count(*) from documents z where z.source = dataset) % 2 = 0 then 3 else 4 end as expected from h),
r as (select doc_id, file_id, f[1] as experiment_part, dataset, scenario, f[4] as branch, f[5] as llm_version, case when len(f) >= 6 and trim(regexp_replace(f[6], '[Rr]un', '', 'g')) <> '' then trim(regexp_replace(f[6], '[Rr]un', '', 'g')) else 'NA' end as run_id, file_id || '.txt' as chat_log_file, n_llm_turns::int as n_llm_turns,
  {", ".join(f"{field('a0', label)} as {k}" for k, label in master.TURN0.items())}, regexp_matches(a0, '(?i)Dataset Inspection') as t0_format_followed,
  starts_with(lower({field("a1", "Needed")}), 'yes') as t1_preprocessing_needed, {field("a1", "Issues Detected")} as t1_issues_detected, {field("a1", "Preprocessing Steps")} as t1_preprocessing_steps, {field("a1", "Treatment of Zero Values")} as t1_zerovalue_treatment, {field("a1", "Justification")} as t1_justification,
  regexp_matches(a1, '(?i)Previous Decisions Summary') as t1_has_previous_summary, regexp_matches(a1, '(?i)Preprocessing Decision') as t1_format_followed,
  starts_with(lower({field("a1", "Needed")}), 'yes') and regexp_matches({field("a1", "Preprocessing Steps")}, '{transcripts.OVERCLEANED}') as t1_overcleaned_flag,
  said as t2_scenario_understanding, {field("a2", "Fixed Model")} as t2_model_confirmed, {field("a2", "Fixed Hyperparameters")} as t2_hyperparams_confirmed, implied as t2_key_implication,
  regexp_matches(a2, '(?i)Previous Decisions Summary') as t2_has_previous_summary, regexp_matches(a2, '(?i)Setup Understanding') as t2_format_followed,
  {", ".join(f"regexp_matches(lower(said || ' ' || implied), '{UNDERSTOOD[k]}') as t2_understands_{n}" for k, n in (("blockwise", "blockwise"), ("retraining", "retraining"), ("ground_truth", "groundtruth")))},
  a3 as t3_raw_response, code as t3_script_content, numbers as t3_forecast_list, kind as t3_output_type, kind in ('SCRIPT', 'LIST') as t3_parse_success,
  kind = 'SCRIPT' and strpos(x3, regexp_extract(x3, '(?m)^(?:import|from)\s')) > 81 as t3_extra_text_flag, k3::int as t3_forecast_length,
  {", ".join(f"regexp_matches(code, '{_q(transcripts.CODE_FLAGS[k])}') as {n}" for n, k in master.FLAGS3.items())}, scenario <> 'S4' or regexp_matches(code, '(?i)(?:block_size|PRED_LEN|pred_len)\s*=\s*12\b') as t3_correct_block_size,
  case when kind = 'SCRIPT' and code <> '' then 'scripts-output/' || file_id || '.py' else '' end as script_file, case when kind = 'LIST' then 'raw-forecasts/' || file_id || '.json' else '' end as raw_file,
  case kind when 'ERROR' then 'MODEL_ERROR_LITERAL' when 'LIST' then case when k3 = expected then 'OK_FORECAST_LIST' else 'INVALID_LIST_LENGTH' end when 'SCRIPT' then 'OK_FORECAST_SCRIPT' else 'INVALID_OUTPUT' end as analysis_status from w),
v as (select *, case branch when 'Base' then 'baseline' when 'ChalML' then 'challenger_ml' else '' end as track, dataset in ('src0', 'src3', 'src6', 'src9', 'src12') as given from r),
y as (select *, case when given then case track when 'challenger_ml' then 'Random Forest' else 'SARIMAX' end else t2_model_confirmed end as expected_model, case when given and scenario <> 'S1' then 'order=(1, 1, 1)' else t2_hyperparams_confirmed end as expected_hyperparameters from v),
z as (select *, {plain("expected_model")} as m, {plain("t3_script_content")} as c, list_distinct(list_transform(list_concat({", ".join(f"regexp_extract_all({plain('expected_hyperparameters')}, '{p}')" for p in _TOKENS)}), lambda t: regexp_replace(t, '\s+', '', 'g'))) as all_tokens from y),
q as (select *, case when len(all_tokens) <= 5 then all_tokens else list_filter(all_tokens, lambda t: t not in ({_NOISY})) end as tokens from z),
k as (select *, t2_model_confirmed <> '' as t2_model_confirmed_nonempty, t2_hyperparams_confirmed <> '' as t2_hyperparams_confirmed_nonempty, case when t3_output_type = 'SCRIPT' then {_FAMILY} end as code_model_matches_expected,
  case when t3_output_type = 'SCRIPT' and expected_hyperparameters <> '' and t3_script_content <> '' then len(list_filter(tokens, lambda t: contains(c, t))) / nullif(len(tokens), 0) >= 0.6 end as code_hyperparams_match_expected,
  case when t3_output_type = 'SCRIPT' then {_FAMILY} end as script_uses_expected_family, t3_forecast_list <> '' as ok from q)"""
_NAMES = "file_id, experiment_part, dataset, scenario, branch, llm_version, run_id, chat_log_file, n_llm_turns"
_T0 = ", ".join(master.TURN0)
_FLAGS3 = ", ".join(master.FLAGS3)
_T1 = "t1_preprocessing_needed, t1_issues_detected, t1_preprocessing_steps, t1_zerovalue_treatment, t1_justification, t1_has_previous_summary, t1_format_followed, t1_overcleaned_flag"
_T2 = "t2_scenario_understanding, t2_model_confirmed, t2_hyperparams_confirmed, t2_key_implication, t2_has_previous_summary, t2_format_followed, t2_understands_blockwise, t2_understands_retraining, t2_understands_groundtruth"
_T3 = f"t3_output_type, t3_parse_success, t3_extra_text_flag, t3_forecast_list, t3_forecast_length, {_FLAGS3}, t3_correct_block_size"
SQL = {
    "turn0_records": f"{CTES} select file_id, {_T0}, t0_format_followed from r",
    "turn3_records": f"{CTES} select file_id, md5(t3_raw_response) as raw_digest, md5(t3_script_content) as script_digest, {_T3} from r",
    "master_record": f"{CTES} select {_NAMES}, {_T0}, t0_format_followed, {_T1}, {_T2}, md5(t3_raw_response) as t3_raw_response, md5(t3_script_content) as t3_script_content, {_T3}, script_file, raw_file, analysis_status from r",
}
