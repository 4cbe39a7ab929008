"""Protocol and compliance queries, with their SQL: over the records of master.py, whose flags are parsed from whole chat logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from foretally.operators import master, protocol, records
from foretally.plans import master as logs
from foretally.plans.texts import rendered
from foretally.sources.tables import table

_SCORES = ["format_score", "scenario_score", "code_score", "model_score", "turn0_score", "turn1_score", "turn2_score", "turn3_score", "overall_score"]
_FLAGS = list(master.CHECKS.values())
#: The scenarios as a prompt describes them.
PROMPT = """Scenario 1: Static.
Model retraining: NOT performed. Use of ground truth during inference: disabled (no updates).
Scenario 2: Rolling one step.
Model retraining: performed at every step. Use of ground truth during inference: enabled.
Scenario 3: Multi-step ahead prediction.
The model is retrained after each horizon. Ground truth is enabled.
Scenario 4: Block-wise rolling update. Block size: 12.
Model retraining: performed after each block. Use of ground truth during inference: enabled.
Scenario 5: Free.
Anything goes."""


def _checks(spark, sf_dir):
    return master.flags(master.checked(*logs.runs(spark, sf_dir)), "file_id", "scenario", "ok")


def _scored(spark, sf_dir):
    return protocol.scores(_checks(spark, sf_dir), "file_id", "output_type", "scenario")


def protocol_checks(spark, sf_dir):
    c = _checks(spark, sf_dir)
    return c.groupBy("output_type").agg(F.count("*").alias("n"), *[F.count(F.when(F.col(k), 1)).alias(k) for k in [*_FLAGS, "ok"]])


def protocol_scores(spark, sf_dir):
    return _scored(spark, sf_dir)


def protocol_summary(spark, sf_dir):
    return protocol.score_summary(_scored(spark, sf_dir), _SCORES, "output_type", "scenario")


def protocol_success(spark, sf_dir):
    """Point-biserial association of each score with success."""
    from foretally.operators.stats import point_biserial

    rows = _scored(spark, sf_dir).join(_checks(spark, sf_dir).select("file_id", "ok"), "file_id")
    long = rows.select("ok", F.inline(F.array(*[F.struct(F.lit(s).alias("score"), F.col(s).alias("value")) for s in _SCORES])))
    return point_biserial(long, F.col("ok"), F.col("value"), "score")


def _requirements(spark):
    return protocol.scenario_requirements(spark.createDataFrame([(PROMPT,)], "text string"))


#: A document's text, then two scenarios whose demands vary with its id, in either engine.
_NL = "chr(10)"
_PROMPTS = f"""text || {_NL} || 'Scenario ' || (doc_id % 4 + 1) || ': ' || case doc_id % 3 when 0 then 'Multi-Step Ahead Prediction' when 1 then 'Block size: ' || (doc_id % 24) else 'plain' end || {_NL}
 || case doc_id % 5 when 0 then 'Model retraining: NOT performed.' when 1 then 'Model retraining: performed often' when 2 then 'It is retrained after each step' else 'Fit it.' end || {_NL} || '  Scenario ' || (doc_id % 7 + 5) || ': ' || {_NL}
 || case doc_id % 4 when 0 then 'Use of ground truth during inference: disabled' when 1 then 'Ground truth is Enabled' when 2 then 'blockwise, forecast multiple steps ahead; disabled (no updates)' else '' end || {_NL} || 'Scenario ' || (doc_id % 7 + 5) || ': as before' || {_NL}"""


def scenario_requirements(spark, sf_dir):
    """What prompts ask for: each holds a document and scenarios that begin at a line's start."""
    prompts = rendered(table(spark, sf_dir, "documents"), "doc_id", text=_PROMPTS)
    return protocol.scenario_requirements(prompts, "doc_id")


def protocol_table(spark, sf_dir):
    """The summary by scenario and model."""
    return protocol.group_summary(logs.protocol_details(spark, sf_dir), "scenario", "llm_version")


def protocol_table_by_branch(spark, sf_dir):
    return protocol.group_summary(logs.protocol_details(spark, sf_dir), "branch")


def scenario_design(spark, sf_dir):
    """The design beside the runs that there are of each scenario."""
    parts = rendered(table(spark, sf_dir, "documents"), "doc_id", file_id=logs.FILE)
    names = dict(zip(("part", "dataset", "scenario", "branch", "llm", "run"), records.file_parts(F.col("file_id")), strict=True))
    return protocol.scenario_design(parts.select(names["scenario"].alias("scenario"), names["dataset"].alias("dataset")))


def _runs(spark, sf_dir):
    c = _checks(spark, sf_dir)
    seen = c.select("file_id", "scenario", "ok", *[F.col(k).alias(f"t2_{k}") for k in protocol.SUPPORTED], F.col("t3_retraining"), F.col("t3_truth").alias("t3_ground_truth"), F.col("t3_block").alias("t3_blockwise"))
    return seen.join(F.broadcast(_requirements(spark)), "scenario")  # five rows


def compliance_per_run(spark, sf_dir):
    return protocol.compliance(_runs(spark, sf_dir), "file_id", "scenario")


def compliance_summary(spark, sf_dir):
    return protocol.compliance_summary(protocol.compliance(_runs(spark, sf_dir), "scenario", "ok"), "scenario")


def requirement_summary(spark, sf_dir):
    return protocol.requirement_summary(_runs(spark, sf_dir), "scenario")


def verification_sample(spark, sf_dir):
    """Up to three runs of each scenario for a look by hand, the same whenever asked."""
    from pyspark.sql import Window

    w = Window.partitionBy("scenario").orderBy(F.md5(F.concat(F.lit("7:"), F.col("file_id"))))
    return compliance_per_run(spark, sf_dir).withColumn("i", F.row_number().over(w)).where("i <= 3").select("scenario", "file_id", "semantic", "implementation")


QUERIES = {f.__name__: f for f in (protocol_checks, protocol_scores, protocol_summary, protocol_success, scenario_requirements, protocol_table, protocol_table_by_branch, scenario_design, compliance_per_run, compliance_summary, requirement_summary, verification_sample)}

_C = logs.CTES + ", c as (select file_id, scenario, ok, t3_output_type as output_type, " + ", ".join(f"{k} as {v}" for k, v in master.CHECKS.items()) + " from k)"


def _share(flags: list[str]) -> str:
    known = " + ".join(f"coalesce(({f})::int, 0)" for f in flags)
    n = " + ".join(f"(({f}) is not null)::int" for f in flags)
    return f"round(100.0 * ({known}) / nullif({n}, 0), 2)"


_SC, _CO, _MO = list(protocol.SCENARIO_FLAGS), list(protocol.CODE_FLAGS), list(protocol.MODEL_FLAGS)
_EX = "not t3_extra"
_PARTS = (
    _C
    + f""", ss as (select file_id, output_type, scenario, ok, {_share(["t0_format", "t1_format", "t1_previous", "t2_format", "t2_previous", _EX])} as format_score, {_share(_SC)} as scenario_score,
  case output_type when 'SCRIPT' then {_share(_CO)} when 'LIST' then {_share(_CO[:1])} else 0.0 end as code_score, case when output_type = 'SCRIPT' then {_share(_MO)} end as model_score,
  {_share(["t0_format"])} as turn0_score, {_share(["t1_format", "t1_previous", "not t1_overcleaned"])} as turn1_score, {_share(["t2_format", "t2_previous", *_SC])} as turn2_score,
  case output_type when 'SCRIPT' then {_share([_EX, *_CO, *_MO])} when 'LIST' then {_share([_EX, *_CO[:1]])} else {_share([_EX, "false"])} end as turn3_score from c),
oo as (select *, round(list_avg(list_filter([format_score, scenario_score, code_score, model_score], lambda x: x is not null)), 2) as overall_score,
  turn0_score = 100 and turn1_score = 100 and turn2_score = 100 and turn3_score = 100 as strict from ss)"""
)
_COLS = ", ".join(_SCORES)
_REQ = "rq(scenario, expected_retraining, expected_ground_truth, expected_blockwise, expected_multistep) as (values ('S1', false, false, null::boolean, null::boolean), ('S2', true, true, null, null), ('S3', true, true, null, true), ('S4', true, true, true, null), ('S5', null, null, null, null))"
_RUNS = _C + ", " + _REQ + """, rr as (select file_id, c.scenario, ok, expected_retraining as e1, expected_ground_truth as e2, expected_blockwise as e3, retraining as s1, ground_truth as s2, blockwise as s3, t3_retraining as i1, t3_truth as i2, t3_block as i3 from c join rq using (scenario)),
kk as (select *, (e1 is not null)::int + (e2 is not null)::int + (e3 is not null)::int as n, coalesce((e1 = s1)::int, 0) + coalesce((e2 = s2)::int, 0) + coalesce((e3 = s3)::int, 0) as ks, coalesce((e1 = i1)::int, 0) + coalesce((e2 = i2)::int, 0) + coalesce((e3 = i3)::int, 0) as ki from rr),
pp as (select *, round(100.0 * ks / nullif(n, 0), 1) as semantic, round(100.0 * ki / nullif(n, 0), 1) as implementation, ks = n as fs, ki = n as fi from kk)"""
SQL = {
    "protocol_checks": _C + " select output_type, count(*) as n, " + ", ".join(f"count(*) filter ({k}) as {k}" for k in [*_FLAGS, "ok"]) + " from c group by 1",
    "protocol_scores": _PARTS + f" select file_id, output_type, scenario, {_COLS}, strict from oo",
    "protocol_summary": _PARTS + " select output_type, scenario, count(*) as n, " + ", ".join(f"coalesce(round(avg({s}), 2), 0.0) as mean_{s}" for s in _SCORES) + ", round(100.0 * count(*) filter (strict) / count(*), 2) as strict_pct from oo group by 1, 2",
    "protocol_success": _PARTS + ", ll as (" + " union all ".join(f"select ok, '{s}' as score, {s}::double as value from oo" for s in _SCORES) + ") select score, count(*) as n, round(case when isnan(corr(ok::int, value)) then null else corr(ok::int, value) end, 6) as r, round(avg(value) filter (ok), 6) as mean_true, round(avg(value) filter (not ok), 6) as mean_false, round(avg(value) filter (ok) - avg(value) filter (not ok), 6) as difference from ll where ok is not null and value is not null group by 1",
    "scenario_requirements": f"""with p as (select doc_id, {_PROMPTS} as x from documents),
b as (select doc_id, unnest(string_split_regex(x, '\\nScenario ')[2:]) as b from p),
l as (select doc_id, regexp_extract(b, '^(\\d+):', 1) as number, lower(b) as b from b)
select doc_id, 'S' || number as scenario, case when contains(b, 'model retraining: not performed') then false when contains(b, 'model retraining: performed') or contains(b, 'retrain after each') or contains(b, 'retrained after each') then true end as expected_retraining,
  case when contains(b, 'use of ground truth during inference: disabled') or contains(b, 'disabled (no updates') then false when contains(b, 'enabled') then true end as expected_ground_truth,
  case when contains(b, 'block-wise rolling update') or contains(b, 'block size:') or contains(b, 'blockwise') then true end as expected_blockwise, case when contains(b, 'multi-step ahead prediction') or contains(b, 'forecast multiple steps ahead') then true end as expected_multistep
from l where number <> ''""",
    "compliance_per_run": _RUNS + " select file_id, scenario, semantic, implementation, fs as full_semantic, fi as full_implementation, case when e3 is null then 'retraining,ground_truth' else 'retraining,ground_truth,blockwise' end as supported, case when e3 is null then 'blockwise' else '' end as unsupported from pp",
    "verification_sample": _RUNS + " select scenario, file_id, semantic, implementation from pp qualify row_number() over (partition by scenario order by md5('7:' || file_id)) <= 3",
    "compliance_summary": _RUNS + " select scenario, count(*) as n, round(avg(semantic), 1) as mean_semantic, round(avg(implementation), 1) as mean_implementation, count(*) filter (fs) || ' / ' || count(*) as full_semantic, count(*) filter (fi) || ' / ' || count(*) as full_implementation, round(100.0 * count(*) filter (fs and fi) / nullif(count(*) filter (fs), 0), 1) as implemented_given_semantic, round(100.0 * count(*) filter (fi and coalesce(ok, false)) / nullif(count(*) filter (fi), 0), 1) as success_given_implemented from pp group by 1",
    "requirement_summary": _RUNS + ", uu as (select scenario, 'retraining' as requirement, e1 as e, s1 as s, i1 as i from rr union all select scenario, 'ground_truth', e2, s2, i2 from rr union all select scenario, 'blockwise', e3, s3, i3 from rr) select scenario, requirement, count(e) as n, round(100.0 * count(*) filter (e = s) / nullif(count(e), 0), 1) as semantic_pct, round(100.0 * count(*) filter (e = i) / nullif(count(e), 0), 1) as implementation_pct from uu group by 1, 2",
}
_DESIGN = ", ".join(str(row) for row in protocol.DESIGN)
SQL["scenario_design"] = f"""with f as (select string_split(file_id, '-') as f from (select {logs.FILE} as file_id from documents)), n as (select f[3] as scenario, count(*) as runs, count(distinct f[2]) as datasets from f group by 1)
select d.*, coalesce(runs, 0) as runs, coalesce(datasets, 0) as datasets from (values {_DESIGN}) d(scenario, forecast_mode, update_mode, ground_truth, retraining, inference) left join n using (scenario)"""
#: The detail table holds checks and scores.
QUERIES["protocol_details"] = logs.protocol_details
SQL["protocol_details"] = _PARTS + ", n as (select file_id, dataset, scenario, branch, track, llm_version, run_id, t3_output_type as output_type, expected_model, expected_hyperparameters, " + ", ".join(master.CHECKS) + f" from k) select n.*, {_COLS}, strict from n join oo using (file_id)"


def _table_sql(keys: str) -> str:
    rate = lambda c, n: f"coalesce(round(100.0 * count(*) filter ({c}) / nullif({n}, 0), 2), 0.0)"
    kind = lambda k: f"count(*) filter (output_type = '{k}')"
    counts = f"count(*) as total_runs, {kind('SCRIPT')} as script_rows, round(100.0 * {kind('SCRIPT')} / count(*), 2) as script_rate_pct, {kind('LIST')} as list_rows, round(100.0 * {kind('LIST')} / count(*), 2) as list_rate_pct, {kind('ERROR')} as model_error_rows, {kind('TEXT')} as text_rows"
    means = ", ".join(f"coalesce(round(avg({c}), 2), 0.0) as {k}" for k, c in protocol.MEANS.items())
    rates = ", ".join([*[f"{rate(c, 'count(*)')} as {k}" for k, c in protocol.RATES.items()], *[f"{rate(c, f'count({c})')} as {k}" for k, c in protocol.KNOWN_RATES.items()]])
    details = SQL["protocol_details"].removeprefix("with ")
    return f"with {details.replace(' select n.*', ', de as (select n.*')}) select {keys}, {counts}, {means}, {rates} from de group by all"


SQL |= {"protocol_table": _table_sql("scenario, llm_version"), "protocol_table_by_branch": _table_sql("branch")}
