"""Text, transcript and taxonomy queries, with their SQL.

The driver's texts are invented words, so that each query first renders what it parses from
columns; the expressions are such that both engines read them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from foretally.functions import text as T
from foretally.functions.numeric import r6
from foretally.operators import taxonomy, transcripts
from foretally.sources.tables import table

_NL = "chr(10)"
#: A last answer: script, list, error or prose.
RESPONSE = f"""case doc_id % 4
 when 0 then 'import numpy as np' || {_NL} || 'np.random.seed(' || doc_id || ')' || {_NL} || 'n_train = ' || n_chars || {_NL} || case when doc_id % 8 = 0 then 'for i in range(3):' || {_NL} || '    m.fit(x)' || {_NL} else '' end || 'block_size = ' || (10 + doc_id % 3) || {_NL} || case when doc_id % 12 = 0 then 'print(x)' else 'print(forecasts)' end
 when 1 then case when doc_id % 3 = 0 then '[' || doc_id || ', np.float64(' || n_chars || '.5), ' || (doc_id % 7) || ',]' when doc_id % 3 = 1 then '[' || doc_id || ', ' || n_chars || '.5]' else '[1, true, 3]' end
 when 2 then case when doc_id % 3 = 0 then 'Answer: [' || n_chars || ', 2, -3e2] or [4, 5]' else 'ERROR' end
 else left(text, 200) end"""
#: An answer with labelled fields.
ANSWER = f"""'Rows: ' || n_chars || {_NL} || 'Trend - ' || lang || {_NL} || case when doc_id % 2 = 0 then 'Seasonality:  ' || source || '  ' || {_NL} else '' end || 'Stationarity:' || {_NL} || 'Outliers: none'"""
#: What errors and logs are made of; two or three of these stand in each log, in every order.
ERRORS = (
    "", "boom", "Script timed out after 900 seconds", "Forecast length mismatch: expected 29, got 24", "No Python forecast list found", "IndentationError: unexpected indent", "ModuleNotFoundError: No module named x", "script exited with code 1",
    "previous failure", "Unsupported output type: text", "script exited with code 2", "TIMEOUT AFTER 5", "previous script execution failed", "boom",
)
STARTS = ("STDOUT\n[1.5, 2]\n", "STDOUT\n\n", "", "STDOUT\nabc\n", "STDOUT\n[np.float64(1.5), np.float64(2)]\n", "STDOUT\n[1, [2, 3]]\n", "STDOUT\ntensor(2)\n", "STDOUT\n[]\n", "STDOUT\n['a', 1]\n", "note\n")
MARKS = (
    "SyntaxError: x", "IndentationError: y", "TIMEOUT after 900 seconds", "it timed out", "NameError: name 'pd' is not defined", "NameError: name 'zz' is not defined", "AttributeError: a", "ValueError: Invalid frequency: M", "ValueError: bad", "TypeError: t",
    "KeyError: 'a'", "ImportError: i", "ModuleNotFoundError: m", "IndexError: 3", "RuntimeError: size of tensor a", "RuntimeError: r", "Traceback (most recent call last):", "  torch/nn/modules", "  statsmodels/tsa", "  pandas/core", "  sklearn/base", "  lightgbm/engine",
    "UserWarning: u", "ValueWarning: v", "LGBMRegressor note", "plain line", "", "7 lines",
)


def _sql_text(s: str) -> str:
    return "(" + f" || {_NL} || ".join("'" + part.replace("'", "' || chr(39) || '") + "'" for part in s.split("\n")) + ")"


def _pick(of: tuple[str, ...], number: str) -> str:
    return f"case {number} % {len(of)} " + " ".join(f"when {i} then {_sql_text(e)}" for i, e in enumerate(of)) + " end"


ERROR = _pick(ERRORS, "(doc_id * 5 + 3)")
_WEAK = MARKS[16:]
LOG = f"""{_pick(STARTS, 'doc_id')} || case when doc_id % 3 = 0 then '' else {_NL} || 'STDERR' || {_NL} end || case when doc_id % 2 = 1 then {_pick(MARKS, '(doc_id * 11)')} else {_pick(_WEAK, '(doc_id * 5)')} end || {_NL}
 || case when doc_id % 4 = 0 then '' else {_pick(_WEAK, '(doc_id * 7 + 5)')} || {_NL} end || case when doc_id % 5 = 0 then {_pick(MARKS, '(doc_id * 3 + 9)')} || {_NL} else '' end"""
STATUS = "case when doc_id % 19 = 0 then 'ok' else 'FAIL' end"
OUTPUT = "case when doc_id % 28 = 13 then 'ERROR' when doc_id % 28 = 27 then 'TEXT' else 'SCRIPT' end"


def rendered(docs, *keep, **columns):
    """keep and the rendered columns, behind a generator: what reads them sees columns, as of a stored table, and not their expressions."""
    return docs.select(*keep, F.inline(F.array(F.struct(*[F.expr(e).alias(k) for k, e in columns.items()]))))


def _docs(spark, sf_dir, **columns):
    return rendered(table(spark, sf_dir, "documents"), "doc_id", "source", "lang", **columns)


def turns_pivot(spark, sf_dir):
    t = transcripts.turn_columns(table(spark, sf_dir, "conversations"))
    return t.select("conv_id", *[F.char_length(f"t{i}").alias(f"t{i}_chars") for i in range(4)], "n_turns")


def turn_fallback(spark, sf_dir):
    return transcripts.turn_columns(table(spark, sf_dir, "conversations")).select("conv_id", "t3")


def turns_rendered(spark, sf_dir):
    """Conversations written as one text and taken apart again: the assistant's turns must be those of the table, but for Turn 1, which is answered again at the end."""
    again = F.expr("'===== TURN 1 ASSISTANT (again) =====' || chr(10) || 'again ' || conv_id")
    r = transcripts.render(table(spark, sf_dir, "conversations")).select("conv_id", F.concat("transcript", again).alias("transcript"))
    parts = r.select("conv_id", F.explode(transcripts.turns(F.col("transcript"))).alias("turn", "text"))
    return parts.select("conv_id", "turn", F.md5(T.strip(F.col("text"))).alias("digest"))


def prompt_words(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(T.word_count(F.col("text"))).alias("words"))


def chat_render(spark, sf_dir):
    return transcripts.render(table(spark, sf_dir, "conversations")).select("conv_id", F.md5("transcript").alias("digest"), F.char_length("transcript").alias("chars"))


def field_extract(spark, sf_dir):
    d = _docs(spark, sf_dir, a=ANSWER)
    return d.select("doc_id", *[T.field(F.col("a"), x).alias(x.lower()) for x in ("Rows", "Trend", "Seasonality", "Stationarity", "Missing")])


def header_flags(spark, sf_dir):
    d = _docs(spark, sf_dir, a=ANSWER)
    return d.groupBy("lang").agg(*[F.count(F.when(T.has_header(F.col("a"), x), 1)).alias(f"has_{x.lower()}") for x in ("Rows", "Seasonality", "Drift")])


def classify_output(spark, sf_dir):
    return _docs(spark, sf_dir, r=RESPONSE).select("doc_id", transcripts.output_type(F.col("r")).alias("output_type"))


def validate_response(spark, sf_dir):
    return _docs(spark, sf_dir, r=RESPONSE).select("doc_id", F.inline(F.array(transcripts.validate(F.col("r"), F.lit(3)))))


def script_format(spark, sf_dir):
    return _docs(spark, sf_dir, r=RESPONSE).groupBy("lang").agg(F.count(F.when(transcripts.is_script(F.col("r")), 1)).alias("scripts"), F.count("*").alias("n"))


def code_feature_flags(spark, sf_dir):
    d = _docs(spark, sf_dir, r=RESPONSE).withColumn("scenario", F.when(F.col("doc_id") % 3 == 0, "S4").otherwise("S1"))
    ok = transcripts.block_size_ok(F.col("r"), F.col("scenario"), F.lit(12))
    flags = d.select("doc_id", *[F.regexp_like("r", F.lit(transcripts.CODE_FLAGS[k])).alias(k) for k in ("seed", "split", "retraining", "prints", "torch")], ok.alias("block_ok"), F.char_length(transcripts.code_of(F.col("r"))).alias("code_chars"))
    return flags


def page_flags(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.regexp_like("html", F.lit(r"track\(\d+\)")).alias("tracks"), F.regexp_like("html", F.lit(r"(?i)<h1>")).alias("headed"), F.regexp_extract("html", r'lang="(\w+)"', 1).alias("lang"))


def _failures(spark, sf_dir):
    d = _docs(spark, sf_dir, status=STATUS, output=OUTPUT, error=ERROR, log=LOG)
    return d.withColumn("category", taxonomy.category(F.col("status"), F.col("output"), F.col("error"), F.col("log")))


def failure_taxonomy(spark, sf_dir):
    return _failures(spark, sf_dir).select("doc_id", "category", taxonomy.group(F.col("category")).alias("error_group"))


def failure_group_share(spark, sf_dir):
    from foretally.operators.summary import category_share

    return category_share(_failures(spark, sf_dir).withColumn("error_group", taxonomy.group(F.col("category"))), "error_group", "lang")


def failure_details(spark, sf_dir):
    return taxonomy.details(_failures(spark, sf_dir).select("lang", "doc_id", "category", "error"), "lang", "doc_id")


def previous_failures(spark, sf_dir):
    d = _docs(spark, sf_dir, log=LOG)
    path = F.concat(F.lit("logs/"), F.col("doc_id").cast("string"))
    return d.select("doc_id", taxonomy.previous_failure(F.col("log"), path, F.lit(3)).alias("reason"))


def log_tail(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    t = T.tail(F.col("text"), 2)
    return d.select("doc_id", F.md5(t).alias("digest"), F.char_length(t).alias("chars"))


_VECTOR = "'Forecast: [' || cast(round(v1 * 1000) as int) || ', ' || cast(round(v2 * 1000) as int) || ', ' || cast(round(v3 * 1000) as int) || case when vec_id % 5 = 0 then ', x' else '' end || '] end' || case when vec_id % 3 = 0 then ' [7, ' || vec_id || ']' else '' end"


def _in_floats(expression: str) -> str:
    """An expression of the SQL, where a float times 1000 is a float, for Spark, where it would be a double: what is a half in one needn't be in the other."""
    return expression.replace("* 1000)", "* 1000F)")


def _vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", *[F.col("embedding")[i].alias(f"v{i + 1}") for i in range(3)]).withColumn("text", F.expr(_in_floats(_VECTOR)))


def list_literals(spark, sf_dir):
    d = _vectors(spark, sf_dir)
    text = lambda x: F.array_join(F.transform(x, lambda v: v.cast("long").cast("string")), ",")
    return d.select("vec_id", text(T.first_list(F.col("text"))).alias("first_values"), text(T.last_list(F.col("text"))).alias("last_values"))


def shortened_texts(spark, sf_dir):
    """Texts as a report shows them: up to 160 characters and dots for the rest."""
    x = T.shortened(F.col("text"), 160)
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(x).alias("digest"), F.char_length(x).alias("chars"))


#: Whole vectors as lists of any depth, behind an apostrophe and a list of words.
_NESTED_LISTS = "'it' || chr(39) || 's [old] ' || repeat('[', cast(vec_id % 6 as int)) || {values} || repeat(']', cast(vec_id % 6 as int)) || ' done'"


def last_literals(spark, sf_dir):
    text = F.expr(_NESTED_LISTS.format(values=_in_floats("array_join(transform(embedding, x -> cast(cast(round(x * 1000) as int) as string)), ', ')")))
    d = rendered(table(spark, sf_dir, "embeddings").withColumn("text", text), "vec_id", x="text")
    literal = T.last_literal(F.col("x"))
    return d.select("vec_id", F.md5(literal).alias("digest"), F.char_length(literal).alias("chars"), T.list_problem(F.col("x")).alias("problem"), F.size(T.last_list(F.col("x"))).alias("n"))


def list_explode(spark, sf_dir):
    d = _vectors(spark, sf_dir)
    return d.select("vec_id", F.posexplode(T.last_list(F.col("text"))).alias("t", "forecast"))


def list_length_check(spark, sf_dir):
    n = F.size(T.last_list(F.col("text")))
    d = _vectors(spark, sf_dir).select("label", transcripts.analysis_status(F.lit(""), F.lit("LIST"), F.when(n >= 0, n), F.lit(3)).alias("status"))
    return d.groupBy("label", "status").agg(F.count("*").alias("n"))


def normalise_text(spark, sf_dir):
    x = F.concat(F.lit("  "), F.replace("p_name", F.lit(" "), F.lit("__")), F.lit("\t"), F.upper("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", T.normalize_text(x).alias("name"))


def slugify(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.slugify(F.concat_ws(" / ", "p_brand", "p_type")).alias("slug"), T.alnum(F.col("p_brand")).alias("plain"))


def strip_fences(spark, sf_dir):
    x = f"'code ' || doc_id || {_NL} || '```' || case when doc_id % 2 = 0 then {_NL} || ' ``` ' || {_NL} else '' end"
    return _docs(spark, sf_dir, x=x).select("doc_id", T.strip_fences(F.col("x")).alias("code"))


def alias_map(spark, sf_dir):
    x = F.concat(F.when(F.col("turn") % 3 == 0, "Scenario ").when(F.col("turn") % 3 == 1, "s").otherwise(""), (F.col("turn") % 4 + 1).cast("string"))
    role = T.mapped(F.col("role"), {"assistant": "model", "user": "person"})
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.scenario_name(x).alias("scenario"), role.alias("speaker"))


_CATEGORIES = {"steel": "metal", "brass": "metal", "tin": "metal", "small": "size", "economy": "grade", "promo": "grade", "standard": "grade"}


def category_keywords(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(T.first_keyword(F.col("p_type"), _CATEGORIES).alias("category")).agg(F.count("*").alias("n"))


_PARAMS = "'Order = (1, ' || (doc_id % 3) || ', 1); n_lags=' || (doc_id % 5) || ' alpha = 0.' || (doc_id % 9 + 1)"
_CODE = "'fit(n_lags=' || (doc_id % 4) || ', alpha=0.' || (doc_id % 9 + 1) || ' order=(1, 2, 1))'"


def hyperparam_tokens(spark, sf_dir):
    return _docs(spark, sf_dir, x=_PARAMS).select("doc_id", F.array_join(T.hyperparameter_tokens(F.col("x")), "|").alias("tokens"))


def token_coverage(spark, sf_dir):
    d = _docs(spark, sf_dir, x=_PARAMS, c=_CODE)
    cover = T.token_coverage(T.hyperparameter_tokens(F.col("x")), F.col("c"))
    return d.select("doc_id", r6(cover).alias("coverage"), (cover >= 0.6).alias("matches"))


QUERIES = {f.__name__: f for f in (
    turns_pivot, turn_fallback, turns_rendered, prompt_words, chat_render, field_extract, header_flags, classify_output, validate_response, script_format, code_feature_flags, page_flags, failure_taxonomy, failure_group_share,
    failure_details, previous_failures, log_tail, list_literals, last_literals, shortened_texts, list_explode, list_length_check, normalise_text, slugify, strip_fences, alias_map, category_keywords, hyperparam_tokens, token_coverage,
)}

_ASSISTANT = "a as (select conv_id, turn, text, row_number() over (partition by conv_id order by turn) - 1 as k from conversations where role = 'assistant')"
_PIVOT = _ASSISTANT + ", t as (select conv_id, max(text) filter (k = 0) as t0, max(text) filter (k = 1) as t1, max(text) filter (k = 2) as t2, coalesce(max(text) filter (k = 3), arg_max(text, k)) as t3, count(*) as n_turns from a group by 1)"
_RENDERED = "x as (select conv_id, string_agg('===== TURN ' || turn || ' ' || upper(role) || ' =====' || chr(10) || coalesce(text, '') || chr(10), '' order by turn) as s from conversations group by 1)"
_D = f"d as (select *, {RESPONSE} as r, {ANSWER} as a from documents)"
_NUM = r"[+-]?(\d[\d_]*\.?\d*|\.\d+)([eE][+-]?\d+)?"
_FLAT = rf"^\[\s*{_NUM}\s*(,\s*{_NUM}\s*)*\]$"
_ANY_LIST = rf"\[\s*{_NUM}\s*(,\s*{_NUM}\s*)*\]"
_PLAIN = r"regexp_replace(regexp_replace(r, 'np\.float64\(([^()]+)\)', '\1', 'g'), ',\s*\]', ']', 'g')"
_START = r"(?m)^(import\s+\w+|from\s+\w+\s+import|class\s+\w+\s*[\(:]|def\s+\w+\s*\(|(random|np|torch|pd|plt)\.\w+\s*\(|(np|torch)\.random\.\w+)"
_IS_SCRIPT = r"(not contains(r, '```') and regexp_matches(r, '(?m)(^\s*(import|from)\s+\w+|^\s*def\s+\w+\s*\(|^\s*class\s+\w+|^\s*\w+\s*=\s*|^\s*for\s+\w+|^\s*if\s+)') and (regexp_matches(r, '(?i)print\([^\n]*(forecast|predict|preds)') or regexp_matches(regexp_extract(rtrim(r, chr(10)), '([^\n]*)$', 1), '(?i)forecast|predict|preds')))"
_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
def _has(x: str, *marks: str) -> str:
    return "(" + " or ".join(f"contains({x}, '{m}')" for m in marks) + ")"


_RUN = f"""case when {_has('tl', 'valueerror')} then case when {_has('tl', 'invalid frequency')} then 'SCRIPT_PANDAS_FREQUENCY_ERROR' else 'SCRIPT_VALUE_ERROR' end when {_has('tl', 'keyerror')} then 'SCRIPT_KEY_ERROR' when {_has('tl', 'indexerror')} then 'SCRIPT_INDEX_ERROR'
 when {_has('tl', 'runtimeerror')} then case when {_has('tl', 'tensor')} then 'SCRIPT_TENSOR_SHAPE_ERROR' else 'SCRIPT_RUNTIME_ERROR' end when {_has('tl', 'typeerror')} then 'SCRIPT_TYPE_ERROR' when {_has('tl', 'attributeerror')} then 'SCRIPT_ATTRIBUTE_ERROR' when {_has('tl', 'nameerror')} then 'SCRIPT_NAME_ERROR' else 'SCRIPT_RUNTIME_ERROR' end"""
_DEEP = rf"""case when {_has('lo', 'syntaxerror', 'indentationerror')} then 'SCRIPT_SYNTAX_ERROR' when {_has('lo', 'timed out', 'timeout after')} then 'TIMEOUT'
 when {_has('lo', 'nameerror')} then case when {_has('lo', "''pd'' is not defined", "''np'' is not defined")} or ({_has('lo', 'torch')} and {_has('lo', 'is not defined')}) then 'SCRIPT_MISSING_IMPORT' else 'SCRIPT_NAME_ERROR' end
 when {_has('lo', 'attributeerror')} then 'SCRIPT_ATTRIBUTE_ERROR' when {_has('lo', 'valueerror')} then 'SCRIPT_VALUE_ERROR' when {_has('lo', 'typeerror')} then 'SCRIPT_TYPE_ERROR' when {_has('lo', 'keyerror')} then 'SCRIPT_KEY_ERROR' when {_has('lo', 'importerror', 'modulenotfounderror')} then 'SCRIPT_MISSING_PACKAGE'
 when {_has('lo', 'traceback')} then case when {_has('lo', 'torch')} then 'SCRIPT_TORCH_ERROR' when {_has('lo', 'statsmodels')} then 'SCRIPT_STATSMODELS_ERROR' when {_has('lo', 'pandas')} then 'SCRIPT_PANDAS_ERROR' when {_has('lo', 'sklearn', 'xgboost', 'lightgbm')} then 'SCRIPT_SKLEARN_ERROR' else 'SCRIPT_RUNTIME_ERROR' end
 when so and not se then case when {_has('sx', 'np.float', 'np.int')} then 'FORECAST_NUMPY_WRAPPED' when {_has('sx', 'tensor(')} then 'FORECAST_TENSOR_WRAPPED' when regexp_matches(sx, '[\d.]+') then 'FORECAST_PARSE_FAILURE' else 'SCRIPT_EMPTY_OUTPUT' end
 when {_has('lo', 'userwarning', 'valuewarning')} then case when {_has('lo', 'sklearn', 'lgbmregressor', 'lightgbm')} then 'SCRIPT_MODEL_WARNING_OUTPUT' when {_has('lo', 'statsmodels')} then 'SCRIPT_STATSMODELS_WARNING' when {_has('lo', 'torch')} then 'SCRIPT_TORCH_WARNING' else 'FORECAST_PARSE_FAILURE' end
 when not so and not se then 'SCRIPT_NO_OUTPUT' else 'OTHER_FAIL' end"""
_FAILED = rf"""f0 as (select doc_id, lang, upper({STATUS}) as status, {OUTPUT} as output, {ERROR} as error, {LOG} as log from documents),
f1 as (select *, lower(log) as lo, lower(array_to_string(string_split(log, chr(10))[greatest(len(string_split(log, chr(10))) - 39, 1):], chr(10))) as tl, regexp_matches(log, '(?:^|\n)STDOUT\s*\n\s*\S') as so, regexp_matches(log, '(?:^|\n)STDERR\s*\n\s*\S') as se, substr(log, strpos(log, 'STDOUT') + 6) as sx from f0),
f2 as (select *, lower(error) || chr(10) || tl as bt from f1),
f3 as (select *, case when status = 'OK' then 'OK' when output = 'ERROR' or {_has('bt', 'unsupported output type: error')} then 'MODEL_RETURNED_ERROR' when output = 'TEXT' or {_has('bt', 'unsupported output type: text')} then 'UNSTRUCTURED_TEXT_OUTPUT' when {_has('bt', 'timed out', 'timeout after')} then 'TIMEOUT'
  when {_has('bt', 'forecast length mismatch')} then 'FORECAST_LENGTH_MISMATCH' when {_has('bt', 'no python forecast list found')} then 'NO_FORECAST_LIST_FOUND' when {_has('bt', 'syntaxerror', 'indentationerror')} then 'SCRIPT_SYNTAX_ERROR' when {_has('bt', 'modulenotfounderror', 'importerror')} then 'MISSING_PACKAGE'
  when {_has('bt', 'script exited with code')} then {_RUN} when trim(error) <> '' then {_DEEP} else 'FAIL_UNKNOWN' end as category from f2)"""
_GROUP = "case when category = 'OK' then 'OK' when category in ('MODEL_RETURNED_ERROR', 'UNSTRUCTURED_TEXT_OUTPUT', 'FORECAST_LENGTH_MISMATCH', 'NO_FORECAST_LIST_FOUND', 'FORECAST_NUMPY_WRAPPED', 'FORECAST_TENSOR_WRAPPED', 'FORECAST_PARSE_FAILURE') then 'model/output issue' when starts_with(category, 'SCRIPT_') then 'code issue' else 'runtime/infra issue' end"
_VEC = f"v as (select vec_id, label, embedding[1] as v1, embedding[2] as v2, embedding[3] as v3 from embeddings), x as (select *, {_VECTOR} as text from v), l as (select *, list_filter(regexp_extract_all(text, '\\[[^\\[\\]]+\\]'), lambda s: regexp_matches(s, '^\\[[-0-9, ]+\\]$')) as ls from x)"
_NOISY = ", ".join(f"'{x}'" for x in T.NOISY)
_TOKENS = rf"""t0 as (select doc_id, trim(regexp_replace(lower(replace({_PARAMS}, '_', ' ')), '\s+', ' ', 'g')) as x, trim(regexp_replace(lower(replace({_CODE}, '_', ' ')), '\s+', ' ', 'g')) as c from documents),
t1 as (select doc_id, c, list_distinct(list_transform(list_concat(regexp_extract_all(x, '\b[a-z_][a-z0-9_]*\s*=\s*[-+]?\d+(?:\.\d+)?'), regexp_extract_all(x, '\b(?:order|seasonal_order)\s*[:=]\s*\(?\s*\d+\s*,\s*\d+\s*,\s*\d+'), regexp_extract_all(x, '\b[-+]?\d+(?:\.\d+)?\b')), lambda s: replace(s, ' ', ''))) as a from t0),
t2 as (select doc_id, c, case when len(a) <= 5 then a else list_filter(a, lambda s: s not in ({_NOISY})) end as k from t1)"""
_JOIN = "array_to_string(list_transform(string_split(trim({0}, '[]'), ','), lambda s: trim(s)), ',')"
SQL = {
    "turns_pivot": f"with {_PIVOT} select conv_id, length(t0) as t0_chars, length(t1) as t1_chars, length(t2) as t2_chars, length(t3) as t3_chars, n_turns from t",
    "turn_fallback": f"with {_PIVOT} select conv_id, t3 from t",
    "turns_rendered": f"""select conv_id, turn::int as turn, md5({_STRIP.format('text')}) as digest from conversations where role = 'assistant' and turn <> 1
union all select distinct conv_id, 1, md5('again ' || conv_id) from conversations""",
    "prompt_words": r"select conv_id, sum(len(regexp_extract_all(text, '\S+')))::bigint as words from conversations group by 1",
    "chat_render": f"with {_RENDERED} select conv_id, md5(s) as digest, length(s) as chars from x",
    "field_extract": f"with {_D} select doc_id, n_chars::varchar as rows, lang as trend, case when doc_id % 2 = 0 then source else '' end as seasonality, 'Outliers: none' as stationarity, '' as missing from d",
    "header_flags": f"with {_D} select lang, count(*) filter (regexp_matches(a, '(?i)rows')) as has_rows, count(*) filter (regexp_matches(a, '(?i)seasonality')) as has_seasonality, count(*) filter (regexp_matches(a, '(?i)drift')) as has_drift from d group by 1",
    "classify_output": f"with {_D} select doc_id, case when upper(trim(r)) = 'ERROR' then 'ERROR' when regexp_matches(r, '{_START}') then 'SCRIPT' when regexp_matches({_PLAIN}, '{_ANY_LIST}') then 'LIST' else 'TEXT' end as output_type from d",
    "validate_response": f"""with {_D}, e as (select doc_id, r, {_PLAIN} as p from d), f as (select *, regexp_matches(p, '{_FLAT}') as is_list, len(string_split(p, ',')) as k, {_IS_SCRIPT} as scr from e)
select doc_id, case when r = 'ERROR' then 'MODEL_ERROR_LITERAL' when is_list then 'OK_FORECAST_LIST' when length(r) > 16000 then 'INVALID_SCRIPT_TOO_LONG' when scr then 'OK_FORECAST_SCRIPT' else 'INVALID_SCRIPT_FORMAT' end as status,
  case when is_list then 'LIST' when r = 'ERROR' then 'ERROR' else 'SCRIPT' end as output_type, case when is_list then k::int end as actual_length, is_list and k <> 3 as length_mismatch, case when is_list then k = 3 else r <> 'ERROR' and length(r) <= 16000 and scr end as compliant from f""",
    "script_format": f"with {_D} select lang, count(*) filter ({_IS_SCRIPT}) as scripts, count(*) as n from d group by 1",
    "code_feature_flags": f"""with {_D} select doc_id, regexp_matches(r, 'np\\.random\\.seed') as seed, regexp_matches(r, 'n_train\\s*=\\s*\\d+') as split, contains(r, 'for i in range(3):') and contains(r, '.fit(') as retraining, contains(r, 'print(forecasts)') as prints,
  contains(r, 'import torch') as torch, case when doc_id % 3 <> 0 then true else regexp_matches(r, 'block_size = 12\\b') end as block_ok, case when regexp_matches(r, '{_START}') then length(r) else 0 end as code_chars from d""",
    "page_flags": r"""select page_id, regexp_matches(html, 'track\(\d+\)') as tracks, regexp_matches(html, '(?i)<h1>') as headed, regexp_extract(html, 'lang="(\w+)"', 1) as lang from pages""",
    "failure_taxonomy": f"with {_FAILED} select doc_id, category, {_GROUP} as error_group from f3",
    "failure_group_share": f"with {_FAILED}, g as (select lang, {_GROUP} as error_group, count(*) as n from f3 group by 1, 2) select *, (sum(n) over (partition by lang))::bigint as total, round(100.0 * n / sum(n) over (partition by lang), 2) as share from g",
    "failure_details": f"with {_FAILED} select lang, doc_id, category, error from f3 where category <> 'OK'",
    "previous_failures": rf"""with l as (select doc_id, {LOG} as log from documents), o as (select *, regexp_replace(string_split(log, chr(10) || 'STDERR' || chr(10))[1], '^STDOUT\s*\n', '') as so, coalesce(string_split(log, chr(10) || 'STDERR' || chr(10))[2], '') as se from l),
u as (select *, regexp_replace(so, 'np\.float64\(([^()]+)\)', '\1', 'g') as x from o), w as (select *, regexp_extract(x, '(?s)^.*(\[[^\[\]]*\])[^\]]*$', 1) as flat, regexp_matches(x, '(?s)\[[^\[\]]*\[[^\[\]]*\]\s*\][^\]]*$') as nested from u)
select doc_id, case when regexp_matches(log, 'TIMEOUT after \d+ seconds') then 'script timed out after ' || regexp_extract(log, 'TIMEOUT after (\d+) seconds', 1) || 's; see logs/' || doc_id when trim(se, chr(10) || ' ') <> '' then null when nested then 'forecast list is not flat' when flat = '' then 'no Python forecast list found'
  when contains(flat, chr(39)) then 'forecast list has an item that is no number' when flat = '[]' then 'forecast length mismatch: expected 3, got 0' else 'forecast length mismatch: expected 3, got ' || len(string_split(flat, ',')) end as reason from w""",
    "log_tail": "with p as (select doc_id, string_split(text, chr(10)) as s from documents), t as (select doc_id, array_to_string(s[greatest(len(s) - 1, 1):], chr(10)) as t from p) select doc_id, md5(t) as digest, length(t) as chars from t",
    "list_literals": f"with {_VEC} select vec_id, {_JOIN.format('ls[1]')} as first_values, {_JOIN.format('ls[-1]')} as last_values from l",
    "shortened_texts": "with s as (select doc_id, case when length(text) > 160 then left(text, 160) || '...' else text end as x from documents) select doc_id, md5(x) as digest, length(x) as chars from s",
    "last_literals": f"""with t as (select vec_id, {_NESTED_LISTS.format(values="array_to_string(list_transform(embedding, lambda x: cast(cast(round(x * 1000) as int) as varchar)), ', ')")} as x from embeddings),
l as (select vec_id, regexp_extract(x, '(\\[[\\[0-9, -]*\\]+) done$', 1) as lit from t)
select vec_id, md5(lit) as digest, length(lit) as chars, case when lit = '' then 'no Python forecast list found' when lit like '[[%' then 'forecast list is not flat' end as problem, case when regexp_matches(lit, '^\\[[^\\[]') then len(string_split(lit, ',')) end as n from l""",
    "list_explode": f"with {_VEC}, e as (select vec_id, list_transform(string_split(trim(ls[-1], '[]'), ','), lambda s: cast(trim(s) as double)) as f from l where len(ls) > 0) select vec_id, unnest(generate_series(0, len(f) - 1))::int as t, unnest(f) as forecast from e",
    "list_length_check": f"with {_VEC} select label, case when len(ls) = 0 then 'INVALID_OUTPUT' when len(string_split(ls[-1], ',')) = 3 then 'OK_FORECAST_LIST' else 'INVALID_LIST_LENGTH' end as status, count(*) as n from l group by 1, 2",
    "normalise_text": r"select p_partkey, trim(regexp_replace(lower(p_name) || ' ' || lower(p_brand), '\s+', ' ', 'g')) as name from part",
    "slugify": r"select p_partkey, trim(regexp_replace(lower(p_brand || ' / ' || p_type), '[^a-z0-9]+', '-', 'g'), '-') as slug, regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g') as plain from part",
    "strip_fences": "select doc_id, 'code ' || doc_id as code from documents",
    "alias_map": "select conv_id, turn, 'S' || (turn % 4 + 1) as scenario, case role when 'assistant' then 'model' when 'user' then 'person' else role end as speaker from conversations",
    "category_keywords": "select case " + " ".join(f"when contains(lower(p_type), '{k}') then '{v}'" for k, v in _CATEGORIES.items()) + " else 'Unknown' end as category, count(*) as n from part group by 1",
    "hyperparam_tokens": f"with {_TOKENS} select doc_id, array_to_string(list_sort(k), '|') as tokens from t2",
    "token_coverage": f"with {_TOKENS}, s as (select doc_id, len(list_filter(k, lambda x: contains(c, x))) / len(k) as v from t2) select doc_id, round(v, 6) as coverage, v >= 0.6 as matches from s",
}
