"""Failure taxonomy: ordered rules over error texts and logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretally.functions.text import any_marker, last_list, list_problem, strip, tail

Rules = tuple[tuple[str, str], ...]

#: Fixed values: (text in the lower-cased error, category), first hit first.
MESSAGE_RULES: Rules = (
    ("timed out", "TIMEOUT"), ("timeout after", "TIMEOUT"), ("forecast length mismatch", "FORECAST_LENGTH_MISMATCH"), ("no python forecast list found", "NO_FORECAST_LIST_FOUND"),
    ("syntaxerror", "SCRIPT_SYNTAX_ERROR"), ("indentationerror", "SCRIPT_SYNTAX_ERROR"), ("modulenotfounderror", "MISSING_PACKAGE"), ("importerror", "MISSING_PACKAGE"),
)
RUNTIME_RULES: Rules = (
    ("valueerror", "SCRIPT_VALUE_ERROR"), ("keyerror", "SCRIPT_KEY_ERROR"), ("indexerror", "SCRIPT_INDEX_ERROR"), ("runtimeerror", "SCRIPT_RUNTIME_ERROR"),
    ("typeerror", "SCRIPT_TYPE_ERROR"), ("attributeerror", "SCRIPT_ATTRIBUTE_ERROR"), ("nameerror", "SCRIPT_NAME_ERROR"),
)
LOG_RULES: Rules = (
    ("syntaxerror", "SCRIPT_SYNTAX_ERROR"), ("indentationerror", "SCRIPT_SYNTAX_ERROR"), ("timed out", "TIMEOUT"), ("timeout after", "TIMEOUT"), ("nameerror", "SCRIPT_NAME_ERROR"), ("attributeerror", "SCRIPT_ATTRIBUTE_ERROR"),
    ("valueerror", "SCRIPT_VALUE_ERROR"), ("typeerror", "SCRIPT_TYPE_ERROR"), ("keyerror", "SCRIPT_KEY_ERROR"), ("importerror", "SCRIPT_MISSING_PACKAGE"), ("modulenotfounderror", "SCRIPT_MISSING_PACKAGE"),
)
TRACE_LIBRARIES: Rules = (
    ("torch", "SCRIPT_TORCH_ERROR"), ("statsmodels", "SCRIPT_STATSMODELS_ERROR"), ("pandas", "SCRIPT_PANDAS_ERROR"), ("sklearn", "SCRIPT_SKLEARN_ERROR"), ("xgboost", "SCRIPT_SKLEARN_ERROR"), ("lightgbm", "SCRIPT_SKLEARN_ERROR"),
)
WARNINGS = ("userwarning", "valuewarning")
WARNING_LIBRARIES: Rules = (
    ("sklearn", "SCRIPT_MODEL_WARNING_OUTPUT"), ("lgbmregressor", "SCRIPT_MODEL_WARNING_OUTPUT"), ("lightgbm", "SCRIPT_MODEL_WARNING_OUTPUT"), ("statsmodels", "SCRIPT_STATSMODELS_WARNING"), ("torch", "SCRIPT_TORCH_WARNING"),
)
OUTPUT_ISSUES = ("MODEL_RETURNED_ERROR", "UNSTRUCTURED_TEXT_OUTPUT", "FORECAST_LENGTH_MISMATCH", "NO_FORECAST_LIST_FOUND", "FORECAST_NUMPY_WRAPPED", "FORECAST_TENSOR_WRAPPED", "FORECAST_PARSE_FAILURE")


def first_rule(x: Column, rules: Rules, default: Column) -> Column:
    """The category of the first rule whose text x holds."""
    return reduce(lambda rest, r: F.when(F.contains(x, F.lit(r[0])), F.lit(r[1])).otherwise(rest), reversed(rules), default)


def runtime_category(log: Column) -> Column:
    """Of a script that ended with an error, by the end of its log."""
    x = F.lower(log)
    has = lambda s: F.contains(x, F.lit(s))
    plain = first_rule(x, RUNTIME_RULES, F.lit("SCRIPT_RUNTIME_ERROR"))
    return (
        F.when((plain == "SCRIPT_VALUE_ERROR") & has("invalid frequency"), "SCRIPT_PANDAS_FREQUENCY_ERROR")
        .when((plain == "SCRIPT_RUNTIME_ERROR") & has("runtimeerror") & has("tensor"), "SCRIPT_TENSOR_SHAPE_ERROR").otherwise(plain)
    )


def log_category(log: Column) -> Column:
    """A second look at a whole log."""
    x = F.lower(log)
    has = lambda s: F.contains(x, F.lit(s))
    part = lambda name: F.regexp_like(log, F.lit(rf"(?:\A|\n){name}\s*\n\s*\S"))
    out, err = part("STDOUT"), part("STDERR")
    said = F.try_element_at(F.split(log, "STDOUT", 2), F.lit(2))
    only_out = (
        F.when(F.contains(said, F.lit("np.float")) | F.contains(said, F.lit("np.int")), "FORECAST_NUMPY_WRAPPED").when(F.contains(said, F.lit("tensor(")), "FORECAST_TENSOR_WRAPPED")
        .when(F.regexp_like(said, F.lit(r"[\d.]")), "FORECAST_PARSE_FAILURE").otherwise("SCRIPT_EMPTY_OUTPUT")
    )
    missing = has("'pd' is not defined") | has("'np' is not defined") | (has("torch") & has("is not defined"))
    named = first_rule(x, LOG_RULES, F.lit(None).cast("string"))
    warned = F.lit(False)
    for w in WARNINGS:
        warned = warned | has(w)
    return (
        F.when((named == "SCRIPT_NAME_ERROR") & missing, "SCRIPT_MISSING_IMPORT").when(named.isNotNull(), named).when(has("traceback"), first_rule(x, TRACE_LIBRARIES, F.lit("SCRIPT_RUNTIME_ERROR"))).when(out & ~err, only_out)
        .when(warned, first_rule(x, WARNING_LIBRARIES, F.lit("FORECAST_PARSE_FAILURE"))).when(~out & ~err, "SCRIPT_NO_OUTPUT").otherwise("OTHER_FAIL")
    )


def category(status: Column, output: Column, error: Column, log: Column) -> Column:
    """The failure category of a run; log is the whole log, null where none is stored."""
    e, end = F.coalesce(error, F.lit("")), F.coalesce(tail(log), F.lit(""))
    x = F.lower(F.concat(e, F.lit("\n"), end))
    has = lambda s: F.contains(x, F.lit(s))
    kind = F.upper(F.coalesce(output, F.lit("")))
    other = F.when(F.trim(e) != "", F.coalesce(log_category(log), F.lit("OTHER_FAIL"))).otherwise("FAIL_UNKNOWN")
    ran = F.when(has("script exited with code"), runtime_category(end)).otherwise(other)
    return (
        F.when(F.upper(F.coalesce(status, F.lit(""))) == "OK", "OK").when((kind == "ERROR") | has("unsupported output type: error"), "MODEL_RETURNED_ERROR")
        .when((kind == "TEXT") | has("unsupported output type: text"), "UNSTRUCTURED_TEXT_OUTPUT").otherwise(first_rule(x, MESSAGE_RULES, ran))
    )


def group(cat: Column) -> Column:
    return F.when(cat == "OK", "OK").when(cat.isin(*OUTPUT_ISSUES), "model/output issue").when(F.startswith(cat, F.lit("SCRIPT_")), "code issue").otherwise("runtime/infra issue")


#: What an exception's lower-cased text holds, by the system status it means.
TIMEOUT_MARKS = ("timeout", "timed out", "read timeout", "connect timeout", "deadline exceeded", "operation timed out")
RATE_MARKS = ("rate limit", "429", "too many", "quota", "ratelimit", "resource_exhausted")
SERVER_MARKS = ("500", "502", "503", "504", "bad gateway", "service unavailable", "connection reset", "server error", "internal server error", "overloaded")


def system_status(message: Column) -> Column:
    """The system status of an exception's text."""
    return F.when(any_marker(message, TIMEOUT_MARKS), "SYSTEM_TIMEOUT").when(any_marker(message, RATE_MARKS), "SYSTEM_RATE_LIMIT").when(any_marker(message, SERVER_MARKS), "SYSTEM_API_ERROR").otherwise("SYSTEM_REQUEST_FAILED")


def previous_failure(log: Column, path: Column, expected: Column) -> Column:
    """What a stored log tells about an earlier failure; null where it can't tell: after output to STDERR the exit code is missing, and without a fault there is none.

    The messages are fixed values."""
    parts = F.split(log, "\nSTDERR\n", 2)
    out, err = F.regexp_replace(parts[0], r"\ASTDOUT\s*\n", ""), F.coalesce(F.get(parts, F.lit(1)), F.lit(""))
    seconds = F.regexp_extract(log, r"TIMEOUT after (\d+) seconds", 1)
    found = F.greatest(F.size(F.coalesce(last_list(out), F.array().cast("array<double>"))), F.lit(0))
    return (
        F.when(seconds != "", F.concat(F.lit("script timed out after "), seconds, F.lit("s; see "), path)).when(strip(err) != "", F.lit(None).cast("string"))
        .when(list_problem(out).isNotNull(), list_problem(out)).when(found != expected, F.format_string("forecast length mismatch: expected %d, got %d", expected, found))
    )


def details(runs: DataFrame, *keys: str) -> DataFrame:
    """Failed runs, ordered by keys and category."""
    return runs.where("category <> 'OK'").orderBy(*keys, "category")
