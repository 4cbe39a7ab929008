"""Records of stored chats: file names, chats without turn marks, answers of each turn, recommendations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foretally.functions import text as T
from foretally.operators.transcripts import OVERCLEANED

#: Names that stand before `response` or `said` in exported chats.
SPEAKERS = ("deepseek", "chatgpt", "claude", "gemini", "grok", "kimi", "llm")
ADVISERS = ("chatgpt", "claude", "llm", "assistant", "gemini", "grok", "deepseek", "kimi", "perplexity")
#: Model families by name; exact names go first, then the first that a name holds.
MODEL_CATEGORIES = (
    dict.fromkeys(("arima", "sarima", "exponentialsmoothing", "holtwinters", "holt", "ets", "theta", "tbats", "bats", "stl", "naive", "snaive", "prophet"), "Statistical")
    | dict.fromkeys(("var", "varma", "varmax", "vecm", "arimax", "sarimax"), "Multivariate Statistical")
    | dict.fromkeys(("xgboost", "xgb", "lightgbm", "lgbm", "randomforest", "svr", "elasticnet", "ridge", "lasso", "linearregression"), "ML")
    | dict.fromkeys(("lstm", "gru", "transformer", "tcn", "nbeats", "tft", "deepar", "rnn"), "Deep Learning")
)
#: What tells that a scenario was understood, in lower case.
UNDERSTOOD = {
    "blockwise": r"block.{0,30}(?:rolling|window|loop|forecast|predict|train|by.block)|(?:sliding|moving).{0,20}block|blockwise|block.wise|by.{0,10}block",
    "retraining": r"(?:retrain|re.train|refit|re.fit).{0,30}(?:block|each|every|iteration|after|step|model)|(?:train|fit)\s+(?:again|anew|each\s+(?:block|step)|after\s+each)|every\s+(?:block|step|iteration).{0,30}(?:retrain|refit|train)",
    "ground_truth": r"(?:ground.truth|actual.val|test.label|true.val|observed|real.data).{0,30}(?:extend|append|add|incorporate|fed|concatenat|merge|update)|(?:actual|true|observed|real)\s+(?:value|data).{0,30}(?:fed|added|incorporated|included|concatenat)|(?:update|augment).{0,20}(?:train|data).{0,20}(?:actual|true|ground|observed)|(?:ground|actual|true).{0,30}(?:concatenat|merge|join|combine).{0,20}(?:train|data)|true.value.{0,30}(?:extend|append|use)",
}
_MARK = "\u0001"


def file_parts(stem: Column) -> list[Column]:
    """part, dataset, scenario, branch, llm, run of a name like Part2-<dataset>-<scenario>-<branch>-<llm>-Run<n>; NA where it is too short."""
    parts = F.split(stem, "-")
    found = [F.coalesce(F.get(parts, F.lit(i)), F.lit("NA")).alias(n) for i, n in enumerate(("part", "dataset", "scenario", "branch", "llm"))]
    run = T.strip(F.regexp_replace(F.get(parts, F.lit(5)), "[Rr]un", ""))
    return [*found, F.coalesce(F.nullif(run, F.lit("")), F.lit("NA")).alias("run")]


def recommendation_parts(stem: Column) -> list[Column]:
    """dataset, version, scenario, llm, run of a name like Part1-<dataset>-v<n>-S<n>-<llm>-Run<n>; empty and null for other names."""
    group = lambda i: F.regexp_extract(stem, r"^Part1-(.+?)-v(\d+)-S(\d+)-(.+?)-Run(\d+)$", i)
    numbered = lambda p, i: F.when(group(i) != "", F.concat(F.lit(p), group(i)))
    return [group(1).alias("dataset"), numbered("v", 2).alias("version"), numbered("S", 3).alias("scenario"), group(4).alias("llm"), group(5).try_cast("int").alias("run")]


def chat_header(text: Column) -> Column:
    """name and style (response or said) of the first header that stands alone on a line; null without."""
    pattern = rf"(?imd)^\s*({'|'.join(SPEAKERS)})\s+(response|said:?)\s*$"
    name, style = F.lower(F.regexp_extract(text, pattern, 1)), F.lower(F.regexp_extract(text, pattern, 2))
    return F.when(name != "", F.struct(name.alias("name"), F.regexp_replace(style, ":", "").alias("style")))


def chat_turns(text: Column, header: Column) -> Column:
    """The answers, in their order, of a chat whose turns begin with such headers and with `you asked` lines."""
    said = F.when(header["style"] == "said", "said:?").otherwise("response")
    answer = F.concat(F.lit(r"(?imd)^\s*"), header["name"], F.lit(r"\s+"), said, F.lit(r"\s*$"))
    marked = F.regexp_replace(F.regexp_replace(F.replace(text, F.lit(_MARK), F.lit("")), answer, F.lit(f"{_MARK}A")), r"(?imd)^\s*you\s+asked\s*$", f"{_MARK}U")
    parts = F.split(marked, _MARK)
    segments = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1)))
    answers = F.filter(segments, lambda s: F.startswith(s, F.lit("A")))
    return F.coalesce(F.transform(answers, lambda s: T.strip(F.substr(s, F.lit(2)))), F.array().cast("array<string>"))


def turn1(response: Column) -> list[Column]:
    """What the answer on preprocessing decides, and whether it cleans too much."""
    needed = F.startswith(F.lower(T.field(response, "Needed")), F.lit("yes"))
    steps = T.field(response, "Preprocessing Steps")
    return [
        needed.alias("needed"), T.field(response, "Issues Detected").alias("issues"), steps.alias("steps"), T.field(response, "Treatment of Zero Values").alias("zeros"), T.field(response, "Justification").alias("justification"),
        T.has_header(response, "Previous Decisions Summary").alias("has_summary"), T.has_header(response, "Preprocessing Decision").alias("format_followed"), (needed & F.regexp_like(steps, F.lit(OVERCLEANED))).alias("overcleaned"),
    ]


def turn2(response: Column) -> list[Column]:
    """How the answer on the setup understands its scenario."""
    said, implied = T.field(response, "Scenario Understanding"), T.field(response, "Key Implication")
    both = F.lower(F.concat(said, F.lit(" "), implied))
    return [
        said.alias("understanding"), T.field(response, "Fixed Model").alias("model"), T.field(response, "Fixed Hyperparameters").alias("hyperparameters"), implied.alias("implication"),
        T.has_header(response, "Previous Decisions Summary").alias("has_summary"), T.has_header(response, "Setup Understanding").alias("format_followed"), *[F.regexp_like(both, F.lit(p)).alias(f"understands_{k}") for k, p in UNDERSTOOD.items()],
    ]


def extra_text(response: Column) -> Column:
    """Whether more than 80 characters stand before the first import of a script."""
    return F.regexp_instr(T.strip(response), F.lit(r"(?md)^(import|from)\s")) > 81


def first_response(text: Column) -> Column:
    """The first adviser's answer of a chat, up to the next header; the whole text without a header."""
    names = "|".join(ADVISERS)
    after = F.split(text, rf"(?imd)^\s*(?:{names})\s+response\s*$", 2)
    answer = F.split(F.get(after, F.lit(1)), rf"(?imd)^\s*(?:you asked|{names})\s*(?:response|asked)?\s*$", 2)
    return F.when(F.size(after) > 1, T.strip(answer[0])).otherwise(text)


def structured(response: Column) -> Column:
    """From the summary's heading on, so that free text before it isn't parsed."""
    at = F.regexp_instr(response, F.lit(r"(?i)Data Characteristics Summary\s*:"))
    return F.when(at > 0, F.substr(response, at)).otherwise(response)


def model_category(model: Column) -> Column:
    return T.first_keyword(F.regexp_replace(model, "[-_ ]", ""), MODEL_CATEGORIES)


def recommendation(text: Column, version: Column, expected_target: Column) -> list[Column]:
    """target, target_ok, trend, seasonality, noise, model, category, hyperparameters, justification, errors (array), error_flag of a recommendation; only v3 names a target."""
    s = structured(first_response(text))
    line = lambda label: rf"(?i){label}\s*:\s*(.+)"
    value = lambda p: T.strip(F.regexp_extract(s, p, 1))
    missing = lambda p, said: F.when(~F.regexp_like(s, F.lit(p)), F.lit(said))
    hyper, just = r"(?is)Hyperparameters\s*:\s*(\{.*?\})", r"(?is)Justification\s*:\s*(.+?)(?=\n\n|\z)"
    v3, target_line = version == "v3", line("Primary target column")
    target = F.when(v3, F.regexp_replace(value(target_line), r"^[\[\]'\" ]+|[\[\]'\" ]+$", "")).otherwise("")
    model = value(line("Recommended Model"))
    # fixed values: the messages
    errors = [
        F.when(v3, missing(target_line, "Primary target column field not found in v3 response")), F.when(v3 & F.contains(target, F.lit(",")), F.lit("LLM returned multiple targets - expected exactly 1")),
        *[missing(line(x), f"{x} field not found") for x in ("Trend", "Seasonality", "Noise", "Recommended Model")],
        missing(hyper, "Hyperparameters field not found or not a valid dict"), missing(just, "Justification field not found"),
    ]
    found = F.filter(F.array(*errors), lambda e: e.isNotNull())
    same = (target != "") & ~F.contains(target, F.lit(",")) & (F.lower(target) == F.lower(T.strip(expected_target)))
    return [
        target.alias("target"), F.coalesce((version != "v2") & same, F.lit(False)).alias("target_ok"), *[value(line(x)).alias(x.lower()) for x in ("Trend", "Seasonality", "Noise")], model.alias("model"), model_category(model).alias("category"),
        F.when(F.regexp_like(s, F.lit(hyper)), T.from_python_dict(value(hyper))).otherwise("").alias("hyperparameters"), value(just).alias("justification"), found.alias("errors"), (F.size(found) > 0).alias("error_flag"),
    ]


def filled(template: Column, values: dict[str, Column]) -> Column:
    """A prompt template with {name} replaced; names without a value stay."""
    for k, v in values.items():
        template = F.replace(template, F.lit("{" + k + "}"), F.coalesce(v, F.lit("")))
    return template
