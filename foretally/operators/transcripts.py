"""Transcripts: turns, labelled answers, output classes and response checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foretally.functions import text as T
from foretally.operators.order import numbered

#: Marks of turns.
MARK = r"(?m)^===== TURN\s+(\d+)\s+ASSISTANT[^\n]*=====\s*\n"
#: Before each mark, of either side; of an answer, its number and what follows the mark.
_BEFORE = r"(?im)^(?====== TURN\s+\d+\s+(?:USER|ASSISTANT)[^\n]*=====)"
_ANSWER = r"(?isd)\A===== TURN\s+(\d+)\s+ASSISTANT[^\n]*=====\s*\n(.*)\z"
MOST_CHARACTERS = 16_000

#: Patterns of generated forecasting code.
CODE_START = r"(?md)^(import\s+\w+|from\s+\w+\s+import|class\s+\w+\s*[\(:]|def\s+\w+\s*\(|(?:random|np|torch|pd|plt)\.\w+\s*\(|(?:np|torch)\.random\.\w+)"
#: What looks like code.
SCRIPT_SHAPE = (r"(?md)^\s*(import|from)\s+\w+", r"(?md)^\s*def\s+\w+\s*\(", r"(?md)^\s*class\s+\w+", r"(?md)^\s*\w+\s*=\s*", r"(?md)^\s*for\s+\w+", r"(?md)^\s*if\s+")
#: What code does.
CODE_FLAGS = {
    "seed": r"random\.seed|np\.random\.seed|torch\.manual_seed|set_seed",
    "split": r"0\.8\s*\*|int\(.*0\.8|n_train\s*=\s*\d+|train_size\s*=\s*\d+|n_test\s*=\s*\d+",
    "retraining": r"(?is)for\s+block|block_idx|train_model\(current_train|for\s+\w+\s+in\s+range\s*\([^)]*\)\s*:.*?\.fit\(|while\s+[^:]+:.*?\.fit\(",
    "ground_truth": r"(?is)(?:extend|append|\.append\(|\.extend\()\s*.*?(?:test_val|test|y_test|X_test|y_true)|current_train\s*=\s*np\.concatenate|np\.concatenate\s*\(.*?(?:test|y_test|y_true)|(?:X_train|y_train)\s*=\s*np\.concat|y_train\s*=\s*y_train\s*\+.*?(?:test|y_test)",
    "remainder": r"(?i)remainder|len.*%\s*block|%\s*block_size",
    "prints": r"print\(\s*forecasts\s*\)",
    "reads_csv": "read_csv",
    "torch": "import torch",
    "sklearn": "from sklearn|import sklearn",
    "statsmodels": "import statsmodels|from statsmodels",
    "xgboost": "import xgboost|XGBRegressor",
    "prophet": "from prophet|import prophet",
}
#: Fixed value: preprocessing that goes too far.
OVERCLEANED = r"(?i)(normaliz|standardiz|scal|log.transfor|differenc)"


def turn_list(text: Column) -> Column:
    """turn, text of the answers of a rendered transcript, by number; of answers with one number the last stays.

    The text is cut once, at its marks."""
    own = F.filter(F.split(text, _BEFORE), lambda p: F.regexp_like(p, F.lit(_ANSWER)))
    part = lambda p, place: F.struct(F.regexp_extract(p, _ANSWER, 1).try_cast("int").alias("turn"), place.alias("place"), F.regexp_extract(p, _ANSWER, 2).alias("text"))
    ordered = F.array_sort(F.filter(F.transform(own, part), lambda e: e["turn"].isNotNull()))
    last = lambda a: F.transform(F.filter(a, lambda e, i: F.coalesce(F.get(a, i + 1)["turn"] != e["turn"], F.lit(True))), lambda e: F.struct(e["turn"].alias("turn"), e["text"].alias("text")))
    return F.transform(F.array(ordered), last)[0]


def turns(text: Column) -> Column:
    """Map from turn number to the assistant's text of a rendered transcript."""
    return F.map_from_entries(turn_list(text))


def assistant_turns(chats: DataFrame) -> DataFrame:
    """conv_id, k (0-based number among the assistant's turns), text of a table of turns."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return chats.where("role = 'assistant'").select("conv_id", (F.row_number().over(w) - 1).alias("k"), "text")


def turn_columns(chats: DataFrame, n: int = 4) -> DataFrame:
    """conv_id, t0 .. t<n-1>, n_turns; a missing last column takes the last turn there is."""
    rows = assistant_turns(chats)
    g = rows.groupBy("conv_id").agg(*[F.max(F.when(F.col("k") == i, F.col("text"))).alias(f"t{i}") for i in range(n)], F.max_by("text", "k").alias("last"), F.count("*").alias("n_turns"))
    return g.withColumn(f"t{n - 1}", F.coalesce(f"t{n - 1}", "last")).drop("last")


def render(chats: DataFrame) -> DataFrame:
    """conv_id, transcript: the turns of each conversation in order, with their marks."""
    line = F.concat(F.lit("===== TURN "), F.col("turn").cast("string"), F.lit(" "), F.upper("role"), F.lit(" =====\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    return chats.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda s: s["line"]), "").alias("transcript"))


def code_of(response: Column) -> Column:
    """From the first line that looks like code, without trailing fences and without quotes that wrap all of it; '' if there is none."""
    at = F.regexp_instr(response, F.lit(CODE_START))
    before = F.lower(T.strip(F.substring(response, F.lit(1), at - 1)))
    code = T.strip(F.substring(response, at, F.char_length(response)))
    for quote in ("'''", '"""'):
        wrapped = before.isin(quote, f"python{quote}", f"{quote}python")
        code = F.when(wrapped, F.regexp_replace(code, rf"\s*{quote}\s*\z", "")).otherwise(code)
    return F.when(at > 0, T.strip_fences(code)).otherwise("")


def output_type(response: Column) -> Column:
    """ERROR, SCRIPT, LIST or TEXT, in this order."""
    r = T.strip(F.coalesce(response, F.lit("")))
    return F.when(F.upper(r) == "ERROR", "ERROR").when(F.regexp_like(r, F.lit(CODE_START)), "SCRIPT").when(T.first_list(r).isNotNull(), "LIST").otherwise("TEXT")


def is_script(response: Column) -> Column:
    """No fence, the shape of code, and a forecast in a print or in the last line."""
    shape = F.lit(False)
    for p in SCRIPT_SHAPE:
        shape = shape | F.regexp_like(response, F.lit(p))
    lines = F.filter(F.split(response, "\n"), lambda x: T.strip(x) != "")
    says = lambda x: F.regexp_like(x, F.lit("(?i)forecast|predict|preds"))
    ends = F.exists(lines, lambda x: F.contains(x, F.lit("print(")) & says(x)) | F.coalesce(says(F.try_element_at(lines, F.lit(-1))), F.lit(False))
    return ~F.contains(response, F.lit("```")) & shape & ends


def validate(response: Column, expected: Column) -> Column:
    """status, output_type, actual_length, length_mismatch, compliant of a last turn's response."""
    r = T.strip(F.coalesce(response, F.lit("")))
    numbers = T.number_list(r)
    n = F.size(numbers)
    status = (
        F.when(r == "ERROR", "MODEL_ERROR_LITERAL").when(numbers.isNotNull(), "OK_FORECAST_LIST").when(F.char_length(r) > MOST_CHARACTERS, "INVALID_SCRIPT_TOO_LONG")
        .when(is_script(r), "OK_FORECAST_SCRIPT").otherwise("INVALID_SCRIPT_FORMAT")
    )
    return F.struct(
        status.alias("status"), F.when(numbers.isNotNull(), "LIST").when(r == "ERROR", "ERROR").otherwise("SCRIPT").alias("output_type"), F.when(numbers.isNotNull(), n).alias("actual_length"),
        F.coalesce(numbers.isNotNull() & (n != expected), F.lit(False)).alias("length_mismatch"),
        F.when(numbers.isNotNull(), n == expected).otherwise(status == "OK_FORECAST_SCRIPT").alias("compliant"),
    )


def code_flags(code: Column) -> list[Column]:
    return [F.regexp_like(code, F.lit(p)).alias(k) for k, p in CODE_FLAGS.items()]


def block_size_ok(code: Column, scenario: Column, block: Column) -> Column:
    """True unless S4, where the code must set the expected block size."""
    return F.when((scenario != "S4") | block.isNull(), True).otherwise(F.regexp_like(code, F.concat(F.lit(r"(?i)(?:block_size|PRED_LEN|pred_len)\s*=\s*"), block.cast("string"), F.lit(r"\b"))))


def csv_path_fixed(code: Column, path: str) -> Column:
    """read_csv calls with another path, keeping their other arguments."""
    return F.regexp_replace(code, r"pd\.read_csv\(\s*['\"][^'\"]*['\"]\s*((?:,\s*[^)]+)?)\)", f"pd.read_csv(r'{path}'$1)")


def analysis_status(run_status: Column, output: Column, n: Column, expected: Column) -> Column:
    """The status a run is analysed under, from what its last answer holds."""
    blank = F.coalesce(run_status, F.lit("")) == ""
    given = F.when(~blank, run_status)
    return (
        F.when((output == "ERROR") | (run_status == "MODEL_ERROR_LITERAL"), "MODEL_ERROR_LITERAL")
        .when(n.isNotNull() & expected.isNotNull(), F.when(n == expected, "OK_FORECAST_LIST").otherwise("INVALID_LIST_LENGTH"))
        .when(output == "LIST", F.when(blank | (run_status == "OK_FORECAST_LIST"), "INVALID_OUTPUT").otherwise(run_status))
        .when(output == "SCRIPT", F.coalesce(given, F.lit("OK_FORECAST_SCRIPT")))
        .when(output == "TEXT", F.when(F.regexp_like(F.coalesce(run_status, F.lit("")), F.lit("^(INVALID_|SYSTEM_)")), run_status).otherwise("INVALID_OUTPUT"))
        .otherwise(run_status)
    )


def _placed(few: DataFrame, n: Column, descending: bool = False) -> DataFrame:
    """n, line of few ordered rows (_o, line); i is the place in their order."""
    rows = few.agg(F.sort_array(F.collect_list(F.struct("_o", "line")), asc=not descending).alias("rows"))
    return rows.select(F.posexplode("rows").alias("i", "row")).select(n.alias("n"), F.col("row.line").alias("line"))


def prompt_csv(rows: DataFrame, mode: str, order: str, most: int = 400) -> DataFrame:
    """n, line of a table as CSV lines for a prompt: full, head_tail (a marker between) or metadata_only."""
    if mode not in ("full", "head_tail", "metadata_only"):
        raise ValueError(f"unknown mode {mode}")
    columns = [c for c in rows.columns if c != order]
    if mode == "metadata_only":
        return rows.agg(F.count("*").alias("c")).select(F.lit(0).alias("n"), F.concat(F.lit("rows="), F.col("c").cast("string"), F.lit(f"; columns={'|'.join(columns)}")).alias("line"))
    line = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    lines = rows.select(F.col(order).alias("_o"), line.alias("line"))
    if mode == "full":
        return numbered(lines, "n", F.col("_o"), start=0).select(F.col("n").cast("int").alias("n"), "line")
    # two short sorts and a count instead of one order over all rows
    half = max(most // 2, 1)
    total = rows.count()
    first = _placed(lines.orderBy("_o").limit(half + 1), F.col("i"))
    cut = (F.col("n") == half) & F.lit(half < total - half)
    first = first.select("n", F.when(cut, "...").otherwise(F.col("line")).alias("line"))
    last = _placed(lines.orderBy(F.desc("_o")).limit(max(min(half, total - half - 1), 0)), total - 1 - F.col("i"), descending=True)
    return first.unionByName(last.select("n", "line")).select(F.col("n").cast("int").alias("n"), "line")
