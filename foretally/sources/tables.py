"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foretally.operators.order import numbered


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and a stated schema; a byte order mark is no part of the first name, NaN and blanks are null."""
    return spark.read.csv(path, header=True, schema=schema, nanValue="NaN", enforceSchema=False, encoding="UTF-8")


def texts(spark: SparkSession, path: str) -> DataFrame:
    """file_name, text: a row per file of a folder; bytes that aren't UTF-8 are replaced."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1).alias("file_name"), F.col("value").alias("text"))


def lookup(facts: DataFrame, setups: DataFrame, *keys: str) -> DataFrame:
    """facts with their setup; keys are compared without case.  A fact without a setup is an error at run time."""
    s = setups.select(*[F.lower(k).alias(f"_{k}") for k in keys], *[c for c in setups.columns if c not in keys], F.lit(True).alias("_found"))
    on = [F.lower(facts[k]) == s[f"_{k}"] for k in keys]
    out = facts.join(s, on, "left")
    said = F.concat(F.lit("no setup for "), F.concat_ws("/", *[F.col(k).cast("string") for k in keys]))
    return out.withColumn("_found", F.when(F.col("_found"), True).otherwise(F.raise_error(said).cast("boolean"))).where("_found").drop("_found", *[f"_{k}" for k in keys])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def append(df: DataFrame, path: str, columns: list[str]) -> None:
    """Append the listed columns, absent ones as null text, so that every part has the same schema."""
    df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns]).write.mode("append").parquet(path)


def write_forecasts(df: DataFrame, path: str) -> None:
    """One table for all runs, by series and scenario."""
    df.write.mode("overwrite").partitionBy("series_id", "scenario").parquet(path)


def write_artifacts(records: DataFrame, path: str) -> None:
    """The scripts and raw lists of records (file_id, script_file, t3_script_content, raw_file, t3_raw_response) as texts: a folder a kind and file, a text a record; a record without either has none."""
    each = F.array(F.struct(F.col("script_file").alias("file"), F.col("t3_script_content").alias("content")), F.struct(F.col("raw_file").alias("file"), F.regexp_replace("t3_raw_response", r"^\s+|\s+$", "").alias("content")))
    rows = records.select("file_id", F.inline(each)).where("file <> ''")
    rows.select(F.regexp_extract("file", "^([^/]+)/", 1).alias("kind"), F.regexp_extract("file", "([^/]+)$", 1).alias("file"), "content").write.mode("overwrite").partitionBy("kind", "file").text(path)


def artifacts(spark: SparkSession, path: str) -> DataFrame:
    """kind, file, content of what write_artifacts() wrote."""
    return spark.read.text(path, wholetext=True).select("kind", "file", F.regexp_replace("value", r"\n\z", "").alias("content"))  # the writer ends each with a line end


#: The turns of a chat, and the file that holds each one's template.
TURN_FILES = ((0, "data_inspection", "turn0_data_inspection.txt"), (1, "preprocessing_decision", "turn1_preprocessing_decision.txt"), (2, "setup_understanding", "turn2_fixed_setup_and_understanding.txt"), (3, "train_and_forecast", "turn3_train_and_forecast.txt"))
#: What is added to the first and to the last turn.
_CSV = ("\n\nThe raw CSV content is provided below and must be treated as the attached CSV file.\nRAW CSV START\n", "RAW CSV END")
_CONTEXT = "\n\nFor OPTION 2 only, read the dataset from a local CSV file named input.csv in the current working directory.\nDo not use absolute paths in generated code."


def templates(spark: SparkSession, path: str) -> DataFrame:
    """scenario, turn, label, template of a folder with a folder a scenario (scenario<n>_...); files of other names are none."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    parts = F.split(F.col("_metadata.file_path"), "/")
    names = spark.createDataFrame(list(TURN_FILES), "turn int, label string, name string")
    found = rows.select(F.regexp_extract(F.element_at(parts, -2), r"(?i)^scenario(\d+)", 1).alias("n"), F.element_at(parts, -1).alias("name"), F.col("value").alias("template")).where("n <> ''")
    return found.join(F.broadcast(names), "name").select(F.concat(F.lit("S"), "n").alias("scenario"), "turn", "label", "template")


def prompts(templates: DataFrame, setups: DataFrame) -> DataFrame:
    """setups (scenario, target, model, hyperparameters, horizon, csv and others) with turn, label, content: each template of their scenario, filled."""
    text = F.col("template")
    for name, column in (("<PRIMARY_TARGET_COLUMN_NAME>", "target"), ("<MODEL_NAME>", "model"), ("<HYPERPARAMETERS>", "hyperparameters")):
        text = F.replace(text, F.lit(name), F.coalesce(F.col(column).cast("string"), F.lit("")))
    horizon = F.coalesce(F.col("horizon").cast("string"), F.lit(""))
    for before, mark, after in (("Forecast horizon: ", "H", " (>0)"), ("Block size: ", "B", " (>0)"), ("Forecast horizon: ", "B", " (forecast")):
        text = F.replace(text, F.lit(before + mark + after), F.concat(F.lit(before), horizon, F.lit(after)))
    content = F.when(F.col("turn") == 0, F.concat(text, F.lit(_CSV[0]), F.coalesce("csv", F.lit("")), F.lit(_CSV[1]))).when(F.col("turn") == 3, F.concat(text, F.lit(_CONTEXT))).otherwise(text)
    return setups.join(templates, "scenario").withColumn("content", content).drop("template")


def reused(new: DataFrame, old: DataFrame, key: str, value: str) -> DataFrame:
    """new with the stored value where there is one."""
    o = old.select(F.col(key).alias("_k"), F.col(value).alias("_v"))
    return new.join(o, new[key] == o["_k"], "left").withColumn(value, F.coalesce("_v", F.col(value))).drop("_k", "_v")


def with_schema_of(df: DataFrame, like: DataFrame) -> DataFrame:
    """df with like's columns, order and types."""
    return df.select(*[F.col(f.name).cast(f.dataType) for f in like.schema.fields])


def markdown(df: DataFrame, order: str, *columns: str) -> DataFrame:
    """n, line: a table of results as lines of a Markdown report, in the order of one of its columns."""
    cell = lambda c: F.coalesce(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit(""))
    row = lambda *cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    head = df.sparkSession.createDataFrame([(-2, "| " + " | ".join(columns) + " |"), (-1, "|" + " --- |" * len(columns))], "n int, line string")
    return head.unionByName(numbered(df, "_n", F.col(order), start=0).select(F.col("_n").cast("int").alias("n"), row(*map(cell, columns)).alias("line")))


def series_of(table: DataFrame, series_id: str, target: str, order: str) -> DataFrame:
    """series_id, t, y of a dataset; a missing column, an empty dataset or one too short to split is an error."""
    for c in (target, order):
        if c not in table.columns:
            raise ValueError(f"no column {c} in {table.columns}")
    n = table.count()
    if n * 4 // 5 in (0, n):
        raise ValueError(f"{n} rows can't be split into train and test")
    return numbered(table, "_t", F.col(order), start=0).select(F.lit(series_id).alias("series_id"), F.col("_t").cast("int").alias("t"), F.col(target).cast("string").try_cast("double").alias("y"))
