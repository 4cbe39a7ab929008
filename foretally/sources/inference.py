"""Schemas of CSV files from all their rows.

Each value has the set of types that can hold it, as bits of a number; a column has the intersection of its values' sets, which
is one bitwise aggregate: it doesn't matter how rows are split or merged.  The narrowest type left is the column's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: From the narrowest on; a column without a value is of the first that isn't boolean, as numbers that are all missing.
TYPES = ("boolean", "bigint", "double", "date", "timestamp_ntz", "string")
#: What stands for a missing value.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
_DAY = r"\d{4}-\d{2}-\d{2}"
_FORMS = {
    "boolean": r"(?:True|TRUE|true|False|FALSE|false)",
    "bigint": r"\s*[+-]?\d+\s*",
    "double": r"\s*[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|inf|Infinity|nan)\s*",
    "date": _DAY,
    "timestamp_ntz": rf"{_DAY}(?:[ T]\d{{2}}:\d{{2}}(?::\d{{2}}(?:\.\d{{1,6}})?)?)?",
}


def missing(x: Column) -> Column:
    return x.isNull() | x.isin(*MISSING)


def read(x: Column, kind: str) -> Column:
    """A text as that type; null where it is missing or none."""
    value = F.when(~missing(x), x)
    if kind == "string":
        return value
    fits = F.regexp_like(value, F.lit(rf"\A{_FORMS[kind]}\z"))
    return F.when(fits, F.replace(F.trim(value), F.lit("inf"), F.lit("Infinity")).try_cast(kind) if kind == "double" else F.trim(value).try_cast(kind))


def holders(x: Column) -> Column:
    """The types that hold x, a bit each; all of them for a missing value."""
    everything = (1 << len(TYPES)) - 1
    bits = F.lit(1 << len(TYPES) - 1)
    for i, kind in enumerate(TYPES[:-1]):
        bits = bits + F.when(read(x, kind).isNotNull(), F.lit(1 << i)).otherwise(F.lit(0))
    return F.when(missing(x), F.lit(everything)).otherwise(bits)


def narrowest(bits: Column) -> Column:
    """The name of the type; double where nothing but missing values was seen."""
    everything = (1 << len(TYPES)) - 1
    out = F.when(bits.isNull() | (bits == everything), "double")
    for i, kind in enumerate(TYPES):
        out = out.when(bits.bitwiseAND(F.lit(1 << i)) != 0, kind)
    return out


def kinds(texts: DataFrame, *columns: str) -> DataFrame:
    """name, kind, n, n_missing of columns of text, in one pass over all rows."""
    columns = columns or tuple(texts.columns)
    c = {k: F.col(f"`{k}`") for k in columns}
    one = texts.agg(*[F.struct(F.bit_and(holders(v)).alias("bits"), F.count(F.lit(1)).alias("n"), F.count(F.when(missing(v), 1)).alias("n_missing")).alias(f"c{i}") for i, v in enumerate(c.values())])
    rows = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k).alias("name"), F.col(f"c{i}")["bits"].alias("bits"), F.col(f"c{i}")["n"].alias("n"), F.col(f"c{i}")["n_missing"].alias("n_missing")) for i, k in enumerate(columns)])
    return one.select(F.inline(rows)).select("i", "name", narrowest(F.col("bits")).alias("kind"), "n", "n_missing")


def typed(texts: DataFrame) -> DataFrame:
    """texts with each column as its narrowest type."""
    found = kinds(texts).collect()  # a row a column
    return texts.select(*[read(F.col(f"`{r['name']}`"), r["kind"]).alias(r["name"]) for r in found])


def csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """CSV files with a header, typed by all their rows: whole numbers, numbers, booleans, days, times or text.

    Files of one folder must have the same header; a byte order mark is no part of it.  multi_line: values in quotes may hold line ends."""
    return typed(spark.read.csv(path, header=True, inferSchema=False, multiLine=multi_line, escape='"', enforceSchema=False, encoding="UTF-8", nullValue="\\x00"))
