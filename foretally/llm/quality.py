"""Quality rules with adaptive thresholds (operator 3).

Base features are exact counts over the whole text.  The verdict compares four
ratios with thresholds taken, for each language and source, from quantile
sketches: logarithmic histograms whose bucket counts add, so that partial
sketches of tasks, days or shards merge by a sum.  A ratio in bucket b is known
to a relative error of GAMMA - 1.  A group's thresholds are drawn towards those of its language, which weigh as much as PRIOR of its documents that pass the base
rule: nearly the language's for a few documents, its own for many, without a size at which one takes over.
All four limits are upper ones: too many symbols, repeated lines or words, and overlong words.

Defined results: a null text has no words and fails the base rule; a null lang or
source is a group of its own; repeated rows each get their result; an empty table
gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import materialise, only, table

#: Characters counted as symbols.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
GAMMA = 1.02
#: A document is rejected beyond the upper quartile plus so many interquartile ranges.
FENCE = 6.0
#: The spread of a ratio counts as this much at least, so that groups without any spread keep their documents.
LEAST_SPREAD = 0.02
#: Documents of a group that weigh as much as its language.
PRIOR = 50.0

RATIOS = {
    "symbol_ratio": ("n_symbols", "n_words"),
    "dup_line_ratio": ("n_dup_lines", "n_lines"),
    "repeat_ratio": ("n_repeat_words", "n_words"),
    "word_length": ("word_chars", "n_words"),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")

_IS_SYMBOL = np.zeros(256, np.int64)
_IS_SYMBOL[list(SYMBOLS)] = 1
_STARTS = (np.arange(256) & 0xC0 != 0x80).astype(np.int64)


def count_chunk(buf: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    w = K.Words(buf, offs)
    rows = len(offs) - 1
    inside = ~K.SPACE[buf]
    salt = K.mix(np.arange(rows, dtype=np.uint64) + np.uint64(1))
    grams = K.Prefix(w.hash).grams(3)
    whole = w.text[: len(grams)] == w.text[2:] if len(grams) else np.zeros(0, bool)
    at = np.flatnonzero(whole)
    twice = at[K.repeated(grams[at] ^ salt[w.text[at]])]
    hit = np.zeros(len(w.start) + 2, bool)
    for d in range(3):
        hit[twice + d] = True

    cut = np.zeros(len(buf) + 1, bool)
    cut[np.flatnonzero(buf == 10) + 1] = True
    cut[offs[:-1]] = True
    begin = np.flatnonzero(cut[:-1])
    end = np.append(begin[1:], len(buf))
    text = np.searchsorted(offs, begin, "right") - 1
    end = end - ((end > begin) & (buf[np.maximum(end - 1, 0)] == 10)) if len(buf) else end
    words = K.per_row(inside, np.append(begin, len(buf)))
    full = np.flatnonzero(words > 0)
    keys = w.prefix.ranges(begin[full], end[full]) ^ salt[text[full]]
    lines = np.bincount(text[full], minlength=rows)
    _, first = np.unique(keys, return_index=True)
    distinct = np.bincount(text[full][first], minlength=rows)
    return {
        "n_words": w.counts(),
        "word_chars": K.per_row(_STARTS[buf] * inside, offs),
        "n_symbols": K.per_row(_IS_SYMBOL[buf], offs),
        "n_dup_lines": lines - distinct,
        "n_repeat_words": K.per_row(hit[: len(w.start)], w.first),
        "n_lines": lines,
    }


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        text = b.column("text")
        for lo, hi, buf, offs in K.chunks(text):
            got = count_chunk(buf, offs)
            yield pa.RecordBatch.from_arrays(
                [b.column(c).slice(lo, hi - lo) for c in ("doc_id", "lang", "source")] + [pa.array(got[c].astype(np.int64)) for c in COUNTS],
                names=["doc_id", "lang", "source", *COUNTS],
            )


def features(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, lang, source and the counts."""
    d = only(docs, "doc_id", "lang", "source", "text").withColumns({"doc_id": F.col("doc_id").cast("long"), "lang": F.col("lang").cast("string"), "source": F.col("source").cast("string")})
    return d.mapInArrow(_count, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))


def _ratio(name: str) -> Column:
    over, under = RATIOS[name]
    return F.coalesce(F.try_divide(F.col(over), F.col(under)), F.lit(0.0))


def _bucket(x: Column) -> Column:
    return F.when(x <= 1e-4, F.lit(0)).otherwise(1 + F.floor(F.log(x / 1e-4) / float(np.log(GAMMA)))).cast("int")


def sketches(feats: DataFrame) -> DataFrame:
    """lang, source, ratio, bucket, n: the mergeable sketches of documents that pass the base rule."""
    pairs = F.array(*[F.struct(F.lit(r).alias("ratio"), _bucket(_ratio(r)).alias("bucket")) for r in RATIOS])
    return feats.where(~base_failed()).select("lang", "source", F.explode(pairs).alias("p")).groupBy("lang", "source", "p.ratio", "p.bucket").agg(F.count("*").alias("n"))


def merge(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("lang", "source", "ratio", "bucket").agg(F.sum("n").alias("n"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """lang, source, <ratio>_max: one row per group."""

    def quartiles(s: DataFrame, keys: list[str]) -> DataFrame:
        w = Window.partitionBy(*keys, "ratio").orderBy("bucket")
        cum = s.withColumn("upto", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy(*keys, "ratio")))
        value = F.when(F.col("bucket") == 0, 0.0).otherwise(1e-4 * F.pow(F.lit(GAMMA), F.col("bucket") - 0.5))
        q = lambda p: F.min(F.when(F.col("upto") >= F.ceil(p * F.col("total")), value))
        got = cum.groupBy(*keys, "ratio").agg(q(0.25).alias("q1"), q(0.75).alias("q3"), F.max("total").alias("total"))
        top = F.col("q3") + FENCE * F.greatest(F.col("q3") - F.col("q1"), F.lit(LEAST_SPREAD))
        wide = [F.max(F.when(F.col("ratio") == r, top)).alias(f"{r}_max") for r in RATIOS]
        return got.groupBy(*keys).agg(*wide, F.max("total").alias("group_docs"))

    own = quartiles(sketch, ["lang", "source"])
    by_lang = quartiles(sketch.groupBy("lang", "ratio", "bucket").agg(F.sum("n").alias("n")), ["lang"])
    wide = by_lang.select(F.col("lang").alias("l"), *[F.col(f"{r}_max").alias(f"{r}_lang") for r in RATIOS])
    joined = own.join(wide, own["lang"].eqNullSafe(wide["l"]), "left")
    drawn = lambda r: (F.col(f"{r}_max") * F.col("group_docs") + F.col(f"{r}_lang") * PRIOR) / (F.col("group_docs") + PRIOR)
    return joined.select("lang", "source", "group_docs", *[drawn(r).alias(f"{r}_max") for r in RATIOS])


def apply_thresholds(feats: DataFrame, limits: DataFrame) -> DataFrame:
    """feats with base_failed, kept and the ratios.  The limits have a row per language and source; Spark broadcasts them while they are below its size threshold."""
    lim = limits.select(F.col("lang").alias("l_"), F.col("source").alias("s_"), *[f"{r}_max" for r in RATIOS])
    on = feats["lang"].eqNullSafe(lim["l_"]) & feats["source"].eqNullSafe(lim["s_"])
    joined = feats.join(lim, on, "left").withColumn("base_failed", base_failed())
    within = F.lit(True)
    for r in RATIOS:
        within = within & (_ratio(r) <= F.coalesce(F.col(f"{r}_max"), F.lit(float("inf"))))
    return joined.withColumns({r: _ratio(r) for r in RATIOS}).withColumn("kept", ~F.col("base_failed") & within).drop("l_", "s_")


def assess(docs: DataFrame) -> DataFrame:
    """Features, sketches, thresholds and verdicts for docs; the texts are read once."""
    feats = materialise(features(docs), "quality")
    return apply_thresholds(feats, thresholds(sketches(feats)))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assess(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *[f"{r}_max" for r in RATIOS])


QUERIES = {"op3_quality_rules": op3_quality_rules}
ORACLE: dict[str, str] = {}
