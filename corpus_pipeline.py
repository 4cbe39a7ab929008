"""The corpus pipeline: five stages, each on all that its predecessor kept.

All but the last return the columns of documents, whatever these are named; packing returns its pieces.
What holds for all stages: a row without an id goes in the first; rows that share an id go or stay
together; an empty table stays empty; columns beyond doc_id and text pass through as they
are, n_chars apart, which follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foretally.llm import decontamination, near_dup, packing, pii, toxicity
from foretally.llm.common import materialise, scratch, settled, table


def _with_ids(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """docs whose id is (left_semi) or isn't (left_anti) among ids; rows without an id go."""
    return docs.where(F.col("doc_id").isNotNull()).join(ids.select("doc_id").distinct(), "doc_id", how).select(*[f"`{c}`" for c in docs.columns])


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null and empty texts have the score of no evidence and stay; repeated rows score alike; of an id
    with several texts all rows go if one is rejected; without labels the fixed word list and
    patterns decide.
    """
    with scratch(spark):
        model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return _with_ids(docs, toxicity.score(docs, model).where("predicted = 1"), "left_anti")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays: that with the least id; of its rows, if its id is repeated, that with the least text.

    Null, empty and blank texts are one class.
    """
    classes = settled(spark, "classes", lambda: near_dup.classes(docs))  # the texts laid out for it are gone
    kept = _with_ids(docs, classes.where("doc_id = class_id"), "left_semi")
    nested = kept.select("doc_id", F.struct(*[F.col(f"`{c}`").alias(c) for c in kept.columns]).alias("row"), F.struct(F.coalesce("text", F.lit("")).alias("t"), F.xxhash64(*[F.col(f"`{c}`") for c in kept.columns]).alias("h")).alias("order"))
    one = nested.groupBy("doc_id").agg(F.min_by("row", "order").alias("row"))
    return one.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go.

    Null and empty texts contain none; an empty benchmark rejects nothing; of an id with
    several texts all rows go if one contains an item.
    """
    return _with_ids(docs, decontamination.contaminated(docs, table(spark, sf_dir, "benchmark")), "left_anti")


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets; n_chars follows.

    Every row stays; a null text becomes an empty one; repeated rows become equal ones.
    """
    with scratch(spark):
        model = pii.fit(docs)
    out = pii.redact(docs.where(F.col("doc_id").isNotNull()), model)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[f"`{c}`" for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, packed into sequences; see packing.pack.

    A null or empty text is the end id alone; rows that share an id are packed each.
    """
    return packing.pack(docs)


STAGES = [("toxicity", toxic), ("near_dup", near_duplicates), ("decontamination", decontaminate), ("pii", redact), ("packing", pack)]

#: SQL can express none of the learned and hashed stages; tests/llm holds the operators, and the stages' decisions, to brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents in their order, each written to the shared folder and read again; returns the packed pieces.

    A stage's tables are deleted once the next stage is written; only the pieces stay."""

    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with scratch(spark) as written:
            docs = materialise(stage(spark, docs, sf_dir), name)
            kept = written.pop()
            written += before  # goes with what the stage wrote on its way
        before = [kept]
    return docs
