"""Delta-maintained token counts (operator 2).

A store is a folder with one part per batch.  A batch holds signed deltas, summed by
source, language and tokenizer version: an insert adds a document's count, a delete
takes it away, a revision does both.  Totals are the sum over batches, so they never
need the documents again.  A batch is written aside as an attempt, which readers don't see, and then
published under its id by one rename: a reader sees all of it or nothing, also if the writer fails
between the two.  A batch that is published already stays as it is, so that delivering it
twice changes nothing.

Defined results: a null text has no tokens but is a document; null source and
language are groups of their own; repeated rows count each; groups that have come
down to no document and no token are left out; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, shared_folder, table
from .packing import default_vocabulary, encoder

BPE = "byte_bpe_50k@1"
#: Counts that column functions express, by tokenizer version.
COUNTERS = {"words@1": r"[^\x20\x09-\x0D]+", "words@2": "[A-Za-z0-9]+"}
KEYS = ("source", "lang", "tokenizer")


def bpe_counts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """docs (doc_id, source, lang, text) without text, with n_tokens by the vocabulary."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for b in batches:
            n = np.fromiter((len(encode(t.as_py() or "")) for t in b.column("text")), np.int64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("doc_id", "source", "lang")] + [pa.array(n)], names=["doc_id", "source", "lang", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", "text").mapInArrow(run, "doc_id long, source string, lang string, n_tokens long").withColumn("tokenizer", F.lit(BPE))


def pattern_counts(docs: DataFrame, versions: tuple[str, ...] = tuple(COUNTERS)) -> DataFrame:
    """doc_id, source, lang, tokenizer, n_tokens, a row per version."""
    count = lambda v: F.coalesce(F.regexp_count("text", F.lit(COUNTERS[v])), F.lit(0)).cast("long")
    rows = F.array(*[F.struct(F.lit(v).alias("tokenizer"), count(v).alias("n_tokens")) for v in versions])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", F.explode(rows).alias("r")).select("doc_id", "source", "lang", "r.n_tokens", "r.tokenizer")


def signed(counts: DataFrame, sign: int | Column) -> DataFrame:
    """Counts as deltas: sign 1 inserts, -1 deletes."""
    s = F.lit(sign) if isinstance(sign, int) else sign
    return counts.select(*KEYS, s.cast("long").alias("n_docs"), (s * F.col("n_tokens")).cast("long").alias("n_tokens"))


def revised(old: DataFrame, new: DataFrame) -> DataFrame:
    """Deltas of documents whose counts or tokenizer version change from old to new."""
    return signed(old, -1).unionByName(signed(new, 1))


def attempt(store: str, deltas: DataFrame) -> str:
    """Writes the sums of deltas beside the batches of store, where no reader looks; returns the folder."""
    path = f"{store}/_attempts/{uuid.uuid4().hex}"
    deltas.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).write.parquet(path)
    return path


def publish(spark: SparkSession, store: str, batch: str, path: str) -> bool:
    """Makes an attempt the batch by a rename that never replaces; False, and the attempt is dropped, if the batch is there already."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    source, target = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{store}/batch={batch}")
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf)
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    if not files.util().exists(target):
        try:
            files.rename(source, target, options)
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in str(e.java_exception):
                raise
    files.delete(source, True)
    return False


def commit(store: str, batch: str, deltas: DataFrame) -> bool:
    """Adds a batch, once; whether it was new."""
    return publish(deltas.sparkSession, store, batch, attempt(store, deltas))


def totals(spark: SparkSession, store: str) -> DataFrame:
    schema = "source string, lang string, tokenizer string, n_docs long, n_tokens long, batch string"
    out = spark.read.schema(schema).parquet(store).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    return out.where("n_docs <> 0 or n_tokens <> 0")


def maintained(spark: SparkSession, counts: DataFrame, labels: DataFrame) -> DataFrame:
    """Totals after four batches: all documents come in under their first versions; that batch is delivered again; those of
    quality 0 are deleted; those of source src0 move from words@1 to words@2."""
    store = shared_folder(spark, "rollup")
    first = counts.where(F.col("tokenizer") != "words@2")
    for _ in range(2):
        commit(store, "load", signed(first, 1))
    bad = labels.where("quality = 0").select("doc_id").distinct()
    commit(store, "delete", signed(first.join(bad, "doc_id", "left_semi"), -1))
    moved = counts.where(F.col("source") == "src0").join(bad, "doc_id", "left_anti")
    commit(store, "move", revised(moved.where("tokenizer = 'words@1'"), moved.where("tokenizer = 'words@2'")))
    return totals(spark, store)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    counts = materialise(bpe_counts(docs).unionByName(pattern_counts(docs)), "counts")
    return maintained(spark, counts, table(spark, sf_dir, "labels"))


def llm_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rollup for the tokenizer versions that SQL can express."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    return maintained(spark, materialise(pattern_counts(docs), "counts"), table(spark, sf_dir, "labels"))


QUERIES = {"op2_token_counts": op2_token_counts, "llm_word_counts": llm_word_counts}
ORACLE = {
    "llm_word_counts": r"""
with c as (
  select doc_id, source, lang, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as w1,
         len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+')) as w2
  from documents where doc_id not in (select doc_id from labels where quality = 0)
)
select source, lang, case when source = 'src0' then 'words@2' else 'words@1' end as tokenizer,
       count(*)::bigint as n_docs, sum(case when source = 'src0' then w2 else w1 end)::bigint as n_tokens
from c group by source, lang
"""
}
