"""Licence scans (operator 4).

A file's text is looked at in units: each line that speaks of a licence, that line with the next,
the paragraph around it, the leading comment block, and, for a licence file (LICENSE, COPYING, ...), the whole text.
Lines lose their comment marks; none is cut.  Units and templates (licence texts
and notices) are sparse TF-IDF vectors, with document frequencies over all units and
templates, and are compared by cosine.  Only templates with a term of the unit are met: the
terms of the templates are a fixed, small table.

A licence file or comment block that is like a licence text decides first; then the unit with the greatest cosine.
A unit names a licence only if that is MARGIN ahead of the next other one, so that a line that names no version, or several licences, names none; lines that
say that something isn't under a licence are no units.
A bare reservation of rights counts only where no licence is found, and of a licence and a longer
one that contains it (CONTAINS), if both are found, the longer is meant.
A file without a licence of its own takes that of the nearest ancestor directory with a
licence file: each folder is joined with its ancestor directories, and the deepest wins.

Terms, folders and directories with a large share of all rows are counted on the map side
and joined by `beside`, so that none meets in one task.

Defined results: a null text has no notice; ties between templates go to the least
name; rows that share an id are one file, named by their best unit; a file without path
inherits nothing; repeated rows are given each; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import beside, materialise, only, table
from .licence_texts import BODIES, NOTICES

_WORDS = r"licen[cs]e|creative commons|cc0|copyright|public domain|rights reserved|mozilla public|permission (?:is hereby|to use)|redistribution and use|neither the name"
#: What a line of comment or of a list begins and ends with.
MARKS = r"(?m)^[\t /*#;%!<>-]+|[\t */<>-]+$"
#: A line of comment, or a blank one.
COMMENT = r"^[\t ]*(?:[/*#;%!]|--|<!--|$)"
TERM = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
LEAST_COSINE, MARGIN = 0.6, 0.01
#: What says that a licence doesn't hold.
NOT_UNDER = r"(?i)\b(?:not|n't)\s+(?:\w+\s+){0,2}under\b"
LICENCE_FILES = ("LICENSE", "LICENCE", "COPYING", "NOTICE", "UNLICENSE")
#: Licences whose text begins with all of another's.
CONTAINS = {"BSD-3-Clause": "BSD-2-Clause"}
WHOLE, PART = 0, 1


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def is_licence_file(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.upper(F.regexp_replace(name, r"\..*$", "")).isin(*LICENCE_FILES)


def units(files: DataFrame) -> DataFrame:
    """doc_id, level (WHOLE or PART), words: the units of each text, each once."""
    said = lambda x: F.regexp_like(x, F.lit(f"(?i)(?:{_WORDS})"))
    holds = lambda x: said(x) & ~F.regexp_like(x, F.lit(NOT_UNDER))
    text = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), r"\r\n?", "\n")
    f = files.select("doc_id", "path", text.alias("text")).where(said(F.col("text")) | F.coalesce(is_licence_file(F.col("path")), F.lit(False)))
    # a line of comment marks alone parts paragraphs, as a blank one does
    code = F.array_position(F.transform(F.split("text", "\n"), lambda x: ~F.regexp_like(x, F.lit(COMMENT))), True)
    top = F.when(code == 0, F.col("text")).otherwise(F.array_join(F.slice(F.split("text", "\n"), 1, (F.greatest(code, F.lit(1)) - 1).cast("int")), "\n"))
    f = f.select("doc_id", "path", F.regexp_replace("text", MARKS, "").alias("plain"), F.regexp_replace(top, MARKS, "").alias("head"))
    lines = F.filter(F.split("plain", "\n"), lambda x: x != "")
    paragraphs = F.filter(F.split("plain", r"\n\n+"), said)
    f = f.withColumns({"lines": lines, "paragraphs": paragraphs})
    after = F.zip_with("lines", F.slice("lines", 2, F.greatest(F.size("lines"), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    part = F.filter(F.concat(F.filter("lines", holds), F.filter(after, holds), F.filter("paragraphs", lambda x: ~F.regexp_like(x, F.lit(NOT_UNDER)))), lambda x: x.isNotNull())
    whole = F.filter(F.array(F.when(is_licence_file(F.col("path")), F.col("plain")), F.when(said(F.col("head")), F.col("head"))), lambda x: x.isNotNull() & (x != ""))
    level = lambda xs, n: F.transform(xs, lambda x: F.struct(F.lit(n).alias("level"), _terms(x).alias("words")))
    both = F.array_distinct(F.concat(level(whole, WHOLE), level(part, PART)))
    # outer, since the filter that Spark puts below an inner explode works out all units a second time
    return f.select("doc_id", F.explode_outer(both).alias("u")).select("doc_id", "u.level", "u.words").where(F.size("words") > 0)


def templates(spark: SparkSession) -> DataFrame:
    """template, licence, level, words."""
    rows = [(i, k, level, x) for i, (k, level, x) in enumerate([(k, WHOLE, x) for k, x in BODIES.items()] + [(k, PART, x) for k, x in NOTICES])]
    return spark.createDataFrame(rows, "template int, licence string, level int, text string").select("template", "licence", "level", _terms(F.col("text")).alias("words"))


def own_licences(files: DataFrame) -> DataFrame:
    """doc_id, licence, cosine of files with a unit like a template."""
    spark = files.sparkSession
    # equal units of different files are compared once
    found = units(files).select("doc_id", "level", "words", F.unhex(F.sha2(F.array_join("words", " "), 256)).alias("unit"))
    found = materialise(found, "units")
    each = materialise(found.groupBy("unit").agg(F.first("words").alias("words"), F.count("*").alias("files")), "vectors")
    temp = templates(spark)
    terms = lambda d, *keys: d.select(*keys, F.explode("words").alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("tf"))
    rows, t_rows = materialise(terms(each, "unit", "files"), "terms"), terms(temp, "template", "licence", "level")
    total = found.count() + len(BODIES) + len(NOTICES)
    counts = rows.groupBy("term").agg(F.sum("files").alias("df"), F.count("*").alias("n")).unionByName(t_rows.groupBy("term").agg(F.count("*").alias("df"), F.lit(0).cast("long").alias("n")))
    df = counts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("n").alias("n"))
    df = materialise(df.select("term", "n", (F.log(F.lit(1.0 + total) / (1.0 + F.col("df"))) + 1.0).alias("idf")), "weights")
    notice = beside(rows.select("unit", "term", "tf"), df, ["term"], "n").withColumn("w", F.col("tf") * F.col("idf"))
    template = t_rows.join(df, "term").withColumn("t_w", F.col("tf") * F.col("idf"))
    t_length = template.groupBy("template").agg(F.sqrt(F.sum(F.col("t_w") * F.col("t_w"))).alias("t_norm"))
    known = F.broadcast(template.join(t_length, "template").groupBy("term").agg(F.collect_list(F.struct("template", (F.col("t_w") / F.col("t_norm")).alias("v"))).alias("vs")))
    # a unit's rows meet once: its length from all terms, its products from those that templates have
    own = notice.join(known, "term", "left").groupBy("unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.collect_list(F.when(F.col("vs").isNotNull(), F.struct("w", "vs"))).alias("products"))
    dots = own.select("unit", "norm", F.explode("products").alias("p")).select("unit", "norm", "p.w", F.explode("p.vs").alias("v")).groupBy("unit", "norm", "v.template").agg(F.sum(F.col("w") * F.col("v.v")).alias("dot"))
    names = F.broadcast(temp.select("template", "licence", F.col("level").alias("of")))
    scored = dots.select("unit", "template", F.round(F.col("dot") / F.col("norm"), 6).alias("cosine")).where(F.col("cosine") >= LEAST_COSINE).join(names, "template")
    scored = scored.groupBy("unit", "licence", "of").agg(F.max("cosine").alias("cosine"))
    likes = scored.groupBy("unit").agg(F.reverse(F.array_sort(F.collect_list(F.struct("cosine", "licence", "of")))).alias("likes"))
    sizes = likes.where(_clear(F.col("likes"))).join(each.select("unit", "files"), "unit")
    likes = beside(found.select("doc_id", "level", "unit"), materialise(sizes, "likes"), ["unit"], "files").select("doc_id", "level", F.explode("likes").alias("l")).select("doc_id", "level", "l.*")
    rank = F.when((F.col("level") == WHOLE) & (F.col("of") == WHOLE), 0).otherwise(1) + F.when(F.col("licence") == "Proprietary", 2).otherwise(0)
    best = likes.groupBy("doc_id").agg(F.min(F.struct(rank.alias("rank"), (-F.col("cosine")).alias("c"), "licence")).alias("b"), F.collect_set(F.struct("licence", (F.col("level") == WHOLE).alias("whole"))).alias("all"))
    name = F.col("b.licence")
    for longer, shorter in CONTAINS.items():
        name = F.when((name == shorter) & (F.col("b.rank") > 0) & F.exists("all", lambda x: x["licence"] == longer), longer).otherwise(name)
    return best.select("doc_id", name.alias("licence"), (-F.col("b.c")).alias("cosine"))


def _clear(likes: Column) -> Column:
    """Whether the best of likes (cosine, licence; the best first) is ahead of all other licences; one that contains another doesn't compete with it."""
    top = likes[0]
    pair = F.lit(False)
    for longer, shorter in CONTAINS.items():
        pair = pair | (top["licence"].isin(longer, shorter))
    related = lambda x: pair & x["licence"].isin(*CONTAINS, *CONTAINS.values())
    return ~F.exists(likes, lambda x: (x["licence"] != top["licence"]) & ~related(x) & (x["cosine"] > top["cosine"] - MARGIN))


def ancestors(folder: Column) -> Column:
    """A folder and the directories above it, from the root ('') down."""
    parts = F.when(folder == "", F.array().cast("array<string>")).otherwise(F.split(folder, "/"))
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, 1, i), "/").alias("dir")))


def nearest(folders: DataFrame, given: DataFrame) -> DataFrame:
    """folder, n, dir, dir_licence from folders (folder, n) and given (dir, dir_licence): the deepest directory with a licence above each folder, or nulls."""
    up = materialise(folders.select("folder", F.explode(ancestors(F.col("folder"))).alias("a")).select("folder", "a.*"), "ancestors")
    below = materialise(up.groupBy("dir").agg(F.count("*").alias("below")).join(given, "dir"), "below")
    near = beside(up, below, ["dir"], "below").groupBy("folder").agg(F.max(F.struct("depth", "dir", "dir_licence")).alias("best"))
    return folders.join(near, "folder", "left").select("folder", "n", "best.dir", "best.dir_licence")


def scan(files: DataFrame) -> DataFrame:
    """files (doc_id, path, text) as doc_id, path, licence, cosine, origin ('own', a directory, or null)."""
    f = only(files, "doc_id", "path", "text")
    own = materialise(own_licences(f), "own")
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    paths = materialise(f.select("doc_id", "path").join(own, "doc_id", "left").withColumn("folder", folder), "paths")
    given = paths.where(is_licence_file(F.col("path")) & F.col("licence").isNotNull()).groupBy(F.col("folder").alias("dir")).agg(F.min("licence").alias("dir_licence"))
    bare = F.col("licence").isNull() & F.col("folder").isNotNull()
    folders = materialise(paths.where(bare).groupBy("folder").agg(F.count("*").alias("n")), "folders")
    near = materialise(nearest(folders, given), "near")
    columns = ("doc_id", "path", "licence", "cosine", "origin")
    heirs = beside(paths.where(bare).select("doc_id", "path", "folder"), near, ["folder"], "n").select("doc_id", "path", F.col("dir_licence").alias("licence"), F.lit(None).cast("double").alias("cosine"), F.col("dir").alias("origin"))
    rest = paths.where(~bare).withColumn("origin", F.when(F.col("licence").isNotNull(), F.lit("own"))).select(*columns)
    return rest.unionByName(heirs)


def with_paths(docs: DataFrame) -> DataFrame:
    """Paths for a table that has none: block of 4,096 ids / block of 64 ids / file; the first file of a block of 64 is its LICENSE, that of a block of 4,096 stands one level higher."""
    i = F.col("doc_id")
    big, small = F.concat(F.lit("p"), F.floor(i / 4096).cast("string")), F.concat(F.lit("d"), F.floor(i / 64).cast("string"))
    path = F.when(i % 4096 == 0, F.concat_ws("/", F.lit("corpus"), big, F.lit("LICENSE"))).when(i % 64 == 0, F.concat_ws("/", F.lit("corpus"), big, small, F.lit("LICENSE"))).otherwise(F.concat_ws("/", F.lit("corpus"), big, small, F.concat(i.cast("string"), F.lit(".txt"))))
    return docs.select("doc_id", "text").withColumn("path", path)


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(with_paths(table(spark, sf_dir, "documents")))


QUERIES = {"op4_licences": op4_licences}
ORACLE: dict[str, str] = {}
