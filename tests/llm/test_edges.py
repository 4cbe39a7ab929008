"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns: no operator crashes, and each gives its stated result."""

import hashlib
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from foretally.llm import decontamination, licences, near_dup, packing, phrase_dedup, pii, quality, suffix_dedup, token_counts, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, path string, start long, key string, bucket int, term string, kind string, base string, part int, score double, centre long"
LONG = " ".join(f"w{i % 977}x{i % 1009}" for i in range(300_000))


def row(i, text, lang="en", source="s"):
    return (i, text, lang, source, 1, "p/q.txt", 1, "k", 1, "t", "x", "b", 0, 0.5, 1)


@pytest.fixture(scope="module")
def docs(spark):
    same = " ".join(f"word{i}" for i in range(120))
    rows = [row(1, None), row(2, ""), row(3, "   \n\t "), row(4, "one"), row(5, same), row(6, same), row(6, same), row(7, LONG), row(8, "\x00 \U0001f600 é\x85x " * 30, None, None), row(None, same), row(9, "a" * 60_000)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(5, 1, 0), (7, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, " ".join(f"word{i}" for i in range(30, 60))), (2, None), (3, ""), (None, "x"), (4, "one")], "item_id long, text string")


OPERATORS = {
    "pii": lambda d, la, b: pii.find(d.where("doc_id is not null"), pii.fit(d)),
    "tokens": lambda d, la, b: token_counts.maintained(d.sparkSession, token_counts.bpe_counts(d).unionByName(token_counts.pattern_counts(d)), la),
    "quality": lambda d, la, b: quality.assess(d),
    "licences": lambda d, la, b: licences.scan(d),
    "decontamination": lambda d, la, b: decontamination.contaminated(d, b),
    "packing": lambda d, la, b: packing.pack(d),
    "suffix": lambda d, la, b: suffix_dedup.deduplicate(d),
    "phrase": lambda d, la, b: phrase_dedup.deduplicate(d),
    "near": lambda d, la, b: near_dup.classes(d),
    "toxicity": lambda d, la, b: toxicity.score(d, toxicity.fit(d, la)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(docs, labels, benchmark, name):
    assert OPERATORS[name](docs.limit(0), labels.limit(0), benchmark.limit(0)).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_edges_do_not_crash(docs, labels, benchmark, name):
    out = OPERATORS[name](docs, labels, benchmark).collect()
    if name in ("pii", "quality", "licences", "suffix", "phrase", "near", "toxicity"):
        assert sorted(r["doc_id"] for r in out) == [1, 2, 3, 4, 5, 6, 6, 7, 8, 9]


def test_results(docs, labels, benchmark):
    nothing = hashlib.sha256(b"").hexdigest()
    s = {r["doc_id"]: r for r in suffix_dedup.deduplicate(docs).collect()}
    assert s[1]["n_bytes"] == 0 and s[1]["kept_sha256"] == nothing and s[5]["n_removed"] == 0 and s[6]["n_removed"] == s[6]["n_bytes"] and s[9]["n_removed"] == 0
    p = {r["doc_id"]: r for r in phrase_dedup.deduplicate(docs).collect()}
    assert (p[5]["n_words"], p[5]["n_removed"], p[6]["n_removed"], p[3]["n_words"]) == (120, 120, 120, 0)
    n = {r["doc_id"]: r["class_id"] for r in near_dup.classes(docs).collect()}
    assert n[1] == n[2] == n[3] == 1 and n[5] == n[6] == 5 and n[4] == 4
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs, benchmark).collect()} == {(5, 1), (6, 1), (4, 4)}
    k = packing.pack(docs).where("doc_id = 1").first()
    assert (k["length"], k["doc_tokens"]) == (1, 1)
    q = {r["doc_id"]: r for r in quality.assess(docs).collect()}
    assert q[1]["base_failed"] and q[1]["n_words"] == 0 and not q[1]["kept"] and q[7]["n_words"] == 300_000
    assert {r["doc_id"] for r in pii.find(docs, None).where("size(pii.found) > 0").collect()} == set()


def test_pii_keeps_columns_of_its_own_names(spark):
    names = ("base", "found", "added", "done", "_done", "at_email", "g_ip", "candidates", "own", "clean")
    d = spark.createDataFrame([(1, "mail a@b.org or 1.2.3.4", *names), (2, None, *names), (3, LONG + " a@b.org", *names)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    model = pii.Model(((1.0, (0, 5.0, -1.0, 1.0)),), {k: 0.5 for k in pii.GENERATED})
    for out in (pii.find(d, model), pii.redact(d, model)):
        assert out.columns[: len(d.columns)] == d.columns
        assert {tuple(r[n] for n in names) for r in out.collect()} == {names}
    got = {r["doc_id"]: r["text"] for r in pii.redact(d, model).collect()}
    assert got[1] == "mail [EMAIL] or [IP]" and got[2] == "" and got[3] == LONG + " [EMAIL]"


def test_rollup_is_idempotent(spark, tmp_path):
    store = str(tmp_path / "r")
    rows = spark.createDataFrame([("s", "en", "t@1", 5), ("s", "en", "t@1", 7)], "source string, lang string, tokenizer string, n_tokens long")
    for _ in range(2):
        token_counts.commit(store, "a", token_counts.signed(rows, 1))
    first = rows.where("n_tokens = 5")
    token_counts.commit(store, "b", token_counts.revised(first, first.withColumn("n_tokens", F.lit(9).cast("long"))))
    r = token_counts.totals(spark, store).first()
    assert (r["n_docs"], r["n_tokens"]) == (2, 16)
    token_counts.commit(store, "c", token_counts.signed(spark.createDataFrame([("s", "en", "t@1", 16)], rows.schema), -1).withColumn("n_docs", F.lit(-2).cast("long")))
    assert token_counts.totals(spark, store).count() == 0


def test_pipeline_stages(spark, docs, labels, benchmark, tmp_path):
    """Each stage on nulls, empty and long texts, repeated rows and ids, and columns with names of the operators' own."""
    sf = str(tmp_path)
    labels.write.parquet(f"{sf}/labels.parquet")
    benchmark.write.parquet(f"{sf}/benchmark.parquet")
    extra = docs.withColumns({"row": F.lit("r"), "base": F.lit("b"), "score": F.lit(0.1), "class_id": F.lit(7), "spare column": F.lit("s"), "t": F.lit(1), "done": F.lit("d")})
    want = {"toxicity": [1, 2, 3, 4, 5, 6, 6, 7, 8, 9], "near_dup": [1, 4, 5, 7, 8, 9], "decontamination": [1, 2, 3, 7, 8, 9], "pii": [1, 2, 3, 4, 5, 6, 6, 7, 8, 9]}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, extra, sf)
        rows = out.collect()
        assert out.columns == extra.columns and sorted(r["doc_id"] for r in rows) == want[name], name
        assert {(r["row"], r["base"], r["class_id"], r["spare column"], r["t"], r["done"]) for r in rows} == {("r", "b", 7, "s", 1, "d")}
        assert name == "pii" or {r["doc_id"]: r["text"] for r in rows if r["doc_id"] != 6} == {r["doc_id"]: r["text"] for r in extra.collect() if r["doc_id"] in want[name] and r["doc_id"] != 6}
        assert stage(spark, extra.limit(0), sf).count() == 0
    assert corpus_pipeline.pack(spark, extra, sf).select("doc_id").distinct().count() == 9
    assert corpus_pipeline.pack(spark, extra.limit(0), sf).count() == 0


def test_pipeline_decisions_by_brute_force(spark):
    """Stage by stage on the small table: what a stage takes away is what its rule says of its own input."""
    import re

    sf = "/root/testdata/sf0.001"
    rows = lambda d: {r["doc_id"]: r["text"] for r in d.select("doc_id", "text").collect()}
    before = spark.read.parquet(f"{sf}/documents.parquet").persist()
    out = corpus_pipeline.toxic(spark, before, sf)
    scores = {r["doc_id"]: r["predicted"] for r in toxicity.score(before, toxicity.fit(before, spark.read.parquet(f"{sf}/labels.parquet"))).collect()}
    assert rows(out) == {i: t for i, t in rows(before).items() if not scores[i]}
    texts = {i: (t or "").split() for i, t in rows(before).items()}
    grams = {i: Counter(zip(*[w[k:] for k in range(5)])) if len(w) >= 5 else Counter([tuple(w)]) for i, w in texts.items()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in texts:
        for j in texts:
            if j < i:
                both = sum((grams[i] & grams[j]).values())
                if both / (sum(grams[i].values()) + sum(grams[j].values()) - both) >= 0.8:
                    a, b = sorted((find(i), find(j)))
                    root[b] = a
    assert set(rows(corpus_pipeline.near_duplicates(spark, before, sf))) == {i for i in texts if find(i) == i}
    words = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower())
    items = [words(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    whole = {i for i, t in rows(before).items() if any(" " + " ".join(x) + " " in " " + " ".join(words(t)) + " " for x in items)}
    kept = set(rows(corpus_pipeline.decontaminate(spark, before, sf)))
    assert not kept & whole and set(texts) - kept >= whole
    spans = {r["doc_id"]: r["pii"]["found"] for r in pii.find(before, pii.fit(before)).collect()}
    for i, t in rows(corpus_pipeline.redact(spark, before, sf)).items():
        clean, at = "", 0
        source = rows(before)[i] or ""
        for s in sorted(spans[i], key=lambda s: (s["start"], -s["end"])):
            if s["start"] >= at:
                clean += source[at : s["start"]] + f"[{s['kind'].upper()}]"
            at = max(at, s["end"])
        assert t == clean + source[at:]


def test_pipeline(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, before = docs.columns, docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dup", "decontamination", "pii", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.materialise(stage(spark, docs, sf), f"test-{name}")
        if name != "packing":
            assert out.columns == names and 0 < out.count() <= before
            docs, before = out, out.count()
    assert out.select("doc_id").distinct().count() == before
    assert corpus_pipeline.run(spark, sf).count() == out.count()


def test_scratch_is_deleted(spark):
    from foretally.llm import common

    with common.scratch(spark):
        one = common.materialise(spark.range(3), "one")
        two = common.laid_out(spark.range(5).withColumnRenamed("id", "k"), "k", "two")
        files = one.inputFiles() + two.inputFiles()
        assert one.count() == 3 and two.count() == 5 and all(os.path.exists(f.removeprefix("file://")) for f in files)
    assert not any(os.path.exists(f.removeprefix("file://")) for f in files)


def test_sized_puts_the_setting_back(spark):
    from foretally.llm import common

    before = common.partitions(spark)
    with pytest.raises(RuntimeError), common.sized(spark, 1):
        assert common.partitions(spark) == 1
        raise RuntimeError
    assert common.partitions(spark) == before


def test_queries_and_pipeline_leave_only_their_results(spark):
    from foretally.llm import common, queries

    folder = common.shared_dir(spark).removeprefix("file:") + "/foretally"
    there = lambda: set(os.listdir(folder)) if os.path.isdir(folder) else set()
    tables = lambda: {t.name for t in spark.catalog.listTables() if t.name.startswith("foretally_")}
    every, sf = queries.queries(), "/root/testdata/sf0.001"
    for name in ("op5_decontamination", "op8_phrase_dedup", "op12_lexical_search"):
        before, held = there(), tables()
        out = every[name](spark, sf)
        new = there() - before
        assert tables() == held and len(new) == (name != "op5_decontamination") and all(x.startswith(name) for x in new)
        assert out.count() > 0
        with common.scratch(spark):
            every[name](spark, sf).count()
        assert there() == before | new
    before, held = there(), tables()
    out = corpus_pipeline.run(spark, sf)
    assert [x.rsplit("-", 1)[0] for x in there() - before] == ["packing"] and tables() == held and out.count() > 0


def test_pii_of_few_documents_goes_by_evidence(spark):
    """Too few candidates for trees: what is announced is found all the same, and what isn't stays."""
    rows = [(1, 'api key: "' + "a1" * 20 + '"'), (2, "see " + "b2" * 20 + " there"), (3, "from 10:20:30:40:50:60:70:80 then a@b.org"), (4, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    model = pii.fit(d)
    assert model.trees == ()
    got = {r["doc_id"]: r["text"] for r in pii.redact(d, model).collect()}
    assert got == {1: 'api key: "[SECRET]"', 2: rows[1][1], 3: "from [ADDRESS] then [EMAIL]", 4: ""}
