"""Operators 11 to 13 against SQL, brute force and measured recall, and on nulls, repeated rows, ties, empty tables and clashing columns."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from compare import difference
from pyspark.sql import functions as F

from foretally.llm import fill_middle, kernels, lexical, neighbours

TEXTS = [None, "", "\n", "\n\n\n", "one", "one\n", "é\U0001f600\n\nzwei\r\ndrei", "a <P> b\nc", "x<S", "<\n<\n>\n", "m<M>", "z\n" * 700, "Ä\n" * 65 + "end", "\x00\n\x00"]


def sides(text, i):
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = [int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    x, y = sorted(v % (len(units) + 1) for v in h[:2])
    return units, h, "".join(units[:x]), "".join(units[x:y]), "".join(units[y:])


def test_bits():
    for n in (0, 1, 63, 64, 65, 511, 512, 513, 5000):
        flags = np.random.RandomState(n).rand(n) < 0.3
        b = fill_middle.Bits(flags)
        assert (b.rank(np.arange(n + 1)) == np.append(0, np.cumsum(flags))).all()
        assert (b.select(np.arange(1, flags.sum() + 1)) == np.flatnonzero(flags)).all()


@pytest.mark.parametrize("size", [1, 40, 1 << 20])
def test_cuts_of_any_chunk(size):
    ids = list(range(len(TEXTS)))
    for lo, hi, buf, offs in kernels.chunks(pa.array(TEXTS), size):
        h = fill_middle.draws(ids[lo:hi], 7)
        for i, *got in zip(ids[lo:hi], *fill_middle.cuts(buf, offs, h[:, 0], h[:, 1])):
            units, _, p, m, _ = sides(TEXTS[i] or "", i)
            assert got == [len(units), len(p.encode()), len((p + m).encode()), len(p), len(m)]


def test_fill_middle(spark):
    rows = [(i, t, "x", "y") for i, t in enumerate(TEXTS * 9)] + [(None, "gone", "x", "y"), (5, "one\n", "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, n string")
    got = fill_middle.fill_middle(docs).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows if r[0] is not None)
    forms = Counter()
    for r in got:
        text = rows[r["doc_id"]][1] or ""
        units, h, p, m, s = sides(text, r["doc_id"])
        form = "plain" if not text or re.search("<[PSM]>", text) else "spm" if h[3] % 100 < 50 else "psm"
        out = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        assert (r["n"], r["form"], r["output"]) == (len(units), form, out)
        assert (r["prefix_chars"], r["middle_chars"]) == ((None, None) if form == "plain" else (len(p), len(m)))
        assert r["output_sha256"] == hashlib.sha256(out.encode()).hexdigest() and r["restored_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        forms[form] += 1
    assert min(forms.values()) > 9
    assert {r["form"] for r in fill_middle.fill_middle(docs, rate=0).collect()} == {"plain"}
    assert fill_middle.fill_middle(docs.limit(0)).count() == 0


@pytest.mark.parametrize("module, name", [(fill_middle, "op11_fill_middle"), (lexical, "op12_lexical_search")])
def test_query_equals_its_sql(spark, module, name):
    assert difference(spark, module.QUERIES[name], module.ORACLE[name]) is None


def least_cost(x, most, cost):
    best = [0]
    for i in range(1, len(x) + 1):
        best.append(min(best[j] + cost + (i - j) * max(x[j:i]) for j in range(max(0, i - most), i)))
    return best[-1]


@pytest.mark.parametrize("most, cost", [(1, 5), (4, 0), (8, 300), (64, 2000)])
def test_blocks_have_the_least_cost(most, cost):
    state = np.random.RandomState(most)
    sizes = state.randint(1, 90, 40)
    starts, x = np.cumsum(sizes) - sizes, state.randint(0, 1000, sizes.sum())
    begins = lexical.blocks(x, starts, sizes, most, cost)
    for a, n in zip(starts, sizes):
        own = x[a : a + n]
        at = np.append(np.flatnonzero(begins[a : a + n]), n)
        assert at[0] == 0 and np.diff(at).max() <= most
        assert sum(cost + (z - b) * own[b:z].max() for b, z in zip(at, at[1:])) == least_cost(own.tolist(), most, cost)


def ranked(docs, items, k):
    """Plain counting."""
    terms = lambda t: [x.translate(str.maketrans(lexical.UPPER, lexical.LOWER)) for x in re.findall(lexical.TERM, t or "")]
    own = [(i, Counter(terms(t))) for i, t in docs if i is not None]
    own = [(i, c) for i, c in own if c]
    n, total = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = {}
    for item in {i for i, _ in items if i is not None}:
        wanted = {t for i, text in items if i == item for t in terms(text)}
        rows = []
        for i, c in own:
            m = 50 + 50 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in wanted if t in c)
            if score > 0:
                rows.append((-score, i))
        if rows:
            out[item] = [(r + 1, i, -s) for r, (s, i) in enumerate(sorted(rows)[:k])]
    return out


def test_lexical_search_by_shards_and_blocks(spark):
    state = np.random.RandomState(4)
    words = [f"w{i}" for i in range(300)] + ["Über", "é\U0001f600", "X9", "x9"]
    docs = [(int(i), " ".join(state.choice(words, state.randint(1, 120), p=None))) for i in state.permutation(900)]
    docs += [(1000 + i, "w1 w2 w3, w1") for i in range(80)] + [(7, "w5"), (None, "w1 w1"), (2000, None), (2001, " -- "), (2002, "w1 " * 40_000)]
    items = [(i, " ".join(state.choice(words, 12))) for i in range(9)] + [(20, "w1 W1 w2?"), (20, "w3"), (21, None), (22, "nowhere"), (None, "w1"), (23, "X9")]
    d, q = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    d = d.withColumns({"term": F.lit("t"), "shard": F.lit(1), "score": F.lit(2), "ids": F.lit("i")})
    n_docs, n_terms = lexical.collection(d)
    lists = lexical.index(d, n_docs, n_terms, shard_bytes=20_000).persist()
    assert lists.select("shard").distinct().count() > 5
    for k in (1, 5, 50):
        got: dict = {}
        for r in lexical.search(lists, q, n_docs, k, query_items=4).collect():
            got.setdefault(r["item_id"], []).append((r["rank"], r["doc_id"], r["score"]))
        assert {i: sorted(x) for i, x in got.items()} == ranked(docs, items, k)
    lists.unpersist()
    for a, b in ((d.limit(0), q), (d, q.limit(0)), (d.where("doc_id = 2000"), q)):
        assert lexical.ranked(a, b).count() == 0


def exact(rows, query, k):
    q = np.array(rows[query], float)
    near = sorted((float(np.sqrt(((np.array(v, float) - q) ** 2).sum())), i) for i, v in rows.items() if i != query and len(v) == len(q))
    return [(r + 1, i, s) for r, (s, i) in enumerate(near[:k])]


def found(out):
    got: dict = {}
    for r in out.collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: sorted(x) for q, x in got.items()}


def test_neighbours_on_edges(spark):
    """Few vectors are all met, so that the result is exact: ties, copies, other lengths and what takes no part."""
    rows = {i: [1.0, 2.0, 3.0] for i in range(0, 1500, 3)} | {i: [float(i % 7), float(i % 5), 1.0] for i in range(1, 400, 3)} | {50_000 + i: [float(i), 1.0] for i in range(5)} | {70_000: [4.0, 4.0, 4.0, 4.0], -200: [1.0, 2.0, 3.5]}
    out = [(8, None), (11, [0.0, 0.0, 0.0]), (14, [1.0, None, 2.0]), (17, [float("nan"), 1.0, 1.0]), (20, [float("inf"), 1.0, 1.0]), (None, [1.0, 2.0, 3.0]), (200, None), (500, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in [*rows.items(), *out]], "vec_id long, embedding array<double>, node int, shard string")
    got = found(neighbours.nearest(df))
    want = {i: exact(rows, i, 10) for i in rows if i % 100 == 0}
    assert {i for i in want if want[i]} == set(got) and 70_000 not in got and len(got[50_000]) == 4
    for i, x in got.items():
        assert [(r, v) for r, v, _ in x] == [(r, v) for r, v, _ in want[i]] and np.allclose([s for *_, s in x], [s for *_, s in want[i]], rtol=1e-12, atol=0)
    assert neighbours.nearest(df.limit(0)).count() == 0 and neighbours.nearest(df.where("vec_id % 100 <> 0")).count() == 0


def test_neighbours_recall_over_shards(spark):
    """0.9 and more of the true neighbours, in clusters, over several shards and blocks of queries."""
    state = np.random.RandomState(1)
    x = (state.randn(40, 24)[state.randint(0, 40, 4000)] + 0.4 * state.randn(4000, 24)).astype(np.float32)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    vectors = neighbours.usable(df)
    nodes = neighbours.graph(neighbours.folded(vectors).persist(), shard_rows=1100).persist()
    assert nodes.select("shard").distinct().count() == 4 and nodes.agg(F.max(F.size("edges"))).first()[0] <= neighbours.DEGREE
    got = found(neighbours.search(nodes, vectors.where("vec_id % 50 = 0"), query_rows=30))
    hits = 0
    for q in range(0, 4000, 50):
        d = np.sqrt(((x.astype(float) - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        assert [r for r, *_ in got[q]] == list(range(1, 11)) and [s for *_, s in got[q]] == sorted(s for *_, s in got[q])
        assert all(abs(d[v] - s) < 1e-12 for _, v, s in got[q])
        hits += len({v for _, v, _ in got[q]} & set(np.argsort(d, kind="stable")[:10].tolist()))
    assert hits / 800 >= 0.95
