"""Each operator against a brute-force version, on the driver's small table."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from compare import SF, connection, difference

from foretally.llm import decontamination, licences, near_dup, packing, phrase_dedup, pii, quality, suffix_dedup, token_counts, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs():
    return dict(connection().sql("select doc_id, coalesce(text, '') from documents order by doc_id").fetchall())


def luhn(d):
    s = [int(c) for c in reversed(d)]
    return (sum(s[::2]) + sum(sum(divmod(2 * x, 10)) for x in s[1::2])) % 10 == 0


def base_spans(t):
    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m[0])
        out += [("card", m)] * (16 <= len(d) <= 19 and luhn(d))
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub(r"\D", "", m[0])) <= 15]
    return [f"{k}:{m.start()}:{m.end()}" for k, m in out]


HARD = [
    "a@b.c+d@e.f.g x@y@z.w..q \U0001f600é1.2.3.4.5.256.1.1 0001.02.3.255 +1 (017) 555-7713+44 20 7946 0958)", "4111 1111 1111 1111 4111-1111-1111-1111-5", "1" * 5000 + "@" + "a." * 3000,
    "+1 2 3 4 5 6 7 8 9", "..a@b.c.d@e.f", "12-34 5678901234 56789 0000000000000000", "x" * 20000, "1 " * 9000, "",
]


def test_pii(spark, docs):
    df = spark.createDataFrame([*docs.items(), *[(10**9 + i, x) for i, x in enumerate(HARD)]], "doc_id long, text string")
    model = pii.fit(df)
    from pyspark.sql import functions as F

    texts = {r["doc_id"]: r for r in pii.find(df, model).select("doc_id", "text", pii.written(F.col("pii.base")).alias("base"), pii.written(F.col("pii.found")).alias("found"), *[f"pii.n_{k}" for k in pii.BASE]).collect()}
    added = Counter()
    for i, r in texts.items():
        want = base_spans(r["text"])
        assert r["base"] == ",".join(want), i
        assert {k: r[f"n_{k}"] for k in pii.BASE} == {k: sum(w.startswith(k + ":") for w in want) for k in pii.BASE}
        assert r["found"].startswith(r["base"])
        added.update(s.split(":")[0] for s in r["found"][len(r["base"]):].strip(",").split(",") if s)
    secrets = sum(len(re.findall(r'token = "[0-9a-f]{40}"', t)) for t in docs.values())
    assert 0.9 * secrets <= added["secret"] <= 1.2 * secrets
    redacted = {r["doc_id"]: r["text"] for r in pii.redact(df, model).collect()}
    assert all(not base_spans(t) for t in redacted.values())
    assert all(redacted[i] == r["text"] for i, r in texts.items() if not r["found"])


ANNOUNCED = {
    "secret": ('api key: "{}"', ["".join(np.random.RandomState(i).choice(list("0123456789abcdef"), 40)) for i in range(80)]),
    "handle": ("mail me: {}", [f"user{i} (at) host{i % 7} (dot) org" for i in range(80)]),
    "address": ("server {} is up", [":".join(f"{x:x}" for x in np.random.RandomState(i).randint(256, 65536, 8)) for i in range(80)]),
    "account": ("account {} was paid", [f"{i + 10:02d}-{i * 7919 % 1000000:06d}-{i % 90 + 10}" for i in range(80)]),
}
PLAIN = {"secret": "see {} there", "handle": "with {} today", "address": "from {} then", "account": "for {} then"}
ALIKE = ["at 10:20:30:40 sharp", "look at this.thing here", "internationalisation1-of-the-thing", "version 1.2.3.4.5.6", "years 1990 1991 1992", "we sat at noon.today", "path/to/some1/long/file/name"]


def test_pii_generators_learn_from_announced_data(spark):
    """Spans of each kind are found where nothing announces them, and clean text of like form stays."""
    from pyspark.sql import functions as F

    rows = [frame.format(x) for frame, spans in ANNOUNCED.values() for x in spans] + [f"{x} {i}" for i, x in enumerate(ALIKE * 40)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    model = pii.fit(docs)
    fresh = {k: [PLAIN[k].format(x[:-1] + ("1" if x[-1] == "0" else "0") if k != "handle" else "new" + x) for x in spans[:5]] for k, (_, spans) in ANNOUNCED.items()}
    tests = [(k, x) for k, xs in fresh.items() for x in xs] + [("", x) for x in ALIKE]
    d = spark.createDataFrame([(i, k, x) for i, (k, x) in enumerate(tests)], "doc_id long, kind string, text string")
    got = {k: [] for k in ["", *ANNOUNCED]}
    for r in pii.find(d, model).select("kind", F.transform("pii.added", lambda a: a["kind"]).alias("kinds")).collect():
        got[r["kind"]].append(bool(r["kinds"]))
    assert set(model.thresholds) >= {"secret", "handle", "address"}
    assert not any(got[""]) and all(all(got[k]) for k in ("secret", "handle", "address")), got


def test_running_sums_of_blocks(spark):
    from pyspark.sql import functions as F

    r = np.random.RandomState(3)
    xs = [r.randint(0, 50, n).tolist() for n in (1, 2, 63, 64, 65, 128, 129, 1000)]
    d = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i long, x array<int>")
    assert {q["i"]: q["s"] for q in d.select("i", pii._running(F.col("x"), lambda a, n: a + n).alias("s")).collect()} == {i: np.cumsum(x).tolist() for i, x in enumerate(xs)}
    assert {q["i"]: q["s"] for q in d.select("i", pii._running(F.col("x"), pii._greater).alias("s")).collect()} == {i: np.maximum.accumulate(x).tolist() for i, x in enumerate(xs)}


def test_handle_gate_passes_every_match(spark):
    from pyspark.sql import functions as F

    texts = ["john at example.com", "john at example dot com", "john@example.com", "john(at)example.com", "john [at] example[dot]com", "see john at example(dot)com"]
    d = spark.createDataFrame([(x,) for x in texts], "text string")
    rows = d.select("text", F.regexp_like("text", F.lit(pii.GENERATED["handle"])).alias("match"), pii._gate(F.col("text"))["handle"].alias("gate")).collect()
    assert all(r["match"] and r["gate"] for r in rows), rows


def test_token_counts(spark, docs):
    assert difference(spark, token_counts.llm_word_counts, token_counts.ORACLE["llm_word_counts"]) is None
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    bad = {i for (i,) in connection().sql("select doc_id from labels where quality = 0").fetchall()}
    place = {i: (s, la) for i, s, la in connection().sql("select doc_id, source, lang from documents").fetchall()}
    want = Counter()
    for i, x in docs.items():
        if i not in bad:
            want[place[i]] += len(t.encode(x, add_special_tokens=False).ids)
    got = {(r["source"], r["lang"]): r["n_tokens"] for r in token_counts.op2_token_counts(spark, SF).where("tokenizer like 'byte%'").collect()}
    assert got == dict(want)


def test_quality(spark, docs):
    for r in quality.op3_quality_rules(spark, SF).collect():
        t = docs[r["doc_id"]]
        w = WORD.findall(t)
        grams = list(zip(w, w[1:], w[2:]))
        seen = Counter(grams)
        hit = {i + d for i, g in enumerate(grams) if seen[g] > 1 for d in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit))
        assert r["base_failed"] == failed and not (failed and r["kept"])


def test_quality_sketches_merge(spark):
    from pyspark.sql import functions as F

    f = quality.features(spark.read.parquet(f"{SF}/documents.parquet")).persist()
    parts = [quality.sketches(f.where(F.col("doc_id") % 3 == i)) for i in range(3)]
    key = ["lang", "source", "ratio", "bucket"]
    whole = {tuple(r) for r in quality.sketches(f).select(*key, "n").collect()}
    assert {tuple(r) for r in quality.merge(*parts).select(*key, "n").collect()} == whole
    rows = [("en", "s", "repeat_ratio", 0, 100)] + [("en", "s", "repeat_ratio", b, 10) for b in range(10)]
    assert quality.thresholds(spark.createDataFrame(rows, "lang string, source string, ratio string, bucket int, n long")).first()["repeat_ratio_max"] > 0


def test_licences(spark, docs):
    d = spark.createDataFrame(
        [(1, "a/LICENSE", "Released under the MIT License."), (2, "a/x.txt", "words"), (3, "a/b/y.txt", "words\nLicensed under the Apache License, Version 2.0."), (4, "a/b/z.txt", None), (5, "c/x.txt", "no"), (6, "a/b/COPYING.txt", "Licensed under CC BY-NC 4.0."), (7, None, "All rights reserved.")],
        "doc_id long, path string, text string",
    )
    got = {r["doc_id"]: (r["licence"], r["origin"]) for r in licences.scan(d).collect()}
    assert got == {1: ("MIT", "own"), 2: ("MIT", "a"), 3: ("Apache-2.0", "own"), 4: ("CC-BY-NC-4.0", "a/b"), 5: (None, None), 6: ("CC-BY-NC-4.0", "own"), 7: ("Proprietary", "own")}
    names = {"Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "All rights reserved.": "Proprietary", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0"}
    own = {r["doc_id"]: r["licence"] for r in licences.op4_licences(spark, SF).where("origin = 'own'").collect()}
    assert own == {i: names[x] for i, t in docs.items() for x in t.split("\n")[-1:] if x in names}


def folded(s):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), s))


def shingles(words, k=5):
    return Counter(zip(*[words[i:] for i in range(k)])) if len(words) >= k else Counter([tuple(words)] if words else [])


def similar(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def test_decontamination(spark, docs):
    items = {i: folded(t) for i, t in connection().sql("select item_id, text from benchmark").fetchall()}
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontamination.op5_decontamination(spark, SF).collect()}
    want = {}
    for i, t in docs.items():
        w = folded(t)
        grams = set(zip(*[w[k:] for k in range(5)]))
        for j, x in items.items():
            c = shingles(x)
            if len(grams & set(c)) < 0.6 * len(c):
                continue
            for n in (len(x), len(x) - 1, len(x) - 2):
                for s in range(len(w) - n + 1):
                    v = similar(shingles(w[s : s + n]), c)
                    if v >= 0.8:
                        want[i, j] = max(v, want.get((i, j), 0))
    assert got == pytest.approx(want) and want


def test_block_tables_find_all_within_radius():
    r = np.random.RandomState(0)
    index = decontamination.Index(list(range(50)), [" ".join(f"w{x}" for x in r.randint(0, 999, 30)) for _ in range(50)])
    prints = index.prints[r.randint(0, 50, 300)]
    for q in range(len(prints)):
        for b in r.choice(64, r.randint(0, 26), replace=False):
            prints[q] ^= np.uint64(1) << np.uint64(b)
    got = set(zip(*map(list, index.near(prints)), strict=True))
    want = {(q, i) for q in range(300) for i in range(50) if int(prints[q] ^ index.prints[i]).bit_count() <= decontamination.RADIUS}
    assert got == want


def test_packing(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    p = packing.op6_packing(spark, SF).toPandas()
    for i, x in docs.items():
        ids = np.array([*t.encode(x, add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in p[p.doc_id == i].sort_values("start").itertuples():
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    for _, s in p.sort_values("offset").groupby("sequence_id"):
        assert list(s.offset) == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 2048
    used = p.groupby("sequence_id").length.sum()
    assert used.sum() / (2048 * len(used)) > 0.99


def test_special_strings_are_one_id(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x\n\n<|endoftext|><|endoftext|>  y  <|endoftext|>", "<|endoftext|", "é<|endoftext|>\U0001f600 <|ENDOFTEXT|>", "one  <|endoftext|>two " * 600]
    want = {i: t.encode(x, add_special_tokens=False).ids for i, x in enumerate(texts)}
    assert want[0] == [64, 220, 50256, 275]
    d = spark.createDataFrame([(i, "s", "en", x) for i, x in enumerate(texts)], "doc_id long, source string, lang string, text string")
    got = {}
    for r in sorted(packing.pack(d, with_ids=True).collect(), key=lambda r: r["start"]):
        got[r["doc_id"]] = got.get(r["doc_id"], []) + list(r["ids"])
    assert got == {i: [*x, 1] for i, x in want.items()}
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.bpe_counts(d).collect()} == {i: len(x) for i, x in want.items()}


def test_first_fit_decreasing():
    r = np.random.RandomState(1)
    for n in (1, 2, 3, 50, 333):
        x = r.randint(1, 101, n)
        bins, offsets = packing.first_fit_decreasing(x, 100)
        free, want = [], {}
        for i in np.argsort(-x, kind="stable"):
            b = next((k for k, f in enumerate(free) if f >= x[i]), len(free))
            if b == len(free):
                free.append(100)
            want[i] = (b, 100 - free[b])
            free[b] -= x[i]
        assert [(int(b), int(o)) for b, o in zip(bins, offsets, strict=True)] == [want[i] for i in range(n)]


def brute_bytes(docs, k=50):
    first, out = {}, {}
    for i, t in sorted(docs.items()):
        b = t.encode()
        for j in range(len(b) - k + 1):
            first.setdefault(b[j : j + k], i)
    for i, t in docs.items():
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - k + 1):
            if first[b[j : j + k]] < i:
                gone[j : j + k] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out[i] = (len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + (len(b) > 0 and gone[0])), hashlib.sha256(kept).hexdigest())
    return out


#: Few and many windows shipped one by one; anchors counted apart; groups read in parts.
SCHEMES = [{}, {"hot": 3}, {"hot": 5000, "anchor_least": 2}, {"hot": 3, "anchor_least": 10**9, "long": 4}]


@pytest.mark.parametrize("scheme", SCHEMES)
def test_suffix_dedup(spark, docs, scheme):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r[0]: tuple(r)[1:5] for r in suffix_dedup.deduplicate(df, suffix_dedup.SCHEME._replace(**scheme)).collect()}
    assert got == brute_bytes(docs)


def repeated_ids():
    """Rows that share an id: equal texts, and different ones."""
    r = np.random.RandomState(12)
    a, b, c, d = ([f"{x}{i}" for i in r.randint(0, 10**6, 60)] for x in "abcd")
    return [(1, a), (2, a), (2, b), (3, c), (3, c), (4, a + d), (4, d), (5, [])]


def test_suffix_dedup_of_repeated_ids(spark):
    rows = [(i, " ".join(w)) for i, w in repeated_ids()]
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in suffix_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    first = {}
    for i, t in rows:
        for j in range(len(t) - 49):
            first[t[j : j + 50]] = min(i, first.get(t[j : j + 50], i))
    want = []
    for i, t in rows:
        gone = np.zeros(len(t), bool)
        for j in range(len(t) - 49):
            if first[t[j : j + 50]] < i:
                gone[j : j + 50] = True
        want.append((i, len(t), int(gone.sum())))
    assert got == sorted(want)


def test_phrase_dedup_of_repeated_ids(spark):
    rows = repeated_ids()
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in phrase_dedup.deduplicate(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")).collect())
    seen = Counter(tuple(w[j : j + 35]) for _, w in rows for j in range(len(w) - 34))
    want = []
    for i, w in rows:
        gone = np.zeros(len(w), bool)
        for j in range(len(w) - 34):
            if seen[tuple(w[j : j + 35])] > 1:
                gone[j : j + 35] = True
        want.append((i, len(w), int(gone.sum())))
    assert got == sorted(want)


def test_shared_prefix_classes():
    r = np.random.RandomState(5)
    for _ in range(20):
        a = r.randint(97, 100, 400).astype(np.uint8)
        a[r.randint(0, 400, 6)] = 255
        a[-12:] = 255
        order, classes = suffix_dedup.shared_prefix_classes(a, 10)
        t, of = a.tobytes(), dict(zip(order.tolist(), classes.tolist(), strict=True))
        by = {}
        for i in range(len(t) - 10):
            if 255 not in t[i : i + 10]:
                by.setdefault(t[i : i + 10], set()).add(of[i])
        assert all(len(v) == 1 for v in by.values()) and len({min(v) for v in by.values()}) == len(by)


@pytest.mark.parametrize("scheme", SCHEMES)
def test_phrase_dedup(spark, docs, scheme):
    words = {i: t.encode().split() for i, t in docs.items()}
    seen = Counter(tuple(w[j : j + 35]) for w in words.values() for j in range(len(w) - 34))
    want = {}
    for i, w in words.items():
        gone = np.zeros(len(w), bool)
        for j in range(len(w) - 34):
            if seen[tuple(w[j : j + 35])] > 1:
                gone[j : j + 35] = True
        want[i] = (len(w), int(gone.sum()), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest())
    got = {r[0]: tuple(r)[1:4] for r in phrase_dedup.deduplicate(spark.read.parquet(f"{SF}/documents.parquet"), phrase_dedup.SCHEME._replace(**scheme)).collect()}
    assert got == want and sum(v[1] for v in want.values())


def test_near_dup(spark, docs):
    grams = {i: shingles(t.encode().split()) for i, t in docs.items()}
    owners = {}
    for i, c in grams.items():
        for s in c:
            owners.setdefault(s, []).append(i)
    root = {i: i for i in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, c in grams.items():
        for j in {j for s in c for j in owners[s] if j < i}:
            if similar(c, grams[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = {r["doc_id"]: r["class_id"] for r in near_dup.op9_near_dup(spark, SF).collect()}
    assert got == {i: find(i) for i in docs}


def test_near_dup_chains(spark):
    """Texts like a copy but not like the hub, and hubs that only a chain joins: every link counts, also between texts that other centres have linked."""
    r = np.random.RandomState(8)
    fresh = (f"n{i}" for i in range(10**6))

    def changed(words, lo, hi):
        return words[:lo] + [next(fresh) for _ in range(lo, hi)] + words[hi:]

    hub = [next(fresh) for _ in range(1004)]
    first = changed(hub, 0, 96)
    second = changed(first, 450, 546)
    other = changed(second, 908, 1004)
    rows = [hub, first, second, other]
    for h in (hub, other):
        for at in r.randint(0, 1000, 250):
            rows.append(changed(h, int(at), int(at) + 1))
    for i in range(10):
        copy = changed(hub, 80 * i + 150, 80 * i + 156)
        rows += [copy, changed(copy, 896, 1004)]
        a, b, c = (Counter(shingles(x)) for x in (copy, rows[-1], hub))
        assert similar(a, b) >= 0.8 > similar(b, c)
    assert similar(shingles(hub), shingles(other)) < 0.8 > similar(shingles(first), shingles(other))
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(rows)], "doc_id long, text string")
    assert {r["class_id"] for r in near_dup.classes(docs).collect()} == {0}


def test_near_dup_links_within_a_band(spark):
    """300 chains of six texts: neighbours at about 0.805, texts two apart at about 0.65.  No pair that shares a band is lost."""
    r = np.random.RandomState(4)
    fresh = (f"c{i}" for i in range(10**7))
    rows = []
    for _ in range(300):
        words = [next(fresh) for _ in range(400)]
        for step in range(6):
            rows.append(words)
            at = 10 + 60 * step + int(r.randint(0, 5))
            words = words[:at] + [next(fresh) for _ in range(39)] + words[at + 39 :]
    grams = [shingles(w) for w in rows]
    near = [(i, i + 1) for i in range(len(rows) - 1) if i % 6 < 5 and similar(grams[i], grams[i + 1]) >= 0.8]
    assert len(near) == 1500 and max(similar(grams[i], grams[i + 2]) for i in range(0, 1800, 6)) < 0.8
    buf = [" ".join(w).encode() for w in rows]
    offs = np.cumsum([0, *map(len, buf)])
    keys = near_dup.band_keys(near_dup.K.Words(np.frombuffer(b"".join(buf), np.uint8), offs), len(rows), near_dup.FIRST).to_pylist()
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    got = {q["doc_id"]: q["class_id"] for q in near_dup.classes(docs).collect()}
    assert [(a, b) for a, b in near if got[a] != got[b] and set(keys[a]) & set(keys[b])] == []


def test_near_dup_key_joins(spark, monkeypatch):
    """A large group's rows are joined by key to learn something new alone: their centres and, once a signature, the sizes of open buckets; not to filter them."""
    monkeypatch.setattr(near_dup, "SMALL", 4)
    r = np.random.RandomState(9)
    fresh = (f"k{i}" for i in range(10**7))
    core = [next(fresh) for _ in range(300)]
    rows = []
    for _ in range(40):  # pairs of like texts; texts of different pairs are at about 0.72
        text = core[:]
        for j in r.choice(29, 3, replace=False):
            text[10 * j : 10 * j + 4] = [next(fresh) for _ in range(4)]
        rows += [text, text[:295] + [next(fresh)] * 5]
    made, joins = [], near_dup.beside

    def counted(rows, groups, keys, size):
        out = joins(rows, groups, keys, size)
        if keys == ["key"]:
            made.append(out.count())
        return out

    monkeypatch.setattr(near_dup, "beside", counted)
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(rows)], "doc_id long, text string")
    classes = {q["doc_id"]: q["class_id"] for q in near_dup.classes(docs).collect()}
    assert all(classes[i] == classes[i + 1] for i in range(0, 80, 2))
    assert 2 < len(made) and sum(made) <= 4.5 * made[0], made


def test_near_dup_large_buckets(spark, monkeypatch):
    """Buckets beyond SMALL go through the longer signature, in blocks; texts that share an id are one document."""
    monkeypatch.setattr(near_dup, "SMALL", 2)
    monkeypatch.setattr(near_dup, "BLOCK", 3)
    r = np.random.RandomState(9)
    fresh = (f"b{i}" for i in range(10**7))
    core = [next(fresh) for _ in range(300)]
    rows = []
    for i in range(40):  # pairs of like texts; texts of different pairs are at about 0.72
        text = core[:]
        for j in r.choice(29, 3, replace=False):
            text[10 * j : 10 * j + 4] = [next(fresh) for _ in range(4)]
        rows += [text, text[:295] + [next(fresh)] * 5]
    rows.append(["x"] * 9)
    grams = [shingles(w) for w in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if similar(grams[i], grams[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    data = [(i, " ".join(w)) for i, w in enumerate(rows)]
    got = {q["doc_id"]: q["class_id"] for q in near_dup.classes(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == {i: find(i) for i in range(len(rows))} and len(set(got.values())) > 10
    twins = [(1000, " ".join(["x"] * 9)), (1000, data[2][1])]
    got = near_dup.classes(spark.createDataFrame(data + twins, "doc_id long, text string")).collect()
    assert {q["class_id"] for q in got if q["doc_id"] in (1000, len(rows) - 1, 2)} == {find(2)}


def test_registers_estimate_probability_jaccard():
    r = np.random.RandomState(6)
    x, y = r.randint(1, 2**60, 300).astype(np.uint64), r.randint(1, 9, 300)
    z = np.where(r.rand(300) < 0.2, 0, y)
    both = np.concatenate((x, x[z > 0]))
    text = np.repeat([0, 1], [300, int((z > 0).sum())])
    count = np.concatenate((y, z[z > 0]))
    s = near_dup.signatures(text, both, count, 2, 4096)
    a, b = y / y.sum(), z / z.sum()
    keep = (a > 0) & (b > 0)
    exact = sum(1 / np.maximum(a / a[i], b / b[i]).sum() for i in np.flatnonzero(keep))
    assert (s[0] == s[1]).mean() == pytest.approx(exact, abs=0.03)


def test_components(spark):
    r = np.random.RandomState(7)
    edges = [(int(a), int(b)) for a, b in r.randint(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1100)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = {r["node"]: r["root"] for r in near_dup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


def test_components_write_little(spark, monkeypatch):
    """A hub above its leaves takes one step: five small tables, and no shuffle but by a node's number."""
    made, write = [], near_dup.materialise
    monkeypatch.setattr(near_dup, "materialise", lambda df, what: made.append((what, df._jdf.queryExecution().executedPlan().toString().count("Exchange hash"))) or write(df, what))
    links = write(spark.createDataFrame([(500, i) for i in range(1, 400)] + [(500, 7), (900, 901), (3, 3)], "a long, b long"), "links")
    got = {r["node"]: r["root"] for r in near_dup.components(links).collect()}
    assert got == {i: 1 for i in [*range(1, 400), 500]} | {900: 900, 901: 900}
    assert len(made) <= 5 and sum(n for _, n in made) <= 3, made


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in toxicity.op10_toxicity(spark, sf).collect()}
    held = [(got[i]["predicted"], y, got[i]["held_out"]) for i, y in connection(sf).sql("select doc_id, toxic from labels").fetchall()]
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    yes = [p for p, y, h in held if h and y == 1]
    no = [p for p, y, h in held if h and y == 0]
    assert np.mean(yes) > 0.75 and np.mean(no) < 0.03


def test_label_model_tells_voters_apart():
    r = np.random.RandomState(8)
    y = r.rand(20000) < 0.1
    rate = np.where(y[:, None], 0.6, 0.01) * np.ones((1, toxicity.VOTERS))
    rate[:, :2] = 0.05
    mask = ((r.rand(20000, toxicity.VOTERS) < rate).astype(np.int64) << np.arange(toxicity.VOTERS)).sum(axis=1)
    m, n = np.unique(mask, return_counts=True)
    model = toxicity.fit_label_model(m, n.astype(float))
    assert ((model.posterior(mask) > 0.5) == y).mean() > 0.99


def test_label_model_sees_correlated_voters_as_one():
    """Voters that copy another say nothing that it hasn't said: the posterior is that of brute-force Bayes with the true joint rates."""
    r = np.random.RandomState(9)
    n = 200_000
    y = r.rand(n) < 0.1
    votes = r.rand(n, toxicity.VOTERS) < np.where(y[:, None], 0.5, 0.02)
    for copy in (7, 8):
        votes[:, copy] = votes[:, 6] ^ (r.rand(n) < 0.01)
    votes[:, 9:] &= r.rand(n, toxicity.VOTERS - 9) < 0.2
    mask = (votes.astype(np.int64) << np.arange(toxicity.VOTERS)).sum(axis=1)
    m, k = np.unique(mask, return_counts=True)
    model = toxicity.fit_label_model(m, k.astype(float))
    assert (6, 7, 8) in model.cliques
    # three copies that fire alone are about one vote: prior odds 1 / 9, and the odds of the others' silence
    want = np.log(0.1 / 0.9) + np.log(0.5 / 0.02) + 6 * np.log(0.5 / 0.98) + (toxicity.VOTERS - 9) * np.log((1 - 0.1) / (1 - 0.004))
    got = model.posterior(np.array([0b111000000]))[0]
    assert np.log(got / (1 - got)) == pytest.approx(want, abs=0.5)


def test_clashing_labels_are_toxic(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(8)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, t) for i in range(8) for t in ((0, 1) if i % 2 else (1, 0))], "doc_id long, toxic int")
    assert {r["toxic"] for r in toxicity.labelled(docs, labels).collect()} == {1}


def test_failed_batch_is_invisible(spark, tmp_path):
    """A writer that dies between writing and publishing leaves the totals as they were; the batch can come again, once."""
    store = str(tmp_path / "store")
    rows = spark.createDataFrame([("s", "en", "t@1", 5)], "source string, lang string, tokenizer string, n_tokens long")
    assert token_counts.commit(store, "a", token_counts.signed(rows, 1))
    before = [tuple(r) for r in token_counts.totals(spark, store).collect()]
    token_counts.attempt(store, token_counts.signed(rows, 1))
    assert [tuple(r) for r in token_counts.totals(spark, store).collect()] == before == [("s", "en", "t@1", 1, 5)]
    assert token_counts.commit(store, "b", token_counts.signed(rows, 1)) and not token_counts.commit(store, "b", token_counts.signed(rows, 1))
    assert [tuple(r) for r in token_counts.totals(spark, store).collect()] == [("s", "en", "t@1", 2, 10)]


def test_short_items_are_found_as_whole_sequences(spark):
    docs = spark.createDataFrame([(1, "He said: Open, the door! now"), (2, "open the window, the door"), (3, "door"), (4, None), (5, "THE door the DOOR")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "open the door"), (2, "the door"), (3, "..."), (4, "one two three four five six")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["start_word"], r["n_words"]) for r in decontamination.contaminated(docs, items).collect()}
    assert got == {(1, 1, 2, 3), (1, 2, 3, 2), (2, 2, 3, 2), (5, 2, 0, 2)}


def test_quality_verdict_by_brute_force(spark):
    """kept against quartiles of sorted bucket values of each group, by the same rule written over lists."""
    rows = quality.op3_quality_rules(spark, SF).collect()
    place = {i: (la, s) for i, la, s in connection().sql("select doc_id, lang, source from documents").fetchall()}
    lines = {i: len([x for x in (t or "").split("\n") if WORD.search(x)]) for i, t in connection().sql("select doc_id, text from documents").fetchall()}
    value = {
        "symbol_ratio": lambda r: (r["n_symbols"], r["n_words"]), "dup_line_ratio": lambda r: (r["n_dup_lines"], lines[r["doc_id"]]),
        "repeat_ratio": lambda r: (r["n_repeat_words"], r["n_words"]), "word_length": lambda r: (r["word_chars"], r["n_words"]),
    }

    def centre(x):
        return 0.0 if x <= 1e-4 else 1e-4 * quality.GAMMA ** (int(np.floor(np.log(x / 1e-4) / np.log(quality.GAMMA))) + 0.5)

    def limit(xs):
        xs = sorted(map(centre, xs))
        q1, q3 = (xs[int(np.ceil(p * len(xs))) - 1] for p in (0.25, 0.75))
        return q3 + quality.FENCE * max(q3 - q1, quality.LEAST_SPREAD)

    for name, of in value.items():
        ratio = {r["doc_id"]: (of(r)[0] / of(r)[1] if of(r)[1] else 0.0) for r in rows}
        groups, langs = {}, {}
        for r in rows:
            if not r["base_failed"]:
                groups.setdefault(place[r["doc_id"]], []).append(ratio[r["doc_id"]])
                langs.setdefault(place[r["doc_id"]][0], []).append(ratio[r["doc_id"]])
        for r in rows:
            la, s = place[r["doc_id"]]
            own = groups.get((la, s), [])
            want = (limit(own) * len(own) + limit(langs[la]) * quality.PRIOR) / (len(own) + quality.PRIOR) if own else None
            assert (r[f"{name}_max"] is None) == (want is None) and (want is None or r[f"{name}_max"] == pytest.approx(want, rel=1e-6)), (name, r)
            if r["kept"] and want is not None:
                assert ratio[r["doc_id"]] <= want * (1 + 1e-9)
    kept = {r["doc_id"]: r["kept"] for r in rows}
    want = {r["doc_id"]: not r["base_failed"] and all((of(r)[0] / of(r)[1] if of(r)[1] else 0.0) <= (r[f"{k}_max"] if r[f"{k}_max"] is not None else np.inf) for k, of in value.items()) for r in rows}
    assert kept == want


def licence_files():
    from foretally.llm.licence_texts import BODIES

    year = "Copyright (c) 2020, Some One. All rights reserved.\n\n"
    files = [(k, f"a{i}/LICENSE", (year if k in ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause") else "") + t.replace(". ", ".\n")) for i, (k, t) in enumerate(sorted(BODIES.items()))]
    mpl = "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */\nint main;\n" + "int x = 1;\n" * 50
    apache = "#!/bin/sh\n# Copyright 2020 Some One\n#\n# Licensed under the Apache License, Version 2.0 (the \"License\");\n# you may not use this file except in compliance with the License.\n\necho hello world\n"
    gpl = "code\n" * 30 + "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 2 of the License, or\n(at your option) any later version.\n"
    files += [("MPL-2.0", "b/x.c", mpl), ("Apache-2.0", "b/y.sh", apache), ("GPL-2.0", "b/z.txt", gpl), ("Proprietary", "b/w.txt", "Some text.\nAll rights reserved.\n"), (None, "b/v.txt", "The licensee left the room with his copy of the book."), (None, "b/u.txt", None)]
    files.append(("MIT", "b/long.txt", "word " * 400 + "Released under the MIT License" + ".\n"))
    return [(i, p, t, k) for i, (k, p, t) in enumerate(files)]


def test_licence_texts_and_wrapped_notices(spark):
    rows = licence_files()
    d = spark.createDataFrame([r[:3] for r in rows if r[1] != "b/long.txt"], "doc_id long, path string, text string")
    got = {r["doc_id"]: r["licence"] for r in licences.scan(d).collect()}
    assert got == {i: k for i, p, _, k in rows if p != "b/long.txt"}


#: Usual headers, and what they must be named; those of None name no licence of the templates, or several.
HEADERS = [
    ("LGPL-2.1", "# This library is free software; you can redistribute it and/or\n# modify it under the terms of the GNU Lesser General Public\n# License as published by the Free Software Foundation; either\n# version 2.1 of the License, or (at your option) any later version.\n"),
    ("AGPL-3.0", "// This program is free software: you can redistribute it and/or modify\n// it under the terms of the GNU Affero General Public License as\n// published by the Free Software Foundation, either version 3 of the\n// License, or (at your option) any later version.\nint x;\n"),
    ("GPL-3.0", "/*\n * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version.\n */\n"),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", "// SPDX-License-Identifier: Apache-2.0\nfn main() {}\n"), ("GPL-2.0", "/* SPDX-License-Identifier: GPL-2.0-only */\nint x;\n"), ("BSD-3-Clause", "# SPDX-License-Identifier: BSD-3-Clause\n"), ("LGPL-2.1", "# SPDX-License-Identifier: LGPL-2.1-or-later\n"),
    (None, "# SPDX-License-Identifier: MIT OR Apache-2.0\n"), (None, "This code is not released under the MIT License.\n"), (None, "It is under the GNU General Public License, as everyone knows.\n"), (None, "Ask for a license at the counter, says the mozilla public announcement.\n"),
]


def test_headers_name_their_licence(spark):
    d = spark.createDataFrame([(i, f"x/{i}.c", t) for i, (_, t) in enumerate(HEADERS)], "doc_id long, path string, text string")
    got = {r["doc_id"]: r["licence"] for r in licences.scan(d).collect()}
    assert got == {i: k for i, (k, _) in enumerate(HEADERS)}


def test_whole_licence_texts(spark):
    """The texts that many systems keep: each by its own name, as a licence file."""
    import os

    folder = "/usr/share/common-licenses"
    names = {"Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}
    there = [n for n in names if os.path.exists(f"{folder}/{n}")]
    if not there:
        pytest.skip("no licence texts on this system")
    d = spark.createDataFrame([(i, f"d{i}/COPYING", open(f"{folder}/{n}", encoding="utf-8").read()) for i, n in enumerate(there)], "doc_id long, path string, text string")
    got = {there[r["doc_id"]]: (r["licence"], r["cosine"]) for r in licences.scan(d).collect()}
    assert {n: k for n, (k, _) in got.items()} == {n: names[n] for n in there}, got


def test_licence_cosines_by_brute_force(spark):
    """TF-IDF and cosine over plain lists, for the units of the small table and of the fixture."""
    from foretally.llm.licence_texts import BODIES, NOTICES

    d = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id + 1000 as doc_id", "cast(null as string) as path", "text").unionByName(spark.createDataFrame([r[:3] for r in licence_files()], "doc_id long, path string, text string"))
    units = [(r["doc_id"], r["level"], list(r["words"])) for r in licences.units(d).collect()]
    templates = [(k, 0, t) for k, t in BODIES.items()] + [(k, 1, t) for k, t in NOTICES]
    words = [re.findall(licences.TERM, t.lower()) for _, _, t in templates]
    df = Counter(w for x in [u[2] for u in units] + words for w in set(x))
    total = len(units) + len(templates)

    def vector(x):
        v = {w: n * (np.log((1 + total) / (1 + df[w])) + 1) for w, n in Counter(x).items()}
        size = np.sqrt(sum(a * a for a in v.values()))
        return {w: a / size for w, a in v.items()}

    known = [vector(x) for x in words]
    best = {}
    for doc, level, x in units:
        v = vector(x)
        scores = [(round(sum(a * v.get(w, 0.0) for w, a in t.items()), 6), name, of) for (name, of, _), t in zip(templates, known, strict=True)]
        likes = sorted((s for s in scores if s[0] >= licences.LEAST_COSINE), reverse=True)
        bsd = {"BSD-2-Clause", "BSD-3-Clause"}
        if any(name != likes[0][1] and not {name, likes[0][1]} <= bsd and c > likes[0][0] - licences.MARGIN for c, name, _ in likes):
            continue
        for cosine, name, of in likes:
            rank = (0 if level == 0 == of else 1) + 2 * (name == "Proprietary")
            best.setdefault(doc, []).append((rank, -cosine, name))
    want = {}
    for doc, found in best.items():
        rank, cosine, name = min(found)
        if name == "BSD-2-Clause" and rank > 0 and any(n == "BSD-3-Clause" for _, _, n in found):
            name = "BSD-3-Clause"
        want[doc] = (name, -cosine)
    got = {r["doc_id"]: (r["licence"], r["cosine"]) for r in licences.own_licences(d).collect()}
    assert {i: k for i, (k, _) in got.items()} == {i: k for i, (k, _) in want.items()} and len(want) > 20
    assert all(got[i][1] == pytest.approx(c, abs=2e-6) for i, (_, c) in want.items())
