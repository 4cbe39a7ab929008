"""Toxicity scores from weak supervision (operator 10).

Terms of a text are its words (letters and digits, lower-cased) and their first 4, 5
and 6 bytes, so that inflected and compounded insults share a term.

1. Voters.  Some come from a fixed word list, some from patterns of shouting, and
   LEARNED from terms that mark labelled rows: the best terms by smoothed odds,
   dealt over the voters.  A voter fires or not; a text's votes are a bit mask.
2. Label model.  Masks are counted over all documents (at most 2 ** VOTERS rows).
   Expectation maximisation estimates the prior and how voters fire in either class.  Voters
   that go together more than the class explains form cliques of CLIQUE voters at most, and the
   model is fitted again with one table of joint firing a clique and class, so that a vote
   counts for what it adds to the votes it is correlated with.
3. Classifier.  Logistic regression on terms, fitted to the posterior labels of at
   most SAMPLE documents, then calibrated by a logistic fit on labelled rows.

Labels are learned from rows whose crc32(doc_id) mod 4 is not 2, SAMPLE at most.  Neither
labels nor lang, source or id are inputs of a score.

Defined results: a null or empty text has the score of no evidence; a term's
repetition doesn't count; repeated rows score alike; labels that are null or
missing teach nothing, an id that is labelled both ways is toxic, and without any label the fixed list and patterns remain; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import only, table

#: Common insults, by voter.
INSULTS = (
    ("idiot", "moron", "stupid", "dumb", "imbecile", "fool"),
    ("trash", "scum", "garbage", "filth", "vermin"),
    ("worthless", "pathetic", "loser", "clown", "useless"),
    ("disgusting", "hate", "ugly", "sickening", "vile"),
)
SHOUTS = 2
LEARNED = 10
VOTERS = len(INSULTS) + SHOUTS + LEARNED
#: Voters of a clique at most, and the correlation within a class from which two belong together.
CLIQUE, CORRELATED = 4, 0.1
#: Learned terms at most, and the labelled toxic rows a term needs.
TERMS, SUPPORT = 400, 6
#: Documents and labelled rows that a fit takes at most.
SAMPLE = 16_000
#: Terms that the classifier weighs at most.
WEIGHTS = 8192
THRESHOLD = 0.3
PREFIXES = (4, 5, 6)
_SALTS = K.mix(np.arange(1, len(PREFIXES) + 2, dtype=np.uint64))


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


class Terms(NamedTuple):
    text: np.ndarray
    term: np.ndarray
    shout: np.ndarray


_UPPER = ((np.arange(256) >= 65) & (np.arange(256) <= 90)).astype(np.int64)
_LETTER = _UPPER + ((np.arange(256) >= 97) & (np.arange(256) <= 122))
_BANG = (np.arange(256) == 33).astype(np.int64)


def terms(column: pa.Array) -> Iterator[tuple[int, int, Terms]]:
    """Distinct terms of each text and the shouting voters' bits."""
    for lo, hi, buf, offs in K.chunks(column):
        w = K.Words(buf, offs, K.PUNCT, K.FOLD)
        text, term = [w.text], [w.hash ^ _SALTS[0]]
        for n, salt in zip(PREFIXES, _SALTS[1:], strict=True):
            long = np.flatnonzero(w.end - w.start >= n)
            text.append(w.text[long])
            term.append(w.prefix.ranges(w.start[long], w.start[long] + n) ^ salt)
        t, x = np.concatenate(text), np.concatenate(term)
        order = np.lexsort((x, t))
        t, x = t[order], x[order]
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (x[1:] != x[:-1])
        letters, upper, bangs = (K.per_row(f[buf], offs) for f in (_LETTER, _UPPER, _BANG))
        shout = (upper * 2 > letters).astype(np.int64) | ((bangs * 20 > w.counts()) & (bangs > 1)).astype(np.int64) << 1
        yield lo, hi, Terms(t[new], x[new], shout)


def word_terms(words: tuple[str, ...]) -> np.ndarray:
    w = K.Words(*K.texts(pa.array([" ".join(words)])), K.PUNCT, K.FOLD)
    return w.hash ^ _SALTS[0]


class Voters(NamedTuple):
    """Sorted terms and the voter of each."""

    term: np.ndarray
    bit: np.ndarray

    def masks(self, t: Terms, rows: int) -> np.ndarray:
        out = t.shout.copy()
        if len(self.term):
            at = np.minimum(np.searchsorted(self.term, t.term), len(self.term) - 1)
            hit = self.term[at] == t.term
            np.bitwise_or.at(out, t.text[hit], np.int64(1) << self.bit[at[hit]])
        return out


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, toxic: at most about SAMPLE labelled rows that may teach."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    share = min(1.0, SAMPLE / max(1, known.count()))
    return docs.join(known.where(F.pmod(F.xxhash64("doc_id", F.lit(10)), F.lit(1_000_000)) < int(share * 1_000_000)), "doc_id")


def term_counts(rows: DataFrame) -> DataFrame:
    """term, toxic rows, other rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = b.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, hi, t in terms(b.column("text")):
                term, inverse = np.unique(t.term, return_inverse=True)
                bad = np.bincount(inverse, weights=y[lo:hi][t.text], minlength=len(term)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(bad), pa.array(np.bincount(inverse, minlength=len(term)) - bad)], names=["term", "bad", "good"])

    return rows.mapInArrow(run, "term long, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))


def odds(n_bad: int, n_good: int) -> Column:
    return F.log((F.col("bad") + 0.5) / (n_bad + 1.0)) - F.log((F.col("good") + 0.5) / (n_good + 1.0))


def fixed_voters() -> list[tuple[np.ndarray, int]]:
    return [(word_terms(words), SHOUTS + i) for i, words in enumerate(INSULTS)]


def make_voters(best: list[int]) -> Voters:
    """best: learned terms, best first."""
    parts = fixed_voters()
    first = SHOUTS + len(INSULTS)
    parts += [(np.array(best[i::LEARNED], np.int64).view(np.uint64), first + i) for i in range(LEARNED)]
    term = np.concatenate([p for p, _ in parts])
    bit = np.concatenate([np.full(len(p), b) for p, b in parts])
    term, at = np.unique(term, return_index=True)
    return Voters(term, bit[at])


def mask_counts(docs: DataFrame, voters: Voters) -> DataFrame:
    """mask, n over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, t in terms(b.column("text")):
                mask, n = np.unique(voters.masks(t, hi - lo), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(mask), pa.array(n)], names=["mask", "n"])

    return docs.select("text").mapInArrow(run, "mask long, n long").groupBy("mask").agg(F.sum("n").alias("n"))


class LabelModel(NamedTuple):
    prior: float
    #: Voters that are modelled together.
    cliques: tuple[tuple[int, ...], ...]
    #: For each clique, the probability of each pattern of its votes in class 0 and class 1.
    tables: tuple[np.ndarray, ...]

    @property
    def rates(self) -> np.ndarray:
        """Firing rate of each voter in class 0 and class 1."""
        out = np.zeros((2, VOTERS))
        for clique, t in zip(self.cliques, self.tables, strict=True):
            pattern = np.arange(t.shape[1])
            for i, voter in enumerate(clique):
                out[:, voter] = t[:, (pattern >> i) & 1 == 1].sum(axis=1)
        return out

    def posterior(self, mask: np.ndarray) -> np.ndarray:
        z = np.full(len(mask), np.log(self.prior / (1 - self.prior)))
        for clique, t in zip(self.cliques, self.tables, strict=True):
            evidence = np.log(t[1] / t[0])
            evidence[0] = min(evidence[0], 0.0)  # a voter never speaks for the other class
            evidence[1:] = np.maximum(evidence[1:], 0.0)
            z += evidence[_pattern(mask, clique)]
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _bits(mask: np.ndarray) -> np.ndarray:
    return ((mask[:, None] >> np.arange(VOTERS)) & 1).astype(np.float64)


def _pattern(mask: np.ndarray, clique: tuple[int, ...]) -> np.ndarray:
    out = np.zeros(len(mask), np.int64)
    for i, voter in enumerate(clique):
        out |= ((mask >> voter) & 1) << i
    return out


def cliques_of(correlation: np.ndarray) -> tuple[tuple[int, ...], ...]:
    """Voters merged by falling correlation, CLIQUE together at most."""
    of = {i: (i,) for i in range(VOTERS)}
    pairs = [(i, j) for i in range(VOTERS) for j in range(i) if correlation[i, j] > CORRELATED]
    for i, j in sorted(pairs, key=lambda x: (-correlation[x], x)):
        if of[i] != of[j] and len(of[i]) + len(of[j]) <= CLIQUE:
            both = tuple(sorted(of[i] + of[j]))
            of.update(dict.fromkeys(both, both))
    return tuple(sorted(set(of.values())))


def fit_label_model(mask: np.ndarray, n: np.ndarray, rounds: int = 4, steps: int = 50) -> LabelModel:
    """Expectation maximisation over mask counts, with voters that correlate within a class in cliques."""
    alone = tuple((i,) for i in range(VOTERS))
    v, total = _bits(mask), n.sum()
    if not total:
        return LabelModel(0.1, alone, (np.array([[0.99, 0.01], [0.7, 0.3]]),) * VOTERS)
    # to begin with, two votes of lexicon voters tell
    lexicon = v[:, SHOUTS:].sum(axis=1)
    p = np.where(lexicon >= 2, 0.95, np.where(lexicon == 1, 0.4, 0.02))
    cliques, model = alone, None
    for _ in range(rounds):
        patterns = [_pattern(mask, c) for c in cliques]
        for _ in range(steps):
            q1, q0 = n * p, n * (1 - p)
            tables = []
            for c, at in zip(cliques, patterns, strict=True):
                size = 1 << len(c)
                # a little of silence and of each pattern in both classes, so that rare patterns say little
                t = np.stack([np.bincount(at, weights=q0, minlength=size) + 0.5, np.bincount(at, weights=q1, minlength=size) + 0.5])
                t[0, 0] += 50.0
                tables.append(t / t.sum(axis=1, keepdims=True))
            model = LabelModel(float(np.clip((q1.sum() + 1) / (total + 10), 1e-4, 0.5)), cliques, tuple(tables))
            new = model.posterior(mask)
            done = np.abs(new - p).max() < 1e-6
            p = new
            if done:
                break
        excess = np.zeros((VOTERS, VOTERS))
        for q in (n * p, n * (1 - p)):
            mean = q @ v / max(q.sum(), 1e-9)
            centred = v - mean
            cov = (centred * q[:, None]).T @ centred / max(q.sum(), 1e-9)
            sd = np.sqrt(np.diag(cov)).clip(1e-9)
            corr = cov / np.outer(sd, sd)
            corr[np.outer(sd, sd) < 1e-6] = 0
            excess = np.maximum(excess, corr * (q.sum() > 1))
        found = cliques_of(excess)
        if found == cliques:
            break
        cliques = found
    return model


class Classifier(NamedTuple):
    """Sorted terms, their weights, and the calibrated bias and scale."""

    term: np.ndarray
    weight: np.ndarray
    bias: float

    def scores(self, t: Terms, rows: int) -> np.ndarray:
        z = np.full(rows, self.bias)
        if len(self.term):
            at = np.minimum(np.searchsorted(self.term, t.term), len(self.term) - 1)
            hit = self.term[at] == t.term
            z += np.bincount(t.text[hit], weights=self.weight[at[hit]], minlength=rows)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def logistic(row: np.ndarray, column: np.ndarray, y: np.ndarray, n: int, columns: int, decay: float = 1e-4, steps: int = 200) -> tuple[np.ndarray, float]:
    """L2-regularised logistic regression on 0/1 features given by (row, column), for labels y between 0 and 1; accelerated gradient descent."""
    balance = np.where(y > 0.5, 0.5 / max(y.mean(), 1e-3), 0.5 / max(1 - y.mean(), 1e-3))
    balance /= balance.mean()
    rate = np.append(np.full(columns, decay), 0.0)

    def times(w: np.ndarray) -> np.ndarray:
        return np.bincount(row, weights=w[column], minlength=n) + w[-1]

    def back(g: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(column, weights=g[row], minlength=columns), g.sum())

    # the largest curvature, by power iteration, sets the step
    v = np.ones(columns + 1) / np.sqrt(columns + 1)
    curve = 1.0
    for _ in range(20):
        v = back(times(v) * balance) / (4 * n)
        curve = float(np.linalg.norm(v))
        v /= max(curve, 1e-12)
    step = 0.9 / (curve + decay)
    w, look, t = np.zeros(columns + 1), np.zeros(columns + 1), 1.0
    for _ in range(steps):
        g = (1 / (1 + np.exp(-np.clip(times(look), -40, 40))) - y) * balance / n
        new = look - step * (back(g) + rate * look)
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look, w, t = new + (t - 1) / after * (new - w), new, after
    return w[:-1], float(w[-1])


class Model(NamedTuple):
    voters: Voters
    labels: LabelModel
    classifier: Classifier


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    d = only(docs, "doc_id", "text")
    known = labelled(d, labels).select("text", "toxic")
    n = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    n_bad, n_good = n.get(1, 0), n.get(0, 0)
    counts = term_counts(known).where(F.col("bad") + F.col("good") >= SUPPORT).withColumn("odds", odds(n_bad, n_good)).persist()
    best = [r["term"] for r in counts.where((F.col("bad") >= SUPPORT) & (F.col("odds") >= 3.0)).orderBy(F.desc(F.col("odds") * F.sqrt("bad")), "term").limit(TERMS).collect()]
    weighed = [r["term"] for r in counts.orderBy(F.desc(F.abs("odds") * F.sqrt(F.col("bad") + F.col("good"))), "term").limit(WEIGHTS).collect()]
    counts.unpersist()
    voters = make_voters(best)
    patterns = mask_counts(d, voters).toPandas()  # at most 2 ** VOTERS rows
    order = np.argsort(patterns["mask"].to_numpy())
    model = fit_label_model(patterns["mask"].to_numpy()[order], patterns["n"].to_numpy()[order].astype(np.float64))

    term = np.unique(np.concatenate([np.array(weighed, np.int64).view(np.uint64), voters.term]))
    share = min(1.0, SAMPLE / max(1, int(patterns["n"].sum())))
    sample = d.where(~held_out() & (F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) < int(share * 1_000_000))).select("text", F.lit(None).cast("int").alias("toxic")).unionByName(known)
    feats = sample.mapInArrow(_features(term, voters), "toxic int, mask long, at binary").toPandas()  # SAMPLE rows twice at most
    columns = [np.frombuffer(x, "<i4") for x in feats["at"]]
    row = np.repeat(np.arange(len(columns)), [len(c) for c in columns])
    column = np.concatenate([*columns, np.zeros(0, "<i4")]).astype(np.int64)
    y = model.posterior(feats["mask"].to_numpy(dtype=np.int64)) if len(feats) else np.zeros(0)
    weight, bias = logistic(row, column, y, len(columns), len(term)) if len(feats) else (np.zeros(len(term)), -4.0)
    truth = feats["toxic"].to_numpy(dtype=np.float64)
    z = np.bincount(row, weights=weight[column], minlength=len(columns)) + bias if len(feats) else np.zeros(0)
    scale, shift = calibrate(z[~np.isnan(truth)], truth[~np.isnan(truth)])
    return Model(voters, model, Classifier(term, weight * scale, bias * scale + shift))


def calibrate(z: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """scale and shift of a logistic fit of y to z, by Newton's method; none without both classes."""
    if not len(y) or not 0 < y.sum() < len(y):
        return 1.0, 0.0
    x = np.stack([z, np.ones(len(z))], axis=1)
    w = np.array([1.0, 0.0])
    ridge = np.diag([1e-2, 1e-3])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        grad = x.T @ (p - y) + ridge @ (w - np.array([1.0, 0.0]))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, grad)
        w = w - np.clip(step, -2, 2)
    return (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, 0.0)


def _features(term: np.ndarray, voters: Voters) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, t in terms(b.column("text")):
                at = np.minimum(np.searchsorted(term, t.term), max(0, len(term) - 1))
                hit = term[at] == t.term if len(term) else np.zeros(0, bool)
                text, at = t.text[hit], at[hit].astype("<i4")
                cut = np.searchsorted(text, np.arange(hi - lo + 1))
                yield pa.RecordBatch.from_arrays([b.column("toxic").slice(lo, hi - lo), pa.array(voters.masks(t, hi - lo)), pa.array([at[a:z].tobytes() for a, z in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], names=["toxic", "mask", "at"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    classifier = model.classifier

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, t in terms(b.column("text")):
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), pa.array(classifier.scores(t, hi - lo))], names=["doc_id", "score"])

    d = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return d.mapInArrow(run, "doc_id long, score double").select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op10_toxicity": op10_toxicity}
ORACLE: dict[str, str] = {}
