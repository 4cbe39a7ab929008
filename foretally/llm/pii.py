r"""Personal data in texts (operator 1), with DataFrame functions only.

Base spans are exact: e-mail addresses, IPv4 addresses, card numbers and phone
numbers by format and validity.  Beside them, high-recall generators propose spans that
may overlap each other and the base: secrets (long runs of key characters), accounts
(digit groups), handles (written-out addresses) and dotted or colon-separated addresses.
Each gets features of its format and of the punctuation around it; gradient-boosted
trees, written out as column expressions, score it.

Labels for the fit are weak, and come from evidence that no feature shows: a word before the span
that announces its kind, a check digit, a top-level domain, or a valid base span in the same place.  So
the trees learn what announced and valid data looks like, and find it where nothing announces
it.  They are fitted to candidates of at most TRAIN_DOCS documents.  The threshold of each kind is
the least score, 0.5 at least, at which the candidates of all other documents reach PRECISION by
the same evidence; of these only candidates that overlap no base span count, since only
they can be added.  A kind whose candidates don't reach it adds nothing.
Selected candidates are merged where they overlap, and dropped where they overlap a
base span, which stays.

A match's place follows from the lengths of what a split by the same pattern
leaves, summed in blocks, so that one map over the texts finds all, without a shuffle.  Patterns are
possessive and anchored at the start of a run: their time is linear in the text.  Redaction copies
the list of spans for each span of a text: its time grows with the text and with the square of their number.

Defined results: a null text is empty and has no spans; with fewer than LEAST training candidates
of either label, no trees are fitted and only base spans are found; repeated rows give equal results; an empty table
gives an empty result; other columns are kept as they are (but for one named pii, which `find` replaces).
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, only, table

_LOCAL = "A-Za-z0-9._%+-"
#: Base patterns: those of the contract, made linear.
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
GENERATED = {
    "secret": r"(?<![A-Za-z0-9_/+-])(?=[A-Za-z_/+-]*+[0-9])[A-Za-z0-9_/+-]{16,}+",
    "account": r"(?<![0-9])\+?[0-9](?:[ ().-]{0,2}+[0-9]){6,}+",
    "handle": rf"(?<![{_LOCAL}])[{_LOCAL}]++(?:@| ?(?:\(at\)|\[at\]) ?| at )[A-Za-z0-9-]++(?:(?:\.| ?(?:\(dot\)|\[dot\]) ?| dot )[A-Za-z0-9-]++)++",
    "address": r"(?<![0-9A-Fa-f:.])[0-9A-Fa-f]{1,4}(?:[:.][0-9A-Fa-f]{1,4}){3,7}+",
}
CONTEXT = 24
#: Words that announce a kind.
WORDS = {
    "secret": "token|key|secret|passw(?:or)?d|credential|bearer|auth",
    "account": "account|acct|iban|konto|cuenta|compte|passport|ssn|tel|phone|fax|mobile|card",
    "handle": "mail|contact|write|reach",
    "address": r"\bip|ipv6|mac|host|server|addr(?:ess)?",
}
TOP_LEVEL = r"(?i)(?:\.|dot\)? ?|\] ?)(?:com|org|net|edu|gov|info|io|eu|uk|de|fr|es|it|nl)$"
TRAIN_DOCS = 20_000
#: Documents of a fit at most, as a share of all: the others are for the thresholds.
TRAIN_SHARE = 0.75
PRECISION = 0.95
TREES, DEPTH = 20, 3
#: Training candidates of either label without which no tree can be fitted.
LEAST = 5
#: Numbers that are merged at a time, and characters of a piece of a text that is cut.
BLOCK, PIECE = 64, 1024

Expr = Callable[[Column], Column]


def _gate(text: Column) -> dict[str, Column]:
    """What a text must have for a pattern to be tried."""
    digit, at = F.regexp_like(text, F.lit("[0-9]")), F.contains(text, F.lit("@"))
    handle = at
    for mark in ("(at)", "[at]", " at "):
        handle = handle | F.contains(text, F.lit(mark))
    return {"email": at, "ip": digit, "card": digit, "phone": F.contains(text, F.lit("+")) & digit, "secret": digit, "account": digit, "handle": handle, "address": digit}


def _digits(x: Column) -> Column:
    return F.char_length(F.regexp_replace(x, "[^0-9]", ""))


def _ip_part(x: Column) -> Column:
    plain = F.regexp_replace(x, "^0+(?=[0-9])", "")
    return (F.char_length(plain) <= 3) & (F.substring(plain, 1, 3).cast("int") <= 255)


def _luhn(x: Column) -> Column:
    return F.call_function("luhn_check", F.regexp_replace(x, "[^0-9]", ""))


VALID: dict[str, Expr] = {
    "email": lambda x: F.lit(True),
    "ip": lambda x: F.forall(F.split(x, r"\."), _ip_part),
    "card": lambda x: _digits(x).between(16, 19) & _luhn(x),
    "phone": lambda x: _digits(x).between(8, 15),
}


def _greater(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def _running(xs: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """What merge makes of each number (0 or more) and all before it: of blocks first, then within each.  xs isn't empty."""
    starts = F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int"))
    total = lambda x: F.aggregate(x, F.lit(0), merge)
    blocks = F.transform(starts, lambda b: F.slice(xs, b * BLOCK + 1, BLOCK))
    before = F.aggregate(
        blocks, F.struct(F.array().cast("array<int>").alias("xs"), F.lit(0).alias("at")),
        lambda a, x: F.struct(F.concat(a["xs"], F.array(a["at"])).alias("xs"), merge(a["at"], total(x)).alias("at")), lambda a: a["xs"],
    )
    inside = lambda p: F.transform(p["x"], lambda _, i: merge(p["at"], total(F.slice(p["x"], 1, i + 1))))
    return F.flatten(F.transform(F.arrays_zip(blocks.alias("x"), before.alias("at")), inside))


def _below(xs: Column, x: Column) -> Column:
    """How many of the ascending numbers xs, a stored column, are less than x: by halves."""
    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(xs) + 1.0)).cast("int") + 1)
    half = lambda a: F.shiftright(a["lo"] + a["hi"], 1)
    side = lambda a: F.when(F.get(xs, half(a)) < x, F.struct((half(a) + 1).alias("lo"), a["hi"].alias("hi"))).otherwise(F.struct(a["lo"].alias("lo"), half(a).alias("hi")))
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(xs).alias("hi")), lambda a, _: F.when(a["lo"] < a["hi"], side(a)).otherwise(a), lambda a: a["lo"])


def _walls(spans: Column) -> Column:
    """The starts of spans in order, and how far each and those before it reach; null without any."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    both = lambda o: F.struct(o["start"].alias("starts"), _running(o["end"], _greater).alias("reach"))
    return F.when(F.size(spans) > 0, F.transform(F.array(ordered), both)[0])


def located(pieces: Column, hits: Column) -> Column:
    """Array of (start, end, hit, left, right): places in code points, and what stands around."""
    lengths = F.zip_with(pieces, hits, lambda p, h: F.char_length(p) + F.coalesce(F.char_length(h), F.lit(0)))
    left = F.transform(pieces, lambda p: F.substring(p, -CONTEXT, CONTEXT))
    right = F.transform(F.slice(pieces, 2, F.greatest(F.size(hits), F.lit(1))), lambda p: F.substring(p, 1, CONTEXT))
    rows = F.arrays_zip(hits.alias("hit"), _running(lengths, lambda a, n: a + n).alias("end"), left.alias("left"), right.alias("right"))
    found = F.filter(rows, lambda r: r["hit"].isNotNull())
    return F.transform(found, lambda r: F.struct((r["end"] - F.char_length(r["hit"])).alias("start"), r["end"].alias("end"), r["hit"].alias("hit"), r["left"].alias("left"), r["right"].alias("right")))


_PLACES = "array<struct<start:int,end:int,hit:string,left:string,right:string>>"


def _search(rows: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """rows (with text) and an array `at_<kind>` for each pattern.  Texts without a match, which most are, are read once for it and no more."""
    text = F.col("text")
    gate = _gate(text)
    split = rows.withColumns({f"g_{k}": gate[k] & F.regexp_like(text, F.lit(p)) for k, p in patterns.items()}).withColumns(
        {f"p_{k}": F.when(F.col(f"g_{k}"), F.split(text, p, -1)) for k, p in patterns.items()} | {f"h_{k}": F.when(F.col(f"g_{k}"), F.regexp_extract_all(text, F.lit(p), F.lit(0))) for k, p in patterns.items()}
    )
    found = {f"at_{k}": F.when(F.col(f"g_{k}"), located(F.col(f"p_{k}"), F.col(f"h_{k}"))).otherwise(F.array().cast(_PLACES)) for k in patterns}
    return split.withColumns(found).drop(*[f"{x}_{k}" for k in patterns for x in "gph"])


def _span(kind: str) -> Expr:
    return lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))


def _holds(kind: str) -> Expr:
    return lambda s: VALID[kind](s["hit"])


def _named(kind: str) -> Expr:
    return lambda s: F.struct(F.lit(kind).alias("kind"), *[s[x].alias(x) for x in ("start", "end", "hit", "left", "right")])


def base_spans(docs: DataFrame) -> DataFrame:
    """docs with `base` (array of kind, start, end in order) and n_<kind>."""
    d = _search(docs.withColumn("text", F.coalesce(F.col("text"), F.lit(""))), BASE)
    valid = d.withColumns({f"at_{k}": F.transform(F.filter(F.col(f"at_{k}"), _holds(k)), _span(k)) for k in BASE})
    return valid.withColumns({f"n_{k}": F.size(f"at_{k}").cast("long") for k in BASE} | {"base": F.concat(*[F.col(f"at_{k}") for k in BASE])}).drop(*[f"at_{k}" for k in BASE])


def _count(x: Column, of: str) -> Column:
    return F.char_length(F.regexp_replace(x, f"[^{of}]", ""))


FEATURES: dict[str, Expr] = {
    "length": lambda c: F.char_length(c["hit"]),
    "digits": lambda c: _digits(c["hit"]),
    "letters": lambda c: _count(c["hit"], "A-Za-z"),
    "capitals": lambda c: _count(c["hit"], "A-Z"),
    "hex_letters": lambda c: _count(c["hit"], "A-Fa-f"),
    "different": lambda c: F.size(F.array_distinct(F.split(F.substring(c["hit"], 1, 64), ""))),
    "groups": lambda c: F.size(F.split(c["hit"], "[^A-Za-z0-9]+")),
    "dots": lambda c: _count(c["hit"], "."),
    "colons": lambda c: _count(c["hit"], ":"),
    "dashes": lambda c: _count(c["hit"], "_/-"),
    "brackets": lambda c: _count(c["hit"], "()\\[\\]"),
    "at": lambda c: F.contains(c["hit"], F.lit("@")).cast("int"),
    "plus": lambda c: F.startswith(c["hit"], F.lit("+")).cast("int"),
    "longest_number": lambda c: F.coalesce(F.array_max(F.transform(F.split(c["hit"], "[^0-9]+"), F.char_length)), F.lit(0)),
    "small_parts": lambda c: F.coalesce(F.forall(F.split(F.substring(c["hit"], 1, 64), "[^0-9]+"), lambda x: (F.char_length(x) < 4) & (F.coalesce(F.substring(x, 1, 3).try_cast("int"), F.lit(0)) <= 255)), F.lit(True)).cast("int"),
    "quoted": lambda c: F.regexp_like(c["left"], F.lit("[\"'`]$")).cast("int"),
    "assigned": lambda c: F.regexp_like(c["left"], F.lit("[=:]\\s?[\"'`]?$")).cast("int"),
    "joined_left": lambda c: F.regexp_like(c["left"], F.lit("[A-Za-z0-9]$")).cast("int"),
    "joined_right": lambda c: F.regexp_like(c["right"], F.lit("^[A-Za-z0-9]")).cast("int"),
    "kind": lambda c: F.array_position(F.array(*[F.lit(k) for k in GENERATED]), c["kind"]),
}


def _evidence(c: Column) -> Column:
    """What speaks for a candidate beside its format: none of this is a feature."""
    said = F.lit(False)
    for kind, words in WORDS.items():
        said = said | ((c["kind"] == kind) & F.regexp_like(c["left"], F.lit(rf"(?i)(?:{words})\W{{0,6}}$")))
    digit = (c["kind"] == "account") & _digits(c["hit"]).between(12, 19) & F.coalesce(_luhn(c["hit"]), F.lit(False))
    domain = (c["kind"] == "handle") & F.regexp_like(c["hit"], F.lit(TOP_LEVEL))
    form = (c["kind"] == "address") & F.regexp_like(c["hit"], F.lit(r"^(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}|[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}){5})$"))
    return said | digit | domain | form


def candidates(rows: DataFrame) -> DataFrame:
    """rows (with text, base) and `candidates`: array of kind, start, end, evidence, spare (overlaps no base span), f (features)."""
    d = _search(rows.withColumn("walls", _walls(F.col("base"))), GENERATED)
    named = F.concat(*[F.transform(F.col(f"at_{k}"), _named(k)) for k in GENERATED])
    feats = lambda c: F.array(*[f(c).cast("double") for f in FEATURES.values()])
    walls = F.col("walls")
    before = lambda c: _below(walls["starts"], c["end"])
    apart = lambda c: walls.isNull() | F.coalesce(F.get(walls["reach"], before(c) - 1) <= c["start"], F.lit(True))
    full = lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), _evidence(c).alias("evidence"), apart(c).alias("spare"), feats(c).alias("f"))
    return d.withColumn("candidates", F.transform(named, full)).drop("walls", *[f"at_{k}" for k in GENERATED])


class Model(NamedTuple):
    """Trees as (weight, nested tuples), and the thresholds by kind; a leaf is a number, a node (feature, threshold, left, right).  Without trees the evidence decides."""

    trees: tuple
    thresholds: dict[str, float]


def weak_labels(docs: DataFrame) -> DataFrame:
    """kind, f, spare and y (the label) of each candidate of docs."""
    # outer, since the filter that Spark puts below an inner explode works out all candidates a second time
    c = candidates(base_spans(docs)).select(F.explode_outer("candidates").alias("c")).select("c.*").where("kind is not null")
    return c.select("kind", "f", "spare", (~F.col("spare") | F.col("evidence")).cast("double").alias("y"))


def _tree(node) -> tuple | float:
    if node.getClass().getSimpleName() == "LeafNode":
        return float(node.prediction())
    split = node.split()
    return int(split.featureIndex()), float(split.threshold()), _tree(node.leftChild()), _tree(node.rightChild())


def fit(docs: DataFrame) -> Model:
    """Boosted trees and thresholds; with too few candidates of a label to fit any, a model without trees, by which the evidence itself decides."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    docs = only(docs, "doc_id", "text")
    share = min(TRAIN_SHARE, TRAIN_DOCS / max(1, docs.count()))
    sampled = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1_000_000)) < int(share * 1_000_000)
    rows = materialise(weak_labels(docs.where(sampled)), "candidates")
    seen = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    if min(seen.get(0.0, 0), seen.get(1.0, 0)) < LEAST:
        return Model((), {})
    train = rows.select(array_to_vector("f").alias("features"), F.col("y").alias("label"))
    trained = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=1).fit(train)
    trees = tuple((float(w), _tree(t.rootNode())) for w, t in zip(trained.treeWeights, trained._java_obj.trees(), strict=True))
    binned = weak_labels(docs.where(~sampled)).where("spare").select("kind", "y", F.floor(score(trees, F.col("f")) * 50).alias("bin"))
    counts = binned.groupBy("kind", "bin").agg(F.sum("y").alias("yes"), F.count("*").alias("n")).collect()  # kinds times 51 rows at most
    thresholds, found = {}, {(r["kind"], r["bin"]): (r["yes"], r["n"]) for r in counts}
    for kind in GENERATED:
        yes = n = 0.0
        for b in range(50, 24, -1):
            y, m = found.get((kind, b), (0.0, 0))
            yes, n = yes + y, n + m
            if n and yes >= PRECISION * n:
                thresholds[kind] = b / 50
    return Model(trees, thresholds)


def score(trees: tuple, f: Column) -> Column:
    """The trees' probability as a column expression of the features."""

    def value(t) -> Column:
        if isinstance(t, float):
            return F.lit(t)
        return F.when(f[t[0]] <= t[1], value(t[2])).otherwise(value(t[3]))

    margin = F.lit(0.0)
    for w, t in trees:
        margin = margin + F.lit(w) * value(t)
    return 1 / (1 + F.exp(-2 * margin))


def _found(rows: DataFrame, model: Model | None) -> DataFrame:
    """rows (with text and no working columns) with base, n_<kind>, added and found."""
    d = base_spans(rows)
    if model is None or (model.trees and not model.thresholds):
        d = d.withColumn("added", F.array().cast("array<struct<kind:string,start:int,end:int>>"))
    else:
        least = F.create_map(*[F.lit(x) for k, v in {"": 2.0, **model.thresholds}.items() for x in (k, float(v))])
        passes = lambda c: score(model.trees, c["f"]) >= F.coalesce(F.try_element_at(least, c["kind"]), F.lit(2.0)) if model.trees else c["evidence"]
        chosen = F.filter("candidates", lambda c: c["spare"] & passes(c))
        # matches of one pattern never overlap, so that a kind's spans need no merging
        d = candidates(d).withColumn("added", F.array_sort(F.transform(chosen, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))))).drop("candidates")
    return d.withColumn("found", F.concat("base", "added"))


def _nested(docs: DataFrame) -> DataFrame:
    """All columns of docs in one, so that none can clash with a working column, and text."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def find(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs (with doc_id, text) and pii: a struct of base, n_<kind>, added and found (all spans, base first)."""
    d = _found(_nested(docs), model)
    out = F.struct("base", *[f"n_{k}" for k in BASE], "added", "found").alias("pii")
    return d.select(*[F.col("own")[c].alias(c) for c in docs.columns if c.lower() != "pii"], out)


def written(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with each found span replaced by its kind in brackets; a null text becomes an empty one."""
    d = _found(_nested(docs), model)
    some = F.size("found") > 0
    ordered = F.array_sort(F.transform("found", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["end"].alias("end"), s["kind"].alias("kind"))))
    reached = lambda o: F.struct(o.alias("spans"), _running(o["end"], _greater).alias("reach"))
    d = d.withColumn("cuts", F.when(some, F.transform(F.array(ordered), reached)[0])).withColumn("pieces", F.when(some, F.regexp_extract_all("text", F.lit(rf"[\s\S]{{1,{PIECE}}}"), F.lit(0))))
    pieces, cuts = F.col("pieces"), F.col("cuts")

    def cut(a: Column, b: Column) -> Column:
        """The text from a to b, by way of its pieces, so that a long text isn't counted through for each span."""
        i, j = F.floor(a / PIECE).cast("int"), F.floor(b / PIECE).cast("int")
        first, last = F.coalesce(F.get(pieces, i), F.lit("")), F.coalesce(F.get(pieces, j), F.lit(""))
        apart = F.concat(F.substring(first, a % PIECE + 1, F.lit(PIECE)), F.array_join(F.slice(pieces, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substring(last, F.lit(1), b % PIECE))
        return F.when(i == j, F.substring(first, a % PIECE + 1, b - a)).otherwise(apart)

    def part(s: Column, i: Column) -> Column:
        before = F.coalesce(F.get(cuts["reach"], i - 1), F.lit(0))
        return F.when(s["start"] >= before, F.concat(cut(before, s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("")

    rest = cut(F.element_at(cuts["reach"], -1), F.char_length("text"))
    d = d.withColumn("clean", F.when(some, F.concat(F.array_join(F.transform(cuts["spans"], part), ""), rest)).otherwise(F.col("text")))
    return d.select(*[F.col("clean").alias(c) if c == "text" else F.col("own")[c].alias(c) for c in docs.columns])


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = only(table(spark, sf_dir, "documents"), "doc_id", "text")
    out = find(docs, fit(docs))
    return out.select("doc_id", *[F.col(f"pii.n_{k}") for k in BASE], F.sha2(written(F.col("pii.base")), 256).alias("base_sha256"), written(F.col("pii.found")).alias("spans"))


QUERIES = {"op1_pii": op1_pii}
ORACLE: dict[str, str] = {}
