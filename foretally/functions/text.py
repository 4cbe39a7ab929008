"""Text column macros."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foretally.functions import literals

_BLANK = r"^\s+|\s+$"


def strip(x: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(x, _BLANK, "")


def normalize_text(x: Column) -> Column:
    return strip(F.regexp_replace(F.lower(F.replace(x, F.lit("_"), F.lit(" "))), r"\s+", " "))


def slugify(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def alnum(x: Column) -> Column:
    return F.regexp_replace(x, r"[^\p{Alnum}]", "")


def shortened(x: Column, most: int) -> Column:
    """The first characters of a text, with dots if there are more."""
    return F.when(F.char_length(x) > most, F.concat(F.left(x, F.lit(most)), F.lit("..."))).otherwise(x)


def word_count(x: Column) -> Column:
    return F.size(F.filter(F.split(strip(x), r"\s+"), lambda w: w != ""))


def field(text: Column, label: str) -> Column:
    """The value after `label:` or `label -`, trimmed; '' if there is none.  An empty value takes the next line."""
    return strip(F.regexp_extract(text, rf"(?i)\Q{label}\E\s*[:\-]\s*(.+)", 1))


def has_header(text: Column, header: str) -> Column:
    return F.regexp_like(text, F.lit(rf"(?i)\Q{header}\E"))


def strip_fences(x: Column) -> Column:
    """Without trailing lines of three back quotes."""
    return F.regexp_replace(F.regexp_replace(x, r"(?:\s*\n\s*```\s*)+\z", ""), r"\s+\z", "")


def mapped(x: Column, names: dict[str, str], default: Column | None = None) -> Column:
    """names[x], else default, else x."""
    table = F.create_map(*[F.lit(v) for kv in names.items() for v in kv])
    return F.coalesce(F.try_element_at(table, x), x if default is None else default)


def scenario_name(x: Column) -> Column:
    """'1', 's1' and 'scenario 1' are S1."""
    return F.regexp_replace(F.regexp_replace(F.upper(strip(x)), r"\s+", ""), r"^(?:SCENARIO)?S?([1-4])$", "S$1")


def first_keyword(x: Column, table: dict[str, str], unknown: str = "Unknown") -> Column:
    """The category of the exact keyword, else of the first keyword within x in the table's order, else `unknown`; '' for blank."""
    s = F.lower(strip(x))
    out = F.when(F.coalesce(s, F.lit("")) == "", F.lit(""))
    for k, v in table.items():
        out = out.when(s == k, F.lit(v))
    for k, v in table.items():
        out = out.when(F.contains(s, F.lit(k)), F.lit(v))
    return out.otherwise(F.lit(unknown))


def any_marker(x: Column, markers: tuple[str, ...]) -> Column:
    """Whether x, in lower case, holds one of the markers."""
    s = F.lower(F.coalesce(x, F.lit("")))
    out = F.lit(False)
    for m in markers:
        out = out | F.contains(s, F.lit(m))
    return out


def tail(text: Column, lines: int = 40) -> Column:
    """The last lines of a text."""
    parts = F.split(text, "\n")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - lines + 1, F.lit(1)), F.lit(lines)), "\n")


def k_of_n(k: Column, n: Column) -> Column:
    return F.concat_ws(" / ", k.cast("string"), n.cast("string"))


def p_text(p: Column) -> Column:
    return F.when(p < 0.001, F.lit("< 0.001")).otherwise(F.format_string("%.4f", p))


def relative_path(path: Column, root: str) -> Column:
    """Forward slashes, without a leading root."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), rf"^\Q{root}\E/", "")


# --- list literals -------------------------------------------------------------------------

#: Fixed value: scalars of numpy as they are printed.
_NUMPY = r"\b(?:np|numpy)\.(?:float(?:16|32|64)?|int(?:8|16|32|64)?|uint(?:8|16|32|64)?|longdouble|float_)\(([^()]+)\)"


def plain_literal(x: Column) -> Column:
    """numpy scalars unwrapped (three levels), trailing commas dropped."""
    for _ in range(3):
        x = F.regexp_replace(x, _NUMPY, "$1")
    return F.regexp_replace(x, r",\s*\]", "]")


def number_list(x: Column) -> Column:
    """A flat list literal as doubles; null if it isn't one, is empty, or has anything but numbers."""
    literal = plain_literal(strip(x))
    body = F.regexp_extract(literal, r"^\[([^\[\]]*)\]$", 1)
    numbers = F.transform(F.split(body, ","), lambda s: F.when(F.regexp_like(strip(s), F.lit(r"^[+-]?(?:\d[\d_]*\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$")), F.replace(strip(s), F.lit("_"), F.lit("")).try_cast("double")))
    return F.when((strip(body) != "") & ~F.exists(numbers, lambda v: v.isNull()), numbers)


def list_literals(text: Column) -> Column:
    return F.regexp_extract_all(plain_literal(text), F.lit(r"\[[^\[\]]+\]"), F.lit(0))


def first_list(text: Column) -> Column:
    """The first literal that is a list of numbers: the whole text, else in its order."""
    found = F.filter(F.transform(list_literals(text), number_list), lambda v: v.isNotNull())
    return F.coalesce(number_list(text), F.try_element_at(found, F.lit(1)))


def last_literal(text: Column) -> Column:
    """The shortest list literal, of any depth, that ends at the last closing bracket; '' if none does."""
    return literals.last_list_literal(plain_literal(text))["text"]


def last_list(text: Column) -> Column:
    """The list of numbers that ends at the last bracket; null if that closes anything else, as a nested list."""
    return number_list(last_literal(text))


def list_problem(text: Column) -> Column:
    """Why the last literal is no forecast; null if it is one, or an empty list."""
    def problem(found: Column) -> Column:
        literal = found["text"]
        return F.when(literal == "", "no Python forecast list found").when(found["deep"], "forecast list is not flat").when(number_list(literal).isNull() & ~F.regexp_like(literal, F.lit(r"^\[\s*\]$")), "forecast list has an item that is no number")

    return F.transform(F.array(literals.last_list_literal(plain_literal(text))), problem)[0]


def forecast_literal(text: Column) -> Column:
    """The text of the first list of numbers; '' if there is none."""
    found = F.filter(list_literals(text), lambda x: number_list(x).isNotNull())
    whole = strip(plain_literal(text))
    return F.coalesce(F.when(number_list(whole).isNotNull(), whole), F.try_element_at(found, F.lit(1)), F.lit(""))


def literal_length(literal: Column) -> Column:
    """The number of items of a flat list literal."""
    return F.size(number_list(literal))


# --- JSON ----------------------------------------------------------------------------------


canonical_json = literals.canonical


def sorted_json(m: Column) -> Column:
    """A map as JSON text with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))


def merged_maps(first: Column, second: Column) -> Column:
    """The entries of both; where both have a key, the second's value."""
    kept = F.map_filter(first, lambda k, v: ~F.map_contains_key(second, k))
    return F.when(first.isNull(), second).when(second.isNull(), first).otherwise(F.map_concat(kept, second))


#: The hyper-parameters that identify a model family; the first family whose keys are all there counts.
CORE_KEYS = (("order", "seasonal_order"), ("trend", "seasonal", "seasonal_periods"), ("growth", "seasonality_mode", "changepoint_prior_scale", "seasonality_prior_scale"))


def core_parameters(x: Column) -> Column:
    """The core keys of a hyper-parameter object, as sorted 'k=v' text; all keys if it is of no known family."""
    m = F.from_json(x, "map<string,string>")
    keys = F.map_keys(m)
    text = lambda kept: F.array_join(F.array_sort(F.transform(F.filter(F.map_entries(m), kept), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",")
    out = None
    for family in CORE_KEYS:
        names = F.array(*map(F.lit, family))
        hit, kept = F.size(F.array_except(names, keys)) == 0, text(_within(family))
        out = F.when(hit, kept) if out is None else out.when(hit, kept)
    return out.otherwise(text(lambda e: F.lit(True)))


def _within(family: tuple[str, ...]):
    return lambda e: e["key"].isin(*family)


from_python_dict = literals.python_to_json


#: Forms of hyper-parameters, and numbers too common to tell.
_TOKENS = (r"\b[a-z_][a-z0-9_]*\s*=\s*[-+]?\d+(?:\.\d+)?", r"\b(?:order|seasonal_order)\s*[:=]\s*\(?\s*\d+\s*,\s*\d+\s*,\s*\d+", r"\b[-+]?\d+(?:\.\d+)?\b")
NOISY = ("0", "1", "2", "3", "4", "5", "10", "12", "24", "30", "52", "80", "100")


def hyperparameter_tokens(x: Column) -> Column:
    """Distinct name=value, order and number tokens of a text, white space dropped, sorted; of more than five, without the NOISY ones."""
    found = F.concat(*[F.regexp_extract_all(normalize_text(x), F.lit(p), F.lit(0)) for p in _TOKENS])
    tokens = F.array_sort(F.array_distinct(F.transform(found, lambda t: F.regexp_replace(t, r"\s+", ""))))
    return F.when(F.size(tokens) <= 5, tokens).otherwise(F.filter(tokens, lambda t: ~t.isin(*NOISY)))


def token_coverage(tokens: Column, code: Column) -> Column:
    """The share of tokens that the code, in plain words, holds; null without tokens."""
    c = normalize_text(code)
    return F.size(F.filter(tokens, lambda t: F.contains(c, t))) / F.nullif(F.size(tokens), F.lit(0))
