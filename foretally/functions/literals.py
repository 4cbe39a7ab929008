"""Python literals and JSON of any depth, as column expressions.

A text is cut into tokens once, strings as one token each, so that what a string holds is never taken for a
bracket.  One pass over the tokens keeps the open brackets as a stack; no pattern nests.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCALAR = r"(?:True|False|None|[+-]?(?:0[xX][0-9a-fA-F_]+|0[oO][0-7_]+|0[bB][01_]+|(?:\d[\d_]*+\.?[\d_]*+|\.\d[\d_]*+)(?:[eE][+-]?\d[\d_]*+)?))"
#: Tokens of a literal from left to right, and of its reversed text; an escaped quote doesn't end a string.
_STRING = "|".join(rf"{q}[^{q}\\\n]*+(?:\\.[^{q}\\\n]*+)*+{q}" for q in ("'", '"'))
_GNIRTS = "|".join(rf"{q}(?:[^{q}\n]|{q}(?=(?:\\\\)*+\\(?!\\)))*+{q}" for q in ("'", '"'))
_REST = r"|[\w.+\-]++|\s++|[\s\S]"
_JSON = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|-?\d[\d.eE+\-]*+|[A-Za-z]++|\s++|[\s\S]'
#: Starts a string that stands for a number while an object is sorted.
_MARK = "\ue000"


def _first(t: Column) -> Column:
    return F.substring(t, 1, 1)


def _kind(t: Column) -> Column:
    """Of a reversed token: space, v (a scalar), a bracket, a comma, a colon, or x."""
    c = _first(t)
    string = c.isin("'", '"') & (F.length(t) > 1)
    return F.when(F.regexp_like(t, F.lit(r"^\s")), " ").when(string | F.regexp_like(F.reverse(t), F.lit(f"^{_SCALAR}$")), "v").when(c.isin(*"[](){},:") & (F.length(t) == 1), c).otherwise("x")


def scanned(text: Column) -> Column:
    """The literal at the end of a text whose last sign closes a bracket: a struct of n (its characters; 0 if there is none), deep (whether it holds brackets) and set (whether one of these is a set).

    The text is read from its end up to where the last bracket opens.  The stack has a sign for each open bracket: ] ) and }, which becomes D once an
    entry has a colon, E while the next entry of such needs one, and S in a set."""
    tokens = F.transform(F.regexp_extract_all(F.reverse(text), F.lit(f"{_GNIRTS}{_REST}"), F.lit(0)), lambda t: F.struct(_kind(t).alias("k"), F.length(t).alias("n")))
    state = lambda n, stack, last, on, found, deep, sets: F.struct(n.alias("n"), stack.alias("stack"), last.alias("last"), on.alias("on"), found.alias("found"), deep.alias("deep"), sets.alias("sets"))
    start = state(F.lit(0), F.lit(""), F.lit(""), F.lit(True), F.lit(False), F.lit(False), F.lit(False))

    def step(s: Column, t: Column) -> Column:
        k, last, stack = t["k"], s["last"], s["stack"]
        top, below = F.right(stack, F.lit(1)), F.left(stack, F.length(stack) - 1)
        close, opens = k.isin("]", ")", "}"), k.isin("[", "(", "{")
        # what may stand to the right of what; o is a value that ends here (its opening bracket), c an end that has just begun
        fits = (
            F.when(close, last.isin("", ",", ":", "c")).when(k == "v", last.isin(",", ":", "c") & (stack != "")).when(k == ",", last.isin("o", "v", "c") & (stack != "") & (top != "E"))
            .when(k == ":", last.isin("o", "v") & top.isin("}", "E"))
            .when(opens, last.isin("o", "v", "c") & (F.when(k == "[", top == "]").when(k == "(", top == ")").otherwise(top.isin("}", "D", "S"))))
            .otherwise(False)
        )
        comma = F.when((top == "}") & (last != "c"), F.concat(below, F.lit("S"))).when(top == "D", F.concat(below, F.lit("E"))).otherwise(stack)
        new = F.when(close, F.concat(stack, k)).when(opens, below).when(k == ",", comma).when(k == ":", F.concat(below, F.lit("D"))).otherwise(stack)
        sets = (k == "{") & ((top == "S") | ((top == "}") & (last != "c")))
        done = opens & fits & (F.length(stack) == 1)
        seen = state(s["n"] + t["n"], new, F.when(close, "c").when(opens, "o").otherwise(k), fits & ~done, done, s["deep"] | (close & (stack != "")), s["sets"] | sets)
        space = state(s["n"] + t["n"], stack, last, s["on"], s["found"], s["deep"], s["sets"])
        return F.when(~s["on"], s).when(k == " ", space).otherwise(seen)

    return F.aggregate(tokens, start, step, lambda s: F.struct(F.when(s["found"], s["n"]).otherwise(0).alias("n"), s["deep"].alias("deep"), s["sets"].alias("sets")))


def last_list_literal(text: Column) -> Column:
    """A struct of text (the shortest list literal that ends at the last closing square bracket; '' if none does) and deep (whether brackets lie in it)."""
    upto = F.when(F.contains(text, F.lit("]")), F.regexp_replace(text, r"[^\]]*+\z", "")).otherwise("")
    inline = F.transform(F.array(upto), lambda x: F.struct(x.alias("x"), scanned(x).alias("s")))[0]
    return F.struct(F.right(inline["x"], inline["s"]["n"]).alias("text"), inline["s"]["deep"].alias("deep"))


def python_float(n: Column) -> Column:
    """A double as Python writes it: 0.0001, 12345678.5, 1e-05, 1e+16; before version 19 Java may give a digit more than needed."""
    s = n.cast("string")
    plain = F.regexp_replace(F.regexp_replace(n.cast("decimal(38,21)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", ".0")
    power = F.regexp_extract(s, r"E(-?\d+)$", 1).cast("int")
    science = F.concat(F.regexp_replace(F.regexp_extract(s, r"^(.*)E", 1), r"\.0$", ""), F.when(power < 0, "e-").otherwise("e+"), F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), F.lit("0")))
    return F.when(n == 0, F.when(F.startswith(s, F.lit("-")), "-0.0").otherwise("0.0")).when((F.abs(n) >= 1e-4) & (F.abs(n) < 1e16), plain).otherwise(science)


#: What JSON writes as it is: all but control signs, quotes and backslashes; of these, ASCII.
_PLAIN, _ASCII = r'[^\x00-\x1f"\\]', r'[ !#-\[\]-~]'


def json_string(x: Column, plain: str = _ASCII) -> Column:
    """A text as a JSON string; signs that aren't plain are named by a letter or by number."""
    named = F.create_map(*[F.lit(v) for pair in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")) for v in pair])
    coded = lambda c: F.regexp_replace(F.lower(F.hex(F.encode(c, "UTF-16BE"))), "(.{4})", r"\\u$1")
    signs = F.transform(F.split(x, ""), lambda c: F.when(F.regexp_like(c, F.lit(rf"^{plain}*\z")), c).otherwise(F.coalesce(F.try_element_at(named, c), coded(c))))
    return F.concat(F.lit('"'), F.when(F.regexp_like(x, F.lit(rf"^{plain}*+\z")), x).otherwise(F.array_join(signs, "")), F.lit('"'))


def _unescaped(body: Column) -> Column:
    """What the body of a Python string stands for; signs are named by one letter, two, four or eight hexadecimal digits."""
    parts = F.regexp_extract_all(body, F.lit(r"\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[\s\S])|[^\\]++"), F.lit(0))
    named = F.create_map(*[F.lit(v) for pair in (("n", "\n"), ("r", "\r"), ("t", "\t"), ("b", "\b"), ("f", "\f"), ("a", "\a"), ("v", "\v"), ("\\", "\\"), ("'", "'"), ('"', '"'), ("\n", "")) for v in pair])
    sign = lambda p: F.decode(F.unhex(F.lpad(F.substring(p, 3, 8), 8, "0")), "UTF-32")
    one = lambda p: F.when(~F.startswith(p, F.lit("\\")), p).when(F.regexp_like(p, F.lit(r"^\\[xuU].")), sign(p)).otherwise(F.coalesce(F.try_element_at(named, F.substring(p, 2, 1)), p))
    return F.when(F.contains(body, F.lit("\\")), F.array_join(F.transform(parts, one), "")).otherwise(body)


def _json_scalar(t: Column) -> Column:
    """The JSON text of a Python scalar; null for a number that isn't written in decimal."""
    plain = F.regexp_replace(t, r"[_+](?=[\d.])", "")
    number = F.when(F.regexp_like(plain, F.lit(r"^-?\d+$")), F.when(plain == "-0", "0").otherwise(plain)).when(F.regexp_like(plain, F.lit(r"^-?[\d.]")), python_float(plain.try_cast("double")))
    word = F.when(t == "True", "true").when(t == "False", "false").when(t == "None", "null")
    string = json_string(_unescaped(F.substring(t, F.lit(2), F.length(t) - 2)), _PLAIN)
    return F.when(_first(t).isin("'", '"'), string).otherwise(F.coalesce(word, number))


def python_to_json(x: Column) -> Column:
    """A Python list, tuple or dict of any depth as JSON text, tuples as lists; the stripped text itself if it is none, or holds a set, a tuple as a key or a number that isn't decimal.

    One value in round brackets is taken for a list."""
    text = F.regexp_replace(x, r"^\s+|\s+$", "")
    scan = scanned(text)
    tokens = F.filter(F.regexp_extract_all(text, F.lit(f"{_STRING}{_REST}"), F.lit(0)), lambda t: ~F.regexp_like(t, F.lit(r"^\s")))
    held = F.transform(F.array(tokens), lambda a: F.transform(a, lambda t, i: F.struct(t.alias("t"), F.coalesce(F.get(a, i + 1), F.lit("")).alias("after"))))[0]

    def told(e: Column) -> Column:
        t, after = e["t"], e["after"]
        value = _json_scalar(t)
        key = F.when(F.startswith(value, F.lit('"')), value).otherwise(F.concat(F.lit('"'), value, F.lit('"')))
        comma = F.when(after.isin("]", ")", "}"), "").otherwise(", ")
        return F.when(t.isin("(", "["), "[").when(t.isin(")", "]"), F.when(after != ":", "]")).when(t == ",", comma).when(t == ":", ": ").when(t.isin("{", "}"), t).otherwise(F.when(after == ":", key).otherwise(value))

    parts = F.transform(held, told)
    whole = F.transform(F.array(parts), lambda p: F.when(~F.exists(p, lambda v: v.isNull()), F.array_join(p, "")))[0]
    valid = (scan["n"] == F.length(text)) & ~scan["sets"]
    return F.coalesce(F.when(valid, whole), text)


def canonical(x: Column, digits: int = 4) -> Column:
    """JSON of any depth with sorted keys, numbers with a point or a power rounded, and only ASCII signs; {} for blank and null; the stripped text itself if it is no JSON, or if a key comes twice; keys are in the order of UTF-16.

    Numbers pass the sorting as marked strings, so that whole numbers keep all their digits and strings that look like numbers stay strings."""
    text = F.regexp_replace(x, r"^\s+|\s+$", "")
    cut = lambda t: F.regexp_extract_all(t, F.lit(_JSON), F.lit(0))
    number = lambda t: F.regexp_like(t, F.lit(r"^-?\d"))
    rounded = lambda t: F.when(F.regexp_like(t, F.lit(r"^-?\d+$")), F.when(t == "-0", "0").otherwise(t)).otherwise(python_float(F.round(t.cast("double"), digits)))
    marked = lambda t: F.when(number(t), F.concat(F.lit(f'"{_MARK}'), rounded(t), F.lit('"'))).when(F.regexp_like(t, F.lit(rf'^"(?:{_MARK}|\\u[eE]000)')), F.concat(F.lit(f'"{_MARK}'), F.substring(t, 2, 1 << 30))).otherwise(t)
    ordered = F.to_json(F.try_parse_json(F.array_join(F.transform(cut(text), marked), "")))
    body = lambda t: F.get_json_object(F.concat(F.lit('{"a":'), t, F.lit("}")), "$.a")

    def told(t: Column) -> Column:
        own = F.when(F.startswith(t, F.lit(f'"{_MARK}{_MARK}')), F.concat(F.lit('"'), F.substring(t, 3, 1 << 30))).otherwise(t)
        string = F.when(F.regexp_like(own, F.lit(r'^"[ !#-\[\]-~]*+"$')), own).otherwise(json_string(body(own)))
        held = F.startswith(t, F.lit(f'"{_MARK}')) & ~F.startswith(t, F.lit(f'"{_MARK}{_MARK}'))
        return F.when(held, F.substring(t, F.lit(3), F.length(t) - 3)).when(_first(t) == '"', string).when(t == ",", ", ").when(t == ":", ": ").otherwise(t)

    valid = F.try_parse_json(text).isNotNull()
    blank = F.coalesce(text, F.lit("")).isin("", "{}", "null")
    return F.when(blank, "{}").otherwise(F.coalesce(F.when(valid, F.array_join(F.transform(cut(ordered), told), "")), text))
