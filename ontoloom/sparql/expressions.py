"""Filter expressions as native columns: no Python code runs per row.

The value model: booleans, 64-bit floats, texts, IRIs and blank nodes.  ``&&``, ``||`` and ``!`` are
two-valued (an error is false); with ``strict`` they follow SQL's three-valued logic, which is
SPARQL's own error table.  Comparing different types is false for ``=`` and an error for ``<``.
"""

from __future__ import annotations

import logging
import re
from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ontoloom.errors import SparqlError
from ontoloom.functions import terms
from ontoloom.functions.terms import Value
from ontoloom.sparql import algebra as A
from ontoloom.sparql.shapes import Template, Typed

log = logging.getLogger(__name__)

_NULL = {"b": "boolean", "n": "double", "s": "string", "i": "string"}
#: What the supported regular expressions leave out (look-around and back references).
_BEYOND = re.compile(r"\(\?(?:[=!]|<[=!])|\\[1-9]")


#: The parts of a date or moment, and the function that gives each.
_DATE = r"\A(-?[0-9]{4,})-([0-9]{2})-([0-9]{2})(?:T([0-9]{2}):([0-9]{2}):([0-9]{2}(?:\.[0-9]+)?))?(?:Z|[+-][0-9]{2}:[0-9]{2})?\z"
DATE_PARTS = {"YEAR": 1, "MONTH": 2, "DAY": 3, "HOURS": 4, "MINUTES": 5, "SECONDS": 6}
HASHES = {"MD5": F.md5, "SHA1": F.sha1, "SHA256": lambda c: F.sha2(c, 256), "SHA384": lambda c: F.sha2(c, 384), "SHA512": lambda c: F.sha2(c, 512)}


def null(tag: str = "s") -> Value:
    return Value(tag, **{{"b": "b", "n": "n"}.get(tag, "s"): F.lit(None).cast(_NULL[tag])})


def boolean(c: Column) -> Value:
    return Value("b", b=c)


def text(c: Column) -> Value:
    return Value("s", s=c)


def num(c: Column) -> Value:
    return Value("n", n=c)


def java_pattern(pattern: str, flags: str) -> str | None:
    """The pattern in the JVM's dialect, with Unicode classes and case; None if it is no valid one."""
    if _BEYOND.search(pattern):
        return None
    if pattern.endswith("$") and not pattern.endswith("\\$"):
        pattern = pattern[:-1] + r"\z"
    from pyspark import SparkContext

    whole = ("(?iUd)" if "i" in flags else "(?Ud)") + pattern
    try:
        SparkContext._active_spark_context._jvm.java.util.regex.Pattern.compile(whole)
    except Exception:
        return None
    return whole


def java_replacement(text: str, groups: int) -> str:
    """``$1``, ``${1}`` and ``$$`` in the JVM's form; a group that does not exist is empty."""

    def one(m: re.Match) -> str:
        if m[0] == "$$":
            return r"\$"
        if m[0] == "\\":
            return r"\\"
        name = m[1] or m[2]
        if name.isdigit():
            return f"${name}" if int(name) <= groups else ""
        return f"${{{name}}}"

    return re.sub(r"\$\$|\$\{(\w+)\}|\$(\w+)|\\", one, text)


def by_keys(a: Value, b: Value) -> Column | None:
    """IRIs of a template compared by their keys, where that is enough."""
    for x, y in ((a, b), (b, a)):
        if x.native and isinstance(x.native[0], Template):
            shape, parts = x.native
            if y.tag == "i" and y.constant is not None:
                return shape.equals(parts, y.constant)
            if y.native and y.native[0] == shape:
                return reduce(lambda p, q: p & q, [p == q for p, q in zip(parts, y.native[1])])
    return None


#: Fixed value: a beginning of the fixed-width text of a timestamp, from the day on.
_MOMENT = re.compile(r"\d{4}-\d{2}-\d{2}(?:T\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?)?")


def by_time(op: str, a: Value, b: Value) -> Column | None:
    """A timestamp against a constant, natively; the same as by their texts, as those have a fixed width."""
    if b.native and a.constant is not None:
        return by_time({"<": ">", "<=": ">=", ">": "<", ">=": "<="}[op], b, a)
    if not (a.native and isinstance(a.native[0], Typed) and a.native[0].kind.startswith("timestamp") and b.tag == "s" and b.constant and _MOMENT.fullmatch(b.constant)):
        return None
    try:
        moment = datetime.fromisoformat(b.constant)
    except ValueError:
        return None
    if len(b.constant) < 26:  # a beginning comes before all texts that go on from it
        op = ">=" if op[0] == ">" else "<"
    c, at = a.native[1][0], F.lit(moment.isoformat(sep=" ")).cast(a.native[0].kind)
    return {"<": c < at, "<=": c <= at, ">": c > at, ">=": c >= at}[op]


def equal(a: Value, b: Value) -> Column:
    """Null if either is; false for different types."""
    keyed = by_keys(a, b)
    if keyed is not None:
        return keyed

    def same(tag: str) -> Column:
        x, y = a.slot(tag), b.slot(tag)
        return (x == y) & (~F.isnan(x) | y.isNull()) if tag == "n" else x == y

    if isinstance(a.tag, str) and isinstance(b.tag, str):
        if a.tag == b.tag:
            return same(a.tag)
        return F.when(a.slot(a.tag).isNotNull() & b.slot(b.tag).isNotNull(), False)
    known = a.tag if isinstance(a.tag, str) else b.tag if isinstance(b.tag, str) else None
    ta, tb = a.tags(), b.tags()
    both = F.when(ta.isNull() | tb.isNull(), F.lit(None).cast("boolean")).when(ta != tb, False)
    if known:
        return both.otherwise(same(known))
    return both.when(ta == "n", same("n")).when(ta == "b", same("b")).otherwise(same("s"))


def ordered(op: str, a: Value, b: Value) -> Column:
    """Null for different types and for blank nodes."""
    timed = by_time(op, a, b)
    if timed is not None:
        return timed

    def test(tag: str) -> Column:
        x, y = a.slot(tag), b.slot(tag)
        out = {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
        # false with NaN, but null where the other side is
        return out & (~F.isnan(x) | y.isNull()) & (~F.isnan(y) | x.isNull()) if tag == "n" else out

    if isinstance(a.tag, str) and isinstance(b.tag, str):
        return test(a.tag) if a.tag == b.tag and a.tag != "k" else F.lit(None).cast("boolean")
    known = a.tag if isinstance(a.tag, str) else b.tag if isinstance(b.tag, str) else None
    ta, tb = a.tags(), b.tags()
    if known:
        return F.when((ta == known) & (tb == known), test(known))
    return F.when(ta != tb, F.lit(None).cast("boolean")).when(ta == "n", test("n")).when(ta == "b", test("b")).when(ta.isin("s", "i"), test("s"))


def choose(cases: list[tuple[Column | None, Value]]) -> Value:
    """The first value whose condition holds (None: always)."""
    tags = {v.tag for _, v in cases if isinstance(v.tag, str)}
    static = len(tags) == 1 and all(isinstance(v.tag, str) for _, v in cases)

    def slot(get: Callable[[Value], Column]) -> Column:
        out = None
        for condition, value in cases:
            c = F.lit(True) if condition is None else condition
            out = F.when(c, get(value)) if out is None else out.when(c, get(value))
        return out

    if static:
        tag = next(iter(tags))
        return Value(tag, **{{"b": "b", "n": "n"}.get(tag, "s"): slot(lambda v: v.slot(tag))})
    return Value(slot(Value.tags), b=slot(lambda v: v.slot("b")), n=slot(lambda v: v.slot("n")), s=slot(lambda v: v.slot("s")))


class Compiler:
    """Expressions over the variables that ``lookup`` knows (name -> value, or None if never bound).

    ``exists`` answers the pattern of an EXISTS.
    """

    def __init__(self, lookup: Callable[[str], Value | None], strict: bool = False, exists: Callable[[object], Column] | None = None):
        self.lookup, self.strict, self.exists = lookup, strict, exists

    def condition(self, expr) -> Column:
        """Does a row pass?  Only what is exactly true does."""
        return self.compile(expr).truth()

    def compile(self, expr) -> Value:
        if isinstance(expr, A.Var):
            return self.lookup(expr.name) or null()
        if isinstance(expr, (A.Iri, A.Literal)):
            return terms.value_of_constant(expr)
        return self.call(expr.name, expr.args)

    def call(self, name: str, args: tuple) -> Value:
        if name == "BOUND":
            value = self.lookup(args[0].name) if isinstance(args[0], A.Var) else None
            return boolean(F.lit(False) if value is None else value.tags().isNotNull())
        if name in ("LANG", "DATATYPE", "ISBLANK") or name in ("ISIRI", "ISLITERAL", "ISNUMERIC"):
            return self.about(name, args)
        if name == "EXISTS":
            if self.exists is None:
                raise SparqlError("EXISTS is supported in FILTER and BIND only")
            return boolean(self.exists(args[0]))
        v = [self.compile(a) for a in args]
        if name in ("&&", "||", "!"):
            return boolean(self.logic(name, v))
        if name in ("=", "SAMETERM"):
            return boolean(equal(v[0], v[1]))
        if name in ("<", "<=", ">", ">="):
            return boolean(ordered(name, v[0], v[1]))
        if name == "IN":
            hits = F.lit(False)
            for item in v[1:]:
                hits = hits | F.coalesce(equal(v[0], item), F.lit(False))
            return boolean(F.when(v[0].tags().isNotNull(), hits))
        if name == "IF":
            condition = v[0].truth()
            if self.strict:
                known = v[0].pick({"b": v[0].slot("b")}, "boolean")
                return choose([(known, v[1]), (~known, v[2])])
            return choose([(condition, v[1]), (None, v[2])])
        if name == "COALESCE":
            return choose([(x.tags().isNotNull(), x) for x in v]) if v else null()
        if name in ("+", "-", "*", "/", "UMINUS", "ABS", "CEIL", "FLOOR", "ROUND"):
            return num(self.arithmetic(name, [x.as_number() for x in v]))
        if name == "UPLUS":
            return v[0]
        if name == "IRI":
            return Value("i", s=v[0].as_text())
        if name in ("REGEX", "REPLACE"):
            return self.regex(name, args, v)
        if name in DATE_PARTS and v:
            part = F.regexp_extract(v[0].as_text(), _DATE, DATE_PARTS[name])
            return num(F.when(part != "", part.cast("double")))
        if name in ("STRDT", "STRLANG") and len(v) > 1:
            kind = v[1].as_text() if name == "STRDT" else F.lit(A.RDF + "langString")
            made = terms.make("literal", F.when(v[1].as_text().isNotNull(), v[0].as_text()), kind, v[1].as_text() if name == "STRLANG" else None)
            return terms.value_of_term(made)
        if name.startswith(A.XSD) and len(v) == 1:
            return self.cast(name.removeprefix(A.XSD), v[0])
        return self.string(name, v)

    @staticmethod
    def cast(kind: str, v: Value) -> Value:
        """A constructor of XML Schema, in the value model: numbers are 64-bit floats, moments texts."""
        if kind == "string":
            return text(v.as_text())
        if kind == "boolean":
            spelled = F.when(v.as_text().isin("true", "1"), True).when(v.as_text().isin("false", "0"), False)
            return boolean(v.pick({"b": v.slot("b"), "n": (v.slot("n") != 0) & ~F.isnan(v.slot("n")), "s": spelled}, "boolean"))
        if kind in ("decimal", "double", "float"):
            return num(v.as_number())
        if kind in ("integer", "int", "long"):
            x = v.as_number()
            return num(F.when(F.abs(x) < float("inf"), F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")))
        if kind in ("dateTime", "date"):
            whole = v.as_text().rlike(_DATE) & (F.instr(v.as_text(), F.lit("T")) > 0 if kind == "dateTime" else F.instr(v.as_text(), F.lit("T")) == 0)
            return text(F.when(whole, v.as_text()))
        log.warning("no constructor of xsd:%s: an error in every row", kind)
        return null()

    def logic(self, name: str, v: list[Value]) -> Column:
        if self.strict:
            raw = [x.pick({"b": x.slot("b")}, "boolean") for x in v]
        else:
            raw = [x.truth() for x in v]
        return ~raw[0] if name == "!" else raw[0] & raw[1] if name == "&&" else raw[0] | raw[1]

    @staticmethod
    def arithmetic(name: str, x: list[Column]) -> Column:
        if name == "/":
            return F.try_divide(x[0], x[1])
        if name in ("+", "-", "*"):
            return {"+": x[0] + x[1], "-": x[0] - x[1], "*": x[0] * x[1]}[name]
        if name == "UMINUS":
            return -x[0]
        if name == "ABS":
            return F.abs(x[0])
        # beyond 2^53 a double is whole, and outside a bigint's range it could not be cast
        small = F.abs(x[0]) < 2.0**53
        whole = {"CEIL": F.ceil(F.when(small, x[0])), "FLOOR": F.floor(F.when(small, x[0])), "ROUND": F.round(F.when(small, x[0]))}[name]
        return F.coalesce(whole.cast("double"), x[0])

    def about(self, name: str, args: tuple) -> Value:
        value = self.compile(args[0])
        term = value.term if isinstance(args[0], A.Var) else None
        if name == "LANG":
            return text(F.lit("") if term is None else F.coalesce(F.when(term["kind"] == "literal", term["lang"]), F.lit("")))
        if name == "DATATYPE":
            return Value("i", s=F.lit(None).cast("string") if term is None else F.when(term["kind"] == "literal", term["datatype"]))
        wanted = {"ISIRI": "i", "ISBLANK": "k", "ISNUMERIC": "n"}.get(name, "sbn")
        tags = value.tags()
        return boolean(F.when(tags.isNotNull(), tags.isin(*wanted)))

    @staticmethod
    def string(name: str, v: list[Value]) -> Value:
        s = [x.as_text() for x in v]
        both = {"CONTAINS": lambda: s[0].contains(s[1]), "STRSTARTS": lambda: s[0].startswith(s[1]), "STRENDS": lambda: s[0].endswith(s[1])}
        if name in both and len(s) > 1:
            return boolean(both[name]())
        if name == "LANGMATCHES" and len(s) > 1:
            return boolean(F.when(s[1] == "*", s[0] != "").otherwise(F.lower(s[0]).startswith(F.lower(s[1]))))
        if name in ("STRBEFORE", "STRAFTER") and len(s) > 1:
            at = F.instr(s[0], s[1])
            part = F.substr(s[0], F.lit(1), at - 1) if name == "STRBEFORE" else F.substr(s[0], at + F.length(s[1]))
            found = F.when(at > 0, part).otherwise("")
            return text(F.when(s[0].isNotNull() & s[1].isNotNull(), F.when(s[1] == "", "" if name == "STRBEFORE" else s[0]).otherwise(found)))
        if name == "CONCAT":
            return text(F.concat(*s) if s else F.lit(""))
        if name == "SUBSTR" and len(s) > 1:
            start = F.greatest(v[1].as_number().try_cast("int"), F.lit(1))
            rest = F.length(s[0]) if len(v) < 3 else F.greatest(v[2].as_number().try_cast("int"), F.lit(0))
            return text(F.substr(s[0], start, rest))
        if name == "STRLEN" and s:
            return num(F.length(s[0]).cast("double"))
        if name in ("STR", "UCASE", "LCASE") and s:
            return text({"STR": lambda c: c, "UCASE": F.upper, "LCASE": F.lower}[name](s[0]))
        if name in HASHES and s:
            return text(HASHES[name](s[0]))
        if name == "ENCODE_FOR_URI" and s:
            coded = F.url_encode(s[0])
            for had, has in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
                coded = F.replace(coded, F.lit(had), F.lit(has))
            return text(coded)
        log.warning("no function %s of %d arguments: an error in every row", name, len(v))
        return null()

    def regex(self, name: str, args: tuple, v: list[Value]) -> Value:
        wrap = text if name == "REPLACE" else boolean
        fixed = args[1:]
        if len(args) < (3 if name == "REPLACE" else 2):
            return null("s" if name == "REPLACE" else "b")
        if not all(isinstance(a, A.Literal) for a in fixed):
            return wrap(_by_row(name)(v[0].as_text(), *[x.as_text() for x in v[1:]]))
        flags = fixed[-1].value if len(args) > (3 if name == "REPLACE" else 2) else ""
        pattern = java_pattern(fixed[0].value, flags)
        if pattern is None:
            return null("s" if name == "REPLACE" else "b")
        if name == "REGEX":
            return wrap(v[0].as_text().rlike(pattern))
        return wrap(F.regexp_replace(v[0].as_text(), pattern, java_replacement(fixed[1].value, _groups(fixed[0].value))))


def _groups(pattern: str) -> int:
    return len(re.findall(r"(?<!\\)\((?!\?)|\(\?P?<[A-Za-z]", pattern))


def _by_row(name: str):
    """Patterns that differ by row, in Arrow batches; a bad pattern gives null."""
    import pandas as pd
    import regex

    def compiled(pattern, flags):
        try:
            return regex.compile(pattern, regex.I if "i" in (flags or "") else 0)
        except regex.error:
            return None

    def search(s: pd.Series, pattern: pd.Series, *flags: pd.Series) -> pd.Series:
        f = flags[0] if flags else pd.Series([""] * len(s))
        out = [None if a is None or p is None or (r := compiled(p, g)) is None else r.search(a) is not None for a, p, g in zip(s, pattern, f)]
        return pd.Series(out, dtype="object")

    def replace(s: pd.Series, pattern: pd.Series, by: pd.Series, *flags: pd.Series) -> pd.Series:
        f = flags[0] if flags else pd.Series([""] * len(s))
        fill = lambda m, b: regex.sub(r"\$\$|\$\{?(\w+)\}?", lambda g: "$" if g[0] == "$$" else (m[int(g[1])] or "" if g[1].isdigit() and int(g[1]) <= m.re.groups else ""), b)
        out = [None if None in (a, p, b) or (r := compiled(p, g)) is None else r.sub(lambda m, b=b: fill(m, b), a) for a, p, b, g in zip(s, pattern, by, f)]
        return pd.Series(out, dtype="object")

    return F.pandas_udf(search, "boolean") if name == "REGEX" else F.pandas_udf(replace, "string")
