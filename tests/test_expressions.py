"""The expression compiler against an interpreter of the same rules, on random expressions."""

import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from ontoloom.functions.terms import NUMERIC, TERM, number_text, value_of_term
from ontoloom.sparql import algebra as A
from ontoloom.sparql.expressions import Compiler, java_replacement

XSD = A.XSD
TERMS = [None, A.Iri("http://e/a"), A.Iri("http://e/b"), A.Literal("abc"), A.Literal(""), A.Literal("5"), A.Literal("5", XSD + "integer"), A.Literal("05.0", XSD + "decimal"), A.Literal("x", XSD + "integer"), A.Literal("-2.5", XSD + "double"), A.Literal("NaN", XSD + "double"), A.Literal("true", XSD + "boolean"), A.Literal("no", XSD + "boolean"), A.Literal("Ünï", A.RDF + "langString", "de-AT"), A.Blank("b")]


def parse_number(s):
    try:
        return None if s != s.strip() or "_" in s else float(s)
    except ValueError:
        return None


def value(t):
    if t is None:
        return None
    if isinstance(t, A.Iri):
        return "i", t.value
    if isinstance(t, A.Blank):
        return "k", t.label
    if t.datatype == XSD + "boolean":
        return "b", t.value in ("true", "1")
    if t.datatype in NUMERIC and (n := parse_number(t.value)) is not None:
        return "n", n
    return "s", t.value


def text(v):
    if v is None or v[0] == "k":
        return None
    if v[0] == "n":
        x = v[1]
        return "NaN" if math.isnan(x) else ("inf" if x > 0 else "-inf") if math.isinf(x) else str(int(x)) if x == int(x) and not (x == 0 and math.copysign(1, x) < 0) else "-0" if x == 0 else repr(x)
    return str(v[1]).lower() if v[0] == "b" else v[1]


def number(v):
    return None if v is None else {"n": lambda: v[1], "s": lambda: parse_number(v[1]), "b": lambda: float(v[1])}.get(v[0], lambda: None)()


def true(v):
    return v == ("b", True)


def run(e, row):
    if isinstance(e, A.Var):
        return value(row[e.name])
    if not isinstance(e, A.Call):
        return value(e)
    n, v = e.name, [run(a, row) for a in e.args]
    if n in ("&&", "||", "!"):
        return "b", {"&&": lambda: true(v[0]) and true(v[1]), "||": lambda: true(v[0]) or true(v[1]), "!": lambda: not true(v[0])}[n]()
    if n == "BOUND":
        return "b", v[0] is not None
    if n in ("=", "IN"):
        if v[0] is None or n == "=" and v[1] is None:
            return None
        return "b", any(v[0] == x for x in v[1:])
    if n in ("<", ">="):
        if None in v or v[0][0] != v[1][0] or v[0][0] == "k":
            return None
        return "b", v[0][1] < v[1][1] if n == "<" else v[0][1] >= v[1][1]
    if n in ("+", "*", "/"):
        a, b = number(v[0]), number(v[1])
        if a is None or b is None or n == "/" and b == 0:
            return None
        return "n", {"+": lambda: a + b, "*": lambda: a * b, "/": lambda: a / b}[n]()
    if n == "UMINUS":
        return None if number(v[0]) is None else ("n", -number(v[0]))
    if n == "IF":
        return v[1] if true(v[0]) else v[2]
    if n == "COALESCE":
        return next((x for x in v if x is not None), None)
    if n in ("ISIRI", "ISLITERAL", "ISNUMERIC", "ISBLANK"):
        return None if v[0] is None else ("b", v[0][0] in {"ISIRI": "i", "ISLITERAL": "sbn", "ISNUMERIC": "n", "ISBLANK": "k"}[n])
    s = [text(x) for x in v]
    if None in s:
        return None
    if n == "STRLEN":
        return "n", float(len(s[0]))
    if n == "CONCAT":
        return "s", "".join(s)
    if n == "CONTAINS":
        return "b", s[1] in s[0]
    if n == "STRAFTER":
        return "s", s[0].partition(s[1])[2] if s[1] else s[0]
    return "s", {"STR": lambda: s[0], "LCASE": lambda: s[0].lower()}[n]()


leaf = st.one_of(st.sampled_from([A.Var("x"), A.Var("y")]), st.sampled_from([t for t in TERMS if isinstance(t, (A.Iri, A.Literal))]))


def calls(inner):
    one, two = st.sampled_from(["!", "UMINUS", "STR", "LCASE", "STRLEN", "ISIRI", "ISLITERAL", "ISNUMERIC"]), st.sampled_from(["&&", "||", "=", "<", ">=", "+", "*", "/", "CONTAINS", "CONCAT", "STRAFTER", "COALESCE", "IN"])
    return st.one_of(st.builds(lambda n, a: A.Call(n, (a,)), one, inner), st.builds(lambda n, a, b: A.Call(n, (a, b)), two, inner, inner), st.builds(lambda a, b, c: A.Call("IF", (a, b, c)), inner, inner, inner), st.builds(lambda v: A.Call("BOUND", (A.Var(v),)), st.sampled_from("xy")))


@settings(max_examples=6, derandomize=True, database=None, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.recursive(leaf, calls, max_leaves=5), min_size=40, max_size=40))
def test_compiler_matches_the_interpreter(spark, expressions):
    def row(t):
        return None if t is None else ("iri", t.value, None, None) if isinstance(t, A.Iri) else ("blank", t.label, None, None) if isinstance(t, A.Blank) else ("literal", t.value, t.datatype, t.lang)

    pairs = [(x, y) for x in TERMS for y in TERMS]
    df = spark.createDataFrame([(n, row(x), row(y)) for n, (x, y) in enumerate(pairs)], f"n int, x {TERM.simpleString()}, y {TERM.simpleString()}")
    compiler = Compiler(lambda name: value_of_term(df[name]))
    compiled = [compiler.compile(e) for e in expressions]
    out = df.select("n", *[c for k, v in enumerate(compiled) for c in (v.tags().alias(f"t{k}"), v.slot("b").alias(f"b{k}"), v.slot("n").alias(f"d{k}"), v.slot("s").alias(f"s{k}"))]).collect()
    for r in out:
        x, y = pairs[r.n]
        for k, e in enumerate(expressions):
            expected, tag = run(e, {"x": x, "y": y}), r[f"t{k}"]
            got = None if tag is None else (tag, r[f"b{k}"] if tag == "b" else r[f"d{k}"] if tag == "n" else r[f"s{k}"])
            same = got == expected or None not in (got, expected) and got[0] == expected[0] == "n" and math.isnan(got[1]) and math.isnan(expected[1])
            assert same, (e, x, y, got, expected)


def test_number_texts(spark):
    cases = {30.0: "30", 9.5: "9.5", 1e7: "10000000", 1.5e10: "15000000000", -2.25: "-2.25", 0.0001: "0.0001", 0.0: "0", float("nan"): "NaN", float("inf"): "inf", 123456789.125: "123456789.125"}
    df = spark.createDataFrame([(n, x) for n, x in enumerate(cases)], "n int, x double")
    assert [r[0] for r in df.orderBy("n").select(number_text(df.x)).collect()] == list(cases.values())


def test_replacements():
    assert java_replacement("$1-${2}$$\\x$9", 2) == "$1-$2\\$\\\\x"
