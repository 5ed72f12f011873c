"""Query results over the social graph."""

import pytest

from ontoloom.errors import SparqlError
from ontoloom.sparql import algebra as A
from ontoloom.store import TripleStore
from tests.social import EX, turtle


@pytest.fixture(scope="module")
def store(spark):
    s = TripleStore(spark)
    s.import_turtle_data(turtle())
    return s


NAME = "?p ex:name ?name ."
AGE = "?p ex:age ?age ."
#: body of WHERE, variable, expected values (people by local name)
CASES = [
    ("?x ex:knows ex:carol . ?org ex:partOf ex:consortium . FILTER(?x = ex:alice)", "org", ["orgA", "orgB"]),
    ("ex:alice ex:knows ?person . ?person ex:knows ex:dave . ?person ex:worksAt ex:orgA .", "person", ["bob"]),
    ("ex:alice ex:knows ?a . ?a ex:knows ?b . ?b ex:worksAt ?org .", "org", ["orgB"]),
    (NAME + 'FILTER(?name = "Alice")', "p", ["alice"]),
    (NAME + 'FILTER(?name = "Alice" || ?name = "Dave")', "p", ["alice", "dave"]),
    (NAME + 'FILTER(?name != "Alice")', "p", ["bob", "carol", "dave"]),
    (NAME + 'FILTER(?name = "Zed")', "p", []),
    (AGE + "FILTER(?age > 25)", "p", ["alice"]),
    (AGE + 'FILTER(?age >= "25"^^<http://www.w3.org/2001/XMLSchema#integer>)', "p", ["alice", "bob", "carol"]),
    (AGE + "FILTER(?age < 30)", "p", ["bob", "carol"]),
    (AGE + "FILTER(?age <= 25.0)", "p", ["bob", "carol"]),
    (AGE + "FILTER(?age = 25)", "p", ["bob", "carol"]),
    (NAME + 'FILTER(!(?name = "Alice"))', "p", ["bob", "carol", "dave"]),
    ("?p ex:knows ?q . ?p ex:age ?age . FILTER(?age = 30 && ?q = ex:bob)", "p", ["alice"]),
    (NAME + AGE + 'FILTER((?name = "Alice" || ?name = "Bob") && ?age >= 25)', "p", ["alice", "bob"]),
    (NAME + AGE + "FILTER(BOUND(?age))", "p", ["alice", "bob", "carol"]),
    (NAME + "FILTER(BOUND(?nothing))", "p", []),
    (NAME + 'FILTER(?name IN ("Alice", "Carol"))', "p", ["alice", "carol"]),
    (NAME + 'FILTER(?name NOT IN ("Alice", "Carol"))', "p", ["bob", "dave"]),
    (NAME + 'FILTER(CONTAINS(?name, "li"))', "p", ["alice"]),
    (NAME + 'FILTER(STRSTARTS(?name, "A"))', "p", ["alice"]),
    (NAME + 'FILTER(STRENDS(?name, "b"))', "p", ["bob"]),
    (NAME + "FILTER(STRLEN(?name) > 4)", "p", ["alice", "carol"]),
    (NAME + 'FILTER(LCASE(?name) = "alice")', "p", ["alice"]),
    (NAME + 'FILTER(UCASE(?name) = "BOB")', "p", ["bob"]),
    (NAME + 'FILTER(REGEX(?name, "^[AB]"))', "p", ["alice", "bob"]),
    (NAME + 'FILTER(REGEX(?name, "ALICE", "i"))', "p", ["alice"]),
    (NAME + 'FILTER(REGEX(?name, "^Z"))', "p", []),
    (NAME + 'FILTER(REGEX(?name, "["))', "p", []),
    (NAME + "FILTER(?p = ex:alice)", "p", ["alice"]),
    ("ex:alice ex:knows ?q . FILTER(ISIRI(?q))", "q", ["bob", "carol"]),
    ("ex:alice ?v ?q . FILTER(ISLITERAL(?q))", "v", ["age", "name", "score"]),
    ("?p ex:knows ?q . ?q ex:age ?age . FILTER(?age = 25)", "p", ["alice", "alice", "bob"]),
    ("?p ex:score ?s . FILTER(?s * 2 > 17)", "p", ["alice"]),
    (AGE + 'FILTER(IF(?age > 26, "old", "young") = "old")', "p", ["alice"]),
    (AGE + "FILTER(COALESCE(?nothing, ?age) = 30)", "p", ["alice"]),
    (NAME + "FILTER(false)", "p", []),
    (NAME + "FILTER(true)", "p", ["alice", "bob", "carol", "dave"]),
    (NAME + 'FILTER(SAMETERM(?name, "Alice"))', "p", ["alice"]),
    ("?p ex:knows ex:nobody . FILTER(?p = ex:alice)", "p", []),
    # more functions
    (NAME + 'FILTER(STRBEFORE(?name, "li") = "A" && STRAFTER(?name, "li") = "ce")', "p", ["alice"]),
    (NAME + 'FILTER(STRBEFORE(?name, "zz") = "" && STRAFTER(?name, "") = ?name && ?name = "Bob")', "p", ["bob"]),
    ("?p ex:score ?s . FILTER(STR(?s) = \"7\")", "p", ["bob"]),
    (NAME + AGE + 'FILTER(CONCAT(?name, "-", ?age) = "Bob-25")', "p", ["bob"]),
    (NAME + 'FILTER(SUBSTR(?name, 2, 2) = "li" || SUBSTR(?name, 9) = "x")', "p", ["alice"]),
    (NAME + 'FILTER(REPLACE(?name, "(l)(i)", "$2${1}") = "Ailce")', "p", ["alice"]),
    (NAME + 'FILTER(LANG(?name) = "" && DATATYPE(?name) = <http://www.w3.org/2001/XMLSchema#string>)', "p", ["alice", "bob", "carol", "dave"]),
    (AGE + "FILTER(ISNUMERIC(?age) && !ISBLANK(?p) && ABS(-?age) = 30)", "p", ["alice"]),
    ("?p ex:score ?s . FILTER(CEIL(?s) = 10 && FLOOR(?s) = 9 && ROUND(?s) = 10)", "p", ["alice"]),
    (NAME + 'FILTER(IRI(CONCAT("http://example.org/", LCASE(?name))) = ?p && +1 = 1 && 2 - 3 = -1 && 1 / 2 = 0.5)', "p", ["alice", "bob", "carol", "dave"]),
    (AGE + "FILTER(?age / 0 = 1)", "p", []),
    (AGE + "FILTER(!(?age / 0 = 1))", "p", ["alice", "bob", "carol"]),
    (NAME + "FILTER(?name = 5)", "p", []),
    (NAME + "FILTER(?name != 5)", "p", ["alice", "bob", "carol", "dave"]),
    (NAME + "FILTER(?name < 5)", "p", []),
    (NAME + "FILTER(NOT EXISTS { ?p ex:age ?a })", "p", ["dave"]),
    (NAME + "FILTER EXISTS { ?p ex:knows ex:dave }", "p", ["bob", "carol"]),
    ('BIND("2024-03-05T06:07:08.5Z" AS ?d) ?p ex:name ?n FILTER(YEAR(?d) = 2024 && MONTH(?d) = 3 && DAY(?d) = 5 && HOURS(?d) = 6 && MINUTES(?d) = 7 && SECONDS(?d) = 8.5 && ?n = "Bob")', "p", ["bob"]),
    (AGE + 'FILTER(YEAR("2024-03-05") = 2024 && !BOUND(?none) && COALESCE(HOURS("2024-03-05"), -1) = -1 && COALESCE(YEAR("x"), 1) = 1 && ?age > 25)', "p", ["alice"]),
    (NAME + 'FILTER(MD5(?name) = "2fc1c0beb992cd7096975cfebf9d5c3b" && STRLEN(SHA1(?name)) = 40 && STRLEN(SHA256(?name)) = 64 && STRLEN(SHA384(?name)) = 96 && STRLEN(SHA512(?name)) = 128)', "p", ["bob"]),
    (NAME + 'FILTER(ENCODE_FOR_URI("a b/*~é+") = "a%20b%2F%2A~%C3%A9%2B" && ?name = "Bob")', "p", ["bob"]),
    (NAME + 'BIND(STRDT("7", <http://www.w3.org/2001/XMLSchema#integer>) AS ?x) BIND(STRLANG("v", "de") AS ?y) FILTER(?x + 1 = 8 && LANG(?y) = "de" && DATATYPE(?x) = <http://www.w3.org/2001/XMLSchema#integer> && ?name = "Bob")', "p", ["bob"]),
    (AGE + 'FILTER(<http://www.w3.org/2001/XMLSchema#integer>("-7.9") = -7 && <http://www.w3.org/2001/XMLSchema#boolean>("1") && <http://www.w3.org/2001/XMLSchema#string>(?age) = "30" && !BOUND(?q))', "p", ["alice"]),
    (NAME + 'FILTER(COALESCE(<http://www.w3.org/2001/XMLSchema#dateTime>("2024-01-01"), "no") = "no" && <http://www.w3.org/2001/XMLSchema#date>("2024-01-01") = "2024-01-01" && ?name = "Bob")', "p", ["bob"]),
    (NAME + "FILTER(NOSUCH(?name) = 1)", "p", []),
    # joins
    ("?p ex:age ?a . ?q ex:age ?a . FILTER(?p != ?q)", "p", ["bob", "carol"]),
    ('?p ex:age "25" .', "p", ["bob", "carol"]),
    ("?p ex:name ?n . ex:alice ex:knows ex:bob .", "p", ["alice", "bob", "carol", "dave"]),
    ("?p ex:name ?n . ex:alice ex:knows ex:dave .", "p", []),
    ("?p ex:knows ?p .", "p", []),
    ("{ SELECT ?p WHERE { ?p ex:age 30 } } ?p ex:name ?n", "p", ["alice"]),
    ("?p ex:name ?n OPTIONAL { ?p ex:age ?a } FILTER(!BOUND(?a))", "p", ["dave"]),
    ("{ ?p ex:age 30 } UNION { ?p ex:worksAt ex:orgB }", "p", ["alice", "carol"]),
    ("?p ex:name ?n MINUS { ?p ex:worksAt ex:orgA }", "p", ["carol", "dave"]),
    ("VALUES ?p { ex:bob ex:nobody } ?p ex:name ?n", "p", ["bob"]),
    ("?p ex:age ?a BIND(?a + 1 AS ?b) FILTER(?b = 31)", "p", ["alice"]),
]


@pytest.mark.parametrize("body,var,expected", CASES, ids=range(len(CASES)))
def test_select(store, body, var, expected):
    rows = store.query(f"SELECT ?{var} WHERE {{ {body} }}").df.collect()
    assert sorted(r[0]["value"].removeprefix(EX) for r in rows) == sorted(expected)


def test_cross_product(store):
    assert store.query("SELECT * WHERE { ?p ex:worksAt ex:orgB . ?o ex:partOf ex:consortium }").df.count() == 2


def test_social(store):
    q = 'SELECT ?person ?colleague WHERE { ?person ex:worksAt ?org . ?colleague ex:worksAt ?org . ?person ex:name ?n . ?colleague ex:age ?a . FILTER(STRSTARTS(?n, "A") && ?a <= 25 && ?person != ?colleague) }'
    (row,) = store.query(q).rows()
    assert row == {"person": A.Iri(EX + "alice"), "colleague": A.Iri(EX + "bob")}


def test_blank_nodes_join_and_stay_apart_from_variables(store):
    found = store.query("SELECT ?a ?b WHERE { ?a ex:worksAt _:org . ?b ex:worksAt _:org . FILTER(?a != ?b) }")
    assert found.vars == ["a", "b"] and found.df.columns == ["a", "b"]
    assert sorted(r["a"].value.removeprefix(EX) for r in found.rows()) == ["alice", "bob"]
    assert store.query("SELECT ?friend ?x WHERE { _:x ex:knows ?friend . ?x ex:worksAt ex:orgA }").df.count() == 10


def test_unprojected_variables_can_be_read(store):
    found = store.query("SELECT ?p WHERE { ?p ex:name ?name FILTER(?name IN (\"Bob\")) }")
    assert found.df.columns == ["p"]
    assert found.all_bindings.select("name.value").collect()[0][0] == "Bob"


def test_show(store):
    text = store.query("SELECT ?n ?none WHERE { ?p ex:name ?n FILTER(?p = ex:bob) }").show()
    assert text == "?n\t?none\nBob\t"


def test_modifiers(store):
    names = lambda q: [r["n"].value for r in store.query(q).rows()]
    assert names("SELECT ?n WHERE { ?p ex:name ?n } ORDER BY DESC(?n) LIMIT 2 OFFSET 1") == ["Carol", "Bob"]
    assert store.query("SELECT DISTINCT ?a WHERE { ?p ex:age ?a }").df.count() == 2
    assert [r["a"].value for r in store.query("SELECT DISTINCT ?a WHERE { ?p ex:age ?a } ORDER BY DESC(?a)").rows()] == ["30", "25"]
    pairs = store.query("SELECT ?n ?a WHERE { ?p ex:name ?n OPTIONAL { ?p ex:age ?a FILTER(?a > 25 && ?n != \"Bob\") } }").rows()
    assert {r["n"].value: r["a"].value if "a" in r else None for r in pairs} == {"Alice": "30", "Bob": None, "Carol": None, "Dave": None}
    assert [r["a"].value for r in store.query("SELECT ?a WHERE { ?p ex:age ?a } ORDER BY ?a").rows()] == ["25", "25", "30"]
    assert store.query("SELECT ?x WHERE {}").bindings.df.count() == 1


def test_aggregates(store):
    rows = store.query("SELECT ?org (COUNT(?p) AS ?n) (AVG(?a) AS ?mean) (MIN(?a) AS ?low) WHERE { ?p ex:worksAt ?org ; ex:age ?a } GROUP BY ?org HAVING(COUNT(?p) > 1)").values.collect()
    assert [(r.org, r.n, r.mean, r.low) for r in rows] == [(EX + "orgA", 2, 27.5, "25")]
    assert store.query("SELECT (COUNT(*) AS ?n) WHERE { ?s ?p ?o }").values.collect()[0].n == 20


def test_construct(store):
    graph = store.query("CONSTRUCT { ?s ex:knows ex:alice } WHERE { ex:alice ex:knows ?s }")
    assert {t.s.value.removeprefix(EX) for t in graph.triples()} == {"bob", "carol"}
    graph = store.query('CONSTRUCT { ?p ex:has [ ex:age ?a ; ex:of "x"@en ] . "no" ex:p ?p . ?p ex:q ?unbound } WHERE { ?p ex:age ?a }')
    found = list(graph.triples())
    assert len(found) == 9 and len({t.o for t in found if isinstance(t.o, A.Blank)}) == 3
    assert sum(t.o == A.Literal("x", A.RDF + "langString", "en") for t in found) == 3
    assert store.query("CONSTRUCT WHERE { ?p ex:age 30 }").df.count() == 1


def test_ask_and_describe(store):
    assert store.query("ASK { ex:alice ex:knows ex:bob }") is True
    assert store.query("ASK { ex:alice ex:knows ex:dave }") is False
    assert store.query("DESCRIBE ex:alice").df.count() == 6
    assert store.query("DESCRIBE ?o WHERE { ?p ex:worksAt ?o }").df.count() == 5


@pytest.mark.parametrize(
    "text",
    ["SELECT ?p WHERE { GRAPH ?g { ?p ?q ?r } }", "SELECT WHERE { ?p ?q ?r }", "SELECT ?p { \"x\" ?q ?p }", "SELECT ?p { ?p no:x ?q }", "SELECT ?p { ?p ex:x << ex:a ex:b ex:c >> ", "LOAD <x>"],
)
def test_unsupported_and_wrong_queries_raise(store, text):
    with pytest.raises(SparqlError):
        store.query(text)


def test_strict_errors(spark, store):
    strict = TripleStore(spark, store.path, strict=True)
    strict.prefixes = store.prefixes
    assert strict.query("SELECT ?p WHERE { ?p ex:age ?a FILTER(!(?a / 0 = 1)) }").df.count() == 0
    assert strict.query("SELECT ?p WHERE { ?p ex:age ?a FILTER(?a / 0 = 1 || ?a = 30) }").df.count() == 1
