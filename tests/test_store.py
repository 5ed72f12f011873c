"""Loading, inserting, ids, prefixes and export."""

import re

import pytest

from ontoloom.errors import DataError, StoreError
from ontoloom.sources.rdfxml import parse_rdfxml
from ontoloom.sources.statements import term_text
from ontoloom.sources.turtle import parse_turtle
from ontoloom.sparql import algebra as A
from ontoloom.store import ElementType, TripleStore, shorten_column
from tests.social import EX, rdfxml, turtle

STAR = """@prefix ex: <http://example.org/> .
<<ex:alice ex:knows ex:bob>> ex:certainty 0.9 ; ex:assertedBy ex:carol .
<< <<ex:alice ex:knows ex:bob>> ex:certainty 0.9 >> ex:statedIn ex:report1 .
ex:x ex:says <<( ex:a ex:b "c"@en )>> .
"""


@pytest.fixture(scope="module")
def store(spark):
    s = TripleStore(spark)
    s.import_rdfxml_data(rdfxml())
    return s


def facts(triples):
    return {term_text(t) for t in triples}


def test_both_formats_hold_the_same_triples():
    a, b = parse_turtle(turtle()), parse_rdfxml(rdfxml())
    assert facts(a[0]) == facts(b[0]) and len(facts(a[0])) == 20
    assert a[1]["ex"] == b[1]["ex"] == EX


def test_import_of_files(spark, tmp_path):
    (tmp_path / "ttl").mkdir()
    (tmp_path / "ttl/a.ttl").write_text(turtle())
    (tmp_path / "ttl/b.ttl").write_text("@prefix z: <http://z/> . [] z:p 1 . [] z:p 2 .")
    s = TripleStore(spark, str(tmp_path / "db"))
    s.import_turtle_file(str(tmp_path / "ttl"))
    assert s.table("relations").count() == 10 and s.table("properties").count() == 12
    (tmp_path / "x.rdf").write_text(rdfxml())
    s.import_rdfxml_file(str(tmp_path / "x.rdf"))
    assert s.table("relations").count() == 10 and s.table("properties").count() == 12
    again = TripleStore(spark, str(tmp_path / "db"))
    assert again.prefixes == s.prefixes and again.prefixes["z"] == "http://z/"
    assert again.query("SELECT ?n WHERE { ?p ex:name ?n }").df.count() == 4
    again.reset_db()
    assert again.table("relations").count() == 0 and again.prefixes == {}
    assert again.query("SELECT ?s WHERE { ?s ?p ?o }").df.count() == 0


def test_turtle_terms():
    text = """BASE <http://b/> PREFIX : <http://c/>
    <a> a :T ; :p 1, -2.5, 1e3, true, "x\\u00e9\\n", '''long "q" text''', "v"@en-GB, "t"^^<http://d/t> .
    :s :q ( 1 :y ) ; :r [ :in _:k ] . _:k :p <mailto:x@y> ."""
    found, _ = parse_turtle(text)
    o = {term_text(t.o) for t in found}
    assert '"1"^^<http://www.w3.org/2001/XMLSchema#integer>' in o and '"-2.5"^^<http://www.w3.org/2001/XMLSchema#decimal>' in o
    assert '"xé\\n"^^<http://www.w3.org/2001/XMLSchema#string>' in o and '"v"@en-GB' in o and "<mailto:x@y>" in o
    assert found[0].s == A.Iri("http://b/a") and len(found) == 17


def test_bad_statements_are_skipped():
    found, _ = parse_turtle('@prefix e: <http://e/> . e:a e:p 1 . e:b e:p no:x . e:c ! e:d . "lit" e:p 2 . e:z e:p 3 .')
    assert sorted(t.s.value for t in found) == ["http://e/a", "http://e/z"]


def test_rdfxml_ends_where_it_is_not_well_formed():
    head = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="http://e/">'
    one, two = '<e:T rdf:about="http://e/1"><e:p>a</e:p></e:T>', '<rdf:Description rdf:about="http://e/2"><e:p>b</e:p><e:q>c'
    found, prefixes = parse_rdfxml(head + one + two + "</e:p></rdf:Description>" + one + "</rdf:RDF>")
    assert {(t.s.value, t.p.value) for t in found} == {("http://e/1", A.RDF + "type"), ("http://e/1", "http://e/p"), ("http://e/2", "http://e/p")}
    assert prefixes["e"] == "http://e/"
    assert facts(parse_rdfxml(head + one + "</rdf:RDF> junk <")[0]) == facts(parse_rdfxml(head + one + "</rdf:RDF>")[0])
    for text in ("", "no xml", "<"):
        with pytest.raises(DataError):
            parse_rdfxml(text)


def test_one_bad_file_does_not_stop_an_import(spark, tmp_path):
    (tmp_path / "a.rdf").write_text(rdfxml())
    (tmp_path / "b.rdf").write_text("this is no XML at all")
    s = TripleStore(spark)
    s.import_rdfxml_file(str(tmp_path))
    assert s.table("relations").count() + s.table("properties").count() == 20 and s.prefixes["ex"] == EX


LINES = r"""# a comment
<http://e/a> <http://e/p> <http://e/b> .
  <http://e/a>	<http://e/p> "plain"  . # why not
_:x <http://e/p> _:y.1 .
<http://e/a><http://e/p>"tagged"@en-GB.
<http://e/a> <http://e/p> "7"^^<http://www.w3.org/2001/XMLSchema#integer> .
<http://e/a> <http://e/p> "" .
<http://e/a> <http://e/p> "two\nlines \u00e9 \"q\"" .
<http://e/\u00e9> <http://e/p> <http://e/b> .
<http://e/a> <http://e/p> <<( <http://e/s> <http://e/p> "o" )>> .

this is nothing
<http://e/a> <http://e/p> "open .
<http://e/a> "no predicate" <http://e/b> .
<http://e/a> <http://e/p> "CONTROL" .
""".replace("CONTROL", "\x01")


def test_lines_are_read_as_turtle_is(spark, tmp_path):
    one, two, three = TripleStore(spark), TripleStore(spark), TripleStore(spark)
    one.import_ntriples_data(LINES)
    for n in range(2):
        (tmp_path / f"{n}.nt").write_text(LINES)
    two.import_ntriples_file(str(tmp_path / "0.nt"))
    three.import_ntriples_file(str(tmp_path))
    good = "\n".join(x for x in LINES.splitlines() if not any(bad in x for bad in ("nothing", '"open', "no predicate")))
    wanted = parse_turtle(good)[0]
    plain = lambda text: re.sub(r"_:\w*?_", "_:", text)
    for s in (one, two):
        found = {plain(term_text(A.Triple(t.s, A.Iri("http://e/p"), t.o))) for t in s.query("CONSTRUCT { ?s <http://e/p> ?o } WHERE { ?s <http://e/p> ?o }").triples()}
        assert found == {plain(term_text(t)) for t in wanted if not isinstance(t.o, A.Triple)}
        assert s.table("annotations").count() == 1 and s.table("quoted").count() == 1
    assert three.table("relations").where("s_kind = 'blank'").count() == 2 and three.table("properties").count() == one.table("properties").count()


def test_compact_keeps_the_triples(spark, tmp_path):
    s = TripleStore(spark, str(tmp_path / "db"))
    for n in range(4):
        s.insert_triples([A.Triple(A.Iri(f"http://e/{n}"), A.Iri("http://e/p"), A.Literal(str(n)))])
    files = lambda: len(list((tmp_path / "db/properties").rglob("*.parquet")))
    assert files() == 4
    s.compact()
    assert files() == 1 and s.table("properties").count() == 4 and s.table("relations").count() == 0
    # cut off between its two renames, it is ended by the next start
    (tmp_path / "db/properties").rename(tmp_path / "db/properties.old")
    again = TripleStore(spark, str(tmp_path / "db"))
    assert again.table("properties").count() == 4 and not (tmp_path / "db/properties.old").exists()
    # what a cut off one has left is no hindrance
    (tmp_path / "db/properties.new").mkdir()
    again.compact()
    assert again.table("properties").count() == 4 and not (tmp_path / "db/properties.new").exists()


def test_the_number_of_prefixes_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(TripleStore, "MOST_PREFIXES", 3)
    s = TripleStore(spark)
    s.import_turtle_data("@prefix a: <http://a/> . @prefix b: <http://b/> . @prefix c: <http://c/> . a:x b:y c:z .")
    assert len(s.prefixes) == 3
    s.import_turtle_data("@prefix a: <http://a/> . @prefix b: <http://b/> . a:x b:y a:z .")
    with pytest.raises(StoreError):
        s.import_turtle_data("@prefix d: <http://d/> . d:x d:y d:z .")
    assert s.table("relations").count() == 2


def test_a_hot_predicate_is_written_by_many_tasks(spark, tmp_path):
    s = TripleStore(spark, str(tmp_path / "db"))
    rows = spark.range(200_000).selectExpr("'iri' as s_kind", "concat('http://e/', uuid()) as s", "'http://e/type' as p", "'iri' as o_kind", "'http://e/T' as o", "cast(null as string) as datatype", "cast(null as string) as lang", "true as asserted")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        s.insert_statements(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(list((tmp_path / "db/relations").rglob("*.parquet"))) > 3 and s.table("relations").count() == 200_000


def test_rdfxml_forms():
    text = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="http://e/" xml:base="http://b/">
    <e:Thing rdf:ID="one" e:attr="v"><e:p rdf:parseType="Resource"><e:q xml:lang="de">w</e:q></e:p><e:l rdf:nodeID="n"/><rdf:li>x</rdf:li>
    <e:c rdf:parseType="Collection"><rdf:Description rdf:about="y"/></e:c><e:n><e:Other/></e:n></e:Thing></rdf:RDF>"""
    found, prefixes = parse_rdfxml(text)
    texts = {(term_text(t.s), t.p.value, term_text(t.o)) for t in found}
    assert ("<http://b/#one>", A.RDF + "type", "<http://e/Thing>") in texts and ("<http://b/#one>", "http://e/attr", '"v"^^<http://www.w3.org/2001/XMLSchema#string>') in texts
    assert any(t.o == A.Literal("w", A.RDF + "langString", "de") for t in found) and any(t.p.value == A.RDF + "_1" for t in found)
    assert len(found) == 11 and prefixes["e"] == "http://e/"


def test_inserts_have_set_semantics(spark):
    s = TripleStore(spark)
    t = A.Triple(A.Iri(EX + "a"), A.Iri(EX + "p"), A.Iri(EX + "b"))
    s.insert_triple(t)
    s.insert_triples([t, t, A.Triple(A.Iri(EX + "a"), A.Iri(EX + "q"), A.Literal("5", A.XSD + "integer")), A.Triple(A.Iri(EX + "a"), A.Iri(EX + "q"), A.Literal("5")), A.Triple(A.Blank("x"), A.Iri(EX + "p"), A.Blank("y"))])
    assert s.table("relations").count() == 2 and s.table("properties").count() == 2
    # one lexical form under two datatypes is one match
    assert s.query(f'SELECT ?s WHERE {{ ?s <{EX}q> "5" }}').df.count() == 1
    (row,) = s.query(f"SELECT ?s WHERE {{ ?s <{EX}p> ?o FILTER(ISBLANK(?o)) }}").rows()
    assert row["s"] == A.Blank("x")
    s.insert_triple(A.Triple(A.Iri(EX + "n"), A.Iri(EX + "p"), A.Iri(EX + "n")))
    assert s.query(f"SELECT ?x WHERE {{ ?x <{EX}p> ?x }}").df.count() == 1
    with pytest.raises(DataError):
        s.insert_triple(A.Triple(A.Literal("x"), A.Iri(EX + "p"), A.Iri(EX + "b")))


def test_language_tags(spark):
    s = TripleStore(spark)
    s.import_turtle_data('@prefix e: <http://e/> . e:a e:l "Haus"@de-AT, "house"@en, "x" .')
    langs = lambda f: sorted(r["l"].value for r in s.query(f"SELECT ?l WHERE {{ ?s e:l ?l FILTER({f}) }}").rows())
    assert langs('LANGMATCHES(LANG(?l), "DE")') == ["Haus"] and langs('LANGMATCHES(LANG(?l), "*")') == ["Haus", "house"] and langs('LANG(?l) = ""') == ["x"]


def test_quoted_triples(spark):
    s = TripleStore(spark)
    s.import_turtle_data(STAR)
    assert s.table("quoted").count() == 3 and s.table("annotations").count() == 4
    assert s.table("annotations").join(s.table("quoted").select("quoted"), "quoted", "left_anti").count() == 0
    assert s.query("ASK { ex:alice ex:knows ex:bob }") is False
    assert s.query("SELECT ?who WHERE { ?r ex:assertedBy ?who }").df.count() == 1
    told = TripleStore(spark, assert_quoted=True)
    told.import_turtle_data(STAR)
    assert told.query("ASK { ex:alice ex:knows ex:bob }") is True


def test_ids_and_descriptions(store):
    alice, knows = store.get_id_from_iri(EX + "alice"), store.get_id_from_iri(EX + "knows", ElementType.PREDICATE)
    assert store.get_id_from_iri(EX + "nobody") is None and store.get_id_from_iri(EX + "nothing", ElementType.PREDICATE) is None
    assert len(list(store.describe_object_by_id(alice).triples())) == 6
    assert len(list(store.describe_predicate_by_id(knows).triples())) == 5
    subjects = store.get_relation_subject_list("ex:knows", EX + "carol").collect()
    assert {r.subject for r in subjects} == {EX + "alice", EX + "bob"} and alice in {r.subject_id for r in subjects}
    assert {r.object_id for r in subjects} == {store.get_id_from_iri(EX + "carol")}
    with pytest.raises(DataError):
        store.describe_object_by_id(1)


def test_prefixes(spark, store):
    assert store.get_short_iri(EX + "bob") == "ex:bob" and store.get_short_iri(EX) == EX and store.get_short_iri("urn:x") == "urn:x"
    store.add_prefix(EX + "sub/", "sub")
    assert store.get_short_iri(EX + "sub/x") == "sub:x"
    store.add_prefix("http://other/", "sub")
    assert store.prefixes["sub"] == "http://other/" and store.normalize_iri("sub:x") == "http://other/x" and store.normalize_iri("mailto:a@b") == "mailto:a@b"
    with pytest.raises(DataError):
        store.normalize_iri("plain")
    df = spark.createDataFrame([(EX + "bob",), (EX,), ("urn:x",), (None,)], "i string")
    assert [r[0] for r in df.select(shorten_column(df.i, {"ex": EX})).collect()] == ["ex:bob", EX, "urn:x", None]


def test_export_round_trip(spark, store, tmp_path):
    graph = store.query("CONSTRUCT { ?s ?p ?o } WHERE { ?s ?p ?o }")
    assert facts(parse_rdfxml(store.export_as_rdfxml(graph))[0]) == facts(parse_turtle(turtle())[0])
    store.write_rdfxml(graph, str(tmp_path / "out"))
    found = [t for f in (tmp_path / "out").glob("part-*") for t in parse_rdfxml(f.read_text())[0]]
    assert facts(found) == facts(graph.triples())
    with pytest.raises(DataError):
        store.export_as_rdfxml([A.Triple(A.Iri("a:b"), A.Iri("http://x/1"), A.Literal("y"))])
