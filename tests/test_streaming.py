"""Following a folder of documents."""

from ontoloom.store import TripleStore
from ontoloom.streaming.ingest import stream_documents
from tests.social import rdfxml, turtle


def test_documents_are_inserted_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    store = TripleStore(spark)
    (folder / "a.ttl").write_text(turtle())
    stream_documents(store, str(folder), "turtle", str(tmp_path / "cp"), available_now=True).awaitTermination(120)
    assert store.table("relations").count() == 10
    (folder / "b.ttl").write_text("<http://a> <http://p> <http://b> , 'x' . <http://example.org/alice> <http://example.org/knows> <http://example.org/bob> .")
    stream_documents(store, str(folder), "turtle", str(tmp_path / "cp"), available_now=True).awaitTermination(120)
    assert store.table("relations").count() == 11 and store.table("properties").count() == 11
    other = tmp_path / "rdf"
    other.mkdir()
    (other / "c.rdf").write_text(rdfxml())
    stream_documents(store, str(other), "rdfxml", str(tmp_path / "cp2"), available_now=True).awaitTermination(120)
    assert store.table("relations").count() == 11
    lines = tmp_path / "nt"
    lines.mkdir()
    (lines / "d.nt").write_text('<http://a> <http://p> <http://c> .\nno statement\n_:x <http://p> "y\\u00e9" .\n')
    stream_documents(store, str(lines), "ntriples", str(tmp_path / "cp3"), available_now=True).awaitTermination(120)
    assert store.table("relations").count() == 12 and store.table("properties").where("value = 'yé' and s_kind = 'blank'").count() == 1
