"""Turtle documents that are read some lines at a time."""

import gzip
import random
import tracemalloc
from collections import Counter

import pyarrow as pa
import pytest

from ontoloom.plans import stores
from ontoloom.sources import statements
from ontoloom.sources.turtle import TurtleParser, parse_turtle

HEAD = "@prefix e: <http://e/> .\n@prefix : <http://empty/> .\n"
#: Statements of one line and of many, good and bad, some that look like others within a string.
PARTS = [
    'e:a e:p "x" .\n',
    "e:a e:p e:b .\n",
    ":a :p : .\n",
    '<http://x/é> <http://x/p> "y{}<"@en-GB .\n',
    '_:k e:p "7"^^<http://www.w3.org/2001/XMLSchema#integer> . \r\n',
    '\te:a-1 e:p ""^^e:t.\n',
    "no:x e:p e:b .\n",
    'e:a e:p "z"^^no:t .\n',
    "e:a e:p _:k , 5 ;\n  e:q [ e:r ( 1 2 ) ] .\n",
    'e:a e:p """two\ne:n e:n e:n .\n""lines""" . # why\n',
    'e:a e:p "an \\"escape\\n" .\n',
    'e:a e:p "end\\\nless .\n',
    "e:a ! e:b .\n",
    "e:a e:p <<( e:s e:p 1 )>> .\n",
    "@prefix e: <http://f/> .\n",
    "\n",
    "# e:a e:p e:c .\n",
]


def document(seed: int) -> str:
    rnd = random.Random(seed)
    return "﻿" * (seed % 2) + HEAD + "".join(rnd.choice(PARTS[:8] if rnd.random() < 0.9 else PARTS) * rnd.choice([1, 1, 3, 20]) for _ in range(60))


def slices(text: str, size: int):
    lines = text.split("\n")
    return (pa.array(lines[n : n + size]) for n in range(0, len(lines), size))


@pytest.mark.parametrize("size", [1, 7, 100, 10_000])
def test_lines_give_what_the_whole_text_gives(size):
    for seed in range(8):
        text = document(seed)
        triples, prefixes = parse_turtle(text)
        wanted = list(statements.rows(statements.scoped(t, "f1_") for t in triples)) + [("prefix", None, p, "prefix", n, None, None, None) for p, n in prefixes.items()]
        assert Counter(tuple(r.values()) for b in statements._parsed(slices(text, size), "f1_") for r in b.to_pylist()) == Counter(wanted)
        lines = iter([*text.lstrip("﻿").splitlines(keepends=True)])
        parser = TurtleParser(more=lambda least: next(lines, ""))
        assert parser.statements() == triples and parser.prefixes == prefixes


def test_a_base_holds_for_the_lines_that_follow():
    text = "@base <http://b/c/> .\n" + "<d> <p> <../e> .\n" * 40
    assert [tuple(r.values()) for b in statements._parsed(slices(text, 9), "f_") for r in b.to_pylist()] == list(statements.rows(parse_turtle(text)[0]))


@pytest.mark.parametrize("line", ['<http://e/{}> e:p "a text" .', '<http://e/{}> e:p "a \\"text\\"" .', "<http://e/{}> e:p\n  e:b , 1 .", "<http://e/{}> ! wrong .", "! ,"])
def test_memory_does_not_follow_the_document(line, monkeypatch):
    monkeypatch.setattr("ontoloom.sources.turtle.log.warning", lambda *_: None)  # pytest keeps what is logged

    def some():
        yield pa.array(HEAD.splitlines())
        for n in range(20):
            yield pa.array("\n".join(line.format(1000 * n + k) for k in range(1000)).splitlines())

    tracemalloc.start()
    try:
        found = sum(b.num_rows for b in statements._parsed(some(), "f_"))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found in (2, 20_002, 40_002) and peak < 8e6


def test_files_in_parts_and_compressed_ones_are_whole_documents(spark, tmp_path):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    texts = [document(seed) for seed in range(4)]
    (tmp_path / "in").mkdir()
    for n, text in enumerate(texts[:3]):
        (tmp_path / f"in/{n}.ttl").write_bytes(text.encode())
    (tmp_path / "in/3.ttl.gz").write_bytes(gzip.compress(texts[3].encode()))
    wanted = sum(len(list(statements.rows(t))) + len(p) for t, p in map(parse_turtle, texts))
    bad = '_:bad e:p """never closed\n' + 'e:a e:p "x" .\n' * 3
    try:
        for part in ("1k", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", part)
            found = statements.from_files(spark, str(tmp_path / "in"), "turtle")
            assert found.count() == wanted
            assert found.where("s_kind = 'blank' and s like 'f%_k'").select("s").distinct().count() == 4
        (tmp_path / "bad.ttl").write_text(HEAD + bad)
        assert statements.from_files(spark, str(tmp_path / "bad.ttl"), "turtle").count() == 2 + len(parse_turtle(HEAD + bad)[0])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_store_turtle_writes_documents_line_by_line(spark, tmp_path, monkeypatch):
    """No row holds a document; each begins with the prefix and has all statements of its subjects."""
    seen = []
    monkeypatch.setattr(stores.TripleStore, "import_turtle_file", lambda self, path: seen.append(path))
    stores.store_turtle(spark, "/root/testdata/sf0.001")
    rows = spark.read.text(seen[0]).selectExpr("_metadata.file_path as f", "value")
    assert rows.selectExpr("max(length(value)) as n").head().n < 10_000
    assert rows.where("value like '@prefix%'").groupBy("f").count().where("count = 1").count() == rows.select("f").distinct().count() > 1
    assert rows.where("value not like '@prefix%'").selectExpr("split(value, ' ')[0] as s", "f").distinct().groupBy("s").count().where("count > 1").isEmpty()
