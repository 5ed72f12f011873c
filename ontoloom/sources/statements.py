"""Parsed triples as rows, and files of documents as rows.

RDF/XML files are parsed whole, each once.  A Turtle file is read by one task, some lines at a time.
N-Triples are lines: large files are split between tasks, and lines without escapes are taken apart
natively.
"""

from __future__ import annotations

import logging
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from hashlib import blake2b
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontoloom.errors import DataError
from ontoloom.sources.rdfxml import parse_rdfxml
from ontoloom.sources.turtle import TurtleParser, parse_turtle
from ontoloom.sparql import algebra as A

log = logging.getLogger(__name__)

#: o_kind is iri, blank, literal or triple (o: the text of the quoted triple).  Rows that are not asserted describe
#: quoted triples.  A row of s_kind prefix declares one (p) for a namespace (o).
COLUMNS = ["s_kind", "s", "p", "o_kind", "o", "datatype", "lang"]
STATEMENT = ", ".join(f"{c} string" for c in COLUMNS) + ", asserted boolean"
PARSERS: dict[str, Callable] = {"turtle": parse_turtle, "rdfxml": parse_rdfxml}


def term_text(t) -> str:
    """A term in the manner of N-Triples; names quoted triples."""
    if isinstance(t, A.Iri):
        return f"<{t.value}>"
    if isinstance(t, A.Blank):
        return f"_:{t.label}"
    if isinstance(t, A.Triple):
        return f"<<( {term_text(t.s)} {term_text(t.p)} {term_text(t.o)} )>>"
    text = t.value.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r")
    return f'"{text}"' + (f"@{t.lang}" if t.lang else f"^^<{t.datatype}>")


def scoped(t, scope: str):
    """Blank labels are those of one document."""
    if isinstance(t, A.Blank):
        return A.Blank(scope + t.label)
    return A.Triple(scoped(t.s, scope), t.p, scoped(t.o, scope)) if isinstance(t, A.Triple) else t


def rows(triples: Iterable[A.Triple], asserted: bool = True) -> Iterator[tuple]:
    """The rows of triples; each quoted triple adds rows that describe it."""
    for t in triples:
        if not isinstance(t.s, (A.Iri, A.Blank)) or not isinstance(t.p, A.Iri):
            raise DataError("a subject is an IRI or blank node, a predicate an IRI")
        s = ("iri", t.s.value) if isinstance(t.s, A.Iri) else ("blank", t.s.label)
        if isinstance(t.o, A.Iri):
            o = ("iri", t.o.value, None, None)
        elif isinstance(t.o, A.Blank):
            o = ("blank", t.o.label, None, None)
        elif isinstance(t.o, A.Literal):
            o = ("literal", t.o.value, t.o.datatype, t.o.lang)
        else:
            o = ("triple", term_text(t.o), None, None)
            yield from rows([t.o], asserted=False)
        yield (*s, t.p.value, *o, asserted)


def from_text(spark: SparkSession, text: str, form: str) -> DataFrame:
    """Statements and prefixes of one document."""
    scope = f"d{blake2b(text.encode(), digest_size=8).hexdigest()}_"
    if form == "ntriples":
        return from_lines(spark.createDataFrame([(scope, line) for line in text.splitlines()], "scope string, value string"))
    return spark.createDataFrame(list(_document(text, form, scope)), STATEMENT)


def _document(text: str, form: str, scope: str) -> Iterator[tuple]:
    triples, prefixes = PARSERS[form](text)
    yield from rows(scoped(t, scope) for t in triples)
    for prefix, namespace in prefixes.items():
        yield ("prefix", None, prefix, "prefix", namespace, None, None, None)


def _batch(found: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*found)) if found else [()] * (len(COLUMNS) + 1)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns[:-1]] + [pa.array(columns[-1], pa.bool_())], names=[*COLUMNS, "asserted"])


def parse_batches(texts: DataFrame, form: str) -> DataFrame:
    """Statements and prefixes of documents (scope, value); blank labels carry the scope.

    A document that cannot be parsed at all is logged and has no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for scope, text in zip(batch.column("scope").to_pylist(), batch.column("value").to_pylist()):
                try:
                    found = list(_document(text, form, f"f{scope}_"))
                except DataError as fault:
                    log.warning("skipped a document: %s", fault)
                    continue
                yield _batch(found)

    return texts.mapInArrow(run, STATEMENT)


def from_files(spark: SparkSession, path: str, form: str) -> DataFrame:
    """Statements and prefixes of the documents under ``path``, parsed in parallel."""
    if form == "ntriples":
        return from_lines(spark.read.text(path).select(F.concat(F.lit("f"), F.hex(F.xxhash64(F.input_file_name())), F.lit("_")).alias("scope"), "value"))
    if form == "turtle":
        return _from_turtle_files(spark, path)
    return parse_batches(spark.read.text(path, wholetext=True).select(F.hex(F.xxhash64(F.input_file_name())).alias("scope"), "value"), form)


def _from_turtle_files(spark: SparkSession, path: str) -> DataFrame:
    """Each file's lines in their order in one task; only those of files that are read in parts are shuffled for it."""
    whole = F.col("_metadata.file_block_length") == F.col("_metadata.file_size")
    scope = F.hex(F.xxhash64(F.input_file_name())).alias("scope")
    lines = spark.read.text(path, lineSep="\n").select(scope, whole.alias("whole"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), "value")
    parts = lines.where("not whole").repartition("scope").sortWithinPartitions("scope", "block", "line")
    return parse_lines(lines.where("whole")).unionByName(parse_lines(parts))


def parse_lines(lines: DataFrame) -> DataFrame:
    """Statements and prefixes of Turtle documents of which a partition has the lines (scope, value) in order, one document after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def slices() -> Iterator[tuple[str, pa.Array]]:
            for batch in batches:
                scopes, begin = pc.run_end_encode(batch.column("scope")), 0
                for scope, end in zip(scopes.values.to_pylist(), scopes.run_ends.to_pylist()):
                    yield scope, batch.column("value").slice(begin, end - begin)
                    begin = end

        for scope, found in groupby(slices(), itemgetter(0)):
            yield from _parsed((values for _, values in found), f"f{scope}_")

    return lines.select("scope", "value").mapInArrow(run, STATEMENT)


_PREFIXED = r"(?:[A-Za-z][A-Za-z0-9_-]*)?:(?:[A-Za-z0-9_][A-Za-z0-9_-]*)?"
_FULL = r'<[^\x00-\x20<>"{}|^`\\]+>'
_NODE = rf"{_FULL}|_:[A-Za-z0-9_]+|{_PREFIXED}"
#: Fixed value: a line of Turtle that is one statement without escapes; the groups are its terms and what a literal has behind its quotes.
#: RE2 is fast for up to five groups only.
PLAIN = rf'\A[ \t]*(?P<s>{_NODE})[ \t]+(?P<p>{_FULL}|{_PREFIXED})[ \t]+(?P<o>{_NODE}|"[^"\\\n\r]*")(?P<end>@[A-Za-z]+(?:-[A-Za-z0-9]+)*|\^\^(?:{_FULL}|{_PREFIXED}))?[ \t]*\.[ \t\r]*\z'


class _Lines:
    """The lines of one document, given out in runs of plain ones or as text."""

    #: Least lines of a run; most lines and rows that are held at a time otherwise.
    LEAST, MOST = 16, 5000

    def __init__(self, slices: Iterator[pa.Array]):
        self.slices, self.values, self.n, self.begun = slices, [], 0, False

    def _here(self) -> bool:
        """Whether there is a line left, at ``n`` of ``values``."""
        while self.n == len(self.values):
            values = next(self.slices, None)
            if values is None:
                return False
            self.values, self.n = values, 0
            self.groups = pc.extract_regex(values, PLAIN)
            plain = np.concatenate([[0], np.asarray(self.groups.is_valid()), [0]]).astype(np.int8)
            runs = np.flatnonzero(np.diff(plain)).reshape(-1, 2)
            #: where runs begin and end, by turns
            self.bounds = runs[runs[:, 1] - runs[:, 0] >= self.LEAST].ravel().tolist()
        return True

    def run(self) -> pa.StructArray | None:
        """The plain lines that come next, if they are many."""
        if not self._here() or not (at := bisect_right(self.bounds, self.n)) % 2:
            return None
        begin, self.n, self.begun = self.n, self.bounds[at], True
        return self.groups.slice(begin, self.n - begin)

    def is_run(self) -> bool:
        return self._here() and bisect_right(self.bounds, self.n) % 2 == 1

    def text(self, least: int) -> str:
        """The lines up to the next run's begin or end, and more for so many characters; "" at the end."""
        out, size = [], -1
        while size < least and self._here():
            at = bisect_right(self.bounds, self.n)
            end = min([self.n + self.MOST, len(self.values), *self.bounds[at : at + 1]])
            out += self.values.slice(self.n, end - self.n).to_pylist()
            size, self.n = sum(map(len, out)), end
        text = "".join(f"{line}\n" for line in out)
        text, self.begun = text if self.begun else text.lstrip("\ufeff"), self.begun or bool(out)
        return text


def _parsed(slices: Iterator[pa.Array], scope: str) -> Iterator[pa.RecordBatch]:
    """The statements and prefixes of a document, of which a few lines are held at a time."""
    lines, found = _Lines(slices), []
    parser = TurtleParser(more=lines.text)
    while True:
        if lines.is_run() and not parser.base and parser.between():
            yield _plain_batch(lines.run(), parser.prefixes, scope)
            continue
        own = parser.next_statement()
        if own is None:
            break
        try:
            found += list(rows(scoped(t, scope) for t in own))
        except DataError as fault:
            log.warning("skipped a statement: %s", fault)
        if len(found) >= _Lines.MOST:
            yield _batch(found)
            found = []
    yield _batch(found + [("prefix", None, prefix, "prefix", namespace, None, None, None) for prefix, namespace in parser.prefixes.items()])


def _plain_batch(groups: pa.StructArray, prefixes: dict[str, str], scope: str) -> pa.RecordBatch:
    """The statements of lines that ``PLAIN`` has taken apart."""

    def full(term: str) -> str | None:
        """A blank node or an IRI; None if its prefix is unknown."""
        if term[0] in "_<":
            return scope + term[2:] if term[0] == "_" else term[1:-1]
        prefix, _, local = term.partition(":")
        return prefixes[prefix] + local if prefix in prefixes else None

    def each(terms: pa.Array, f: Callable[[str], str | None]) -> pa.Array:
        """``f`` of every term, called once for each distinct one."""
        coded = terms.dictionary_encode()
        return pa.array([f(t) for t in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)

    def nodes(terms: pa.Array) -> tuple[pa.Array, pa.Array]:
        blank, literal, iri = (pc.starts_with(terms, mark) for mark in ("_", '"', "<"))
        inner = pc.binary_slice(terms.cast(pa.binary()), 1, -1).cast(pa.string())
        short = pc.invert(pc.or_(literal, iri))
        values = pc.replace_with_mask(inner, short, pa.array([full(t) for t in terms.filter(short).to_pylist()], pa.string()))
        return pc.if_else(blank, "blank", pc.if_else(literal, "literal", "iri")), values

    s, p, o, end = (x.cast(pa.string()) for x in groups.flatten())
    (s_kind, s), (o_kind, o) = nodes(s), nodes(o)
    told, none = pc.equal(o_kind, "literal"), pa.scalar(None, pa.string())
    datatype = each(end, lambda t: A.XSD + "string" if not t else A.RDF + "langString" if t[0] == "@" else full(t[2:]))
    lang = each(end, lambda t: t[1:] if t[:1] == "@" else None)
    columns = [s_kind, s, each(p, full), o_kind, o, pc.if_else(told, datatype, none), pc.if_else(told, lang, none), pa.repeat(True, len(s))]
    found = pa.RecordBatch.from_arrays(columns, names=[*COLUMNS, "asserted"])
    known = pc.and_(pc.and_(columns[1].is_valid(), columns[2].is_valid()), pc.and_(o.is_valid(), datatype.is_valid()))
    if not pc.all(known).as_py():
        log.warning("skipped %d statements: unknown prefix", len(s) - pc.sum(known).as_py())
        found = found.filter(known)
    return found


_IRI = r"<([^\x00-\x20<>\"{}|^`\\]*+)>"
_LABEL = r"_:([\p{L}\p{N}_](?:[\p{L}\p{N}_.·-]*[\p{L}\p{N}_·-])?)"
#: Fixed value: a line of N-Triples without escapes; the object's groups are IRI, label, quoted text, language tag and datatype.
LINE = rf'\A\s*(?:{_IRI}|{_LABEL})\s*{_IRI}\s*(?:{_IRI}|{_LABEL}|("[^"\\\n\r]*+")(?:@([A-Za-z]+(?:-[A-Za-z0-9]+)*)|\^\^{_IRI})?)\s*\.\s*(?:#.*)?\z'


def from_lines(lines: DataFrame) -> DataFrame:
    """Statements of N-Triples lines (scope, value).

    Lines with escapes or quoted triples go through the Turtle parser in Arrow batches, which logs and skips
    what is no statement.
    """
    text = F.coalesce("value", F.lit(""))
    plain = text.rlike(LINE)
    mark = "\x01"  # no line that matches can hold it outside a literal, and the literal comes last
    parts = F.split(F.regexp_replace("value", LINE, mark.join(f"${n}" for n in (1, 2, 3, 4, 5, 7, 8, 6))), mark, 8)
    got = lines.where(plain).select("scope", parts.alias("g"))

    def part(n: int):
        return F.nullif(F.get("g", n), F.lit(""))

    quoted, tag, datatype = part(7), part(5), part(6)
    s = F.coalesce(part(0), F.concat("scope", part(1)))
    literal = F.substr(quoted, F.lit(2), F.length(quoted) - 2)
    native = got.select(
        F.when(part(1).isNotNull(), "blank").otherwise("iri").alias("s_kind"),
        F.coalesce(s, F.lit("")).alias("s"),
        F.coalesce(part(2), F.lit("")).alias("p"),
        F.when(quoted.isNotNull(), "literal").when(part(4).isNotNull(), "blank").otherwise("iri").alias("o_kind"),
        F.when(quoted.isNotNull(), literal).when(part(4).isNotNull(), F.concat("scope", part(4))).otherwise(F.coalesce(part(3), F.lit(""))).alias("o"),
        F.when(quoted.isNotNull(), F.when(tag.isNotNull(), A.RDF + "langString").otherwise(F.coalesce(datatype, F.lit(A.XSD + "string")))).alias("datatype"),
        tag.alias("lang"),
        F.lit(True).alias("asserted"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for scope, line in zip(batch.column("scope").to_pylist(), batch.column("value").to_pylist()):
                found += rows(scoped(t, scope) for t in parse_turtle(line)[0])
            yield _batch(found)

    rest = lines.where(~plain & ~text.rlike(r"\A\s*(?:#.*)?\z"))
    return native.unionByName(rest.mapInArrow(run, STATEMENT))
