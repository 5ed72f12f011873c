"""RDF/XML: documents to statements, and graphs to documents."""

from __future__ import annotations

import io
import itertools
import logging
import re
from collections.abc import Iterable, Iterator
from urllib.parse import urljoin
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

from ontoloom.errors import DataError
from ontoloom.sparql import algebra as A
from ontoloom.sparql.algebra import RDF

log = logging.getLogger(__name__)
XML = "http://www.w3.org/XML/1998/namespace"


class Reader:
    """Walks the element tree: node elements hold property elements, which hold values or nodes."""

    def __init__(self, base: str):
        self.base, self.fresh, self.out = base, itertools.count(), []

    def blank(self) -> A.Blank:
        return A.Blank(f"_{next(self.fresh)}")

    @staticmethod
    def name(tag: str) -> str:
        return tag[1:].replace("}", "", 1) if tag.startswith("{") else tag

    def iri(self, text: str, base: str) -> A.Iri:
        return A.Iri(urljoin(base, text) if base else text)

    def add(self, s, p: str, o) -> None:
        self.out.append(A.Triple(s, A.Iri(p), o))

    def node(self, e: ElementTree.Element, base: str, lang: str | None):
        base, lang = e.get(f"{{{XML}}}base", base), e.get(f"{{{XML}}}lang", lang)
        given = {self.name(k): v for k, v in e.attrib.items() if not k.startswith(f"{{{XML}}}")}
        if RDF + "about" in given:
            subject = self.iri(given.pop(RDF + "about"), base)
        elif RDF + "ID" in given:
            subject = self.iri("#" + given.pop(RDF + "ID"), base)
        elif RDF + "nodeID" in given:
            subject = A.Blank(given.pop(RDF + "nodeID"))
        else:
            subject = self.blank()
        if self.name(e.tag) != RDF + "Description":
            self.add(subject, RDF + "type", A.Iri(self.name(e.tag)))
        self.attributes(subject, given, lang)
        self.properties(subject, e, base, lang)
        return subject

    def attributes(self, subject, given: dict[str, str], lang: str | None) -> None:
        for name, value in given.items():
            self.add(subject, name, A.Iri(value) if name == RDF + "type" else text_literal(value, lang))

    def properties(self, subject, e: ElementTree.Element, base: str, lang: str | None) -> None:
        members = itertools.count(1)
        for child in e:
            try:
                self.property(subject, child, base, lang, members)
            except DataError as fault:
                log.warning("skipped a property: %s", fault)

    def property(self, subject, e: ElementTree.Element, base: str, lang: str | None, members: Iterator[int]) -> None:
        base, lang = e.get(f"{{{XML}}}base", base), e.get(f"{{{XML}}}lang", lang)
        predicate = self.name(e.tag)
        if predicate == RDF + "li":
            predicate = f"{RDF}_{next(members)}"
        if ":" not in predicate:
            raise DataError(f"{predicate!r} is no IRI")
        given = {self.name(k): v for k, v in e.attrib.items() if not k.startswith(f"{{{XML}}}")}
        kind, datatype = given.pop(RDF + "parseType", None), given.pop(RDF + "datatype", None)
        if kind == "Resource":
            node = self.blank()
            self.add(subject, predicate, node)
            self.properties(node, e, base, lang)
        elif kind == "Collection":
            cells = [(self.blank(), self.node(child, base, lang)) for child in e]
            for (cell, item), after in zip(cells, [c for c, _ in cells[1:]] + [A.Iri(RDF + "nil")]):
                self.add(cell, RDF + "first", item)
                self.add(cell, RDF + "rest", after)
            self.add(subject, predicate, cells[0][0] if cells else A.Iri(RDF + "nil"))
        elif kind is not None:
            inner = (e.text or "") + "".join(ElementTree.tostring(c, "unicode") for c in e)
            self.add(subject, predicate, A.Literal(inner, RDF + "XMLLiteral"))
        elif len(e):
            for child in e:
                self.add(subject, predicate, self.node(child, base, lang))
        elif RDF + "resource" in given or RDF + "nodeID" in given or given and datatype is None:
            if RDF + "resource" in given:
                value = self.iri(given.pop(RDF + "resource"), base)
            else:
                value = A.Blank(given.pop(RDF + "nodeID")) if RDF + "nodeID" in given else self.blank()
            self.add(subject, predicate, value)
            self.attributes(value, given, lang)
        else:
            self.add(subject, predicate, A.Literal(e.text or "", datatype) if datatype else text_literal(e.text or "", lang))


def text_literal(value: str, lang: str | None) -> A.Literal:
    return A.Literal(value, RDF + "langString", lang) if lang else A.Literal(value)


def parse_rdfxml(text: str, base: str = "") -> tuple[list[A.Triple], dict[str, str]]:
    """The triples of a document, and its prefixes; a text without any element raises DataError.

    Where the document stops being well-formed it ends: what was closed before counts, with the
    closed properties of an element that was not.  Elements are read and dropped one by one.
    """
    prefixes: dict[str, str] = {}
    reader, top, lang, many = Reader(base), base, None, False
    open_elements: list[ElementTree.Element] = []
    try:
        for event, item in ElementTree.iterparse(io.BytesIO(text.lstrip("\ufeff").encode()), events=("start-ns", "start", "end")):
            if event == "start-ns":
                if item[0]:
                    prefixes[item[0]] = item[1]
                continue
            if event == "start":
                open_elements.append(item)
                if len(open_elements) == 1 and reader.name(item.tag) == RDF + "RDF":
                    many, top, lang = True, item.get(f"{{{XML}}}base", base), item.get(f"{{{XML}}}lang")
                continue
            open_elements.pop()
            if len(open_elements) == many:
                reader.node(item, top, lang)
                if many:
                    open_elements[0].remove(item)
    except ElementTree.ParseError as fault:
        if not open_elements:
            if reader.out or prefixes:
                log.warning("stopped where a document is not well-formed: %s", fault)
                return reader.out, prefixes
            raise DataError(f"not well-formed XML: {fault}") from fault
        log.warning("stopped where a document is not well-formed: %s", fault)
        if len(open_elements) > many:
            begun = open_elements[many]
            if len(open_elements) > many + 1:
                begun.remove(open_elements[many + 1])
            reader.node(begun, top, lang)
    return reader.out, prefixes


_NAME = re.compile(r"^(.*?)([^\W\d][\w.\-]*)$", re.S)


def description(t: A.Triple) -> str:
    """One triple as a description element; DataError if it has no such form."""
    m = _NAME.match(t.p.value)
    if not m or not m[1]:
        raise DataError(f"the predicate {t.p.value!r} has no XML name")
    subject = f"rdf:about={quoteattr(t.s.value)}" if isinstance(t.s, A.Iri) else f"rdf:nodeID={quoteattr(t.s.label)}"
    tag = f"p:{m[2]}"
    begin = f"  <rdf:Description {subject}><{tag} xmlns:p={quoteattr(m[1])}"
    if isinstance(t.o, A.Iri):
        return f"{begin} rdf:resource={quoteattr(t.o.value)}/></rdf:Description>"
    if isinstance(t.o, A.Blank):
        return f"{begin} rdf:nodeID={quoteattr(t.o.label)}/></rdf:Description>"
    extra = f" xml:lang={quoteattr(t.o.lang)}" if t.o.lang else "" if t.o.datatype == A.XSD + "string" else f" rdf:datatype={quoteattr(t.o.datatype)}"
    return f"{begin}{extra}>{escape(t.o.value, {chr(13): '&#13;'})}</{tag}></rdf:Description>"


HEAD, FOOT = f'<?xml version="1.0" encoding="UTF-8"?>\n<rdf:RDF xmlns:rdf="{RDF}">', "</rdf:RDF>"


def document(triples: Iterable[A.Triple]) -> str:
    return "\n".join([HEAD, *map(description, triples), FOOT]) + "\n"
