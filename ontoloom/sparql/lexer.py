"""Tokens of SPARQL and Turtle, which share their terms."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ontoloom.errors import SparqlError

_PN = r"[^\W\d_](?:[\w.·-]*[\w·-])?"
_LOCAL = r"(?:[\w:]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?#@%])(?:(?:[\w.:·-]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?#@%])*(?:[\w:·-]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?#@%]))?"
_RULES = [
    ("space", r"(?:\s|#[^\n]*)+"),
    ("iri", r"<(?:[^\x00-\x20<>\"{}|^`\\]|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})*>"),
    ("string", r'"""(?:"{0,2}(?:[^"\\]|\\.))*"""|' + r"'''(?:'{0,2}(?:[^'\\]|\\.))*'''" + r'|"(?:[^"\\\n\r]|\\.)*"|' + r"'(?:[^'\\\n\r]|\\.)*'"),
    ("quote", r"<<\(?|\)?>>"),
    ("var", r"[?$]\w+"),
    ("blank", r"_:[\w](?:[\w.·-]*[\w·-])?"),
    ("tag", r"@[A-Za-z]+(?:-[A-Za-z0-9]+)*"),
    ("double", r"(?:\d+\.\d*|\.\d+|\d+)[eE][+-]?\d+"),
    ("decimal", r"\d*\.\d+"),
    ("integer", r"\d+"),
    ("curie", rf"(?:{_PN})?:(?:{_LOCAL})?"),
    ("word", r"[A-Za-z_]\w*"),
    ("op", r"\^\^|&&|\|\||!=|<=|>=|[{}()\[\].;,=<>!+\-*/^|?]"),
]
#: A string of one line whose last line end is escaped.
_UNCLOSED = re.compile(r'"(?:[^"\\\n\r]|\\.)*\Z|' + r"'(?:[^'\\\n\r]|\\.)*\Z", re.S)
_MASTER = re.compile("|".join(f"(?P<{name}>{rule})" for name, rule in _RULES), re.S)
#: The short escapes of strings.
_ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}
_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.S)


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    at: int


def tokens(text: str, error: type[Exception] = SparqlError, lenient: bool = False) -> list[Token]:
    """All tokens, blanks and comments left out, with an ``end`` token last.

    If ``lenient``, a character that begins no token becomes one of kind ``bad``.
    """
    out, at = [], 0
    while at < len(text):
        found = token_at(text, at, error, lenient)
        if found.kind != "space":
            out.append(found)
        at += len(found.text)
    return [*out, Token("end", "", at)]


def token_at(text: str, at: int, error: type[Exception] = SparqlError, lenient: bool = False) -> Token:
    """The token that begins at a character, which may be one of kind ``space``."""
    m = _MASTER.match(text, at)
    if m:
        return Token(m.lastgroup, m[0], at)
    if lenient:
        return Token("bad", text[at], at)
    raise error(f"unexpected character {text[at]!r} at {at}")


def is_open(found: Token, text: str) -> bool:
    """Whether a token could be another if the text, which ends with a line, went on."""
    quotes = text[found.at : found.at + 3]
    if quotes in ('"""', "'''"):
        return len(found.text) < 6
    return quotes[:1] in ('"', "'") and found.kind != "string" and bool(_UNCLOSED.match(text, found.at))


def unescape(text: str, error: type[Exception] = SparqlError) -> str:
    def one(m: re.Match) -> str:
        if m[3] is None:
            return chr(int(m[1] or m[2], 16))
        if m[3] not in _ESCAPES:
            raise error(f"unknown escape \\{m[3]}")
        return _ESCAPES[m[3]]

    return _ESCAPE.sub(one, text)


def string_value(token: str, error: type[Exception] = SparqlError) -> str:
    width = 3 if token[:3] in ('"""', "'''") else 1
    return unescape(token[width:-width], error)


def local_name(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text)
