"""Turtle (and N-Triples) documents to statements."""

from __future__ import annotations

import logging
from collections.abc import Callable

from ontoloom.errors import DataError
from ontoloom.sparql import algebra as A
from ontoloom.sparql.lexer import Token, is_open, token_at
from ontoloom.sparql.parser import Terms

log = logging.getLogger(__name__)


class TurtleParser(Terms):
    """Parses statement by statement; one that fails is logged and skipped up to its full stop.

    ``more``: gives the text that follows, some whole lines at a time and at least so many characters
    if there are as many, or "" at the end.  Held are the lines that it gave last and the statement
    that is parsed; what begins as a long string is read up to where it ends.
    """

    error = DataError
    lenient = True

    def __init__(self, text: str = "", base: str = "", more: Callable[[int], str] | None = None):
        super().__init__("", base=base)
        self.text, self.at, self.gone = text.lstrip("\ufeff"), 0, 0
        self.more, self.ended, self.tokens = more, more is None, []

    @property
    def now(self) -> Token:
        return self._token(self.i)

    @property
    def after(self) -> Token:
        return self._token(self.i + 1)

    def _token(self, i: int) -> Token:
        while i >= len(self.tokens):
            self._lex()
        return self.tokens[i]

    def _lex(self) -> None:
        if self.at == len(self.text) and not self._read():
            self.tokens.append(Token("end", "", self.gone + self.at))
            return
        found = token_at(self.text, self.at, self.error, self.lenient)
        while not self.ended and is_open(found, self.text):
            if self._read():
                found = token_at(self.text, self.at, self.error, self.lenient)
        self.at += len(found.text)
        if found.kind != "space":
            self.tokens.append(Token(found.kind, found.text, self.gone + found.at))

    def _read(self) -> bool:
        """Whether more text has come; what is behind is dropped."""
        if self.ended:
            return False
        self.text, self.gone, self.at = self.text[self.at :], self.gone + self.at, 0
        got = self.more(len(self.text))
        self.ended = not got
        self.text += got
        return bool(got)

    def between(self) -> bool:
        """Whether all that was read is parsed, so that a statement begins with the text that follows."""
        if self.i < len(self.tokens):
            return False
        while self.at < len(self.text):
            found = token_at(self.text, self.at, self.error, self.lenient)
            if found.kind != "space":
                return False
            self.at += len(found.text)
        return True

    def next_statement(self) -> list[A.Triple] | None:
        """The triples of a statement; none of one that is skipped or a declaration, None at the end."""
        del self.tokens[: self.i]
        self.i = 0
        if self.now.kind == "end":
            return None
        own: list[A.Triple] = []
        try:
            self.statement(own)
            return own
        except DataError as fault:
            log.warning("skipped a statement: %s", fault)
            while self.now.kind != "end" and not self.op("."):
                self.i += 1
                if self.i > 1000:
                    del self.tokens[: self.i]
                    self.i = 0
            return []

    def statements(self) -> list[A.Triple]:
        out: list[A.Triple] = []
        while (own := self.next_statement()) is not None:
            out += own
        return out

    def statement(self, out: list[A.Triple]) -> None:
        if self.now.kind == "tag" and self.now.text in ("@prefix", "@base"):
            if self.take().text == "@prefix":
                self.prefix_declaration()
            else:
                self.base = self.resolve(self.take().text[1:-1])
            self.need(".")
        elif self.word("PREFIX"):
            self.prefix_declaration()
        elif self.word("BASE"):
            self.base = self.resolve(self.take().text[1:-1])
        else:
            self.subject_triples(out)
            for t in out:
                if isinstance(t.s, (A.Literal, A.Triple, A.Var)) or isinstance(t.p, A.Var) or isinstance(t.o, A.Var):
                    raise DataError("a literal, quoted triple or variable is out of place")
            self.need(".")


def parse_turtle(text: str, base: str = "") -> tuple[list[A.Triple], dict[str, str]]:
    """The triples of a document, and its prefixes (prefix -> namespace)."""
    parser = TurtleParser(text, base=base)
    return parser.statements(), parser.prefixes
