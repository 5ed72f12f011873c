"""Terms, expressions and graph patterns of a parsed query."""

from __future__ import annotations

from dataclasses import dataclass, field

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XSD = "http://www.w3.org/2001/XMLSchema#"


@dataclass(frozen=True)
class Iri:
    value: str

    def __str__(self) -> str:
        return self.value


@dataclass(frozen=True)
class Literal:
    value: str
    datatype: str = XSD + "string"
    lang: str | None = None

    def __str__(self) -> str:
        return self.value


@dataclass(frozen=True)
class Blank:
    """A blank node: in a pattern, a variable of its own name space that is never projected."""

    label: str

    def __str__(self) -> str:
        return self.label


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Triple:
    """A triple of terms, or a pattern with variables; also a quoted triple in object position."""

    s: object
    p: object
    o: object


@dataclass(frozen=True)
class Call:
    """An operator or function of an expression; the name is upper case."""

    name: str
    args: tuple


@dataclass(frozen=True)
class Path:
    """A property path: 'seq' and 'alt' of parts, 'inv', 'opt', 'plus' and 'star' of one, 'not' of IRIs and inverses of IRIs."""

    kind: str
    parts: tuple


@dataclass
class Bgp:
    patterns: list[Triple]


@dataclass
class Closure:
    """Distinct pairs of terms linked by one or more steps of ``step``, a pattern from ``a`` to ``b``.

    ``zero``: a term is linked to itself too; ``once``: at most one step is taken.
    """

    s: object
    o: object
    step: object
    a: Var
    b: Var
    zero: bool
    once: bool = False


@dataclass
class Filter:
    expr: object
    inner: object


@dataclass
class Join:
    left: object
    right: object


@dataclass
class LeftJoin:
    left: object
    right: object
    expr: object = None


@dataclass
class Union:
    left: object
    right: object


@dataclass
class Minus:
    left: object
    right: object


@dataclass
class Extend:
    inner: object
    var: str
    expr: object


@dataclass
class Values:
    vars: list[str]
    rows: list[list]


@dataclass
class Group:
    inner: object
    keys: list[str]
    aggregates: list[tuple[str, Aggregate]]


@dataclass(frozen=True)
class Aggregate:
    name: str
    arg: object
    distinct: bool = False
    separator: str = " "


@dataclass
class OrderBy:
    inner: object
    keys: list[tuple[object, bool]]


@dataclass
class Project:
    inner: object
    vars: list[str]


@dataclass
class Distinct:
    inner: object


@dataclass
class Slice:
    inner: object
    offset: int = 0
    limit: int | None = None


@dataclass
class Query:
    form: str  # select, construct, ask or describe
    pattern: object
    vars: list[str] = field(default_factory=list)
    template: list[Triple] = field(default_factory=list)
    described: list = field(default_factory=list)


def key(term) -> str:
    """Column stem of a variable or blank node of a pattern."""
    return f"v_{term.name}" if isinstance(term, Var) else f"b_{term.label}"


def is_open(term) -> bool:
    return isinstance(term, (Var, Blank))


def expr_vars(expr) -> set[str]:
    """Names of the variables that an expression reads."""
    if isinstance(expr, Var):
        return {expr.name}
    if isinstance(expr, Call):
        return set().union(*map(expr_vars, expr.args)) if expr.args else set()
    if isinstance(expr, Aggregate):
        return expr_vars(expr.arg)
    return set()
