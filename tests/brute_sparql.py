"""A plain evaluator of the algebra over a list of triples, to compare with.

Solutions are dicts; EXISTS evaluates its pattern anew for each solution, with its variables in place.
"""

from collections import deque

from ontoloom.sparql import algebra as A


def compatible(a, b):
    return all(a[k] == b[k] for k in a.keys() & b.keys())


def evaluate(node, triples, given):
    """The solutions of a pattern; ``given`` holds the values of an outer solution."""
    again = lambda n: evaluate(n, triples, given)
    if isinstance(node, A.Bgp):
        out = [{}]
        for p in node.patterns:
            out = [m for s in out for t in triples if (m := match(p, t, s, given)) is not None]
        return out
    if isinstance(node, A.Join):
        return [{**a, **b} for a in again(node.left) for b in again(node.right) if compatible(a, b)]
    if isinstance(node, A.LeftJoin):
        out, right = [], again(node.right)
        for a in again(node.left):
            found = [{**a, **b} for b in right if compatible(a, b) and (node.expr is None or truth(node.expr, {**given, **a, **b}, triples))]
            out += found or [a]
        return out
    if isinstance(node, A.Union):
        return again(node.left) + again(node.right)
    if isinstance(node, A.Minus):
        right = again(node.right)
        return [a for a in again(node.left) if not any(a.keys() & b.keys() and compatible(a, b) for b in right)]
    if isinstance(node, A.Filter):
        return [s for s in again(node.inner) if truth(node.expr, {**given, **s}, triples)]
    if isinstance(node, A.Extend):
        out = []
        for s in again(node.inner):
            v = s.get(A.key(node.expr)) if isinstance(node.expr, A.Var) else value(node.expr, {**given, **s}, triples)
            out.append(s if v is None else {**s, A.key(A.Var(node.var)): v if not isinstance(v, bool) else A.Literal(str(v).lower(), A.XSD + "boolean")})
        return out
    if isinstance(node, A.Values):
        return [{A.key(A.Var(v)): t for v, t in zip(node.vars, row) if t is not None} for row in node.rows]
    if isinstance(node, A.Closure):
        return walked(node, triples, given)
    if isinstance(node, A.Project):
        keep = {A.key(A.Var(v)) for v in node.vars}
        return [{k: v for k, v in s.items() if k in keep} for s in evaluate(node.inner, triples, {})]
    if isinstance(node, A.Distinct):
        return list({tuple(sorted(s.items(), key=str)): s for s in again(node.inner)}.values())
    raise NotImplementedError(node)


def match(pattern, triple, s, given):
    s = dict(s)
    for slot, term in zip((pattern.s, pattern.p, pattern.o), (triple.s, triple.p, triple.o)):
        if A.is_open(slot):
            key = A.key(slot)
            if given.get(key, term) != term or s.get(key, term) != term:
                return None
            s[key] = term
        elif slot != term:
            return None
    return s


def walked(node, triples, given):
    steps = {(s[A.key(node.a)], s[A.key(node.b)]) for s in evaluate(node.step, triples, {})}
    nodes = {x for t in triples for x in (t.s, t.o)} | {x for x in (node.s, node.o) if not A.is_open(x)}
    pairs = set(steps) if node.once else set()
    if not node.once:
        for start in {a for a, _ in steps}:
            seen, todo = set(), deque([start])
            while todo:
                at = todo.popleft()
                for a, b in steps:
                    if a == at and b not in seen:
                        seen.add(b)
                        todo.append(b)
            pairs |= {(start, b) for b in seen}
    if node.zero:
        pairs |= {(x, x) for x in nodes}
    out = []
    for a, b in pairs:
        m = match(A.Triple(node.s, None, node.o), A.Triple(a, None, b), {}, given)
        if m is not None:
            out.append(m)
    return [dict(x) for x in {tuple(sorted(m.items())) for m in out}] if out and out[0] else out[:1]


def value(expr, s, triples):
    """A term, number, text or boolean; None for an error."""
    if isinstance(expr, A.Var):
        expr = s.get(A.key(expr))
    if isinstance(expr, A.Literal):
        return float(expr.value) if expr.datatype == A.XSD + "integer" else expr.value == "true" if expr.datatype == A.XSD + "boolean" else expr.value
    if not isinstance(expr, A.Call):
        return expr
    if expr.name == "EXISTS":
        return bool(evaluate(expr.args[0], triples, s))
    if expr.name == "BOUND":
        return A.key(expr.args[0]) in s
    v = [value(a, s, triples) for a in expr.args]
    if expr.name in ("&&", "||"):
        return (v[0] is True and v[1] is True) if expr.name == "&&" else (v[0] is True or v[1] is True)
    if expr.name == "!":
        return v[0] is not True
    if expr.name == "IN":
        return v[0] is not None and v[0] in v[1:]
    if None in v or expr.name != "=" and type(v[0]) is not type(v[1]):
        return None
    if expr.name == "=":
        return v[0] == v[1]
    return {"<": lambda a, b: a < b, ">": lambda a, b: a > b, "+": lambda a, b: a + b}[expr.name](*v)


def truth(expr, s, triples):
    return value(expr, s, triples) is True
