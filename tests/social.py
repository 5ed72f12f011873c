"""The small social graph that the query tests share: 20 triples."""

EX = "http://example.org/"
PEOPLE = {"alice": ("Alice", 30, "9.5"), "bob": ("Bob", 25, "7.0"), "carol": ("Carol", 25, "8.0"), "dave": ("Dave", None, None)}
KNOWS = [("alice", "bob"), ("alice", "carol"), ("bob", "carol"), ("bob", "dave"), ("carol", "dave")]
WORKS = [("alice", "orgA"), ("bob", "orgA"), ("carol", "orgB")]


def turtle() -> str:
    lines = ["@prefix ex: <http://example.org/> .", "@prefix xsd: <http://www.w3.org/2001/XMLSchema#> .", "# people"]
    for who, (name, age, score) in PEOPLE.items():
        more = f' ; ex:age "{age}"^^xsd:integer ; ex:score "{score}"^^xsd:decimal' if age else ""
        lines.append(f'ex:{who} ex:name "{name}"{more} .')
    lines += [f"ex:{a} ex:knows ex:{b} ." for a, b in KNOWS] + [f"ex:{a} ex:worksAt ex:{b} ." for a, b in WORKS]
    return "\n".join([*lines, "ex:orgA ex:partOf ex:consortium . ex:orgB ex:partOf ex:consortium ."])


def rdfxml() -> str:
    out = ['<?xml version="1.0"?><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:ex="http://example.org/">']
    xsd = "http://www.w3.org/2001/XMLSchema#"
    for who, (name, age, score) in PEOPLE.items():
        more = f'<ex:age rdf:datatype="{xsd}integer">{age}</ex:age><ex:score rdf:datatype="{xsd}decimal">{score}</ex:score>' if age else ""
        out.append(f'<rdf:Description rdf:about="{EX}{who}"><ex:name>{name}</ex:name>{more}</rdf:Description>')
    for p, pairs in (("knows", KNOWS), ("worksAt", WORKS), ("partOf", [("orgA", "consortium"), ("orgB", "consortium")])):
        out += [f'<rdf:Description rdf:about="{EX}{a}"><ex:{p} rdf:resource="{EX}{b}"/></rdf:Description>' for a, b in pairs]
    return "".join([*out, "</rdf:RDF>"])
