"""A reader of the Turtle that ontologies are written in, and a writer.

Prefixes, base, lists by ; and , , long strings, language tags, datatypes, comments,
numbers, booleans, blank nodes and collections are understood.
"""

from __future__ import annotations

import re

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
SKOS = "http://www.w3.org/2004/02/skos/core#"
XSD = "http://www.w3.org/2001/XMLSchema#"

_TOKEN = re.compile(
    r'''(?P<skip>\s+|\#[^\n]*)|(?P<iri><[^<>"{}|^`\\\s]*>)|(?P<long>"""(?:[^"\\]|\\.|"(?!""))*"""|\'\'\'(?:[^\'\\]|\\.|\'(?!\'\'))*\'\'\')'''
    r'''|(?P<str>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<dt>\^\^)|(?P<num>[+-]?(?:\d+\.\d+|\.\d+|\d+)(?:[eE][+-]?\d+)?)'''
    r'''|(?P<blank>_:[\w.-]*\w)|(?P<name>(?:[A-Za-z_\u0080-\uFFFF][\w.-]*)?:(?:[\w%][\w.%:-]*[\w%-]|[\w%])?|[A-Za-z]+)|(?P<mark>[.;,\[\]()])''',
    re.S,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


def _plain(text: str) -> str:
    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else _ESCAPES.get(m[1], m[1]), text, flags=re.S)


class TurtleError(ValueError):
    """The text is no Turtle that this reader understands."""


def parse(text: str) -> list[tuple[str, str, str, str, str | None]]:
    """Distinct (s, p, o, kind, lang); kind: iri, literal or blank."""
    tokens, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if m is None:
            raise TurtleError(f"unexpected {text[at : at + 20]!r} at {at}")
        if m.lastgroup != "skip":
            tokens.append((m.lastgroup, m[0]))
        at = m.end()
    prefixes, base, out, blanks = {}, "", {}, 0
    i = 0

    def peek():
        return tokens[i] if i < len(tokens) else ("end", "")

    def take():
        nonlocal i
        i += 1
        if i > len(tokens):
            raise TurtleError("the text ends within a statement")
        return tokens[i - 1]

    def iri(kind: str, x: str) -> str:
        if kind == "iri":
            return x[1:-1] if ":" in x else base + x[1:-1]
        head, sep, tail = x.partition(":")
        if not sep or head not in prefixes:
            raise TurtleError(f"unknown name {x!r}")
        return prefixes[head] + tail

    def term(verb: bool = False):
        nonlocal blanks
        kind, x = take()
        if verb and x == "a":
            return RDF + "type", "iri", None
        if kind == "name" and x in ("true", "false"):
            return x, "literal", None
        if kind in ("iri", "name"):
            return iri(kind, x), "iri", None
        if kind == "num":
            return x, "literal", None
        if kind == "blank":
            return x, "blank", None
        if kind in ("str", "long"):
            value, lang = _plain(x[3:-3] if kind == "long" else x[1:-1]), None
            if peek()[0] == "lang":
                lang = take()[1][1:]
            elif peek()[0] == "dt":
                take()
                take()
            return value, "literal", lang
        if x == "[":
            blanks += 1
            node = f"_:b{blanks}"
            if peek()[1] != "]":
                properties(node)
            if take()[1] != "]":
                raise TurtleError("a blank node isn't closed")
            return node, "blank", None
        if x == "(":
            return collection()
        raise TurtleError(f"unexpected {x!r}")

    def collection():
        """The first node of a list of terms, or nil."""
        nonlocal blanks
        items = []
        while peek()[1] != ")" or peek()[0] != "mark":
            items.append(term())
        take()
        nodes = [f"_:b{blanks + n}" for n in range(1, len(items) + 1)]
        blanks += len(items)
        for node, item, rest in zip(nodes, items, [*nodes[1:], None]):
            out[node, RDF + "first", *item] = None
            out[(node, RDF + "rest", *((rest, "blank") if rest else (RDF + "nil", "iri")), None)] = None
        return (nodes[0], "blank", None) if nodes else (RDF + "nil", "iri", None)

    def properties(subject: str) -> None:
        while True:
            p, _, _ = term(verb=True)
            while True:
                o, kind, lang = term()
                out[subject, p, o, kind, lang] = None
                if peek()[1] != ",":
                    break
                take()
            while peek()[1] == ";":
                take()
                if peek()[1] != ";":
                    break
            else:
                return
            if peek()[1] in (".", "]"):
                return

    while i < len(tokens):
        kind, x = peek()
        if x.lower() in ("@prefix", "prefix"):
            take()
            name, value = take()[1], take()
            prefixes[name.rstrip(":")] = iri(*value)
            if x[0] == "@" and take()[1] != ".":
                raise TurtleError("@prefix isn't ended")
        elif x.lower() in ("@base", "base"):
            take()
            base = iri(*take())
            if x[0] == "@" and take()[1] != ".":
                raise TurtleError("@base isn't ended")
        else:
            subject, _, _ = term()
            if peek()[1] != ".":
                properties(subject)
            if take()[1] != ".":
                raise TurtleError(f"a statement about {subject} isn't ended")
    return list(out)


def _quote(text: str) -> str:
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t") + '"'


def write(classes: list[dict], predicates: list[dict]) -> str:
    """Turtle of classes (uri, label, description) and predicates (uri, label, description, property_type, domain, range: URIs); what has no URI is left out."""
    lines = [f"@prefix owl: <{OWL}> .", f"@prefix rdfs: <{RDFS}> .", f"@prefix xsd: <{XSD}> .", ""]

    def ref(uri: str) -> str:
        return uri if uri.startswith("xsd:") else f"<{uri}>"

    for kind, rows in (("class", classes), ("predicate", predicates)):
        for r in sorted((r for r in rows if r.get("uri")), key=lambda r: r["uri"]):
            ranges = [x for x in r.get("range") or [] if x]
            simple = [x for x in ranges if x.startswith("xsd:") or x.startswith(XSD)]
            datatype = str(r.get("property_type") or "").endswith("DatatypeProperty") or (ranges and len(simple) == len(ranges))
            say = [f"a owl:{'Class' if kind == 'class' else 'DatatypeProperty' if datatype else 'ObjectProperty'}", f"rdfs:label {_quote(r.get('label') or '')}"]
            if r.get("description"):
                say.append(f"rdfs:comment {_quote(r['description'])}")
            say += [f"rdfs:domain {ref(x)}" for x in r.get("domain") or [] if x] + [f"rdfs:range {ref(x)}" for x in ranges]
            lines.append(f"<{r['uri']}> " + " ;\n    ".join(say) + " .")
    return "\n".join(lines) + "\n"
