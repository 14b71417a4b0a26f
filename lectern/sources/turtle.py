"""A reader of Turtle documents: prefixes, bases, predicate and object lists, literals, blank nodes, collections."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame

_RDF, _XSD = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2001/XMLSchema#"
_TOKEN = re.compile(
    r"""(?P<skip>\s+|\#[^\n]*)
    |(?P<iri><[^<>"{}|^`\x00-\x20]*>)
    |(?P<long>\"\"\"(?:\"{0,2}(?:[^"\\]|\\.))*\"\"\"|'''(?:'{0,2}(?:[^'\\]|\\.))*''')
    |(?P<string>"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
    |(?P<directive>@prefix\b|@base\b|(?i:PREFIX|BASE)(?=\s+[<\w:]))
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<number>[+-]?(?:\d+\.\d*[eE][+-]?\d+|\.?\d+[eE][+-]?\d+|\d*\.\d+|\d+))
    |(?P<blank>_:[\w](?:[\w.·-]*[\w·-])?)
    |(?P<name>(?:[^\W\d_][\w.·-]*)?:(?:(?:[\w:]|%[0-9A-Fa-f]{2}|\\[_~.!$&'()*+,;=/?#@%-])(?:(?:[\w:.·-]|%[0-9A-Fa-f]{2}|\\[_~.!$&'()*+,;=/?#@%-])*(?:[\w:·-]|%[0-9A-Fa-f]{2}|\\[_~.!$&'()*+,;=/?#@%-]))?)?)
    |(?P<word>a\b|true\b|false\b)
    |(?P<mark>\^\^|[.;,\[\]()])""",
    re.X | re.S,
)
_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.S)
_PLAIN = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def unescaped(text: str) -> str:
    """Escapes of a literal or IRI undone in one pass; an unknown one is an error."""

    def one(m: re.Match) -> str:
        if m[3]:
            if m[3] not in _PLAIN:
                raise ValueError(f"unknown escape \\{m[3]}")
            return _PLAIN[m[3]]
        return chr(int(m[1] or m[2], 16))

    return _ESCAPE.sub(one, text)


class _Parser:
    def __init__(self, doc: str, text: str) -> None:
        self.doc, self.prefixes, self.base = doc, {}, ""
        self.tokens = self._tokens(text)
        self.rows: list[tuple] = []
        self.made = 0
        self.kind, self.value, self.at = next(self.tokens)

    def _tokens(self, text: str) -> Iterator[tuple[str, str, int]]:
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise self._error(f"unreadable at {text[at : at + 30]!r}", text.count("\n", 0, at) + 1)
            if m.lastgroup != "skip":
                yield m.lastgroup, m[0], text.count("\n", 0, at) + 1
            at = m.end()
        yield "end", "", -1

    def _error(self, what: str, line: int | None = None) -> ValueError:
        return ValueError(f"{self.doc}, line {self.at if line is None else line}: {what}")

    def _next(self) -> tuple[str, str]:
        now = self.kind, self.value
        if self.kind != "end":
            self.kind, self.value, self.at = next(self.tokens)
        return now

    def _expect(self, mark: str) -> None:
        if (self.kind, self.value) != ("mark", mark):
            raise self._error(f"{mark} expected, not {self.value!r}")
        self._next()

    def _blank(self) -> tuple:
        self.made += 1
        return f"_:{self.doc}.{self.made}", "bnode", None, None

    def _iri(self) -> str:
        kind, value = self._next()
        if kind == "iri":
            iri = unescaped(value[1:-1])
            return urljoin(self.base, iri) if self.base else iri
        if kind == "name":
            prefix, _, local = value.partition(":")
            if prefix not in self.prefixes:
                raise self._error(f"unknown prefix {prefix}:")
            return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)
        raise self._error(f"an IRI expected, not {value!r}")

    def parse(self) -> list[tuple]:
        while self.kind != "end":
            if self.kind == "directive":
                self._directive()
                continue
            lone = self.kind == "mark" and self.value == "["
            subject = self._node()
            if not (lone and (self.kind, self.value) == ("mark", ".")):
                self._predicates(subject)
            self._expect(".")
        return self.rows

    def _directive(self) -> None:
        word = self._next()[1]
        if word.lower().endswith("prefix"):
            kind, name = self._next()
            if kind != "name" or not name.endswith(":"):
                raise self._error(f"a prefix expected, not {name!r}")
            self.prefixes[name[:-1]] = self._iri()
        else:
            self.base = self._iri()
        if word.startswith("@"):
            self._expect(".")

    def _predicates(self, subject: tuple) -> None:
        while True:
            if (self.kind, self.value) == ("word", "a"):
                self._next()
                predicate = _RDF + "type"
            else:
                predicate = self._iri()
            while True:
                self.rows.append((*subject[:2], predicate, *self._node()))
                if (self.kind, self.value) != ("mark", ","):
                    break
                self._next()
            while (self.kind, self.value) == ("mark", ";"):
                self._next()
            if self.kind == "mark":
                return

    def _node(self) -> tuple:
        """(value, kind, lang, datatype) of a term."""
        kind, value = self.kind, self.value
        if kind in ("iri", "name"):
            return self._iri(), "iri", None, None
        self._next()
        if kind == "blank":
            return f"_:{self.doc}.{value[2:]}", "bnode", None, None
        if kind in ("string", "long"):
            quotes = 3 if kind == "long" else 1
            return self._literal(unescaped(value[quotes:-quotes]))
        if kind == "number":
            form = "double" if "e" in value.lower() else "decimal" if "." in value else "integer"
            return value, "literal", None, _XSD + form
        if kind == "word" and value != "a":
            return value, "literal", None, _XSD + "boolean"
        if (kind, value) == ("mark", "["):
            node = self._blank()
            if (self.kind, self.value) != ("mark", "]"):
                self._predicates(node)
            self._expect("]")
            return node
        if (kind, value) == ("mark", "("):
            items = []
            while (self.kind, self.value) != ("mark", ")"):
                items.append(self._node())
            self._next()
            rest: tuple = (_RDF + "nil", "iri", None, None)
            for item in reversed(items):
                node = self._blank()
                self.rows += [(*node[:2], _RDF + "first", *item), (*node[:2], _RDF + "rest", *rest)]
                rest = node
            return rest
        raise self._error(f"a term expected, not {value!r}")

    def _literal(self, text: str) -> tuple:
        if self.kind == "lang":
            return text, "literal", self._next()[1][1:], None
        if (self.kind, self.value) == ("mark", "^^"):
            self._next()
            return text, "literal", None, self._iri()
        return text, "literal", None, None


def read_turtle(documents: DataFrame) -> DataFrame:
    """(s, s_kind, p, o, o_kind, lang, datatype) of documents(doc, text), as a set.

    Blank nodes carry the document's name, so documents do not share them.  A
    document that cannot be read is an error with its line.  Documents are read
    in parallel, each as a whole; a graph of one very large document is better
    kept as lines of N-Triples.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc, text in zip(batch["doc"], batch["text"], strict=True):
                yield pd.DataFrame(_Parser(doc, text or "").parse(), columns=["s", "s_kind", "p", "o", "o_kind", "lang", "datatype"], dtype=object)

    schema = "s string, s_kind string, p string, o string, o_kind string, lang string, datatype string"
    return documents.select("doc", "text").mapInPandas(run, schema).distinct()
