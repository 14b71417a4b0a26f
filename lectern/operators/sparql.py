"""Graph queries as text: select, ask, construct and describe over triples, planned as joins.

A solution has a column per variable, a struct<v, k, l, t> of value, kind, language
and datatype, so equal terms join as they are.  Patterns, optional, minus, exists,
union, values, bind, sub-selects, property paths, filters, grouping, order and
slices become DataFrame operations; the planner orders and executes them.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.sources.turtle import unescaped

from .graph import checked_query, closure, construct

_RDF, _XSD = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2001/XMLSchema#"
_TOKEN = re.compile(
    r"""(?P<skip>\s+|\#[^\n]*)|(?P<iri><[^<>"{}|^`\\\x00-\x20]*>)|(?P<var>[?$]\w+)
    |(?P<long>\"\"\"(?:\"{0,2}(?:[^"\\]|\\.))*\"\"\"|'''(?:'{0,2}(?:[^'\\]|\\.))*''')|(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<number>\d+\.\d+(?:[eE][+-]?\d+)?|\d+(?:[eE][+-]?\d+)?|\.\d+)
    |(?P<blank>_:\w+)|(?P<name>(?:[^\W\d_][\w-]*)?:(?:[\w%:](?:[\w.%:-]*[\w%:-])?)?)|(?P<word>[A-Za-z_]\w*)
    |(?P<mark>\^\^|&&|\|\||!=|<=|>=|[{}()\[\].;,*/|+?^=<>!-])""",
    re.X | re.S,
)
TERM = "struct<v:string,k:string,l:string,t:string>"


def term(value: Column, kind: Column | str, lang: Column | None = None, datatype: Column | str | None = None) -> Column:
    none = F.lit(None).cast("string")
    lit = lambda x: none if x is None else F.lit(x) if isinstance(x, str) else x
    return F.struct(value.cast("string").alias("v"), lit(kind).alias("k"), lit(lang).alias("l"), lit(datatype).alias("t"))


@dataclass(frozen=True)
class Const:
    value: str
    kind: str = "iri"
    lang: str | None = None
    datatype: str | None = None

    def column(self) -> Column:
        return term(F.lit(self.value), self.kind, self.lang if self.lang is None else F.lit(self.lang), self.datatype)


@dataclass
class Select:
    names: list  # of (name, expression or None); None: all
    where: list
    distinct: bool = False
    group: list = field(default_factory=list)
    having: list = field(default_factory=list)
    order: list = field(default_factory=list)
    limit: int | None = None
    offset: int = 0


class _Reader:
    """The syntax of a query as nested tuples."""

    def __init__(self, text: str) -> None:
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"unreadable query at {text[at : at + 30]!r}")
            if m.lastgroup != "skip":
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.i, self.prefixes, self.base, self.fresh = 0, {}, "", itertools.count()

    @property
    def kind(self) -> str:
        return self.tokens[self.i][0] if self.i < len(self.tokens) else "end"

    @property
    def value(self) -> str:
        return self.tokens[self.i][1] if self.i < len(self.tokens) else ""

    def next(self) -> str:
        self.i += 1
        return self.tokens[self.i - 1][1]

    def is_(self, *words: str) -> bool:
        return self.kind in ("word", "mark") and self.value.lower() in words

    def take(self, *words: str) -> bool:
        if self.is_(*words):
            self.i += 1
            return True
        return False

    def expect(self, word: str) -> None:
        if not self.take(word):
            raise ValueError(f"{word} expected, not {self.value!r}")

    def variable(self) -> str:
        if self.kind != "var":
            raise ValueError(f"a variable expected, not {self.value!r}")
        return self.next()[1:]

    def hidden(self) -> str:
        return f"_{next(self.fresh)}"

    # -- terms

    def iri(self) -> Const:
        kind, value = self.kind, self.value
        if kind == "iri":
            self.i += 1
            return Const(value[1:-1] if ":" in value else self.base + value[1:-1])
        if kind == "name":
            self.i += 1
            prefix, _, local = value.partition(":")
            if prefix not in self.prefixes:
                raise ValueError(f"unknown prefix {prefix}:")
            return Const(self.prefixes[prefix] + local)
        raise ValueError(f"an IRI expected, not {value!r}")

    def literal(self) -> Const | None:
        kind, value = self.kind, self.value
        if kind in ("string", "long"):
            self.i += 1
            text = unescaped(value[3:-3] if kind == "long" else value[1:-1])
            if self.kind == "lang":
                return Const(text, "literal", self.next()[1:])
            if self.take("^^"):
                return Const(text, "literal", None, self.iri().value)
            return Const(text, "literal")
        if kind == "number":
            self.i += 1
            return Const(value, "literal", None, _XSD + ("double" if "e" in value.lower() else "decimal" if "." in value else "integer"))
        if self.is_("true", "false"):
            return Const(self.next().lower(), "literal", None, _XSD + "boolean")
        return None

    def node(self, out: list):
        """A term of a pattern: a variable's name or a constant."""
        if self.kind == "var":
            return self.variable()
        if self.kind == "blank":
            return "_b" + self.next()[2:]
        if self.take("["):
            name = self.hidden()
            if not self.is_("]"):
                self.predicates(name, out)
            self.expect("]")
            return name
        return self.literal() or self.iri()

    # -- patterns

    def group(self) -> list:
        self.expect("{")
        out: list = []
        if self.is_("select"):
            out.append(("select", self.select()))
        while not self.is_("}"):
            if self.kind == "end":
                raise ValueError("} expected")
            if self.take("optional"):
                out.append(("optional", self.group()))
            elif self.take("minus"):
                out.append(("minus", self.group()))
            elif self.take("filter"):
                if self.take("not"):
                    self.expect("exists")
                    out.append(("not exists", self.group()))
                elif self.take("exists"):
                    out.append(("exists", self.group()))
                else:
                    out.append(("filter", self.primary()))
            elif self.take("bind"):
                self.expect("(")
                e = self.expression()
                self.expect("as")
                out.append(("bind", self.variable(), e))
                self.expect(")")
            elif self.take("values"):
                out.append(self.values())
            elif self.is_("{"):
                parts = [self.group()]
                while self.take("union"):
                    parts.append(self.group())
                out.append(("union", parts))
            else:
                self.triples(out)
            self.take(".")
        self.expect("}")
        return out

    def values(self) -> tuple:
        several = self.take("(")
        names = []
        while self.kind == "var":
            names.append(self.variable())
        if several:
            self.expect(")")
        self.expect("{")
        rows = []
        while not self.take("}"):
            if several:
                self.expect("(")
            row = [None if self.take("undef") else self.literal() or self.iri() for _ in names]
            if several:
                self.expect(")")
            rows.append(row)
        return "values", names, rows

    def triples(self, out: list) -> None:
        lone = self.is_("[")
        s = self.node(out)
        if not (lone and self.is_(".", "}")):
            self.predicates(s, out)

    def predicates(self, s, out: list) -> None:
        while True:
            path = self.variable() if self.kind == "var" else self.path()
            while True:
                out.append(("triple", s, path, self.node(out)))
                if not self.take(","):
                    break
            more = False
            while self.take(";"):
                more = True
            if not more or self.is_(".", "}", "]"):
                return

    def path(self):
        parts = [self.sequence()]
        while self.take("|"):
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else ("|", parts)

    def sequence(self):
        parts = [self.step()]
        while self.take("/"):
            parts.append(self.step())
        return parts[0] if len(parts) == 1 else ("/", parts)

    def step(self):
        if self.take("^"):
            return ("^", self.step())
        if self.take("("):
            p = self.path()
            self.expect(")")
        elif self.kind == "word" and self.value == "a":
            self.next()
            p = Const(_RDF + "type")
        else:
            p = self.iri()
        for mark in "+*?":
            if self.take(mark):
                return (mark, p)
        return p

    # -- expressions

    def expression(self):
        left = self.conjunction()
        while self.take("||"):
            left = ("||", left, self.conjunction())
        return left

    def conjunction(self):
        left = self.relation()
        while self.take("&&"):
            left = ("&&", left, self.relation())
        return left

    def relation(self):
        left = self.sum()
        for op in ("!=", "<=", ">=", "=", "<", ">"):
            if self.take(op):
                return (op, left, self.sum())
        negated = self.is_("not")
        if negated:
            self.next()
        if self.take("in"):
            return ("not in" if negated else "in", left, self.arguments())
        return left

    def sum(self):
        left = self.product()
        while self.is_("+", "-"):
            left = (self.next(), left, self.product())
        return left

    def product(self):
        left = self.primary()
        while self.is_("*", "/"):
            left = (self.next(), left, self.primary())
        return left

    def arguments(self) -> list:
        self.expect("(")
        out = []
        while not self.take(")"):
            out.append(self.expression())
            self.take(",")
        return out

    def primary(self):
        if self.take("("):
            e = self.expression()
            self.expect(")")
            return e
        if self.take("!"):
            return ("!", self.primary())
        if self.take("-"):
            return ("-", Const("0", "literal", None, _XSD + "integer"), self.primary())
        if self.kind == "var":
            return ("var", self.variable())
        found = self.literal()
        if found is not None:
            return ("const", found)
        if self.kind == "word":
            name = self.next().lower()
            if name in ("exists", "not"):
                if name == "not":
                    self.expect("exists")
                raise ValueError("exists stands in a filter of its own")
            if name in _AGGREGATES:
                self.expect("(")
                distinct = self.take("distinct")
                inner = None if self.take("*") else self.expression()
                mark = " "
                if self.take(";"):
                    self.expect("separator")
                    self.expect("=")
                    mark = unescaped(self.next()[1:-1])
                self.expect(")")
                return ("aggregate", name, distinct, inner, mark)
            return ("call", name, self.arguments())
        return ("const", self.iri())

    # -- queries

    def query(self):
        while self.is_("prefix", "base"):
            if self.next().lower() == "base":
                self.base = self.next()[1:-1]
            else:
                name = self.next()
                self.prefixes[name[:-1]] = self.next()[1:-1]
        if self.is_("select"):
            out = ("select", self.select())
        elif self.take("ask"):
            self.take("where")
            out = ("ask", self.group())
        elif self.take("construct"):
            template = self.group()
            self.take("where")
            body = Select([], self.group())
            self.modifiers(body)
            out = ("construct", template, body)
        elif self.take("describe"):
            subjects = []
            while self.kind in ("iri", "name", "var"):
                subjects.append(self.variable() if self.kind == "var" else self.iri())
            body = []
            if self.take("where") or self.is_("{"):
                body = self.group()
            out = ("describe", subjects, body)
        else:
            raise ValueError(f"a query expected, not {self.value!r}")
        if self.kind != "end":
            raise ValueError(f"unread: {self.value!r}")
        return out

    def select(self) -> Select:
        self.expect("select")
        distinct = self.take("distinct", "reduced")
        names: list = []
        while not self.is_("where", "{"):
            if self.take("*"):
                continue
            if self.take("("):
                e = self.expression()
                self.expect("as")
                names.append((self.variable(), e))
                self.expect(")")
            else:
                names.append((self.variable(), None))
        self.take("where")
        out = Select(names, self.group(), distinct)
        self.modifiers(out)
        return out

    def modifiers(self, out: Select) -> None:
        while True:
            if self.take("group"):
                self.expect("by")
                while self.kind == "var" or self.is_("("):
                    if self.take("("):
                        e = self.expression()
                        name = self.variable() if self.take("as") else self.hidden()
                        self.expect(")")
                        out.group.append((name, e))
                    else:
                        out.group.append((self.variable(), None))
            elif self.take("having"):
                out.having.append(self.primary())
            elif self.take("order"):
                self.expect("by")
                while self.kind == "var" or self.is_("asc", "desc", "("):
                    down = self.is_("desc")
                    if self.is_("asc", "desc"):
                        self.next()
                    out.order.append((self.primary(), down))
            elif self.take("limit"):
                out.limit = int(self.next())
            elif self.take("offset"):
                out.offset = int(self.next())
            else:
                return


_AGGREGATES = {"count", "sum", "min", "max", "avg", "sample", "group_concat"}


# ---------------------------------------------------------------- expressions


def _number(e: Column) -> Column:
    return e["v"].try_cast("double")


def _integer(e: Column) -> Column:
    return term(e.cast("long"), "literal", None, _XSD + "integer")


def _truth(e: Column) -> Column:
    """Effective boolean value; an unbound term has none."""
    number = F.coalesce(_number(e) != 0, F.lit(False))
    return F.when(e["t"] == _XSD + "boolean", e["v"] == "true").when(e["t"].startswith(_XSD) & (e["t"] != _XSD + "string"), number).when(e["v"].isNotNull(), e["v"] != "")


def _boolean(c: Column) -> Column:
    return F.when(c.isNotNull(), term(c, "literal", None, _XSD + "boolean"))


def _text(c: Column) -> Column:
    return F.when(c.isNotNull(), term(c, "literal"))


def _compare(op: str, a: Column, b: Column) -> Column:
    x, y = _number(a), _number(b)
    numeric = (a["k"] == "literal") & (b["k"] == "literal") & x.isNotNull() & y.isNotNull()
    same = (a["v"] == b["v"]) & (a["k"] == b["k"]) & (F.lower(F.coalesce(a["l"], F.lit(""))) == F.lower(F.coalesce(b["l"], F.lit(""))))
    order = {"<": lambda p, q: p < q, ">": lambda p, q: p > q, "<=": lambda p, q: p <= q, ">=": lambda p, q: p >= q}
    if op in ("=", "!="):
        equal = F.when(numeric, x == y).otherwise(same)
        return equal if op == "=" else ~equal
    return F.when(numeric, order[op](x, y)).otherwise(order[op](a["v"], b["v"]))


def _arithmetic(op: str, a: Column, b: Column) -> Column:
    x, y = _number(a), _number(b)
    whole = (a["t"] == _XSD + "integer") & (b["t"] == _XSD + "integer") & F.lit(op != "/")
    value = {"+": x + y, "-": x - y, "*": x * y, "/": F.try_divide(x, y)}[op]
    shown = F.when(whole, value.cast("long").cast("string")).otherwise(value.cast("string"))
    return F.when(value.isNotNull(), term(shown, "literal", None, F.when(whole, _XSD + "integer").otherwise(_XSD + "decimal")))


def _column(e, scope: set[str]) -> Column:
    """An expression over solutions as a term column, null where it has no value."""
    match e:
        case ("var", name):
            return F.col(name) if name in scope else F.lit(None).cast(TERM)
        case ("const", c):
            return c.column()
        case ("!", inner):
            return _boolean(~_truth(_column(inner, scope)))
        case ("&&", a, b):
            return _boolean(_truth(_column(a, scope)) & _truth(_column(b, scope)))
        case ("||", a, b):
            return _boolean(_truth(_column(a, scope)) | _truth(_column(b, scope)))
        case ("=" | "!=" | "<" | ">" | "<=" | ">=" as op, a, b):
            return _boolean(_compare(op, _column(a, scope), _column(b, scope)))
        case ("in" | "not in" as op, a, items):
            hit = reduce(lambda x, y: x | y, [_compare("=", _column(a, scope), _column(b, scope)) for b in items], F.lit(False))
            return _boolean(hit if op == "in" else ~hit)
        case ("+" | "-" | "*" | "/" as op, a, b):
            return _arithmetic(op, _column(a, scope) if not isinstance(a, Const) else a.column(), _column(b, scope))
        case ("call", name, items):
            return _call(name, items, scope)
    raise ValueError(f"no such expression: {e!r}")


def _call(name: str, items: list, scope: set[str]) -> Column:
    args = [_column(x, scope) for x in items]
    v = [a["v"] for a in args]
    flags = lambda: "(?" + items[2][1].value + ")" if len(items) > 2 and items[2][1].value else ""
    pattern = lambda: F.lit(flags() + items[1][1].value)
    known = {
        "str": lambda: _text(v[0]), "lang": lambda: _text(F.when(args[0]["k"] == "literal", F.coalesce(args[0]["l"], F.lit("")))),
        "datatype": lambda: F.when(args[0]["k"] == "literal", term(F.coalesce(args[0]["t"], F.when(args[0]["l"].isNotNull(), _RDF + "langString").otherwise(_XSD + "string")), "iri")),
        "bound": lambda: _boolean(args[0].isNotNull()), "coalesce": lambda: F.coalesce(*args), "if": lambda: F.when(_truth(args[0]), args[1]).otherwise(args[2]),
        "regex": lambda: _boolean(F.regexp_like(v[0], pattern())), "contains": lambda: _boolean(F.contains(v[0], v[1])), "strstarts": lambda: _boolean(F.startswith(v[0], v[1])),
        "strends": lambda: _boolean(F.endswith(v[0], v[1])), "lcase": lambda: _text(F.lower(v[0])), "ucase": lambda: _text(F.upper(v[0])), "strlen": lambda: F.when(v[0].isNotNull(), _integer(F.length(v[0]))),
        "concat": lambda: _text(F.concat(*v)), "substr": lambda: _text(F.substring(v[0], _number(args[1]).cast("int"), _number(args[2]).cast("int") if len(args) > 2 else F.length(v[0]))),
        "replace": lambda: _text(F.regexp_replace(v[0], F.lit(items[1][1].value), F.lit(items[2][1].value))), "strbefore": lambda: _text(F.when(F.contains(v[0], v[1]), F.substring_index(v[0], items[1][1].value, 1)).otherwise("")),
        "strafter": lambda: _text(F.when(F.contains(v[0], v[1]), F.substring(v[0], F.locate(items[1][1].value, v[0]) + F.length(v[1]), F.length(v[0]))).otherwise("")),
        "isiri": lambda: _boolean(args[0]["k"] == "iri"), "isuri": lambda: _boolean(args[0]["k"] == "iri"), "isliteral": lambda: _boolean(args[0]["k"] == "literal"), "isblank": lambda: _boolean(args[0]["k"] == "bnode"),
        "langmatches": lambda: _boolean(F.when(v[1] == "*", v[0] != "").otherwise((F.lower(v[0]) == F.lower(v[1])) | F.startswith(F.lower(v[0]), F.concat(F.lower(v[1]), F.lit("-"))))),
        "abs": lambda: F.when(v[0].isNotNull(), term(F.abs(_number(args[0])), "literal", None, args[0]["t"])), "sameterm": lambda: _boolean(args[0] == args[1]),
        "iri": lambda: F.when(v[0].isNotNull(), term(v[0], "iri")), "uri": lambda: F.when(v[0].isNotNull(), term(v[0], "iri")),
    }
    if name not in known:
        raise ValueError(f"no such function: {name}")
    return known[name]()


def _aggregate(e, scope: set[str]) -> Column:
    """An expression over groups."""
    match e:
        case ("aggregate", name, distinct, inner, mark):
            x = F.lit(1) if inner is None else _column(inner, scope)
            n = F.lit(1) if inner is None else _number(x)
            if name == "count":
                if inner is None and distinct:
                    return _integer(F.countDistinct(F.struct(*sorted(scope))))
                return _integer(F.countDistinct(x) if distinct else F.count(x))
            if name == "group_concat":
                items = F.sort_array((F.collect_set if distinct else F.collect_list)(x["v"]))
                return _text(F.array_join(items, mark))
            if name == "sample":
                return F.min(x)
            if name in ("min", "max"):
                key = F.when(x.isNotNull(), F.struct(n.isNull().alias("text"), n.alias("n"), x["v"].alias("v")))
                return (F.min_by if name == "min" else F.max_by)(x, key)
            total = F.sum_distinct(n) if distinct else F.sum(n)
            value = total if name == "sum" else total / (F.countDistinct(n) if distinct else F.count(n))
            whole = F.coalesce(F.bool_and(x["t"] == _XSD + "integer"), F.lit(True)) & F.lit(name == "sum")
            value = F.coalesce(value, F.lit(0.0))
            return term(F.when(whole, value.cast("long").cast("string")).otherwise(value.cast("string")), "literal", None, F.when(whole, _XSD + "integer").otherwise(_XSD + "decimal"))
        case ("var", name):
            return F.first(name) if name in scope else F.lit(None).cast(TERM)
        case ("const", c):
            return c.column()
        case ("!", inner):
            return _boolean(~_truth(_aggregate(inner, scope)))
        case ("&&" | "||" as op, a, b):
            p, q = _truth(_aggregate(a, scope)), _truth(_aggregate(b, scope))
            return _boolean(p & q if op == "&&" else p | q)
        case ("=" | "!=" | "<" | ">" | "<=" | ">=" as op, a, b):
            return _boolean(_compare(op, _aggregate(a, scope), _aggregate(b, scope)))
        case ("+" | "-" | "*" | "/" as op, a, b):
            return _arithmetic(op, _aggregate(a, scope), _aggregate(b, scope))
    raise ValueError(f"not possible over groups: {e!r}")


def _has_aggregate(e) -> bool:
    return isinstance(e, tuple) and (e[0] == "aggregate" or any(_has_aggregate(x) for x in e[1:]))


# ---------------------------------------------------------------- patterns


@dataclass
class Rows:
    """Solutions: a frame, or the one empty solution; sure are the variables that are bound in all."""

    df: DataFrame | None
    sure: set[str]

    @property
    def names(self) -> set[str]:
        return set(self.df.columns) if self.df is not None else set()


class _Engine:
    def __init__(self, graph: DataFrame) -> None:
        kind = F.col("s_kind") if "s_kind" in graph.columns else F.when(F.startswith("s", F.lit("_:")), "bnode").otherwise("iri")
        self.spark = graph.sparkSession
        self.graph = graph.select(
            term(F.col("s"), kind).alias("s"), F.col("p"), term(F.col("o"), F.col("o_kind"), F.col("lang"), F.col("datatype")).alias("o")
        )
        self.fresh = itertools.count()

    def one(self) -> DataFrame:
        return self.spark.range(1).select()

    def join(self, a: Rows, b: Rows, how: str = "inner", on: Column | None = None, keep: bool = True) -> Rows:
        """Compatible solutions of a and b; a variable that may be unbound agrees with anything."""
        if a.df is None and how == "inner" and on is None:
            return b
        left = self.one() if a.df is None else a.df
        right = self.one() if b.df is None else b.df
        shared = sorted(a.names & b.names)
        other = {c: f"_r{next(self.fresh)}" for c in shared}
        right = right.withColumnsRenamed(other) if other else right
        conditions = []
        for c in shared:
            x, y = F.col(c), F.col(other[c])
            conditions.append(x == y if c in a.sure and c in b.sure else (x == y) | x.isNull() | y.isNull())
        if on is not None:
            conditions.append(on)
        if how == "left_anti" and not shared and on is None:
            return a
        condition = reduce(lambda x, y: x & y, conditions) if conditions else F.lit(True)
        joined = left.join(right, condition, how)
        if how in ("left_semi", "left_anti"):
            return Rows(joined, a.sure)
        own = [F.coalesce(c, other[c]).alias(c) if c in other else F.col(c) for c in left.columns]
        more = [F.col(c) for c in b.names - a.names] if b.df is not None else []
        return Rows(joined.select(*own, *more), a.sure | b.sure if how == "inner" else a.sure)

    # -- paths and patterns

    def pairs(self, path) -> DataFrame:
        """(a, b) of a path without variables."""
        match path:
            case Const():
                return self.graph.where(F.col("p") == path.value).select(F.col("s").alias("a"), F.col("o").alias("b"))
            case ("^", inner):
                return self.pairs(inner).select(F.col("b").alias("a"), F.col("a").alias("b"))
            case ("|", parts):
                return reduce(DataFrame.unionByName, [self.pairs(p) for p in parts])
            case ("/", parts):
                return reduce(lambda x, y: x.withColumnRenamed("b", "m").join(y.withColumnRenamed("a", "m"), "m").select("a", "b"), [self.pairs(p) for p in parts])
            case ("+" | "*" | "?" as mark, inner):
                steps = self.pairs(inner)
                reached = steps.distinct() if mark == "?" else closure(steps).select("a", "b")
                if mark == "+":
                    return reached
                nodes = self.graph.select(F.explode(F.array("s", "o")).alias("a")).distinct()
                return reached.unionByName(nodes.select("a", F.col("a").alias("b"))).distinct()
        raise ValueError(f"no such path: {path!r}")

    def triple(self, s, path, o) -> Rows:
        if isinstance(path, str):
            rows, places = self.graph.select("s", term(F.col("p"), "iri").alias("p"), "o"), (("s", s), ("p", path), ("o", o))
        elif isinstance(path, Const):
            rows, places = self.graph.where(F.col("p") == path.value), (("s", s), ("o", o))
        else:
            rows, places = self.pairs(path), (("a", s), ("b", o))
        names: dict[str, str] = {}
        for column, x in places:
            if isinstance(x, Const):
                rows = rows.where(F.col(f"{column}.v") == x.value).where(F.col(column) == x.column())
            elif x in names:
                rows = rows.where(F.col(column) == F.col(names[x]))
            else:
                names[x] = column
        df = rows.select(*[F.col(c).alias(n) for n, c in names.items()]) if names else rows.limit(1).select()
        return Rows(df, set(names))

    def group(self, parts: list) -> Rows:
        out = Rows(None, set())
        filters = []
        for part in parts:
            match part:
                case ("triple", s, path, o):
                    out = self.join(out, self.triple(s, path, o))
                case ("filter", e):
                    filters.append(e)
                case ("optional", inner):
                    inside = [p for p in inner if p[0] != "filter"]
                    tests = [p[1] for p in inner if p[0] == "filter"]
                    found = self.group(inside)
                    on = None
                    if tests:  # filters may name variables of both sides
                        scope = out.names | found.names
                        on = reduce(lambda x, y: x & y, [F.coalesce(_truth(_column(t, scope)), F.lit(False)) for t in tests])
                    out = self.join(out, found, "left", on)
                case ("minus", inner):
                    found = self.group(inner)
                    out = self.join(out, found, "left_anti") if out.names & found.names else out
                case ("exists" | "not exists" as how, inner):
                    filters.append((how, inner))
                case ("union", branches):
                    found = [self.group(b) for b in branches]
                    frames = [f.df if f.df is not None else self.one() for f in found]
                    df = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), frames)
                    out = self.join(out, Rows(df, set.intersection(*[f.sure for f in found])))
                case ("values", names, rows):
                    values = [[None if c is None else (c.value, c.kind, c.lang, c.datatype) for c in row] for row in rows]
                    df = self.spark.createDataFrame(values, ", ".join(f"`{n}` {TERM}" for n in names))
                    out = self.join(out, Rows(df, {n for i, n in enumerate(names) if all(r[i] is not None for r in rows)}))
                case ("bind", name, e):
                    df = self.one() if out.df is None else out.df
                    out = Rows(df.withColumn(name, _column(e, out.names)), out.sure)
                case ("select", inner):
                    df = self.select(inner)
                    out = self.join(out, Rows(df, set()))
        for e in filters:
            if e[0] in ("exists", "not exists"):
                found = self.group(e[1])
                if out.names & found.names or found.df is not None:
                    out = self.join(out, found, "left_semi" if e[0] == "exists" else "left_anti", F.lit(True))
            else:
                df = self.one() if out.df is None else out.df
                out = Rows(df.where(_truth(_column(e, out.names))), out.sure)
        return out

    def select(self, q: Select) -> DataFrame:
        rows = self.group(q.where)
        df = self.one() if rows.df is None else rows.df
        scope = rows.names
        names = q.names or [(n, None) for n in df.columns if not n.startswith("_")]
        for name, e in q.group:
            if e is not None:
                df, scope = df.withColumn(name, _column(e, scope)), scope | {name}
        if q.group or any(_has_aggregate(e) for _, e in names if e is not None):
            keys = [n for n, _ in q.group]
            wanted = [(n, e) for n, e in names if not (e is None and n in keys)]
            tests = [(f"_h{i}", e) for i, e in enumerate(q.having)]
            ranks = [(f"_o{i}", e) for i, (e, _) in enumerate(q.order)]
            produced = {n for n, _ in names}
            sums = [_aggregate(("var", n) if e is None else e, scope).alias(n) for n, e in [*wanted, *tests]]
            sums += [_aggregate(e, scope).alias(n) for n, e in ranks if not (e[0] == "var" and e[1] in produced | set(keys))]
            df = (df.groupBy(*keys).agg(*sums) if keys else df.agg(*sums)) if sums else df.select(*keys).distinct()
            for n, _ in tests:
                df = df.where(_truth(F.col(n)))
            order = [F.col(e[1]) if e[0] == "var" and e[1] in produced | set(keys) else F.col(n) for n, e in ranks]
        else:
            for name, e in names:
                if e is not None:
                    df, scope = df.withColumn(name, _column(e, scope)), scope | {name}
                elif name not in scope:
                    df = df.withColumn(name, F.lit(None).cast(TERM))
            order = [_column(e, scope) for e, _ in q.order]
        keyed = [k for x, (_, down) in zip(order, q.order, strict=True) for k in self._sorted(x, down)]
        if keyed and not q.distinct:
            df = df.orderBy(*keyed)
        out = df.select(*[F.col(n) for n, _ in names])
        if q.distinct:
            out = out.distinct()
            if keyed:
                out = out.orderBy(*[k for x, (e, down) in zip(order, q.order, strict=True) if e[0] == "var" for k in self._sorted(F.col(e[1]), down)])
        if q.offset:
            out = out.offset(q.offset)
        return out if q.limit is None else out.limit(q.limit)

    @staticmethod
    def _sorted(x: Column, down: bool) -> list[Column]:
        keys = [x.isNotNull(), _number(x), x["v"]]
        return [k.desc() if down else k.asc() for k in keys]


def answer(graph: DataFrame, text: str) -> DataFrame:
    """The answer of a query on triples (s, p, o, o_kind, lang, datatype).

    select: a string column per variable in the order asked for (null: unbound);
    ask: one row, answer; construct and describe: distinct s, p, o.  A query that
    is too long, would change data or cannot be read is an error.
    """
    q = _Reader(checked_query(text)).query()
    engine = _Engine(graph)
    if q[0] == "select":
        df = engine.select(q[1])
        return df.select(*[F.col(f"{c}.v").alias(c) for c in df.columns])
    if q[0] == "ask":
        rows = engine.group(q[1])
        return (engine.one() if rows.df is None else rows.df).limit(1).agg((F.count("*") > 0).alias("answer"))
    if q[0] == "construct":
        _, template, body = q
        rows = engine.select(body)
        plain = rows.select(*[F.col(f"{c}.v").alias(c) for c in rows.columns])
        name = lambda x: f"?{x}" if isinstance(x, str) else x.value
        return construct(plain, *[(name(t[1]), name(t[2]), name(t[3])) for t in template])
    _, subjects, body = q
    named = [s.value for s in subjects if isinstance(s, Const)]
    seeds = graph.sparkSession.createDataFrame([(s,) for s in named], "s string")
    if body:
        rows = engine.group(body).df
        for s in subjects:
            if isinstance(s, str):
                seeds = seeds.unionByName(rows.select(F.col(f"{s}.v").alias("s")).where("s is not null"))
    return graph.join(seeds.distinct(), "s", "left_semi").select("s", "p", "o").distinct()
