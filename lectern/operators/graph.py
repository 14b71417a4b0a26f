"""Graph and triple operators: pattern queries, closures, neighbourhoods, succession.

Triples are rows (s, p, o, o_kind, lang, datatype); solutions are frames with a
column per variable.  Every pattern is a filtered scan and a join; the planner
orders them.
"""

from __future__ import annotations

import itertools
import re
import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IRI, LITERAL = "iri", "literal"


def triples(subject: Column, predicate: str, obj: Column, kind: str = IRI, lang: Column | None = None, datatype: str | None = None) -> list[Column]:
    """Columns of one triple for select()."""
    return [
        subject.alias("s"), F.lit(predicate).alias("p"), obj.cast("string").alias("o"), F.lit(kind).alias("o_kind"),
        (F.lit(None).cast("string") if lang is None else lang).alias("lang"), F.lit(datatype).cast("string").alias("datatype"),
    ]


def union(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def pattern(graph: DataFrame, s: str, p: str, o: str, lang: str | None = None) -> DataFrame:
    """Solutions of one pattern.  '?name' is a variable; anything else a constant."""
    rows, out = graph, {}
    for column, term in (("s", s), ("p", p), ("o", o)):
        if not term.startswith("?"):
            rows = rows.where(F.col(column) == term)
        elif term[1:] in out:
            rows = rows.where(F.col(column) == F.col(out[term[1:]]))
        else:
            out[term[1:]] = column
    if lang is not None:
        rows = rows.where(F.col("lang") == lang)
    return rows.select(*[F.col(c).alias(v) for v, c in out.items()])


def _shared(a: DataFrame, b: DataFrame) -> list[str]:
    return [c for c in a.columns if c in b.columns]


def bgp(graph: DataFrame, *patterns: tuple[str, ...]) -> DataFrame:
    """Solutions of all patterns together."""
    return reduce(and_, [pattern(graph, *x) for x in patterns])


def and_(a: DataFrame, b: DataFrame) -> DataFrame:
    keys = _shared(a, b)
    return a.join(b, keys) if keys else a.join(b, how="cross")


def optional(a: DataFrame, b: DataFrame) -> DataFrame:
    """Solutions of a, with those of b where there are any; filters on b belong inside b."""
    return a.join(b, _shared(a, b), "left")


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    """Solutions of a for which b has none (not exists)."""
    return a.join(b, _shared(a, b), "left_anti")


def exists(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, _shared(a, b), "left_semi")


def either(a: DataFrame, b: DataFrame) -> DataFrame:
    """Solutions of a and of b; a variable that one side lacks is null there."""
    return a.unionByName(b, allowMissingColumns=True)


def values(like: DataFrame, name: str, *items: str) -> DataFrame:
    return like.sparkSession.createDataFrame([(x,) for x in items], f"{name} string")


def sequence_path(graph: DataFrame, start: str, predicates: list[str], end: str) -> DataFrame:
    """start / p1 / p2 ... / end."""
    names = [start, *[f"?_{i}" for i in range(1, len(predicates))], end]
    rows = bgp(graph, *[(a, p, b) for a, p, b in zip(names, predicates, names[1:], strict=False)])
    return rows.select(*[x[1:] for x in (start, end) if x.startswith("?")])


def ask(solutions: DataFrame) -> DataFrame:
    """One row: whether there is a solution."""
    return solutions.limit(1).agg((F.count("*") > 0).alias("answer"))


def construct(solutions: DataFrame, *template: tuple[str, str, str]) -> DataFrame:
    """Distinct (s, p, o) of a template over solutions; rows with an unbound variable make no triple."""
    term = lambda t: F.col(t[1:]) if t.startswith("?") else F.lit(t)
    rows = F.explode(F.array(*[F.struct(*[term(t).alias(n) for t, n in zip(x, "spo", strict=True)]) for x in template]))
    return solutions.select(rows.alias("t")).select("t.*").where("s is not null and p is not null and o is not null").distinct()


def describe(graph: DataFrame, *subjects: str) -> DataFrame:
    """Triples of the given subjects and of what they refer to: one hop."""
    seeds = graph.where(F.col("s").isin(*subjects))
    hop = graph.join(seeds.where(F.col("o_kind") != LITERAL).select(F.col("o").alias("s")).distinct(), "s", "left_semi")
    return seeds.unionByName(hop.select(*graph.columns)).distinct()


def select_capped(solutions: DataFrame, cap: int = 1000, *order: str) -> DataFrame:
    """At most cap rows (the feature of the endpoint), the first in order, with the full number of rows next to them."""
    total = solutions.agg(F.count("*").alias("row_count"))
    rows = solutions.orderBy(*order) if order else solutions
    return rows.limit(cap).join(F.broadcast(total), how="cross")


def settled(df: DataFrame) -> DataFrame:
    """df computed once into the checkpoint folder, its lineage cut.

    The folder is the session's spark.checkpoint.dir; only a local session
    without one gets a folder of its own.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lectern-"))
    return df.checkpoint()


def closure(edges: DataFrame) -> DataFrame:
    """(a, b, depth) of all pairs with a path a -> ... -> b of one edge or more, least depth; cycles are harmless.

    Frontier by frontier, until one is empty: each round joins only the pairs
    found last and drops those known.  Edges need columns a and b.
    """
    edges = edges.select("a", "b").distinct()
    every = edges.withColumn("depth", F.lit(1))
    front = every
    for depth in itertools.count(2):
        step = front.select("a", F.col("b").alias("m")).join(edges.select(F.col("a").alias("m"), "b"), "m").select("a", "b").distinct()
        front = settled(step.join(every, ["a", "b"], "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            return every
        every = every.unionByName(front)


def neighbours(edges: DataFrame) -> DataFrame:
    """(a, b) in both directions, distinct, without loops."""
    back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return edges.select("a", "b").unionByName(back).where("a <> b").distinct()


def connected_nodes_only(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends are both nodes (name)."""
    at = lambda c: nodes.select(F.col("name").alias(c))
    return edges.join(at("a"), "a", "left_semi").join(at("b"), "b", "left_semi").select(*edges.columns)


def neighbourhood(edges: DataFrame, name: str) -> DataFrame:
    """Edges among a node and its neighbours."""
    near = neighbours(edges).where(F.col("a") == name).select(F.col("b").alias("n")).unionByName(edges.sparkSession.createDataFrame([(name,)], "n string")).distinct()
    at = lambda c: near.select(F.col("n").alias(c))
    return edges.join(at("a"), "a", "left_semi").join(at("b"), "b", "left_semi").select(*edges.columns)


def degrees(edges: DataFrame) -> DataFrame:
    """(name, n): edge ends per node."""
    return edges.select(F.explode(F.array("a", "b")).alias("name")).groupBy("name").agg(F.count("*").alias("n"))


def succession(edges: DataFrame) -> DataFrame:
    """(pupil, parent, depth): the first teacher, else the first influence, is the parent; roots have depth 0.

    edges: pupil, teacher, kind (teacher, influence), ord.  Every pupil points to
    an ancestor and doubles the distance per round, so rounds follow the
    logarithm of the depth; a cycle, and what hangs from one, stays without depth.
    """
    parent = edges.groupBy("pupil").agg(F.min_by("teacher", F.struct(F.col("kind") != "teacher", "ord")).alias("parent"))
    roots = parent.select(F.col("parent").alias("name")).distinct().join(parent.select(F.col("pupil").alias("name")), "name", "left_anti")
    top = roots.select(F.col("name").alias("up"), F.lit(True).alias("top"))
    jumps = settled(parent.select("pupil", F.col("parent").alias("up"), F.lit(1).alias("depth")).join(top, "up", "left"))
    left = None
    while True:
        open_ = jumps.where("top is null")
        n = open_.count()
        if n in (0, left):  # nobody came to a root this round, so nobody will
            break
        left = n
        far = jumps.select(F.col("pupil").alias("up"), F.col("up").alias("far"), F.col("depth").alias("more"), F.col("top").alias("end"))
        moved = open_.drop("top").join(far, "up").select("pupil", F.col("far").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), F.col("end").alias("top"))
        jumps = settled(jumps.where("top").select("pupil", "up", "depth", "top").unionByName(moved))
    depth = jumps.where("top").select("pupil", "depth")
    return parent.join(depth, "pupil", "left").unionByName(roots.select(F.col("name").alias("pupil"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth")))


def inherited(closure_: DataFrame, own: DataFrame, value: str) -> DataFrame:
    """(concept, value, depth): own values (depth 0) and those of all ancestors; closure: a is above b."""
    mine = own.select("concept", value, F.lit(0).alias("depth"))
    up = closure_.select(F.col("b").alias("concept"), F.col("a").alias("above"), "depth").join(own.withColumnRenamed("concept", "above"), "above")
    return mine.unionByName(up.select("concept", value, "depth")).groupBy("concept", value).agg(F.min("depth").alias("depth"))


def derive_edges(graph: DataFrame, predicates: list[str], node_type: str) -> DataFrame:
    """(a, p, b, certain): triples between typed nodes; certain marks those not made by a hedged statement."""
    nodes = pattern(graph, "?n", "type", node_type).distinct()
    rows = graph.where(F.col("p").isin(*predicates)).select(F.col("s").alias("a"), "p", F.col("o").alias("b")).distinct()
    rows = rows.join(nodes.withColumnRenamed("n", "a"), "a", "left_semi").join(nodes.withColumnRenamed("n", "b"), "b", "left_semi")
    hedged = pattern(graph, "?a", "doubted", "?b").distinct().withColumn("h", F.lit(True))
    return rows.join(hedged, ["a", "b"], "left").select("a", "p", "b", F.col("h").isNull().alias("certain"))


def best_label(graph: DataFrame, predicate: str = "label", languages: tuple[str | None, ...] = ("en", None)) -> DataFrame:
    """(s, label): the label in the first language of the list, then any, least text among equals."""
    rank = F.lit(len(languages))
    for i, lang in reversed(list(enumerate(languages))):
        rank = F.when(F.col("lang").isNull() if lang is None else F.col("lang") == lang, i).otherwise(rank)
    return graph.where(F.col("p") == predicate).groupBy("s").agg(F.min_by("o", F.struct(rank, "o")).alias("label"))


def object_detail(relations: DataFrame, target: str, cap: int = 200) -> DataFrame:
    """(direction, rel, other, total): outbound relations and at most cap inbound ones with their full number."""
    out = relations.where(F.col("a") == target).select(F.lit("out").alias("direction"), "rel", F.col("b").alias("other"))
    inbound = relations.where(F.col("b") == target).select(F.lit("in").alias("direction"), "rel", F.col("a").alias("other"))
    counted = inbound.agg(F.count("*").alias("total"))
    capped = inbound.orderBy("rel", "other").limit(cap).join(F.broadcast(counted), how="cross")
    return capped.unionByName(out.withColumn("total", F.lit(None).cast("long")))


def type_census(graph: DataFrame, top_type: str | None = None) -> DataFrame:
    """(type, n): distinct subjects per type."""
    return pattern(graph, "?s", "type", "?t").groupBy(F.col("t").alias("type")).agg(F.countDistinct("s").alias("n"))


def void_statistics(graph: DataFrame, namespaces: list[tuple[str, str]]) -> DataFrame:
    """(statistic, n): distinct triples, and sameAs links by the first matching namespace (or 'other')."""
    total = graph.select(F.lit("triples").alias("statistic"), F.struct("s", "p", "o", "lang", "datatype").alias("t")).groupBy("statistic").agg(F.countDistinct("t").alias("n"))
    bucket = F.lit("other")
    for name, start in reversed(namespaces):
        bucket = F.when(F.startswith("o", F.lit(start)), name).otherwise(bucket)
    links = graph.where(F.col("p") == "sameAs").select(F.concat(F.lit("sameAs "), bucket).alias("statistic")).groupBy("statistic").agg(F.count("*").alias("n"))
    return total.unionByName(links)


def shape_violations(graph: DataFrame, node_type: str, required: list[str], at_most_one: list[str] = ()) -> DataFrame:
    """(node, rule) of typed nodes that lack a required property or hold several of a single-valued one."""
    nodes = pattern(graph, "?node", "type", node_type).distinct()
    out = [minus(nodes, pattern(graph, "?node", p, "?v").select("node")).withColumn("rule", F.lit(f"lacks {p}")) for p in required]
    for p in at_most_one:
        many = pattern(graph, "?node", p, "?v").distinct().groupBy("node").agg(F.count("*").alias("n")).where("n > 1")
        out.append(exists(nodes, many.select("node")).withColumn("rule", F.lit(f"several {p}")))
    return union(*out)


def query_form(query: str) -> str:
    """select, ask, construct, describe, update or unknown: the first keyword past prefixes.

    One pass over tokens, so a # inside an IRI or a string opens no comment.
    """
    token = re.compile(r"""<[^<>"{}|^`\\\s]*>|\"\"\".*?\"\"\"|'''.*?'''|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|#[^\n]*|\w[\w.-]*|\s+|.""", re.S)
    words = [m[0] for m in token.finditer(query) if not m[0].isspace() and m[0][0] != "#"]
    i = 0
    while i < len(words):
        word = words[i].lower()
        if word == "base":
            i += 2
        elif word == "prefix":
            i += next((k + 1 for k, w in enumerate(words[i:]) if w.startswith("<")), len(words))
        else:
            if word in ("select", "ask", "construct", "describe"):
                return word
            return "update" if word in ("insert", "delete", "load", "clear", "create", "drop", "copy", "move", "add", "with") else "unknown"
    return "unknown"


QUERY_CAP = 20_000


def checked_query(query: str) -> str:
    """The query, or an error if it is too long, changes data or has no known form."""
    if len(query) > QUERY_CAP:
        raise ValueError(f"queries have at most {QUERY_CAP} characters")
    form = query_form(query)
    if form in ("update", "unknown"):
        raise ValueError(f"only read queries are answered, not {form}")
    return query


def requested_query(method: str, parameters: dict[str, str], body: str | dict | None = None, content_type: str = "") -> str | None:
    """The query text of a request, checked: the parameter ``query``, a raw body, or a form's field; None without one.

    Updates, by content type or as a form's field, are an error.
    """
    if "application/sparql-update" in content_type or (method != "GET" and isinstance(body, dict) and isinstance(body.get("update"), str)):
        raise ValueError("only read queries are answered, not updates")
    asked = [parameters.get("query")]
    if method != "GET":
        asked.insert(0, body if isinstance(body, str) else body.get("query") if isinstance(body, dict) else None)
    found = next((x for x in asked if isinstance(x, str) and x.strip()), None)
    return None if found is None else checked_query(found)
