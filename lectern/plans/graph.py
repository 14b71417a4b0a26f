"""Triples and graphs made of the star schema.

Suppliers, customers, nations and regions are typed nodes with labels; located
and part-of links, and orders as links between customers and suppliers' nations.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import graph as G
from lectern.operators.questions import Question, row_counts
from lectern.operators.sparql import answer
from lectern.sources import writers

from .registry import query, read


def iri(prefix, column):
    return F.concat(F.lit(f"{prefix}/"), F.col(column).cast("string"))


def graph(spark, sf_dir):
    r, n, s, c = (read(spark, sf_dir, t) for t in ("region", "nation", "supplier", "customer"))
    en, typed = F.lit("en"), lambda df, p, k, t: df.select(*G.triples(iri(p, k), "type", F.lit(t)))
    return G.union(
        typed(r, "r", "r_regionkey", "Region"), typed(n, "n", "n_nationkey", "Nation"), typed(s, "s", "s_suppkey", "Supplier"), typed(c, "c", "c_custkey", "Customer"),
        r.select(*G.triples(iri("r", "r_regionkey"), "label", F.col("r_name"), G.LITERAL, en)), n.select(*G.triples(iri("n", "n_nationkey"), "label", F.col("n_name"), G.LITERAL, en)),
        n.where("n_nationkey % 2 = 0").select(*G.triples(iri("n", "n_nationkey"), "label", F.concat(F.lit("Z"), "n_name"), G.LITERAL)),
        s.where("s_suppkey % 3 = 0").select(*G.triples(iri("s", "s_suppkey"), "label", F.col("s_name"), G.LITERAL, en)),
        n.select(*G.triples(iri("n", "n_nationkey"), "partOf", iri("r", "n_regionkey"))), s.select(*G.triples(iri("s", "s_suppkey"), "locatedIn", iri("n", "s_nationkey"))),
        c.select(*G.triples(iri("c", "c_custkey"), "locatedIn", iri("n", "c_nationkey"))),
        s.where("s_acctbal < 0").select(*G.triples(iri("s", "s_suppkey"), "doubted", iri("n", "s_nationkey"))),
        s.where("s_suppkey % 4 = 0").select(*G.triples(iri("s", "s_suppkey"), "sameAs", F.concat(F.when(F.col("s_suppkey") % 8 == 0, F.lit("http://a.org/")).otherwise(F.lit("http://b.org/")), F.col("s_suppkey").cast("string")))),
    )


_GRAPH = """
g as (select 'r/' || r_regionkey as s, 'type' as p, 'Region' as o, 'iri' as k, null as lang from region union all select 'n/' || n_nationkey, 'type', 'Nation', 'iri', null from nation
  union all select 's/' || s_suppkey, 'type', 'Supplier', 'iri', null from supplier union all select 'c/' || c_custkey, 'type', 'Customer', 'iri', null from customer
  union all select 'r/' || r_regionkey, 'label', r_name, 'literal', 'en' from region union all select 'n/' || n_nationkey, 'label', n_name, 'literal', 'en' from nation
  union all select 'n/' || n_nationkey, 'label', 'Z' || n_name, 'literal', null from nation where n_nationkey % 2 = 0 union all select 's/' || s_suppkey, 'label', s_name, 'literal', 'en' from supplier where s_suppkey % 3 = 0
  union all select 'n/' || n_nationkey, 'partOf', 'r/' || n_regionkey, 'iri', null from nation union all select 's/' || s_suppkey, 'locatedIn', 'n/' || s_nationkey, 'iri', null from supplier
  union all select 'c/' || c_custkey, 'locatedIn', 'n/' || c_nationkey, 'iri', null from customer union all select 's/' || s_suppkey, 'doubted', 'n/' || s_nationkey, 'iri', null from supplier where s_acctbal < 0
  union all select 's/' || s_suppkey, 'sameAs', case when s_suppkey % 8 = 0 then 'http://a.org/' else 'http://b.org/' end || s_suppkey, 'iri', null from supplier where s_suppkey % 4 = 0)
"""


@query("select 's/' || s_suppkey as supplier, n_name as nation, r_name as region from supplier join nation on n_nationkey = s_nationkey join region on r_regionkey = n_regionkey")
def bgp_join(spark, sf_dir):
    g = graph(spark, sf_dir)
    return G.bgp(g, ("?supplier", "type", "Supplier"), ("?supplier", "locatedIn", "?n"), ("?n", "label", "?nation", "en"), ("?n", "partOf", "?r"), ("?r", "label", "?region", "en")).select("supplier", "nation", "region")


@query("select 's/' || s_suppkey as supplier, case when s_suppkey % 3 = 0 then s_name end as label from supplier")
def bgp_optional(spark, sf_dir):
    g = graph(spark, sf_dir)
    return G.optional(G.pattern(g, "?supplier", "type", "Supplier"), G.pattern(g, "?supplier", "label", "?label", "en"))


@query("select 's/' || s_suppkey as supplier from supplier where not s_acctbal < 0 and s_suppkey % 3 <> 0")
def bgp_not_exists(spark, sf_dir):
    g = graph(spark, sf_dir)
    rows = G.minus(G.pattern(g, "?supplier", "type", "Supplier"), G.pattern(g, "?supplier", "doubted", "?x").select("supplier"))
    return G.minus(rows, G.pattern(g, "?supplier", "label", "?l").select("supplier"))


@query("""select distinct x as node, name from (select 'r/' || r_regionkey as x, r_name as name from region union all select 'n/' || n_nationkey, n_name from nation) where name in (select n_name from nation where n_nationkey in (1, 4, 9) union select r_name from region where r_regionkey = 2)""")
def bgp_union_values(spark, sf_dir):
    g = graph(spark, sf_dir)
    names = read(spark, sf_dir, "nation").where("n_nationkey in (1, 4, 9)").select(F.col("n_name").alias("name")).unionByName(read(spark, sf_dir, "region").where("r_regionkey = 2").select(F.col("r_name").alias("name")))
    of = lambda t: G.and_(G.pattern(g, "?node", "type", t), G.pattern(g, "?node", "label", "?name", "en"))
    return G.and_(G.either(of("Region"), of("Nation")), names).select("node", "name").distinct()


@query(f"""with recursive {_GRAPH}, e as (select s as a, o as b from g where p in ('locatedIn', 'partOf') and s not like 'c/%'),
t(a, b, depth) as (select a, b, 1 from e union all select t.a, e.b, depth + 1 from t join e on e.a = t.b) select a, b, min(depth)::int as depth from t group by a, b""")
def bgp_path_plus(spark, sf_dir):
    g = graph(spark, sf_dir).where("p in ('locatedIn', 'partOf') and s not like 'c/%'")
    return G.closure(g.select(F.col("s").alias("a"), F.col("o").alias("b")))


@query("select distinct 'c/' || c_custkey as customer, r_name as region from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey")
def path_sequence(spark, sf_dir):
    g = graph(spark, sf_dir)
    label = g.where("not (p = 'label' and lang is null)")
    return G.sequence_path(label, "?customer", ["locatedIn", "partOf", "label"], "?region").where("customer like 'c/%'").distinct()


@query("""select 'n/' || n_nationkey as s, 'near' as p, 'r/' || n_regionkey as o from nation union select 'r/' || n_regionkey, 'holds', n_name from nation""")
def construct_onehop(spark, sf_dir):
    g = graph(spark, sf_dir)
    rows = G.bgp(g, ("?n", "partOf", "?r"), ("?n", "label", "?name", "en"))
    return G.construct(rows, ("?n", "near", "?r"), ("?r", "holds", "?name"))


@query(f"with {_GRAPH} select s, p, o from g where s = 's/4' union select s, p, o from g where s in (select o from g where s = 's/4' and k <> 'literal')")
def describe_resource(spark, sf_dir):
    return G.describe(graph(spark, sf_dir), "s/4").select("s", "p", "o")


@query("select (select count(*) from supplier where s_acctbal < 0) > 0 as answer union all select false")
def ask_exists(spark, sf_dir):
    g = graph(spark, sf_dir)
    return G.ask(G.pattern(g, "?s", "doubted", "?n")).unionByName(G.ask(G.pattern(g, "?s", "noSuch", "?n")))


@query("select n_name as nation, count(*)::bigint as n from customer join nation on n_nationkey = c_nationkey group by 1 order by n desc, nation limit 7")
def group_and_limit(spark, sf_dir):
    g = graph(spark, sf_dir)
    rows = G.bgp(g, ("?c", "type", "Customer"), ("?c", "locatedIn", "?n"), ("?n", "label", "?nation", "en"))
    return rows.groupBy("nation").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "nation").limit(7)


@query("select 'c/' || c_custkey as c, (select count(*) from customer)::bigint as row_count from customer order by c limit 1000")
def select_capped(spark, sf_dir):
    return G.select_capped(G.pattern(graph(spark, sf_dir), "?c", "type", "Customer"), 1000, "c")


@query("""select a.n_name as a, b.n_name as b from nation a join nation b on a.n_regionkey = b.n_regionkey and 'n/' || a.n_nationkey < 'n/' || b.n_nationkey and a.n_name <> b.n_name""")
def theta_join(spark, sf_dir):
    g = graph(spark, sf_dir)
    one = G.bgp(g, ("?x", "partOf", "?r"), ("?x", "label", "?a", "en"))
    two = one.select(F.col("x").alias("y"), "r", F.col("a").alias("b"))
    return one.join(two, "r").where("x < y and a <> b").select("a", "b")


@query(f"with {_GRAPH} select o as type, count(distinct s)::bigint as n from g where p = 'type' group by o")
def type_census(spark, sf_dir):
    return G.type_census(graph(spark, sf_dir))


@query(f"with {_GRAPH} select 'triples' as statistic, count(*)::bigint as n from (select distinct s, p, o, lang from g) union all select 'sameAs ' || case when o like 'http://a.org/%' then 'a' else 'other' end, count(*) from g where p = 'sameAs' group by 1")
def void_statistics(spark, sf_dir):
    return G.void_statistics(graph(spark, sf_dir), [("a", "http://a.org/")])


@query("select 'n/' || n_nationkey as s, n_name as label from nation union all select 'r/' || r_regionkey, r_name from region union all select 's/' || s_suppkey, s_name from supplier where s_suppkey % 3 = 0")
def best_label(spark, sf_dir):
    return G.best_label(graph(spark, sf_dir))


@query("select 's/' || s_suppkey as a, 'locatedIn' as p, 'n/' || s_nationkey as b, not s_acctbal < 0 as certain from supplier")
def derived_edges(spark, sf_dir):
    g = graph(spark, sf_dir)
    placed = g.withColumn("o", F.when((F.col("p") == "type") & F.col("o").isin("Supplier", "Nation"), F.lit("Node")).otherwise(F.col("o")))
    return G.derive_edges(placed, ["locatedIn"], "Node")


@query("select 's/' || s_suppkey as node, 'lacks label' as rule from supplier where s_suppkey % 3 <> 0")
def shape_check(spark, sf_dir):
    return G.shape_violations(graph(spark, sf_dir), "Supplier", ["label", "locatedIn"], ["locatedIn"])


_EDGES = "e as (select distinct l_suppkey as a, l_partkey as b from lineitem)"


def edges(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b")).distinct()


@query(f"with {_EDGES} select a, b from e where a <> b union select b, a from e where a <> b")
def neighbours(spark, sf_dir):
    return G.neighbours(edges(spark, sf_dir))


@query(f"with {_EDGES}, nb as (select b as n from e where a = 7 and b <> 7 union select a from e where b = 7 and a <> 7 union select 7) select a, b from e where a in (select n from nb) and b in (select n from nb)")
def neighbourhood(spark, sf_dir):
    return G.neighbourhood(edges(spark, sf_dir).select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b")), "7").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))


@query(f"with {_EDGES} select name, count(*)::bigint as n from (select a as name from e union all select b from e) group by name")
def node_degrees(spark, sf_dir):
    return G.degrees(edges(spark, sf_dir))


@query(f"with {_EDGES}, n as (select s_suppkey as name from supplier where s_acctbal > 0) select a, b from e where a in (select name from n) and b in (select name from n)")
def edges_of_nodes(spark, sf_dir):
    nodes = read(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("name"))
    return G.connected_nodes_only(edges(spark, sf_dir), nodes)


_SUCC = "x as (select l_orderkey as pupil, l_orderkey // 2 - (l_linenumber % 2) * 3 as teacher, case when l_returnflag = 'A' then 'teacher' else 'influence' end as kind, l_linenumber as ord from lineitem)"


@query(f"""with recursive {_SUCC}, par as (select pupil, arg_min(teacher, case when kind = 'teacher' then 0 else 10 end + ord) as parent from x group by pupil),
roots as (select distinct parent as name from par where parent not in (select pupil from par)), d(name, depth) as (select name, 0 from roots union all select pupil, depth + 1 from d join par on parent = name)
select pupil::varchar as pupil, parent::varchar as parent, depth::int as depth from par left join (select name, min(depth) as depth from d group by name) on name = pupil union all select name::varchar, null, 0 from roots""")
def succession_depth(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem")
    teacher = F.expr("l_orderkey div 2") - (F.col("l_linenumber") % 2) * 3
    e = rows.select(F.col("l_orderkey").cast("string").alias("pupil"), teacher.cast("string").alias("teacher"), F.when(F.col("l_returnflag") == "A", "teacher").otherwise("influence").alias("kind"), F.col("l_linenumber").alias("ord"))
    return G.succession(e)


@query("""with recursive isa as (select p_partkey as b, p_partkey // 3 as a from part where p_partkey >= 3), t(b, a, depth) as (select b, a, 1 from isa union all select t.b, isa.a, depth + 1 from t join isa on isa.b = t.a),
own as (select p_partkey as concept, p_size as v from part)
select concept, v, min(depth)::int as depth from (select concept, v, 0 as depth from own union all select t.b, v, depth from t join own on concept = t.a) group by concept, v""")
def inherited_values(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    up = p.where("p_partkey >= 3").select(F.expr("p_partkey div 3").alias("a"), F.col("p_partkey").alias("b"))
    return G.inherited(G.closure(up), p.select(F.col("p_partkey").alias("concept"), F.col("p_size").alias("v")), "v")


@query("""select 'out' as direction, 'locatedIn' as rel, 'r/' || n_regionkey as other, null::bigint as total from nation where n_nationkey = 3 union all
select direction, rel, other, total from (select 'in' as direction, 'locatedIn' as rel, x as other, count(*) over () as total from (select 's/' || s_suppkey as x from supplier where s_nationkey = 3 union all select 'c/' || c_custkey from customer where c_nationkey = 3) order by x limit 20)""")
def object_detail(spark, sf_dir):
    g = graph(spark, sf_dir).where("p in ('locatedIn', 'partOf')")
    return G.object_detail(g.select(F.lit("locatedIn").alias("rel"), F.col("s").alias("a"), F.col("o").alias("b")), "n/3", 20)


@query(f"""with {_GRAPH} select distinct '<' || s || '> <' || p || '> ' || case when k = 'literal' then '"' || o || '"' || case when lang is not null then '@' || lang else '' end else '<' || o || '>' end || ' .' as line from g""")
def turtle_lines(spark, sf_dir):
    return writers.ntriples(graph(spark, sf_dir))


_BODY = """
val as (select distinct s, p, case when k = 'literal' then '{{"@value":"' || o || '"' || case when lang is not null then ',"@language":"' || lang || '"' else '' end || '}}' else '{{"@id":"' || o || '"}}' end as v,
  '<x:' || p || case when k = 'literal' then case when lang is not null then ' xml:lang="' || lang || '"' else '' end || '>' || o || '</x:' || p || '>' else ' rdf:resource="' || o || '"/>' end as e from g),
pv as (select s, p, '"' || p || '":[' || string_agg(v, ',' order by v) || ']' as body from val group by s, p)
""".replace("{{", "{").replace("}}", "}")


@query(f"""with {_GRAPH}, {_BODY} select s, '{{"@id":"' || s || '",' || string_agg(body, ',' order by body) || '}}' as json from pv group by s""")
def json_ld(spark, sf_dir):
    return writers.json_ld(graph(spark, sf_dir))


@query(f"""with {_GRAPH}, {_BODY} select s, '<rdf:Description rdf:about="' || s || '">' || string_agg(e, '' order by e) || '</rdf:Description>' as xml from val group by s""")
def rdf_xml(spark, sf_dir):
    g = graph(spark, sf_dir).withColumn("p", F.concat(F.lit("http://x.org/"), "p"))
    return writers.rdf_xml(g, {"x": "http://x.org/"})


@query(f"with {_GRAPH}, own as (select * from g where s in ('n/1', 'n/2')) select s, p, o from own union all select s, p, o from g where s in (select o from own where k <> 'literal') and s not in ('n/1', 'n/2')")
def section_subgraph(spark, sf_dir):
    seeds = spark.createDataFrame([("n/1",), ("n/2",)], "s string")
    return writers.section_subgraph(graph(spark, sf_dir), seeds).select("s", "p", "o")


# ------------------------------------------------------------------ queries as text


QUESTIONS = (
    Question("members", "Who is in a nation?", "select ?s { ?s a <Supplier> ; <locatedIn> ?n . ?n <label> '$nation'@en }", ("n/3",), {"nation": "NATION_3"}),
    Question("places", "Which nations are in which region?", "select ?n ?r { ?n <partOf> ?x . ?x <label> ?r filter(lang(?r) = 'en') }"),
    Question("unnamed", "Which suppliers have no name?", "select ?s { ?s <type> <Supplier> filter not exists { ?s <label> ?l } }"),
    Question("doubts", "Whose place is doubted?", "select ?s ?n { ?s <doubted> ?n }"),
    Question("names", "What has two names?", "select distinct ?n { ?n <label> ?a . ?n <label> ?b filter(str(?a) < str(?b)) }"),
    Question("elsewhere", "Who is known elsewhere?", "select ?s ?e { ?s <sameAs> ?e filter(strstarts(str(?e), 'http://a.org/')) }"),
    Question("above", "What lies above a supplier?", "select ?s ?up { ?s <type> <Supplier> ; (<locatedIn>|<partOf>)+ ?up }"),
    Question("many", "Which nations have many customers?", "select ?n (count(?c) as ?k) { ?c <type> <Customer> ; <locatedIn> ?n } group by ?n having(count(?c) >= 5)"),
)


def _typed(spark, sf_dir):
    """The graph with the type predicate that ``a`` stands for next to its own."""
    g = graph(spark, sf_dir)
    return g.unionByName(g.where("p = 'type'").withColumn("p", F.lit("http://www.w3.org/1999/02/22-rdf-syntax-ns#type")))


@query("""select question, n::bigint as n from (values
  ('members', (select count(*) from supplier join nation on n_nationkey = s_nationkey where n_name = 'NATION_3')), ('places', (select count(*) from nation)),
  ('unnamed', (select count(*) from supplier where s_suppkey % 3 <> 0)), ('doubts', (select count(*) from supplier where s_acctbal < 0)), ('names', (select count(*) from nation where n_nationkey % 2 = 0)),
  ('elsewhere', (select count(*) from supplier where s_suppkey % 8 = 0)), ('above', (select 2 * count(*) from supplier)),
  ('many', (select count(*) from (select c_nationkey from customer group by 1 having count(*) >= 5)))) t(question, n)""")
def question_counts(spark, sf_dir):
    return row_counts(_typed(spark, sf_dir), QUESTIONS).select("question", "n")


@query("""select 's/' || s_suppkey as s, n_name as nation, case when s_suppkey % 3 = 0 then s_name end as name, s_acctbal < 0 as doubted
from supplier join nation on n_nationkey = s_nationkey""")
def text_select(spark, sf_dir):
    rows = answer(_typed(spark, sf_dir), """select ?s ?nation ?name (bound(?d) as ?doubted) where {
      ?s a <Supplier> ; <locatedIn> ?n . ?n <label> ?nation . filter(lang(?nation) = "en")
      optional { ?s <label> ?name filter(lang(?name) = "en") } optional { ?s <doubted> ?d } }""")
    return rows.withColumn("doubted", F.col("doubted") == "true")


@query("""select r_name as region, count(*)::bigint as customers, min(n_name) as first from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey
group by 1 having count(*) > 1 order by 2 desc, 1 limit 4""")
def text_grouped(spark, sf_dir):
    rows = answer(_typed(spark, sf_dir), """select ?region (count(?c) as ?customers) (min(?name) as ?first) {
      ?c a <Customer> ; <locatedIn> ?n . ?n <partOf>/<label> ?region ; <label> ?name filter(lang(?name) = "en") }
      group by ?region having(count(?c) > 1) order by desc(?customers) ?region limit 4""")
    return rows.withColumn("customers", F.col("customers").cast("long"))


@query("""select 'c/' || c_custkey as s, 'within' as p, 'r/' || n_regionkey as o from customer join nation on n_nationkey = c_nationkey
union select 's/' || s_suppkey, 'within', 'r/' || n_regionkey from supplier join nation on n_nationkey = s_nationkey where not s_acctbal < 0""")
def text_construct(spark, sf_dir):
    return answer(_typed(spark, sf_dir), """construct { ?x <within> ?r } where {
      { ?x a <Customer> } union { ?x a <Supplier> filter not exists { ?x <doubted> ?n } } ?x <locatedIn>/<partOf> ?r }""")
