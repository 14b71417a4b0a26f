"""Queries over derived views.  Claims are order lines, people parts, sections documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import views as V

from .registry import query, read
from .retrieval import _BM25, passages, sparse_pool, topics


def _dated(spark, sf_dir):
    """Births, deaths, floruits, ages and observations worded from order lines."""
    l = read(spark, sf_dir, "lineitem")
    s = lambda c: F.col(c).cast("int").cast("string")
    year = F.concat(F.lit("("), (F.col("l_quantity").cast("int") + 300).cast("string"), F.lit(" BCE)"))
    n = F.col("l_linenumber")
    value = (
        F.when(n == 1, F.concat(F.lit("Born "), year)).when(n == 2, F.concat(F.lit("Died aged "), s("l_quantity"), F.lit(", "), year))
        .when(n == 3, F.concat(F.lit("Flourished "), year)).when(n == 4, F.concat(F.lit("Was "), s("l_quantity"), F.lit(", "), year, F.lit(" and died")))
        .otherwise(F.concat(F.lit("Died aged "), s("l_quantity")))
    )
    sure = F.when(F.col("l_returnflag") == "A", "asserted").when(F.col("l_returnflag") == "N", "reported").otherwise("disputed")
    return l.select(
        F.col("l_partkey").cast("string").alias("subject"), F.when(n == 1, "birthDate").otherwise("deathDate").alias("property"), value.alias("value"),
        sure.alias("certainty"), (F.col("l_orderkey") * 10 + n).alias("ord"),
    )


_TIMELINE = """
c as (select l_partkey::varchar as name, l_linenumber as n, l_quantity::int as q, -(l_quantity::int + 300) as y,
  (case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end) * 100000000000 + l_orderkey * 10 + l_linenumber as o, l_orderkey * 10 + l_linenumber as ord from lineitem),
b as (select name, arg_min(y, o) filter (where n = 1) as born, arg_min(y, o) filter (where n = 2) as died, arg_min(y, o) filter (where n = 3) as floruit,
  arg_min(q, o) filter (where n in (2, 4) or n > 4) as age, arg_min(y - q, ord) filter (where n = 4) as ob, arg_min(y, ord) filter (where n = 4) as od from c group by name),
t as (select name, coalesce(born, died - age, ob) as birth, coalesce(died, born + age, od) as death, floruit, born is null and coalesce(born, died - age, ob) is not null as approx_birth, died is null and coalesce(died, born + age, od) is not null as approx_death
  from b where coalesce(born, died - age, ob) is not null or coalesce(died, born + age, od) is not null or floruit is not null),
m as (select 'm' || name as name, death - 10 - 50 as birth, death - 10 as death, null::int as floruit, true as approx_birth, true as approx_death from t where death is not null),
tl as (select *, coalesce(birth, floruit - 40, death - 70, 0) as anchor_year from (select * from t union all select * from m))
"""


def _timeline(spark, sf_dir):
    people = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("anchor"))
    members = people.select(F.concat(F.lit("m"), "anchor").alias("name"), "anchor", F.lit(10).alias("years"), F.lit(50).alias("age"))
    return V.timeline(_dated(spark, sf_dir), members)


@query(f"with {_TIMELINE} select * from tl")
def timeline(spark, sf_dir):
    return _timeline(spark, sf_dir)


@query(f"""with {_TIMELINE}, e as (select floor((min(least(birth, death, floruit)) - 20) / 50.0) * 50 as lo, ceil((max(greatest(birth, death, floruit)) + 20) / 50.0) * 50 as hi from tl)
select unnest(generate_series(lo::bigint, hi::bigint, 50)) as tick from e""")
def axis_ticks(spark, sf_dir):
    return V.axis_ticks(_timeline(spark, sf_dir))


@query("""with ev as (select 'P' || l_suppkey as label, l_suppkey as k, l_orderkey as subject, case when l_linenumber = 1 then 'deathPlace' else 'visited' end as property from lineitem where l_suppkey in (select s_suppkey from supplier where s_acctbal >= 0)),
acc as (select o_orderkey as subject, count(*) as c from orders where o_orderstatus = 'F' group by 1)
select label, count(*)::int as events, coalesce(sum(case when property = 'deathPlace' then c end), 0)::bigint as accounts from ev left join acc using (subject) group by label
union all select 'P' || s_suppkey, 0, 0 from supplier where s_acctbal < 2000 and 'P' || s_suppkey not in (select label from ev)""")
def place_events(spark, sf_dir):
    """Suppliers as places: those in credit have coordinates, those with little are mentioned."""
    l = read(spark, sf_dir, "lineitem")
    name = lambda c: F.concat(F.lit("P"), c.cast("string"))
    claims = l.select(F.col("l_orderkey").alias("subject"), F.when(F.col("l_linenumber") == 1, "deathPlace").otherwise("visited").alias("property"), name(F.col("l_suppkey")).alias("value"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    spots = lambda which: read(spark, sf_dir, "supplier").where(which).select(name(F.col("s_suppkey")).alias("label"), F.col("s_suppkey").cast("double").alias("lat"), F.lit(0.0).alias("lon"))
    accounts = read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("subject"), F.col("o_orderpriority").alias("account"))
    out = V.place_events(claims, spots("s_acctbal >= 0"), accounts, spots("s_acctbal < 2000"))
    told = F.aggregate("events", F.lit(0).cast("long"), lambda s, e: s + F.coalesce(F.size(e["accounts"]), F.lit(0)))
    return out.select("label", F.size("events").alias("events"), told.alias("accounts"))


@query("""select distinct l_partkey as work, l_suppkey as ref, case when l_linenumber = 1 then 'lost' when l_linenumber = 2 then 'extant' when l_linenumber = 3 then 'spurious' else 'disputed-authorship' end as status
from lineitem where l_linestatus = 'F' and (l_linenumber in (1, 2) or l_returnflag = 'R')""")
def work_transmission(spark, sf_dir):
    n = F.col("l_linenumber")
    note = F.when(n == 1, "BURNT, does not survive").when(n == 2, "it survives").when(n == 3, "perhaps spurious")
    rows = read(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_linestatus") == "F", "wrote").otherwise("read").alias("property"), F.col("l_partkey").alias("value"), F.col("l_suppkey").alias("ref"),
        note.alias("note"), F.when(F.col("l_returnflag") == "R", "disputed").otherwise("asserted").alias("certainty"),
    )
    return V.transmission(rows)


@query("""select case when p_size % 2 = 0 then 'place' else 'work' end as kind, p_name as name from part union select 'authority', p_brand from part where p_size % 5 = 0 union select 'authority', p_type from part union select 'authority', 'X' || (p_size % 7) from part""")
def entity_sets(spark, sf_dir):
    size = F.col("p_size")
    return V.entity_sets(read(spark, sf_dir, "part").select(
        F.when(size % 2 == 0, "place").otherwise("work").alias("value_type"), F.col("p_name").alias("value"), F.when(size % 5 == 0, F.col("p_brand")).alias("according_to"),
        F.array(F.col("p_type"), F.concat(F.lit("X"), (size % 7).cast("string"))).alias("chain"),
    ))


@query("""with l as (select o_custkey as pupil, o_orderkey % 700 as teacher, o_orderstatus = 'F' as asserted, o_orderkey as ord from orders where o_orderkey % 700 < 500 or o_orderkey % 700 in (select c_custkey from customer)),
f as (select pupil, arg_min(teacher, (case when asserted then 0 else 1000000000 end) + ord) as teacher, bool_or(asserted) as teacher_asserted from l group by pupil)
select c_custkey as name, c_nationkey as school, n_regionkey as anchor, teacher, teacher_asserted from customer join nation on n_nationkey = c_nationkey left join f on pupil = c_custkey""")
def associates(spark, sf_dir):
    members = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("name"), F.col("c_nationkey").alias("school"))
    founders = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("school"), F.col("n_regionkey").alias("founder"))
    links = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("pupil"), (F.col("o_orderkey") % 700).alias("teacher"), (F.col("o_orderstatus") == "F").alias("asserted"), F.col("o_orderkey").alias("ord"))
    return V.associates(members, founders, links, spark.range(500).select(F.col("id").alias("name")))


_GROUNDED = """
rt as (select query, doc as section, rank from sp where rank <= 8), mn as (select doc_id as section, doc_id % 30 as entity from documents union all select doc_id, doc_id % 37 from documents),
a as (select l_orderkey * 10 + l_linenumber as id, l_partkey % 30 as subject, case when l_linenumber <> 2 then l_suppkey % 37 end as object, l_orderkey % 1000 as section, l_returnflag as f from lineitem),
en as (select query, entity, min(rank) as er from rt join mn using (section) group by all),
tc as (select query, id, min(er) as er from en join (select id, subject as entity from a union select id, object from a where object is not null) using (entity) group by all),
gl as (select query, id, rank as passage_rank, row_number() over (partition by query order by rank, case f when 'A' then 0 when 'N' then 1 else 2 end, er, id) as place from tc join a using (id) join rt using (query, section))
"""


@query(f"with {_BM25}, {_GROUNDED} select query, place::int as place, id as assertion, passage_rank::int as passage_rank from gl where place <= 12")
def grounded_answer(spark, sf_dir):
    retrieved = sparse_pool(spark, sf_dir, 8).select("query", F.col("doc").alias("section"), "rank")
    d = read(spark, sf_dir, "documents")
    mentions = d.select(F.col("doc_id").alias("section"), F.explode(F.array(F.col("doc_id") % 30, F.col("doc_id") % 37)).alias("entity"))
    n = F.col("l_linenumber")
    sure = F.when(F.col("l_returnflag") == "A", "asserted").when(F.col("l_returnflag") == "N", "reported").otherwise("disputed")
    facts = read(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + n).alias("id"), (F.col("l_partkey") % 30).alias("subject"), F.when(n != 2, F.col("l_suppkey") % 37).alias("object"),
        (F.col("l_orderkey") % 1000).alias("section"), sure.alias("certainty"), V.verbalised(F.col("l_partkey").cast("string"), F.lit("knows"), F.col("l_suppkey").cast("string")).alias("text"),
    )
    return V.grounded_lines(retrieved, mentions, facts).select("query", "place", "assertion", "passage_rank")


@query(f"""with {_BM25}, s as (select doc, score from bm where query = 3)
select doc_id as doc, row_number() over (order by round(coalesce(score, 0), 9) desc, doc_id)::int as place from documents left join s on doc = doc_id where lower(source) in ('src1', 'src2') order by place limit 10""")
def layer_search(spark, sf_dir):
    from lectern.operators.retrieval import bm25_scores

    asked = topics(spark, sf_dir).where("query = 3")
    scores = bm25_scores(passages(spark, sf_dir), asked).select("doc", "score")
    out = V.layer_search(passages(spark, sf_dir).select("doc", "subject"), ["SRC1", "Src2"], scores, 10).select("doc")
    from pyspark.sql import Window

    again = out.join(scores, "doc", "left")
    return again.select("doc", F.row_number().over(Window.orderBy(F.round(F.coalesce("score", F.lit(0.0)), 9).desc(), "doc")).alias("place"))


@query("""with nm as (select n_name as name from nation where n_regionkey = 1 union select n_name from nation where n_nationkey in (0, 9))
select a.n_name as a, b.n_name as b from nation a join nation b on b.n_nationkey = (a.n_nationkey * 7 + 3) % 25 where a.n_name in (select name from nm) and b.n_name in (select name from nm)""")
def answer_subgraph(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    seeds = [r.n_name for r in n.where("n_nationkey in (0, 9)").collect()]  # two rows
    b = n.select(F.col("n_name").alias("b"), F.col("n_nationkey").alias("kb"))
    edges = n.join(b, F.col("kb") == (F.col("n_nationkey") * 7 + 3) % 25).select(F.col("n_name").alias("a"), "b")
    return V.answer_subgraph(n.where("n_regionkey = 1").select("n_name", "n_regionkey"), seeds, n.select(F.col("n_name").alias("name")), edges)


@query("""with d as (select doc_id as id, text, length(text) as n from documents)
select id, case when n >= 12 and doc.ok then 4 when n >= 3 then 2 else 1 end::int as pieces, md5(text) as text_md5 from d join (select doc_id, length(text) > 12 as ok from documents) doc on doc_id = id where n > 12""")
def rendered_text(spark, sf_dir):
    s = read(spark, sf_dir, "documents").where(F.length("text") > 12).select(F.col("doc_id").alias("id"), "text")
    at = lambda a, b, true=True: s.select("id", F.lit(a).alias("start"), F.lit(b).alias("end"), (F.substring("text", a + 1, b - a) if true else F.lit("stale")).alias("surface"), F.lit(f"{a}").alias("entity"))
    spans = at(0, 3).unionByName(at(2, 5)).unionByName(at(4, 6, False)).unionByName(at(6, 9)).unionByName(at(8, 10**6))
    out = V.rendered(s, spans)
    whole = F.array_join(F.transform("pieces", lambda p: p["text"]), "")
    return out.select("id", F.size("pieces").alias("pieces"), F.md5(whole.cast("binary")).alias("text_md5"))


@query(f"with {_BM25} select 'a' as run, count(distinct query)::bigint as topics, count(*)::bigint as lines, max(rank)::int as depth from sp")
def run_summary(spark, sf_dir):
    return V.run_summary(sparse_pool(spark, sf_dir).select(F.lit("a").alias("run"), F.col("query").alias("topic"), "rank"))


@query("""select 'b' || k as id, case when k <> 3 then 'pool ' || (k % 2) end as pool_label, 'j' || k as annotator, (select count(*) from documents where doc_id % 5 = k)::int as items, k in (1, 4) as submitted from range(5) t(k)""")
def batch_summaries(spark, sf_dir):
    k = F.col("doc_id") % 5
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    batches = read(spark, sf_dir, "documents").groupBy(k.alias("k")).agg(F.collect_list("doc_id").alias("items")).select(
        name("b", F.col("k")).alias("id"), F.when(F.col("k") == 3, 9).otherwise(F.col("k") % 2).alias("pool"), name("j", F.col("k")).alias("annotator"), "items"
    )
    pools = spark.createDataFrame([(0, "pool 0"), (1, "pool 1")], "pool long, label string")
    uploads = spark.createDataFrame([("b1",), ("b4",), ("b1",), (None,)], "batch string")
    return V.batch_summaries(batches, uploads, pools)


@query("select 'lang' as facet, coalesce(nullif(lang, 'de'), 'none') as value, count(*)::bigint as n from documents group by 2 union all select 'source', source, count(*) from documents group by 2")
def topic_breakdown(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select(F.nullif(F.col("lang"), F.lit("de")).alias("lang"), "source")
    return V.breakdown(rows, lang="none", source="none")


@query("select doc_id as item, row_number() over (order by doc_id)::int - 1 as place, md5(text) as text_md5 from documents where doc_id in (select doc_id from labels where toxic = 1)")
def blind_items(spark, sf_dir):
    """The batch of a judge who looks at what was marked toxic."""
    d = read(spark, sf_dir, "documents")
    marked = read(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").join(d.select("doc_id"), "doc_id").distinct()
    batch = marked.agg(F.sort_array(F.collect_list("doc_id")).alias("items"))
    out = V.blind_items(batch, d.select(F.col("doc_id").alias("item"), F.col("doc_id").alias("passage")), d.select(F.col("doc_id").alias("id"), "text"))
    return out.select("item", "place", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("select p_partkey, case when p_size % 4 = 0 or p_brand = 'Brand#2' then 'epigram' end as genre from part")
def verse_genres(spark, sf_dir):
    source = F.when(F.col("p_size") % 4 == 0, "Anth. Pal. 7.96").otherwise("fr. 3")
    return read(spark, sf_dir, "part").select("p_partkey", V.verse_genre(source, F.col("p_brand"), "Brand#2").alias("genre"))
