"""Filters, joins, aggregations, windows and sets on the collection's tables.

Sections are documents: ``ord`` is doc_id, the owner its source, and the short
reference doc_id modulo 200, so several sections share one.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import relational as O
from lectern.sources import readers

from .registry import query, read

OWNER = "'src' || (item_id % 20)"


def sections(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("ord"), (F.col("doc_id") % 200).alias("short"), F.col("source").alias("owner"), F.col("lang").alias("school"), "text", "n_chars")


def _src(n):
    return F.concat(F.lit("src"), (n % 20).cast("string"))


# ------------------------------------------------------------------ filters


@query("select doc_id, source from documents where lang = 'en' and contains(lower(source), 'c1')")
def filter_sections(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return O.matching(rows, equal={"lang": "en"}, contains={"source": "C1"}).select("doc_id", "source")


@query("select conv_id, turn, length(text)::int as n from conversations where lower(trim(role)) = 'user' and contains(lower(text), 'th')")
def filter_layer(spark, sf_dir):
    rows = O.matching(read(spark, sf_dir, "conversations"), equal_folded={"role": " User "}, contains={"text": "TH"})
    return rows.select("conv_id", "turn", F.length("text").alias("n"))


@query("""select p_partkey, p_name, (select count(*) from part where contains(lower(p_name), '1') or contains(lower(p_brand), '23') or contains(lower(p_type), 'xyz')) as total
from part where contains(lower(p_name), '1') or contains(lower(p_brand), '23') or contains(lower(p_type), 'xyz') order by p_partkey limit 25 offset 50""")
def entity_page(spark, sf_dir):
    rows = read(spark, sf_dir, "part").where(O.any_contains("1", F.col("p_name")) | O.any_contains("23", F.col("p_brand"), F.lit(None).cast("string")) | O.any_contains("XYZ", F.col("p_type")))
    return O.page(rows.select("p_partkey", "p_name"), "p_partkey", offset=50, limit=25)


@query("select l_orderkey, count(*)::bigint as lines from lineitem group by 1 having count_if(l_returnflag = 'R') > 0 and count_if(l_linestatus = 'O') = 0")
def exists_filter(spark, sf_dir):
    kinds = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("f"), F.collect_set("l_linestatus").alias("s"), F.count("*").alias("lines"))
    return kinds.where(F.exists("f", lambda x: x == "R") & ~F.exists("s", lambda x: x == "O")).select("l_orderkey", "lines")


@query("""
select 'dangling' as rule, doc_id::varchar as key from labels where doc_id not in (select doc_id from documents where doc_id % 3 <> 0)
union all select 'duplicate', md5(text) from documents group by text having count(*) > 1
union all select 'one side', n_regionkey::varchar from nation group by n_regionkey having n_regionkey not in (select r_regionkey from region where r_regionkey <> 2)
""")
def constraint_violations(spark, sf_dir):
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    regions = read(spark, sf_dir, "region").where("r_regionkey <> 2")
    return O.violations(
        dangling=O.dangling(labels, "doc_id", docs.where("doc_id % 3 <> 0"), "doc_id"),
        duplicate=O.duplicates(docs.select(F.md5(F.col("text").cast("binary")).alias("t")), "t"),
        **{"one side": O.mismatched(read(spark, sf_dir, "nation"), "n_regionkey", regions, "r_regionkey")},
    )


# ------------------------------------------------------------------ joins


@query("""select d.doc_id, l.quality, case when l.doc_id is null then 'none' else 'labelled' end as state from documents d left join labels l using (doc_id)""")
def corpus_left_join(spark, sf_dir):
    base = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    marks = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("string").alias("text_en"))
    out = readers.corpus(base, marks)
    return out.select(F.col("id").alias("doc_id"), F.col("text_en").cast("int").alias("quality"), F.when(F.col("text_en").isNull(), "none").otherwise("labelled").alias("state"))


@query(f"""select item_id as row, arg_min(doc_id, (case when source = {OWNER} then 0 else 1 end) * 1000000000 + doc_id) as id
from benchmark join documents on doc_id % 200 = item_id % 200 group by item_id""")
def ref_owner_resolve(spark, sf_dir):
    refs = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("row"), (F.col("item_id") % 200).alias("ref"), _src(F.col("item_id")).alias("owner"))
    return O.resolve_owned(refs, sections(spark, sf_dir))


@query("select item_id as row, doc_id as id from benchmark join documents on doc_id % 200 = item_id % 200")
def ref_all_candidates(spark, sf_dir):
    refs = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("row"), (F.col("item_id") % 200).alias("ref"))
    return O.resolve_all(refs, sections(spark, sf_dir))


@query(f"""with r as (select item_id as row, unnest([0, 1, 2]) as pos, {OWNER} as subj, 'src' || ((item_id + 3) % 20) as obj, item_id from benchmark),
c as (select row, doc_id, (case when source = subj then 0 when source = obj then 1 else 2 end) as p, pos, doc_id as ord
  from r join documents on doc_id % 200 = (case pos when 0 then item_id + 190 when 1 then item_id + 500 else item_id * 3 end)),
b as (select row, arg_min(doc_id, p * 100000000000000 + pos * 10000000000000 + ord) as id from c group by row)
select item_id as row, id from benchmark left join b on row = item_id""")
def ref_three_pass(spark, sf_dir):
    i = F.col("item_id")
    rows = read(spark, sf_dir, "benchmark").select(i.alias("row"), F.array(i + 190, i + 500, i * 3).alias("refs"), _src(i).alias("subject"), _src(i + 3).alias("object"))
    return O.resolve_passes(rows, sections(spark, sf_dir))


@query("""select item_id as row, doc_id as id from benchmark join documents on doc_id % 200 = item_id % 200 where item_id % 4 <> 0
union select item_id, 7 from benchmark where item_id % 4 = 0""")
def ref_pinned(spark, sf_dir):
    refs = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("row"), (F.col("item_id") % 200).alias("ref"))
    pins = refs.where("row % 4 = 0").withColumn("id", F.lit(7).cast("long"))
    return O.resolve_pinned(refs, sections(spark, sf_dir), pins)


@query("""select o_custkey as pupil, arg_min(o_orderkey, (case when o_orderpriority like '1%' then 0 else 1 end) * 1000000000::bigint + o_orderkey) as teacher from orders group by 1""")
def best_associate(spark, sf_dir):
    edges = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("pupil"), F.col("o_orderkey").alias("teacher"), F.startswith("o_orderpriority", F.lit("1")).alias("asserted"), F.col("o_orderkey").alias("ord"))
    return O.best_associate(edges).select("pupil", "teacher")


@query("""with t as (select distinct l_partkey as work, l_suppkey as title from lineitem)
select distinct x.work as a, y.work as b from t x join t y using (title) where x.work < y.work""")
def shared_titles(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem")
    return O.shared_title_pairs(rows.select(F.col("l_partkey").alias("work"), F.col("l_suppkey").alias("title")))


@query("""with n as (select distinct c_custkey as entity, c_nationkey * 100 + (round(c_acctbal)::bigint % 40) as slug from customer)
select slug, x.entity as a, y.entity as b from n x join n y using (slug) where x.entity < y.entity and not (x.entity % 10 = 3 and y.entity % 10 = 7)""")
def homonym_pairs(spark, sf_dir):
    slug = F.col("c_nationkey") * 100 + F.round(F.col("c_acctbal")).cast("long") % 40
    names = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity"), slug.alias("slug"))
    pairs = O.homonyms(names)
    same = pairs.where("a % 10 = 3 and b % 10 = 7").select("a", "b")
    return O.homonyms(names, same)


@query("""select slug, count(distinct c_custkey)::bigint as n from (select c_custkey, c_nationkey * 100 + round(c_acctbal)::bigint % 40 as slug from customer) group by slug having count(distinct c_custkey) > 1""")
def slug_collisions(spark, sf_dir):
    slug = F.col("c_nationkey") * 100 + F.round(F.col("c_acctbal")).cast("long") % 40
    return O.collisions(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity"), slug.alias("slug")))


@query("""with s as (select l_orderkey as key, l_partkey % 500 as "start", l_partkey % 500 + l_quantity::bigint as "end", l_linenumber as n, l_returnflag as f from lineitem)
select key, n, exists (select 1 from s b where b.key = a.key and b.f = 'R' and b."start" < a."end" and b."end" > a."start") as covered from s a where f = 'A'""")
def covered_spans(spark, sf_dir):
    start = F.col("l_partkey") % 500
    s = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), start.alias("start"), (start + F.col("l_quantity").cast("long")).alias("end"), F.col("l_linenumber").alias("n"), F.col("l_returnflag").alias("f"))
    a, b = s.where("f = 'A'"), s.where("f = 'R'")
    mark = lambda df, yes: df.select("key", "n", F.lit(yes).alias("covered"))
    return mark(O.covered(a, b), True).unionByName(mark(O.uncovered(a, b), False))


@query("""select s_suppkey as row, coalesce(case when s_suppkey % 3 = 0 then (select 'E' || n_nationkey from nation where n_nationkey = s_nationkey) end,
  case when s_suppkey % 2 = 0 then 'E' || (s_suppkey % 25) end, 'new:label ' || s_suppkey) as target from supplier""")
def source_reconcile(spark, sf_dir):
    k = F.col("s_suppkey")
    rows = read(spark, sf_dir, "supplier").select(
        k.alias("row"), F.when(k % 3 == 0, F.concat(F.lit("Q"), F.col("s_nationkey").cast("string"))).alias("qid"),
        F.when(k % 2 == 0, F.concat(F.lit("nation "), (k % 25).cast("string"))).otherwise(F.concat(F.lit("label "), k.cast("string"))).alias("label"),
    )
    n = F.col("n_nationkey").cast("string")
    entities = read(spark, sf_dir, "nation").select(F.concat(F.lit("E"), n).alias("entity"), F.concat(F.lit("Q"), n).alias("qid"), F.concat(F.lit("nation "), n).alias("label"))
    return O.reconcile(rows, entities)


@query("select n_nationkey, case when n_nationkey in (3, 5) then 'patched' else n_name end as n_name, case when n_nationkey = 5 then 9 else n_regionkey end as n_regionkey from nation")
def patched_rows(spark, sf_dir):
    patches = spark.createDataFrame([(3, "patched", None), (5, "patched", 9)], "n_nationkey int, n_name string, n_regionkey int")
    return O.patched(read(spark, sf_dir, "nation"), patches, "n_nationkey", ["n_name", "n_regionkey"])


_CLAIMS = """claims as (select l_orderkey * 10 + l_linenumber as id, l_partkey % 97 as subject, l_suppkey % 5 as property, l_orderkey % 97 as value, l_orderkey * 10 + 1 as rival from lineitem),
asked as (select unnest(range(0, 30)) as subject, 2 as property)"""


@query(f"""with {_CLAIMS},
base as (select a.subject, a.property, id, rival, 'direct' as how from asked a join claims c on c.subject = a.subject and c.property = a.property
  union all select a.subject, a.property, id, rival, 'reverse' from asked a join claims c on c.value = a.subject and c.property = a.property),
every as (select subject, property, id, how from base union all select subject, property, rival, 'rival' from base where rival in (select id from claims))
select subject, property, id, min(how) as how from every group by all""")
def claim_answers(spark, sf_dir):
    c = read(spark, sf_dir, "lineitem")
    claims = c.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_partkey") % 97).alias("subject"), (F.col("l_suppkey") % 5).alias("property"),
        (F.col("l_orderkey") % 97).alias("value"), F.array(F.col("l_orderkey") * 10 + 1).alias("conflicts"),
    )
    asked = spark.range(30).select(F.col("id").alias("subject"), F.lit(2).cast("long").alias("property"))
    return O.claim_answers(claims, asked)


# ------------------------------------------------------------------ aggregations


@query("select event_type as key, count(*)::bigint as n, min(event_id) as first from events where event_type is not null group by 1")
def tally(spark, sf_dir):
    return O.tally(read(spark, sf_dir, "events").withColumnRenamed("event_id", "ord"), F.col("event_type"))


@query("select source, lang, count(*)::bigint as n, min(doc_id) as first_id, arg_min(n_chars, doc_id) as first_chars from documents group by all")
def chapter_rollup(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.min_by("n_chars", "doc_id").alias("first_chars"))


@query("""select count(*)::bigint as rows, count(distinct source)::bigint as sources, count(l.quality)::bigint as labelled, count_if(l.quality = 1)::bigint as good from documents d left join labels l using (doc_id)""")
def global_counts(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "source").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    return d.agg(F.count("*").alias("rows"), F.countDistinct("source").alias("sources"), F.count("quality").alias("labelled"), F.count_if(F.col("quality") == 1).alias("good"))


@query("""select source, count(*)::bigint as documents, count_if(doc_id in (select doc_id from labels))::bigint as labels, count_if(doc_id in (select doc_id from labels where toxic = 1))::bigint as toxic from documents group by source""")
def coverage_matrix(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "source")
    marks = read(spark, sf_dir, "labels")
    of = lambda m: d.join(m.select("doc_id").distinct(), "doc_id", "left_semi")
    return O.layer_matrix({"documents": d, "labels": of(marks), "toxic": of(marks.where("toxic = 1"))}, "source")


@query("select count(distinct (least(l_suppkey, l_partkey), greatest(l_suppkey, l_partkey)))::bigint as pairs from lineitem")
def distinct_pairs(spark, sf_dir):
    return O.distinct_pairs(read(spark, sf_dir, "lineitem"), "l_suppkey", "l_partkey")


@query("select l_orderkey, case when count(f) = count(*) and min(f) = max(f) then min(f) end as f from (select l_orderkey, nullif(l_returnflag, 'N') as f from lineitem) group by 1")
def all_agree(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", F.nullif(F.col("l_returnflag"), F.lit("N")).alias("f"))
    return O.all_agree(rows, "l_orderkey", "f")


@query("""select l_partkey, arg_min(l_quantity::int, (case l_returnflag when 'A' then 0 when 'N' then 1 when 'R' then 2 else 4 end) * 10000000000 + l_orderkey * 10 + l_linenumber) as year from lineitem group by 1""")
def best_certainty(spark, sf_dir):
    name = F.element_at(F.create_map(F.lit("A"), F.lit("asserted"), F.lit("N"), F.lit("reported"), F.lit("R"), F.lit("disputed")), F.col("l_returnflag"))
    rows = read(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_quantity").cast("int").alias("year"), name.alias("certainty"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    return O.best_value(rows, ["l_partkey"], "year", O.certainty_rank(F.col("certainty")))


_STOPS = """s as (select o_custkey as person, (floor(o_totalprice)::bigint % 7) as place, case o_orderpriority when '1-URGENT' then 0 when '5-LOW' then 2 else 1 end as phase, o_orderkey as ord from orders)"""


@query(f"with {_STOPS} select person, array_to_string(list(place order by phase, ord), '>') as places, count(*)::int as n from s group by person having count(distinct place) >= 2")
def itineraries(spark, sf_dir):
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "birth").when(F.col("o_orderpriority") == "5-LOW", "death").otherwise("stay")
    stops = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("person"), (F.floor("o_totalprice").cast("long") % 7).alias("place"), kind.alias("kind"), F.col("o_orderkey").alias("ord"))
    out = O.itineraries(stops)
    return out.select("person", F.array_join(F.transform("places", lambda p: p.cast("string")), ">").alias("places"), "n")


@query("""with e as (select l_partkey as person, case l_linenumber when 1 then 'birth' when 2 then 'death' when 3 then 'floruit' else 'age' end as role, (l_quantity * case when l_linenumber > 3 then 3 else -10 end)::int as year,
  case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end as rank, l_orderkey * 10 + l_linenumber as ord from lineitem),
p as (select person, arg_min(year, rank * 10000000000 + ord) filter (where role = 'birth') as b, arg_min(year, rank * 10000000000 + ord) filter (where role = 'death') as d,
  arg_min(year, rank * 10000000000 + ord) filter (where role = 'floruit') as f, arg_min(year, rank * 10000000000 + ord) filter (where role = 'age') as a0 from e group by person),
q as (select *, case when a0 <= 110 then a0 end as a from p)
select person, coalesce(b, d - a) as birth, coalesce(d, b + a) as death, f as floruit, (b is null and coalesce(b, d - a) is not null) or (d is null and coalesce(d, b + a) is not null) as derived from q""")
def life_spans(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem")
    n = F.col("l_linenumber")
    events = rows.select(
        F.col("l_partkey").alias("person"), F.when(n == 1, "birth").when(n == 2, "death").when(n == 3, "floruit").otherwise("age").alias("role"),
        (F.col("l_quantity") * F.when(n > 3, 3).otherwise(-10)).cast("int").alias("year"), F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("rank"),
        (F.col("l_orderkey") * 10 + n).alias("ord"),
    )
    return O.life_spans(events)


@query("""select p_brand, min(-y)::int as first, max(-y)::int as last, bool_or(p_size > 25) as approx, count(distinct p_type)::bigint as refs
from (select p_brand, p_size, p_type, unnest([100 + p_size, 80 + p_size]) as y from part) group by p_brand""")
def chronology_bounds(spark, sf_dir):
    size = F.col("p_size")
    gloss = F.concat(F.lit("born ("), F.when(size > 25, "c. ").otherwise(""), (size + 100).cast("string"), F.lit(" BCE) and ("), (size + 80).cast("string"), F.lit(" BCE)"))
    out = O.year_bounds(read(spark, sf_dir, "part").select("p_brand", gloss.alias("t"), F.col("p_type").alias("ref")), "p_brand", "t")
    return out.select("p_brand", "first", "last", "approx", F.size("refs").cast("long").alias("refs"))


@query("select event_type, list_sort(list(value))[(count(*) // 2 + 1)::int] as median from events group by 1")
def upper_median(spark, sf_dir):
    return O.upper_median(read(spark, sf_dir, "events"), ["event_type"], "value")


@query("select role, count(*)::bigint as n, round(100.0 * count(*) / sum(count(*)) over ()) as share from conversations group by role")
def grade_shares(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations")
    total = rows.agg(F.count("*").alias("t"))
    return rows.groupBy("role").agg(F.count("*").alias("n")).join(F.broadcast(total), how="cross").select("role", "n", F.round(100.0 * F.col("n") / F.col("t")).alias("share"))


@query("""select coalesce(lang, 'all') as lang, coalesce(source, 'all') as source, count(*)::bigint as n from documents group by grouping sets ((lang), (source), ())""")
def overview_sets(spark, sf_dir):
    read(spark, sf_dir, "documents").createOrReplaceTempView("_overview_documents")
    return spark.sql("select coalesce(lang, 'all') as lang, coalesce(source, 'all') as source, count(*) as n from _overview_documents group by grouping sets ((lang), (source), ())")


# ------------------------------------------------------------------ windows and order


@query("select conv_id, turn, lag(turn) over w as prev, lead(role) over w as next_role from conversations window w as (partition by conv_id order by turn)")
def prev_next(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    out = O.neighbours_in_order(rows, "turn", "turn", ["conv_id"]).drop("next")
    return O.neighbours_in_order(out.withColumnRenamed("prev", "p"), "role", "turn", ["conv_id"]).select("conv_id", "turn", F.col("p").alias("prev"), F.col("next").alias("next_role"))


@query("select doc_id as id, case when row_number() over (partition by doc_id % 200 order by doc_id) = 1 then 's' || (doc_id % 200) else 'full ' || doc_id end as shorthand from documents")
def first_writer_shorthand(spark, sf_dir):
    s = sections(spark, sf_dir).select("id", "ord", F.concat(F.lit("s"), F.col("short").cast("string")).alias("short"), F.concat(F.lit("full "), F.col("id").cast("string")).alias("full"))
    return O.first_writer(s, "short", "full").select("id", "shorthand")


@query("""with s as (select l_orderkey % 10 as b, case when l_linenumber = 1 then 'prol' else l_linenumber::varchar end as c, l_partkey as n, min(l_orderkey) as k from lineitem group by 1, 2, 3)
select b || '.' || c || '.' || n || case when k % 2 = 0 then 'a' else '' end as id, row_number() over (order by b, coalesce(try_cast(c as int), -1), n, case when k % 2 = 0 then 'a' else '' end)::int as place from s""")
def section_order(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem")
    chapter = F.when(F.col("l_linenumber") == 1, "prol").otherwise(F.col("l_linenumber").cast("string"))
    one = rows.groupBy((F.col("l_orderkey") % 10).alias("b"), chapter.alias("c"), "l_partkey").agg(F.min("l_orderkey").alias("k"))
    name = F.concat_ws(".", F.col("b").cast("string"), "c", F.concat(F.col("l_partkey").cast("string"), F.when(F.col("k") % 2 == 0, "a").otherwise("")))
    ids = one.select(name.alias("id"))
    book, chapter, *rest = O.section_order(F.col("id"))
    return O.placed(ids, [book, chapter], rest).select("id", F.col("place").cast("int").alias("place"))


@query("""with m as (select user_id, event_type, ts, event_id, case when event_type is not distinct from lag(event_type) over w and row_number() over w > 1 then 0 else 1 end as c from events window w as (partition by user_id order by ts, event_id)),
r as (select *, sum(c) over (partition by user_id order by ts, event_id) as run from m)
select user_id, run::bigint as run, any_value(event_type) as event_type, count(*)::bigint as n from r group by user_id, run""")
def run_islands(spark, sf_dir):
    events = read(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id"))
    return O.runs(events, ["user_id"], "event_type", "at").select("user_id", "run", "event_type", "n")


@query("select doc_id, sha2 as key, row_number() over (order by sha2)::int as place from (select doc_id, sha256('seed' || chr(0) || doc_id) as sha2 from documents)")
def hash_shuffle(spark, sf_dir):
    from lectern.operators.evaluation import shuffle_key

    rows = read(spark, sf_dir, "documents").select("doc_id", shuffle_key("seed", F.col("doc_id").cast("string")).alias("key"))
    return O.placed(rows, [F.substring("key", 1, 3)], ["key", "doc_id"]).withColumn("place", F.col("place").cast("int"))


@query("select p_partkey, row_number() over (order by case when p_size > 25 then null else p_size end asc nulls last, p_partkey)::int as up from part")
def undefined_last(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") <= 25, F.col("p_size")).alias("key"))
    lead = [F.col("key").isNull(), F.coalesce("key", F.lit(0))]
    return O.placed(rows, lead, ["p_partkey"], "up").select("p_partkey", F.col("up").cast("int").alias("up"))


@query("""with recursive r as (select conv_id, turn, length(text) as n, row_number() over (partition by conv_id order by turn) as i from conversations),
f as (select conv_id, turn, i, case when n <= 400 then n else 0 end as used, n <= 400 as kept from r where i = 1
  union all select r.conv_id, r.turn, r.i, f.used + case when f.used + r.n <= 400 then r.n else 0 end, f.used + r.n <= 400 from f join r on r.conv_id = f.conv_id and r.i = f.i + 1)
select conv_id, turn from f where kept""")
def greedy_budget(spark, sf_dir):
    items = read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("ord"), F.length("text").cast("long").alias("n"))
    return O.greedy_budget(items, "conv_id", "n", 400).select("conv_id", F.col("ord").alias("turn"))


@query("""with s as (select l_orderkey as key, (l_partkey % 60)::int as "start", (l_partkey % 60 + l_quantity)::int as "end", l_returnflag = 'R' as heuristic, l_linenumber as n from lineitem),
o as (select *, row_number() over (partition by key order by "start", "end" desc, heuristic, n) as i from s),
f as (with recursive g as (select key, i, "start", "end", n, "end" as last, true as kept from o where i = 1
  union all select o.key, o.i, o."start", o."end", o.n, case when o."start" >= g.last then o."end" else g.last end, o."start" >= g.last from g join o on o.key = g.key and o.i = g.i + 1) select * from g)
select key, "start", "end", n from f where kept""")
def overlap_resolve(spark, sf_dir):
    start = (F.col("l_partkey") % 60).cast("int")
    s = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), start.alias("start"), (start + F.col("l_quantity")).cast("int").alias("end"), (F.col("l_returnflag") == "R").alias("heuristic"), F.col("l_linenumber").alias("n"))
    return O.overlaps_resolved(s, "key").select("key", "start", "end", "n")


@query("""with f as (select c_custkey as entity, c_name as label, c_nationkey as uses, case when starts_with(lower(c_name), 'customer#000000010') then 0 when levenshtein(lower(c_name), 'customer#000000010') <= 2 then levenshtein(lower(c_name), 'customer#000000010') end as score from customer)
select entity, label, score::int as score from f where score is not null order by score, label, uses desc, entity limit 9""")
def edit_distance_suggest(spark, sf_dir):
    names = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_name").alias("label"), F.col("c_nationkey").alias("uses"))
    return O.suggestions(names, "customer#000000010").select("entity", "label", "score")


# ------------------------------------------------------------------ sets


@query("""select 'missing' as side, doc_id from (select doc_id from documents where doc_id % 5 <> 0 except all select doc_id from documents where doc_id % 7 <> 0)
union all select 'extra', doc_id from (select doc_id from documents where doc_id % 7 <> 0 except all select doc_id from documents where doc_id % 5 <> 0)""")
def set_drift(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return O.drift(d.where("doc_id % 5 <> 0"), d.where("doc_id % 7 <> 0"), "doc_id").select("side", "doc_id")


@query("select n_name as label, 'nation' as kind from nation union all select r_name, 'region' from region where r_name not in (select n_name from nation)")
def union_minus(spark, sf_dir):
    a = read(spark, sf_dir, "nation").select(F.col("n_name").alias("label"), F.lit("nation").alias("kind"))
    b = read(spark, sf_dir, "region").select(F.col("r_name").alias("label"), F.lit("region").alias("kind"))
    return a.unionByName(b.join(a, "label", "left_anti"))


@query("""select l_orderkey, l_returnflag from lineitem x group by 1, 2 having count(distinct l_linenumber) = (select count(distinct l_linenumber) from lineitem y where y.l_orderkey = x.l_orderkey)""")
def shared_by_all(spark, sf_dir):
    return O.shared_by_all(read(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag", "l_linenumber")
