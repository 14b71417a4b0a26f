"""Evaluation of rankings over benchmark topics and labels.

Topics are benchmark items; a document that holds a whole item is relevant to it
(grade 2), one that shares its subject number is slightly relevant (grade 1).  Labels play judges: quality and toxic are two annotators,
quality again with every fifth grade turned round is a third.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import evaluation as E

from .registry import query, read
from .retrieval import _BM25, _DENSE, dense_pool, sparse_pool

def qrels(spark, sf_dir):
    """topic, passage, grade."""
    items = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("topic"), F.col("text").alias("needle"))
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("passage"), "text")
    hits = E.holding(docs, items).select("topic", "passage", F.lit(2.0).alias("grade"))
    weak = docs.select((F.col("passage") % 250).alias("topic"), "passage", F.lit(1.0).alias("grade"))
    return hits.unionByName(weak.join(items.select("topic"), "topic", "left_semi")).groupBy("topic", "passage").agg(F.max("grade").alias("grade"))


def topic_list(spark, sf_dir):
    i = F.col("item_id")
    kinds = F.array(*map(F.lit, E.ABSTAIN_TYPES))
    abstain = i % 8 == 5
    return read(spark, sf_dir, "benchmark").select(
        i.alias("topic"), abstain.alias("must_abstain"), F.when(abstain, F.element_at(kinds, (F.floor(i / 8) % 3 + 1).cast("int"))).alias("abstain_type"),
        F.when(i % 10 == 4, F.lit("dataset_aggregate")).alias("reason"),
    )


def run_lines(spark, sf_dir, which):
    pool = sparse_pool(spark, sf_dir) if which == "sparse" else dense_pool(spark, sf_dir)
    return pool.select(F.col("query").alias("topic"), F.col("doc").alias("passage"), "rank")


_QRELS = f"""
qr as (select topic, passage, max(grade) as grade from (
  select item_id as topic, doc_id as passage, 2.0::double as grade from benchmark b join documents d on contains(d.text, b.text)
  union all select doc_id % 250, doc_id, 1.0 from documents where doc_id % 250 in (select item_id from benchmark)) group by all),
tp as (select item_id as topic, item_id % 8 = 5 as must_abstain, case when item_id % 8 = 5 then ['false_premise', 'underspecified', 'homonym'][(item_id // 8 % 3 + 1)::int] end as abstain_type,
  case when item_id % 10 = 4 then 'dataset_aggregate' end as reason from benchmark),
ideal as (select topic, count(*) as n_relevant, sum(case when i <= 10 then grade / log2(i + 1) else 0 end) as ideal from (select *, row_number() over (partition by topic order by grade desc, passage) as i from qr) group by topic)
"""


def _scored_sql(pool: str) -> str:
    return f"""
hit_{pool} as (select query as topic, min(rank) as first_rank, count(*) as k, sum(grade / log2(rank + 1)) as dcg from {pool} join qr on topic = query and passage = doc where rank <= 10 group by query),
sc_{pool} as (select tp.*, coalesce(n_relevant, 0) as n_relevant, first_rank, coalesce(k, 0) as relevant_in_k, coalesce(dcg, 0) as dcg, coalesce(ideal, 0) as ideal
  from tp left join ideal using (topic) left join hit_{pool} using (topic))"""


@query(f"with {_BM25}, {_QRELS}, {_scored_sql('sp')} select topic, n_relevant::bigint as n_relevant, first_rank::int as first_rank, relevant_in_k::bigint as relevant_in_k, round(dcg, 6) as dcg, round(ideal, 6) as ideal from sc_sp")
def topic_scores(spark, sf_dir):
    out = E.score_topics(run_lines(spark, sf_dir, "sparse"), qrels(spark, sf_dir), topic_list(spark, sf_dir))
    return out.select("topic", "n_relevant", "first_rank", "relevant_in_k", F.round("dcg", 6).alias("dcg"), F.round("ideal", 6).alias("ideal"))


def _metrics_sql(pool: str) -> str:
    return f"""select '{pool}' as system, count_if(not (n_relevant = 0 and reason is not null))::bigint as n_topics, count_if(n_relevant > 0)::bigint as n_scored, count_if(n_relevant = 0 and reason is not null)::bigint as n_excluded,
  round(coalesce(avg(coalesce(1.0 / first_rank, 0)) filter (where n_relevant > 0), 0), 6) as mrr, round(coalesce(avg(relevant_in_k / n_relevant) filter (where n_relevant > 0), 0), 6) as recall,
  round(coalesce(avg(case when ideal > 0 then dcg / ideal else 0 end) filter (where n_relevant > 0), 0), 6) as ndcg, round(coalesce(avg(case when first_rank is not null then 1.0 else 0.0 end) filter (where n_relevant > 0), 0), 6) as hit
  from sc_{pool} where not must_abstain"""


@query(f"with {_BM25}, {_DENSE}, {_QRELS}, {_scored_sql('sp')}, {_scored_sql('dn')} {_metrics_sql('sp')} union all {_metrics_sql('dn')}")
def metrics_at_k(spark, sf_dir):
    rel, topics = qrels(spark, sf_dir), topic_list(spark, sf_dir)
    rows = [E.score_topics(run_lines(spark, sf_dir, w), rel, topics).withColumn("system", F.lit(n)) for w, n in (("sparse", "sp"), ("dense", "dn"))]
    out = E.run_metrics(rows[0].unionByName(rows[1]), "system")
    return out.select("system", "n_topics", "n_scored", "n_excluded", *[F.round(c, 6).alias(c) for c in ("mrr", "recall", "ndcg", "hit")])


@query(f"""with {_BM25}, {_QRELS}, {_scored_sql('sp')}
select k as abstain_type, count(topic)::bigint as n_topics, coalesce(sum(case when n_relevant > 0 then 1 else 0 end), 0)::bigint as n_with_evidence, coalesce(sum(case when n_relevant > 0 and first_rank is not null then 1 else 0 end), 0)::bigint as evidence_hit
from (values ('false_premise'), ('underspecified'), ('homonym')) v(k) left join sc_sp on abstain_type = k and must_abstain group by k""")
def abstain_report(spark, sf_dir):
    return E.abstain_report(E.score_topics(run_lines(spark, sf_dir, "sparse"), qrels(spark, sf_dir), topic_list(spark, sf_dir)))


@query(f"""with {_BM25}, {_DENSE}, {_QRELS}, {_scored_sql('sp')}, {_scored_sql('dn')}
select topic, a.first_rank::int as rank_a, b.first_rank::int as rank_b, case when a.first_rank is null and b.first_rank is null then 'both miss' when coalesce(a.first_rank, 1000) < coalesce(b.first_rank, 1000) then 'A wins' else 'B wins' end as outcome
from sc_sp a full join sc_dn b using (topic) where (a.first_rank is null and b.first_rank is null) or a.first_rank is distinct from b.first_rank""")
def run_compare(spark, sf_dir):
    rel, topics = qrels(spark, sf_dir), topic_list(spark, sf_dir)
    a, b = (E.score_topics(run_lines(spark, sf_dir, w), rel, topics) for w in ("sparse", "dense"))
    return E.compare_runs(a, b)


def _runs(spark, sf_dir):
    return run_lines(spark, sf_dir, "sparse").withColumn("run", F.lit("a")).unionByName(run_lines(spark, sf_dir, "dense").withColumn("run", F.lit("b")))


_POOL = """pl as (select 'p1:' || topic || ':' || passage as item, topic, passage, array_to_string(list_sort(list(distinct run)), ',') as from_runs, sha256('p1' || chr(0) || 'p1:' || topic || ':' || passage) as shuffle
  from (select query as topic, doc as passage, rank, 'a' as run from sp union all select query, doc, rank, 'b' from dn) where rank <= 5 group by topic, passage)"""


@query(f"with {_BM25}, {_DENSE}, {_POOL} select * from pl")
def pool_union(spark, sf_dir):
    out = E.pool(_runs(spark, sf_dir), 5, "p1")
    return out.select("item", "topic", "passage", F.array_join("from_runs", ",").alias("from_runs"), "shuffle")


def judgments(spark, sf_dir):
    """item, annotator, grade: quality and toxic as two judges, a third one for every third document."""
    l = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("item"), F.col("quality"), F.col("toxic"))
    third = F.when(F.col("item") % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality"))
    g = lambda name, c, rows=l: rows.select("item", F.lit(name).alias("annotator"), c.alias("grade"))
    return g("q", F.col("quality")).unionByName(g("t", F.col("toxic"))).unionByName(g("z", third, l.where("item % 3 = 0")))


def resolved(spark, sf_dir):
    marks = judgments(spark, sf_dir)
    ruled = read(spark, sf_dir, "labels").where("doc_id % 11 = 0").select(F.col("doc_id").alias("item"), F.lit(9).alias("grade"))
    targets = read(spark, sf_dir, "documents").where("doc_id % 2 = 0 or doc_id % 3 = 0").select(F.col("doc_id").alias("item"), F.when(F.col("doc_id") % 3 == 0, 3).otherwise(2).alias("target"))
    return E.resolve_items(marks, ruled, targets)


_JUDGED = """
jd as (select doc_id as item, 'q' as annotator, quality as grade from labels union all select doc_id, 't', toxic from labels
  union all select doc_id, 'z', case when doc_id % 5 = 0 then 1 - quality else quality end from labels where doc_id % 3 = 0),
ct as (select item, grade, count(*) as c from jd group by all),
bt as (select item, sum(c) as n, count(*) as grades, arg_min(grade, -c * 100 + grade) as top, max(c) as topc from ct group by item),
rs0 as (select doc_id as item, case when doc_id % 3 = 0 then 3 else 2 end as target, coalesce(n, 0) as n, coalesce(grades, 0) as grades, top,
  case when doc_id % 11 = 0 and doc_id in (select doc_id from labels) then 'adjudicated' when coalesce(n, 0) >= case when doc_id % 3 = 0 then 3 else 2 end and grades = 1 then 'unanimous'
    when doc_id % 3 = 0 and topc * 2 > 3 then 'majority' end as method from documents left join bt on item = doc_id where doc_id % 2 = 0 or doc_id % 3 = 0),
rs as (select *, case when method = 'adjudicated' then 9 when method is not null then top end as grade from rs0)
"""


@query(f"with {_JUDGED} select item, target::int as target, n::bigint as n, grades::bigint as grades, method, grade::int as grade from rs")
def qrels_resolve(spark, sf_dir):
    return resolved(spark, sf_dir)


@query(f"""with {_JUDGED} select count_if(n = 0)::bigint as zero, count_if(n = 1)::bigint as one, count_if(n >= 2)::bigint as two_plus, count_if(n >= target)::bigint as complete,
  count_if(method = 'unanimous')::bigint as unanimous, count_if(method = 'majority')::bigint as majority, count_if(method = 'adjudicated')::bigint as adjudicated,
  count_if(method is null and n >= target)::bigint as needs_arbitration, count_if(method is null and n < target and target > 2 and n >= 2)::bigint as awaiting_third from rs""")
def pool_coverage(spark, sf_dir):
    return E.coverage(resolved(spark, sf_dir), 2)


@query(f"with {_JUDGED} select item, case when method = 'adjudicated' then 'adjudicated' when n < target then 'awaiting_third' else 'deadlock' end as state from rs where n >= 2 and grades > 1 and (method is null or method = 'adjudicated')")
def pool_disagreements(spark, sf_dir):
    return E.disagreements(resolved(spark, sf_dir))


def _items(spark, sf_dir):
    key = F.col("doc_id").cast("string")
    return read(spark, sf_dir, "documents").where("doc_id % 2 = 0 or doc_id % 3 = 0").select(F.col("doc_id").alias("item"), F.col("source").alias("topic"), key.alias("passage"), E.shuffle_key("p1", key).alias("shuffle"))


@query(f"""with {_JUDGED} select source || ' 0 ' || item || ' ' || grade as line from rs join documents on doc_id = item where method is not null
union all select '# unresolved_items=' || count(*) || ' pool=p1 depth=5' from rs where method is null""")
def qrels_export(spark, sf_dir):
    return E.qrels_lines(_items(spark, sf_dir), resolved(spark, sf_dir), "p1", 5).select("line")


def _batches(spark, sf_dir):
    """Live batch of judge q over multiples of 6, a revoked one of z over multiples of 9, a live resolution batch of z."""
    d = read(spark, sf_dir, "documents")
    held = lambda m, who, revoked, res: d.where(f"doc_id % {m} = 0").agg(F.collect_list("doc_id").alias("items")).select(F.lit(f"{who}{m}").alias("id"), F.lit(who).alias("annotator"), F.lit(revoked).alias("revoked"), F.lit(res).alias("resolution"), "items")
    return held(6, "q", False, False).unionByName(held(9, "z", True, True)).unionByName(held(14, "z", False, True))


@query(f"""with {_JUDGED}, who as (select item, count(distinct annotator) as n, bool_or(annotator = 'new') as mine from (
  select item, annotator from jd union all select doc_id, 'q' from documents where doc_id % 6 = 0 union all select doc_id, 'z' from documents where doc_id % 14 = 0) group by item),
o as (select doc_id as item, row_number() over (order by case when coalesce(n, 0) = 0 then 1 else 0 end, sha256('p1' || chr(0) || doc_id)) as place from documents left join who on item = doc_id where (doc_id % 2 = 0 or doc_id % 3 = 0) and coalesce(n, 0) < 2)
select item, place::int as place from o where place <= 40""")
def batch_issue(spark, sf_dir):
    from pyspark.sql import Window

    rows = E.issue_batch(_items(spark, sf_dir), judgments(spark, sf_dir), _batches(spark, sf_dir), "new", 2, 40)
    held = _batches(spark, sf_dir).where("not revoked").select(F.explode("items").alias("item")).unionByName(judgments(spark, sf_dir).select("item")).distinct().withColumn("b", F.lit(0))
    order = Window.orderBy(F.coalesce("b", F.lit(1)), E.shuffle_key("p1", F.col("item").cast("string")))
    return rows.select("item").join(held, "item", "left").withColumn("place", F.row_number().over(order)).select("item", "place")


@query(f"""with {_JUDGED}, who as (select item, list(distinct annotator) as w from (select item, annotator from jd union all select doc_id, 'q' from documents where doc_id % 6 = 0 union all select doc_id, 'z' from documents where doc_id % 14 = 0) group by item)
select item from rs join who using (item) where n = 2 and grades > 1 and method is distinct from 'adjudicated' and not list_contains(w, 'z') and len(w) < 3""")
def resolution_batch(spark, sf_dir):
    return E.resolution_batch(resolved(spark, sf_dir), judgments(spark, sf_dir), _batches(spark, sf_dir), "z")


@query("""select doc_id as item from documents where doc_id % 14 = 0 union select doc_id from labels where doc_id % 9 = 0 and doc_id % 3 = 0""")
def escalated_items(spark, sf_dir):
    return E.escalated(_batches(spark, sf_dir), judgments(spark, sf_dir))


@query("""with r as (select doc_id, case when doc_id % 13 = 0 then null else quality end as grade from labels)
select count_if(grade is not null and doc_id % 6 = 0)::bigint as accepted, count_if(grade is null or doc_id % 6 <> 0)::bigint as rejected, count_if(grade is not null and doc_id % 6 = 0)::bigint as replaced from r""")
def judgment_ingest(spark, sf_dir):
    rows = read(spark, sf_dir, "labels").select(F.lit("q6").alias("batch"), F.lit("q").alias("annotator"), F.col("doc_id").alias("item"), F.when(F.col("doc_id") % 13 != 0, F.col("quality")).alias("grade"))
    return E.ingest(rows, _batches(spark, sf_dir), judgments(spark, sf_dir))[2]


@query("""with recursive p as (select doc_id, quality::double as x, toxic::double as y from labels), v as (select x as v from p union all select y from p),
o as (select avg((x - y) * (x - y)) as d from p), e as (select (2.0 * count(*) * sum(v * v) - 2.0 * sum(v) * sum(v)) / (count(*) * (count(*) - 1.0)) as d from v),
n as (select avg(case when x <> y then 1.0 else 0.0 end) as d from p), h as (select v, count(*)::double as c from v group by v), en as (select (sum(c) * sum(c) - sum(c * c)) / (sum(c) * (sum(c) - 1)) as d from h)
select 'interval' as scale, round(1 - o.d / e.d, 6) as alpha from o, e union all select 'nominal', round(1 - n.d / en.d, 6) from n, en""")
def kripp_alpha(spark, sf_dir):
    two = judgments(spark, sf_dir).where("annotator <> 'z'")
    rows = [E.krippendorff_alpha(two, "item", "grade", s).select(F.lit(s).alias("scale"), F.round("alpha", 6).alias("alpha")) for s in ("interval", "nominal")]
    return rows[0].unionByName(rows[1])


@query(f"""with {_JUDGED}, s as (select a.annotator as annotator_a, b.annotator as annotator_b, a.grade as x, b.grade as y from jd a join jd b using (item) where a.annotator < b.annotator),
n as (select annotator_a, annotator_b, count(*) as n, avg(case when x = y then 1.0 else 0.0 end) as po from s group by all),
m as (select annotator_a, annotator_b, sum(ca * cb) as x from (select annotator_a, annotator_b, x as v, count(*) as ca from s group by all) join (select annotator_a, annotator_b, y as v, count(*) as cb from s group by all) using (annotator_a, annotator_b, v) group by all)
select annotator_a, annotator_b, n::bigint as n_shared, round(po, 6) as observed, round((po - x / (n * n)) / (1 - x / (n * n)), 6) as kappa from n join m using (annotator_a, annotator_b)""")
def cohen_kappa(spark, sf_dir):
    out = E.cohen_kappa(judgments(spark, sf_dir), "item", "grade")
    return out.select("annotator_a", "annotator_b", "n_shared", F.round("observed", 6).alias("observed"), F.round("kappa", 6).alias("kappa"))


def _differences(spark, sf_dir):
    rel, topics = qrels(spark, sf_dir), topic_list(spark, sf_dir)
    a, b = (E.score_topics(run_lines(spark, sf_dir, w), rel, topics).where("not must_abstain and n_relevant > 0").select("topic", F.coalesce(1 / F.col("first_rank"), F.lit(0.0)).alias(w)) for w in ("sparse", "dense"))
    return a.join(b, "topic").select("topic", (F.col("sparse") - F.col("dense")).alias("d"))


#: The generator of the draws, and the differences of the reciprocal ranks in topic order.
_DIFFS = """
df as (select a.topic, coalesce(1.0 / a.first_rank, 0)::double - coalesce(1.0 / b.first_rank, 0)::double as d, row_number() over (order by a.topic) - 1 as i
  from sc_sp a join sc_dn b using (topic) where not a.must_abstain and a.n_relevant > 0),
nn as (select count(*) as n, avg(d) as observed from df)
"""


def _draws_sql(first: str, times: int) -> str:
    m = "& 4294967295::hugeint"
    return f"""
g0 as (select draw, i, ({first} + draw * n + i)::hugeint as k, n from nn, range({times}) t(draw), range((select n from nn)) s(i)),
g1 as (select draw, i, n, (42 + (k + 1) * 1831565813::hugeint) {m} as a from g0), g2 as (select draw, i, n, (xor(a, a >> 15) * (a | 1)) {m} as t from g1),
g3 as (select draw, i, n, xor((t + ((xor(t, t >> 7) * (t | 61)) {m})) {m}, t) as t from g2), gen as (select draw, i, n, xor(t, t >> 14)::double / 4294967296.0 as u from g3)
"""


_BOTH = f"{_BM25}, {_DENSE}, {_QRELS}, {_scored_sql('sp')}, {_scored_sql('dn')}, {_DIFFS}"


@query(f"""with {_BOTH}, {_draws_sql('0', 20000)}, ms as (select draw, sum(case when u < 0.5 then d else -d end) / any_value(n) as mean from gen join df using (i) group by draw)
select round(any_value(observed), 9) as observed, case when (select max(abs(d)) from df) = 0 then 1.0 else (count_if(abs(mean) >= abs(observed) - 1e-12) + 1) / 20001.0 end as p from ms, nn""")
def sign_flip_test(spark, sf_dir):
    return E.sign_flip_p(_differences(spark, sf_dir)).select(F.round("observed", 9).alias("observed"), "p")


@query(f"""with {_BOTH}, {_draws_sql('case when (select max(abs(d)) from df) = 0 then 0 else 20000 * n end', 10000)},
ms as (select draw, sum(d) / count(*) as mean from (select draw, floor(u * n)::bigint as i from gen) p join df using (i) group by draw), od as (select mean, row_number() over (order by mean) as place from ms)
select round(max(mean) filter (where place = 251), 9) as low, round(max(mean) filter (where place = 9750), 9) as high from od""")
def bootstrap_ci(spark, sf_dir):
    return E.bootstrap_interval(_differences(spark, sf_dir)).select(F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


@query(f"""with {_BM25}, {_QRELS}, {_scored_sql('sp')}, ok as (select * from sc_sp where not must_abstain and reason is null and n_relevant > 0)
select 'sparse' as system, unnest(['n_scored', 'mrr', 'recall', 'hit']) as metric,
  unnest([count(*), round(coalesce(avg(coalesce(1.0 / first_rank, 0)), 0), 9), round(coalesce(avg(relevant_in_k / n_relevant), 0), 9), round(coalesce(avg(case when first_rank is not null then 1.0 else 0 end), 0), 9)]) as recomputed,
  unnest([true, true, true, false]) as holds from ok""")
def positive_control(spark, sf_dir):
    """The aggregates of the run itself hold; a hit rate that was not stored with it does not."""
    scored = E.score_topics(run_lines(spark, sf_dir, "sparse"), qrels(spark, sf_dir), topic_list(spark, sf_dir)).withColumn("system", F.lit("sparse"))
    stored = E.run_metrics(scored.where("reason is null"), "system").withColumn("hit", F.col("hit") + 0.01)
    return E.positive_control(scored, stored, "system").select("system", "metric", F.round("recomputed", 9).alias("recomputed"), "holds")
