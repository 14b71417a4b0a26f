"""Ranked retrieval over documents, embeddings and benchmark topics.

A topic's query is its whole benchmark item; a document's subject is its source
and its school its language.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import retrieval as R

from .registry import query, read
from .text import STOP, TOKENS

def topics(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), "text")


def passages(spark, sf_dir):
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text", F.col("source").alias("subject"), F.col("lang").alias("school"))


def query_vectors(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    items = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id"))
    return e.join(items, "vec_id").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))


def vectors(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("v"))


def sparse_pool(spark, sf_dir, k=R.POOL):
    return R.bm25_rank(passages(spark, sf_dir), topics(spark, sf_dir), k)


def dense_pool(spark, sf_dir, k=R.POOL):
    return R.dense_rank(vectors(spark, sf_dir), query_vectors(spark, sf_dir), k)


# ------------------------------------------------------------------ SQL

_BM25 = f"""
tok as (select doc_id as doc, {TOKENS.format('text')} as t from documents),
stat as (select count(*) as n, sum(len(t)) / greatest(1, count(*)) as avgdl from tok),
post as (select doc, term, dl, count(*) as tf from (select doc, len(t) as dl, unnest(t) as term from tok) group by all),
dfreq as (select term, count(*) as df from post group by term),
ask as (select item_id as query, {TOKENS.format("text")} as t from benchmark),
ask2 as (select query, case when len(list_filter(t, lambda x: not list_contains({STOP}, x))) > 0 then list_filter(t, lambda x: not list_contains({STOP}, x)) else t end as t from ask),
bag as (select query, term, count(*) as qtf from (select query, unnest(t) as term from ask2) group by all),
bm as (select b.query, p.doc, sum(b.qtf * ln((s.n - d.df + 0.5) / (d.df + 0.5) + 1) * p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * p.dl / s.avgdl))) as score
  from bag b join post p using (term) join dfreq d using (term), stat s group by b.query, p.doc),
sp as (select *, row_number() over (partition by query order by round(score, 9) desc, doc) as rank from bm where score > 0 qualify rank <= 50)
"""
_DENSE = """
qv as (select vec_id as query, list_transform(embedding, lambda x: x::double) as q from embeddings join benchmark on item_id = vec_id),
dn as (select query, vec_id as doc, list_dot_product(list_transform(embedding, lambda x: x::double), q) / sqrt(list_dot_product(q, q)) as score,
  row_number() over (partition by query order by round(list_dot_product(list_transform(embedding, lambda x: x::double), q) / sqrt(list_dot_product(q, q)), 9) desc, vec_id) as rank
  from embeddings, qv qualify rank <= 50)
"""
_FUSED = """
fused as (select query, doc, sum(s) as score from (
  select query, doc, 0.3::double / (20 + rank) as s from sp union all select query, doc, 1.0::double / (20 + rank) from dn) group by query, doc)
"""


@query(f"with {_BM25} select query, doc, round(score, 6) as score, rank::int as rank from sp where rank <= 10")
def bm25_topk(spark, sf_dir):
    return sparse_pool(spark, sf_dir, 10).select("query", "doc", F.round("score", 6).alias("score"), "rank")


@query(f"with {_BM25} select query, doc, round(score, 6) as score, rank::int as rank from sp where rank <= 5")
def bm25_prepared_index(spark, sf_dir):
    postings, stats = R.bm25_index(passages(spark, sf_dir))
    return R.ranked_by_index(postings, stats, topics(spark, sf_dir), 5).select("query", "doc", F.round("score", 6).alias("score"), "rank")


@query(f"with {_BM25} select term, df::bigint as df, round(ln((n - df + 0.5) / (df + 0.5) + 1), 6) as idf from dfreq, stat where df >= 20")
def bm25_term_weights(spark, sf_dir):
    postings, stats = R.bm25_index(passages(spark, sf_dir))
    df = postings.groupBy("term").agg(F.count("*").alias("df")).where("df >= 20").join(F.broadcast(stats), how="cross")
    return df.select("term", "df", F.round(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1), 6).alias("idf"))


@query(f"with {_DENSE} select query, doc, round(score, 6) as score, rank::int as rank from dn where rank <= 10")
def dense_topk(spark, sf_dir):
    return dense_pool(spark, sf_dir, 10).select("query", "doc", F.round("score", 6).alias("score"), "rank")


@query(f"with {_DENSE} select query, doc, round(score * sqrt(list_dot_product(q, q)), 6) as score, rank::int as rank from dn join qv using (query) where rank <= 3")
def dense_dot_topk(spark, sf_dir):
    out = R.dense_rank(vectors(spark, sf_dir), query_vectors(spark, sf_dir), 3, normalise=False)
    return out.select("query", "doc", F.round("score", 6).alias("score"), "rank")


@query(f"""with {_BM25}, {_DENSE}, {_FUSED}
select query, doc, round(score, 6) as score, row_number() over (partition by query order by round(score, 12) desc, doc)::int as rank from fused qualify rank <= 10""")
def rrf_fusion(spark, sf_dir):
    out = R.retrieve("hybrid", sparse_pool(spark, sf_dir), dense_pool(spark, sf_dir), 10)
    return out.select("query", "doc", F.round("score", 6).alias("score"), "rank")


@query(f"""with {_BM25}, {_DENSE}, fused as (select query, doc, sum(s) as score from (
  select query, doc, 1.0::double / (60 + rank) as s from sp union all select query, doc, 1.0::double / (60 + rank) from dn) group by query, doc)
select query, doc, round(score, 6) as score, row_number() over (partition by query order by round(score, 12) desc, doc)::int as rank from fused qualify rank <= 10""")
def rrf_equal_weights(spark, sf_dir):
    out = R.fuse(sparse_pool(spark, sf_dir), dense_pool(spark, sf_dir), R.PLAIN_FUSION).where("rank <= 10")
    return out.select("query", "doc", F.round("score", 6).alias("score"), "rank")


@query(f"""with {_BM25}, {_DENSE}, {_FUSED},
boosted as (select f.query, f.doc, f.score
  + greatest(case when d.source = 'src' || (f.query % 20) then 0.025 when d.source = 'src' || ((f.query + 1) % 20) then 0.0075 else 0 end,
             case when f.doc % 20 = f.query % 20 then 0.025 else 0 end)
  + case when d.lang = 'de' and f.query % 2 = 0 then 0.025 else 0 end as score
  from fused f left join documents d on d.doc_id = f.doc)
select query, doc, round(score, 6) as score, row_number() over (partition by query order by round(score, 12) desc, doc)::int as rank from boosted qualify rank <= 10""")
def rrf_boosted(spark, sf_dir):
    docs, asked = passages(spark, sf_dir), topics(spark, sf_dir)
    name = lambda n: F.concat(F.lit("src"), (n % 20).cast("string"))
    sparse, dense = sparse_pool(spark, sf_dir), dense_pool(spark, sf_dir)
    asserts = sparse.select("query", "doc").unionByName(dense.select("query", "doc")).where("doc % 20 = query % 20")
    out = R.fuse(
        sparse, dense, R.Fusion(), docs.select("doc", "subject", "school"),
        asked.select("query", name(F.col("query")).alias("subject")), asked.select("query", name(F.col("query") + 1).alias("subject")),
        asserts, asked.where("query % 2 = 0").select("query", F.lit("de").alias("school")),
    )
    return out.where("rank <= 10").select("query", "doc", F.round("score", 6).alias("score"), "rank")


def sweep_grid(spark):
    rows = [(f"sw{w}-k{k}-kg{g}", k, 1.0, w, g * 0.5 / k) for w in (0.0, 0.2, 0.3, 0.4, 0.5, 0.7) for k in (20, 60, 120) for g in (0.0, 0.5, 1.0)]
    return spark.createDataFrame([("baseline", 60, 1.0, 1.0, 0.5 / 60), *rows], "variant string, rrf_k int, dense_weight double, sparse_weight double, boost double")


@query(f"""with {_BM25}, {_DENSE},
grid as (select 'baseline' as variant, 60 as k, 1.0::double as sw, 0.5::double / 60 as boost union all
  select 'sw' || w || '-k' || k || '-kg' || g, k, w::double, g::double * 0.5 / k from (values (0.0), (0.2), (0.3), (0.4), (0.5), (0.7)) a(w), (values (20), (60), (120)) b(k), (values (0.0), (0.5), (1.0)) c(g)),
f as (select variant, query, doc, boost, sum(w / (k + rank)) as score from (
  select variant, k, boost, query, doc, rank, sw as w from sp, grid union all select variant, k, boost, query, doc, rank, 1.0 from dn, grid) group by all),
g as (select variant, query, doc, score + case when doc % 20 = query % 20 then boost else 0 end as score from f),
r as (select *, row_number() over (partition by variant, query order by round(score, 12) desc, doc) as rank from g)
select variant, query, doc, round(score, 6) as score, rank::int as rank from r where rank <= 10""")
def fusion_sweep(spark, sf_dir):
    sparse, dense = sparse_pool(spark, sf_dir), dense_pool(spark, sf_dir)
    matched = sparse.select("query", "doc").unionByName(dense.select("query", "doc")).where("doc % 20 = query % 20")
    out = R.fusion_sweep(sparse, dense, sweep_grid(spark), matched).where("rank <= 10")
    return out.select("variant", "query", "doc", F.round("score", 6).alias("score"), "rank")


@query(f"""with {_BM25},
best as (select query, rank, case when length(text) <= 420 then text when strpos(left(text, 420), ' ') > 1 then left(text, 420 - strpos(reverse(left(text, 420)), ' ')) || ' …' else left(text, 420) || ' …' end as body, source
  from sp join documents on doc_id = doc where rank <= 3)
select query, md5(string_agg(source || ': ' || body, chr(10) || chr(10) order by rank) || case when max(n) > 3 then chr(10) || chr(10) || 'Further passages: ' || max(n) else '' end) as answer_md5
from best join (select query, count(*) as n from sp group by query) using (query) group by query""")
def extractive_answer(spark, sf_dir):
    ranked = sparse_pool(spark, sf_dir)
    body = passages(spark, sf_dir).select("doc", F.col("subject").alias("label"), F.col("text").alias("body"))
    return R.extractive_answer(ranked, body).select("query", F.md5(F.col("answer").cast("binary")).alias("answer_md5"))


@query()  # found names are taken out one by one, longest first: tested against a loop
def detect_subjects(spark, sf_dir):
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    a = nation.select(F.col("n_nationkey").alias("ka"), F.col("n_name").alias("a"))
    b = nation.select(F.col("n_nationkey").alias("kb"), F.col("n_name").alias("b"))
    r = region.select(F.col("r_regionkey").alias("kr"), "r_name")
    asked = (
        read(spark, sf_dir, "benchmark").withColumns({"ka": F.col("item_id") % 25, "kb": (F.col("item_id") + 7) % 25, "kr": F.col("item_id") % 5})
        .join(a, "ka").join(b, "kb").join(r, "kr")
        .select(F.col("item_id").alias("query"), F.concat(F.lit("From "), "a", F.lit(" to "), "b", F.lit(", said of "), F.substring("r_name", 1, 3)).alias("text"))
    )
    return R.detect_subjects(asked, R.detection_table(nation.select(F.col("n_name").alias("subject"))))


@query("""
select item_id as query, label from benchmark join (values ('the', 'articles'), ('of', 'links'), ('and', 'links'), ('and', 'joins')) a(alias, label)
  on list_contains(regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}_]+'), alias) group by all
""")
def detect_schools(spark, sf_dir):
    aliases = spark.createDataFrame([("the", "articles"), ("of", "links"), ("and", "links"), ("and", "joins")], "alias string, label string")
    return R.detect_aliases(read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), "text"), aliases)


@query("""
select conv_id, turn, case when regexp_matches(lower(text), 'how many|number of|count') and regexp_matches(lower(text), 'word|line|page') then 'count'
  when regexp_matches(lower(text), 'who|which') then 'who' when regexp_matches(lower(text), 'what') then 'what' end as route,
  len(list_filter(regexp_extract_all(replace(strip_accents(lower(text)), 'ς', 'σ'), '[\\p{L}\\p{N}_]+'), lambda t: starts_with(t, 'stud') or starts_with(t, 'teach'))) > 0 as relational
from conversations
""")
def question_router(spark, sf_dir):
    low = F.lower("text")
    route = F.when(low.rlike("how many|number of|count") & low.rlike("word|line|page"), "count").when(low.rlike("who|which"), "who").when(low.rlike("what"), "what")
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", route.alias("route"), R.cued(F.col("text"), ("stud", "teach")).alias("relational"))
