"""Queries over scalar text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.sources import readers

from .registry import query, read

#: Fold and tokens in SQL.
FOLD = "replace(strip_accents(lower({0})), 'ς', 'σ')"
TOKENS = "regexp_extract_all(" + FOLD + ", '[\\p{{L}}\\p{{N}}_]+')"
STOP = "[" + ", ".join(f"'{w}'" for w in T.QUERY_STOPWORDS) + "]"


@query(f"select doc_id, len(t)::bigint as n_tokens, len(list_distinct(t))::bigint as n_terms, md5(array_to_string(t, ' ')) as tokens_md5 from (select doc_id, {TOKENS.format('text')} as t from documents)")
def fold_tokens(spark, sf_dir):
    t = T.tokens(F.col("text"))
    rows = read(spark, sf_dir, "documents").select("doc_id", t.alias("t"))
    joined = F.array_join("t", " ").cast("binary")
    return rows.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_terms"), F.md5(joined).alias("tokens_md5"))


@query(f"""
with t as (select item_id, {TOKENS.format("'What is the ' || text")} as t from benchmark),
k as (select item_id, t, list_filter(t, lambda x: not list_contains({STOP}, x)) as k from t)
select item_id, array_to_string(case when len(k) > 0 then k else t end, ' ') as terms from k
union all select -1, array_to_string(regexp_extract_all('who is the', '[a-z]+'), ' ')
""")
def stopword_query(spark, sf_dir):
    rows = read(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("What is the "), "text").alias("text"))
    rows = rows.unionByName(spark.createDataFrame([(-1, "Who IS the?")], "item_id long, text string"))
    return rows.select("item_id", F.array_join(T.query_tokens(F.col("text")), " ").alias("terms"))


@query("""
select p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') as slug,
  list_aggregate(list_transform(list_filter(regexp_split_to_array(p_name, '[^A-Za-z0-9]+'), lambda w: w <> ''), lambda w: upper(w[1]) || w[2:]), 'string_agg', '') as camel,
  lower(regexp_replace(replace(p_type, ' ', ''), '([a-z0-9])([A-Z])', '\\1 \\2', 'g')) as words,
  regexp_extract('http://x.org/' || p_brand || '#' || p_name, '[^#/]*$') as local
from part
""")
def name_forms(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    return part.select(
        "p_partkey", F.regexp_replace(T.slug(F.col("p_name")), "^-|-$", "").alias("slug"), T.upper_camel(F.col("p_name")).alias("camel"),
        T.camel_words(F.replace("p_type", F.lit(" "), F.lit(""))).alias("words"),
        T.local_name(F.concat(F.lit("http://x.org/"), "p_brand", F.lit("#"), "p_name")).alias("local"),
    )


_CUT = "left(text, 420)"


@query(f"""
select doc_id, md5(case when length(text) <= 420 then text
  when strpos({_CUT}, ' ') > 1 then left(text, 420 - strpos(reverse({_CUT}), ' ')) || ' …' else {_CUT} || ' …' end) as excerpt_md5 from documents
""")
def excerpts(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(T.excerpt(F.col("text")).cast("binary")).alias("excerpt_md5"))


@query("""
with d as (select doc_id, text, length(text) as n, strpos(text, 'ing') - 1 as s from documents where strpos(text, 'ing') > 0),
e as (select *, s - 90 as lo, s + 3 + 90 as hi from d),
f as (select *,
  case when lo <= 0 then 0 when strpos(left(text, lo + 1), ' ') > 0 and lo + 1 - strpos(reverse(left(text, lo + 1)), ' ') > 0
    then lo + 1 - strpos(reverse(left(text, lo + 1)), ' ') + 1 else lo end as a,
  case when hi >= n then n when strpos(substr(text, hi + 1), ' ') > 0 then hi + strpos(substr(text, hi + 1), ' ') - 1 else hi end as b from e)
select doc_id, md5((case when a > 0 then '…' else '' end) || substr(text, a + 1, b - a) || (case when b < n then '…' else '' end)) as snippet_md5,
  (case when a > 0 then 1 else 0 end + s - a)::int as hit_start, (case when a > 0 then 1 else 0 end + s + 3 - a)::int as hit_end from f
""")
def snippet_window(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").withColumn("at", F.locate("ing", "text") - 1).where("at >= 0")
    s = T.snippet(F.col("text"), F.col("at"), F.col("at") + 3)
    return rows.select("doc_id", s.alias("s")).select("doc_id", F.md5(F.col("s.snippet").cast("binary")).alias("snippet_md5"), F.col("s.start").alias("hit_start"), F.col("s.end").alias("hit_end"))


@query("""
select p_partkey, p_size::int as age, -(100 + p_size)::int as year, case when p_size % 2 = 0 then -(90 + p_size)::int end as end_year,
  floor(-(100 + p_size) / 100.0)::int as century, ceil((p_size * 40) / 100.0)::int as later from part
""")
def ages_and_years(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    size = F.col("p_size").cast("string")
    forms = [F.concat(F.lit(a), size, F.lit(b)) for a, b in (("He died at the age of about ", ", old"), ("Lived ", " years"), ("was ", ". Then"))]
    said = F.element_at(F.array(*forms), (F.col("p_partkey") % 3 + 1).cast("int"))
    gloss = F.concat(F.lit("born (c. "), (F.col("p_size") + 100).cast("string"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("/"), (F.col("p_size") + 90).cast("string"))).otherwise(""), F.lit(" BCE)"))
    y = T.bce_year(gloss)
    return part.select(
        "p_partkey", T.age(said).alias("age"), y["year"].alias("year"), y["end_year"].alias("end_year"),
        T.century(y["year"]).alias("century"), T.century(F.col("p_size") * 40).alias("later"),
    )


@query("""
select p_partkey, list_distinct(['2.' || p_size, '2.' || (p_partkey % 50), '4.3']).list_sort().array_to_string(' ') as refs, false as clean,
  p_partkey || '.' || p_size || ' 7.' || p_size || 'a' as dotted, 'A ' || p_size || '|' || 'b' as split from part
""")
def reference_parse(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    s, k = F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    raw = F.concat(F.lit("II "), s, F.lit(", "), (F.col("p_partkey") % 50).cast("string"), F.lit("; ??; IV 3"))
    r = readers.parse_refs(raw)
    cited = F.concat(F.lit("D.L. "), k, F.lit("."), s, F.lit(" and 7."), s, F.lit("a"))
    return part.select(
        "p_partkey", F.array_join(F.sort_array(r["refs"]), " ").alias("refs"), r["clean"].alias("clean"), F.array_join(T.dotted_refs(cited), " ").alias("dotted"),
        F.array_join(T.citation_refs(F.concat(F.lit("cf. A "), s, F.lit("; ;b ")), r"^cf\. "), "|").alias("split"),
    )


@query("""
select a.n_name as a, b.n_name as b, case when levenshtein(a.n_name, b.n_name) <= 2 then levenshtein(a.n_name, b.n_name) else -1 end::int as edits,
  (select max(i) from range(0, least(length(a.n_name), length(b.n_name)) + 1) t(i) where left(a.n_name, i::int) = left(b.n_name, i::int))::int as prefix
from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey
""")
def edit_distances(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    a, b = n.select(F.col("n_name").alias("a"), "n_regionkey", F.col("n_nationkey").alias("ka")), n.select(F.col("n_name").alias("b"), "n_regionkey", F.col("n_nationkey").alias("kb"))
    rows = a.join(b, "n_regionkey").where("ka < kb")
    return rows.select("a", "b", T.edit_distance(F.col("a"), F.col("b")).alias("edits"), T.shared_prefix(F.col("a"), F.col("b")).alias("prefix"))


@query("""
select page_id, md5(trim(regexp_replace(
  replace(replace(replace(replace(replace(replace(regexp_replace(html, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<!--.*?-->|<[^>]*>', ' ', 'g'),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ')) as text_md5 from pages
""")
def page_text(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.md5(readers.html_text(F.col("html")).cast("binary")).alias("text_md5"))


@query(r"""
select doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: regexp_matches(w, '\p{L}')))::bigint as words,
  md5(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) as xml_md5 from documents
""")
def letter_words(spark, sf_dir):
    return read(spark, sf_dir, "documents").select(
        "doc_id", T.words_with_letters(F.col("text")).cast("long").alias("words"), F.md5(T.xml_escape(F.col("text")).cast("binary")).alias("xml_md5")
    )
