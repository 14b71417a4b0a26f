"""Citation tree, marked-up text, dictionary tagging, snapshots and documents.

Books are documents by doc_id in hundreds; a section's full id is
book.chapter.section with the language as chapter, its short one book.section
modulo 40, so several sections share one.  The dictionary is made of nation-like
names and frequent words of the synthetic prose.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import navigation as N
from lectern.operators import tagging as A
from lectern.sources import publishing, readers, writers
from lectern.sources.turtle import read_turtle

from .registry import query, read


def sections(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    book = F.floor(F.col("doc_id") / 100).cast("int")
    s = lambda c: c.cast("string")
    return d.select(
        F.concat_ws(".", s(book), "lang", s(F.col("doc_id"))).alias("id"), book.alias("book"),
        F.concat_ws(".", s(book), s(F.col("doc_id") % 40)).alias("short"), F.col("doc_id").alias("ord"), "text",
    )


_S = "s as (select (doc_id // 100) || '.' || lang || '.' || doc_id as id, doc_id // 100 as book, (doc_id // 100) || '.' || (doc_id % 40) as short, doc_id as ord, text from documents)"


@query(f"""with {_S} select distinct book::varchar as ref, book::varchar as id, 'book' as kind from s union all select id, id, 'section' from s
union all select short, arg_min(id, ord), 'section' from s group by short""")
def reference_index(spark, sf_dir):
    return N.reference_index(sections(spark, sf_dir))


@query(f"with {_S}, c as (select short, count(*) as c from s group by short) select count_if(c > 1)::bigint as ambiguous, coalesce(sum(c) filter (where c > 1), 0)::bigint as colliding, coalesce(sum(c - 1) filter (where c > 1), 0)::bigint as fallbacks from c")
def tree_statistics(spark, sf_dir):
    return N.tree_statistics(sections(spark, sf_dir))


@query("select doc_id as ord from documents where doc_id between 37 and 161")
def nav_range(spark, sf_dir):
    s = sections(spark, sf_dir).drop("text")
    ends = s.where("ord in (161, 37)").orderBy(F.desc("ord")).collect()  # two rows
    return N.section_range(s, ends[0]["id"], ends[1]["id"]).select("ord")


@query(f"""with {_S} select 'books' as what, count(*)::bigint as n from (select distinct book from s) union all select 'all', (select count(*) from s) + (select count(distinct book) from s)
union all select 'book 1', count(*) from s where book = 1 union all select 'siblings', count(*) from s where book = 1""")
def navigation(spark, sf_dir):
    s = sections(spark, sf_dir).drop("text")
    n = lambda what, df: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    return n("books", N.navigate(s, down=1)).unionByName(n("all", N.navigate(s, down=-1))).unionByName(n("book 1", N.navigate(s, "1", 1))).unionByName(n("siblings", N.navigate(s, "1.23", 0)))


def _tei(spark, sf_dir):
    """Pages of marked-up text built from documents: one section each, with a note in the middle."""
    d = read(spark, sf_dir, "documents")
    half = F.floor(F.length("text") / 2).cast("int")
    a, b = T.xml_escape(F.substring("text", F.lit(1), half)), T.xml_escape(F.substring("text", half + 1, F.length("text")))
    n = lambda c: c.cast("string")
    xml = F.concat(
        F.lit('<TEI><text><body><div type="book" n="'), n(F.col("doc_id") % 10), F.lit('"><div type="chapter" n="'), F.col("lang"), F.lit('"><div type="section" n="'), n(F.col("doc_id")),
        F.lit('"><p>'), a, F.lit("<note>left <b>out</b></note>"), b, F.lit("</p></div></div></div></body></text></TEI>"),
    )
    return d.where(~F.col("text").rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]")).select(n(F.col("doc_id")).alias("doc"), xml.alias("xml"))


_WS = "trim(regexp_replace({0}, '[\\x09-\\x0D\\x1C-\\x1F \\x85\\xA0]+', ' ', 'g'), ' ')"


@query(f"""with h as (select doc_id, lang, {_WS.format("left(text, (length(text) // 2)::int)")} as a, {_WS.format("substr(text, length(text) // 2 + 1)")} as b from documents)
select doc_id::varchar as doc, (doc_id % 10) || '.' || lang || '.' || doc_id as id, md5(case when a = '' then b when b = '' then a else a || ' ' || b end) as text_md5 from h""")
def tei_flatten(spark, sf_dir):
    meta = spark.createDataFrame([(str(b), c, c.upper()) for b in range(10) for c in ("en", "fr", "de", "es")], "book string, chapter string, school string")
    rows = readers.with_metadata(readers.tei_sections(_tei(spark, sf_dir)), meta)
    return rows.select("doc", "id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


_WORDS = ("the", "Der", "and of", "and", "Of", "que", "La", "En")


def dictionary(spark):
    rows = [(w, f"E{i}", None, False) for i, w in enumerate(_WORDS)] + [("En", "scoped", ["src1", "src2"], False), ("Re", "guess", ["src3"], True)]
    return spark.createDataFrame(rows, "surface string, entity string, scopes array<string>, heuristic boolean")


def _tag_sections(spark, sf_dir):
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("owner"), "text")


#: Runs of letters and of other signs with their offsets; a run that equals a surface is a match, two words before one.
_MATCHES = r"""
r as (select doc_id, source, unnest(x) as w, unnest(range(1, len(x) + 1)) as i from (select doc_id, source, regexp_extract_all(text, '\p{L}+|[^\p{L}]+') as x from documents)),
o as (select *, lead(w, 1) over q as w1, lead(w, 2) over q as w2, coalesce(sum(length(w)) over (q rows between unbounded preceding and 1 preceding), 0) as start from r window q as (partition by doc_id order by i)),
hit as (select doc_id as id, start::int as start, case when w = 'and' and w1 = ' ' and w2 = 'of' then 'and of' else w end as surface, source from o
  where w in ('the', 'Der', 'and', 'Of', 'que', 'La', 'En') or (w = 'Re' and source = 'src3'))
"""


@query(rf"""with {_MATCHES} select id, start, start + length(surface)::int as "end", surface, surface = 'Re' as heuristic,
  case surface when 'En' then case when source in ('src1', 'src2') then 'scoped' else 'E7' end when 'Re' then 'guess' when 'the' then 'E0' when 'Der' then 'E1' when 'and of' then 'E2' when 'and' then 'E3' when 'Of' then 'E4' when 'que' then 'E5' when 'La' then 'E6' end as entity from hit""")
def tag_scan(spark, sf_dir):
    return A.annotate(A.scan(_tag_sections(spark, sf_dir), dictionary(spark)))


@query(rf"with {_MATCHES} select surface, count(*)::bigint as n from hit group by surface")
def tag_counts(spark, sf_dir):
    return A.scan(_tag_sections(spark, sf_dir), dictionary(spark)).groupBy("surface").agg(F.count("*").alias("n"))


@query(r"""with w as (select doc_id, unnest(regexp_extract_all(replace(strip_accents(lower(text)), 'ς', 'σ'), '\p{L}+')) as t from documents)
select case when t in ('erea', 'erean', 'ereas') then 'Ere' else 'the' end as entity, count(*)::bigint as occurrences, count(distinct doc_id)::bigint as sections from w where t in ('erea', 'erean', 'ereas', 'the') group by 1""")
def inflected_terms(spark, sf_dir):
    terms = spark.createDataFrame([("erea", "erea", "Ere", False), ("the", None, "the", False)], "form string, stem string, entity string, name boolean")
    return A.entity_index(A.tag_terms(_tag_sections(spark, sf_dir), terms, ("n", "s")))


@query()
def proper_noun_audit(spark, sf_dir):
    s = _tag_sections(spark, sf_dir)
    spans = A.scan(s, dictionary(spark))
    block = spark.createDataFrame([("And",), ("Was",)], "token string")
    return A.proper_noun_audit(s, spans, block, spark.createDataFrame([("Is",)], "token string"))


@query()
def recall_audit(spark, sf_dir):
    s, words = _tag_sections(spark, sf_dir), dictionary(spark)
    return A.recall_audit(s, words.select("surface").distinct(), A.annotate(A.scan(s, words.where("entity <> 'E3'"))))


@query("""with n as (select p_name as surface, p_brand as entity, p_type as kind from part group by all),
g as (select surface, count(*) as c, count(distinct entity) filter (where kind <> 'ECONOMY') as others, count(*) filter (where kind <> 'ECONOMY') as o, min(entity) filter (where kind <> 'ECONOMY') as e, min(entity) as sole from n group by surface)
select surface, case when c = 1 then sole when o = 1 then e end as entity, case when not (c = 1 or o = 1) then 'ambiguous' end as skipped from g""")
def dictionary_build(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("entity"), F.when(F.col("p_type") == "ECONOMY", "work").otherwise(F.col("p_type")).alias("kind")).distinct()
    names = rows
    out = A.candidate_entries(names.withColumn("qids", F.array(F.concat("name", "entity", "kind"))), spark.createDataFrame([], "token string"))
    return out.select("surface", "entity", "skipped")


@query(r"""with p as (select string_agg('{"doc_id":' || doc_id || ',"lang":"' || lang || '","source":"' || source || '"}', chr(10) order by doc_id) as body, count(*) as n from documents) select sha256(body) as sha256, n::bigint as n from p""")
def snapshot_hash(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").withColumn("ord", F.col("doc_id"))
    return writers.snapshot_hash(writers.snapshot_lines(rows, ["doc_id", "lang", "source"]))


@query("""select doc_id // 100 as book, md5('<TEI><teiHeader><title>sample</title></teiHeader><text><body><div type="book" n="' || (doc_id // 100) || '">'
  || string_agg('<div type="section" n="' || doc_id || '"><p>' || replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '</p></div>', '' order by doc_id) || '</div></body></text></TEI>') as xml_md5
from documents group by doc_id // 100""")
def tei_document(spark, sf_dir):
    """A document per book."""
    s = sections(spark, sf_dir).withColumn("id", F.col("ord"))
    return writers.tei_books(s, "sample").select(F.col("book").cast("long").alias("book"), F.md5(F.col("xml").cast("binary")).alias("xml_md5"))


@query("""with p as (select 'http://x.org/passage/' || doc_id as s, unnest(['type', 'label', 'text', 'citation', 'life']) as p,
    unnest(['http://x.org/Passage', 'D ' || doc_id, md5(text), doc_id::varchar, 'http://x.org/life/' || source]) as o from documents union all
  select 'http://x.org/annotation/' || doc_id || '-0', unnest(['type', 'body', 'target', 'start', 'end', 'exact']),
    unnest(['http://x.org/Annotation', 'http://x.org/entity/article', 'http://x.org/passage/' || doc_id, '0', '3', 'The']) from documents where starts_with(text, 'The '))
select s, p, o from p""")
def passage_triples(spark, sf_dir):
    s = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("D "), F.col("doc_id").cast("string")).alias("label"), F.col("source").alias("owner"), "text")
    spans = s.where(F.startswith("text", F.lit("The "))).select("id", F.lit(0).alias("start"), F.lit(3).alias("end"), F.lit("article").alias("entity"), F.lit("The").alias("surface"))
    out = writers.passage_triples(s, spans, "http://x.org/")
    return out.select("s", "p", F.when(F.col("p") == "text", F.md5(F.col("o").cast("binary"))).otherwise(F.col("o")).alias("o"))


@query("""select conv_id, count(*)::bigint as rows, count_if(ok)::bigint as good from (select conv_id, turn % 3 <> 1 and role <> 'system' as ok from conversations) group by 1""")
def json_lines(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    body = F.to_json(F.struct("conv_id", "role", "turn"))
    lines = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("line_no"), F.when(F.col("turn") % 3 == 1, F.concat(F.lit("{"), body)).otherwise(body).alias("value"))
    good, bad = readers.parsed_lines(lines, "conv_id long, role string, turn long", {"system rows are not allowed": F.col("role") != "system"})
    ids = good.select("line_no", F.lit(1).alias("g")).unionByName(bad.select("line_no", F.lit(0).alias("g")))
    return ids.groupBy(F.expr("line_no div 1000").alias("conv_id")).agg(F.count("*").alias("rows"), F.sum("g").alias("good"))


@query("""select event_id, regexp_extract(props, '"k": ([0-9]+)', 1)::int as k from events where event_id % 4 <> 0""")
def batch_parse(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    line = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("# "), "props")).otherwise(F.concat(F.lit('{"event_id": "'), F.col("event_id").cast("string"), F.lit('", '), F.substring("props", F.lit(2), F.length("props"))))
    rows = readers.parse_batch(e.select(line.alias("value")), "event_id string, k int, note string", "event_id", {"note": "none"})
    return rows.select(F.col("event_id").cast("long").alias("event_id"), "k")


@query("""with v as (select l_orderkey, l_linenumber, min(l_returnflag) as f from lineitem group by 1, 2)
select l_orderkey as section, l_linenumber::int as pos, case when a = b then 't' || l_linenumber end as translated from (
  select l_orderkey, l_linenumber, count(*) over (partition by l_orderkey) as a, count(case when f <> 'R' then 1 end) over (partition by l_orderkey) as b from v)""")
def verse_alignment(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("section"), F.col("l_linenumber").cast("int").alias("pos")).agg(F.min("l_returnflag").alias("f"))
    left = rows.select("section", "pos", F.lit("o").alias("lines"))
    right = rows.where("f <> 'R'").select("section", "pos", F.concat(F.lit("t"), F.col("pos").cast("string")).alias("lines"))
    return readers.aligned(left, right).select("section", "pos", "translated")


#: Signs that need escapes: they begin every text of the round trips.
_HARD = "".join(map(chr, (92, 110, 13, 32, 9, 92, 34, 113, 34, 32, 39, 120, 39, 32, 0x1F600, 32, 0xE9, 32, 13, 92)))
_HARD_SQL_TEXT = " || ".join(f"chr({ord(c)})" for c in _HARD)


def _hard_triples(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    text = F.concat(F.lit(_HARD), "text")
    none = F.lit(None).cast("string")
    return d.select(F.concat(F.lit("http://x.org/d/"), "doc_id").alias("s"), F.lit("http://x.org/text").alias("p"), text.alias("o"), F.lit("literal").alias("o_kind"), F.col("lang").alias("lang"), none.alias("datatype"))


_HARD_SQL = f"select 'http://x.org/d/' || doc_id as s, lang, md5({_HARD_SQL_TEXT} || text) as text_md5 from documents"


@query(_HARD_SQL)
def ntriples_round_trip(spark, sf_dir):
    lines = writers.ntriples(_hard_triples(spark, sf_dir)).withColumnRenamed("line", "value")
    return readers.read_ntriples(lines).select("s", "lang", F.md5(F.col("o").cast("binary")).alias("text_md5"))


@query(_HARD_SQL)
def turtle_round_trip(spark, sf_dir):
    """A Turtle document per hundred texts, with prefixes, written and read again."""
    body = F.concat(F.lit("d:"), F.regexp_extract("s", "[0-9]+$", 0), F.lit(" x:text "), writers.term(F.col("o"), F.col("o_kind"), F.col("lang"), F.col("datatype")), F.lit(" ."))
    book = (F.regexp_extract("s", "[0-9]+$", 0).cast("long") / 100).cast("long").cast("string")
    head = F.lit("@prefix d: <http://x.org/d/> .\nPREFIX x: <http://x.org/>\n")
    docs = _hard_triples(spark, sf_dir).groupBy(book.alias("doc")).agg(F.concat(head, F.array_join(F.collect_list(body), "\n")).alias("text"))
    return read_turtle(docs).select("s", "lang", F.md5(F.col("o").cast("binary")).alias("text_md5"))


@query("""select ord, line from (select doc_id as ord, '  <url><loc>https://x.org/section/' || doc_id || '?a=1&amp;b=2</loc>' || case when doc_id % 2 = 0 then '<lastmod>2024-01-01</lastmod>' else '' end || '</url>' as line from documents
  union all values (-2, '<?xml version="1.0" encoding="UTF-8"?>'), (-1, '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), (4611686018427387904, '</urlset>'))""")
def sitemap_lines(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    path = F.concat(F.lit("/section/"), "doc_id", F.lit("?a=1&b=2"))
    return publishing.sitemap(d.select(F.col("doc_id").alias("ord"), path.alias("path"), F.when(F.col("doc_id") % 2 == 0, "2024-01-01").alias("lastmod")), "https://x.org/")


@query("""with k as (select 'R' as kind, p_name as label, p_brand as qid, p_partkey as id from part union all select 'S', p_name, p_type, p_partkey + 1000000 from part where p_size > 20)
select a.id as entity, a.label as surface, count(distinct b.label)::bigint as others, case when a.label < 'b' then 'curated' else 'uncurated' end as resolution
from k a join k b on a.kind = 'S' and b.kind = 'R' and a.label = b.label group by all""")
def collision_audit(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    rows = p.select(F.lit("R").alias("kind"), F.col("p_name").alias("label"), F.col("p_brand").alias("qid"), F.col("p_partkey").alias("entity")).unionByName(
        p.where("p_size > 20").select(F.lit("S").alias("kind"), F.col("p_name").alias("label"), F.col("p_type").alias("qid"), (F.col("p_partkey") + 1000000).alias("entity")))
    one = rows.withColumn("label", F.regexp_replace("label", " ", "_")).withColumn("qids", F.array("qid"))
    out = A.collision_audit(one, one.where("label < 'b'"), ("S", "R"))
    return out.select("entity", F.regexp_replace(F.col("surfaces")[0], "_", " ").alias("surface"), F.size("others").cast("long").alias("others"), "resolution")
