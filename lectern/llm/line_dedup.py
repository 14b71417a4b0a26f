"""Cross-site boilerplate lines by distinct-site spread, in DataFrame operations only.

A line is normalised (lower case, runs of blanks as one blank, ends trimmed)
and hashed; every line that is not empty counts, whatever its length or script.
Distinct (line, site) pairs are made first.  Lines on one site only are set
aside by a cheap min/max.  For the others, HyperLogLog sketches of the sites are
merged per line hash; where the estimate is close to the threshold the sites are
counted exactly.  A line that reaches the threshold is boilerplate: it stays in
the document with the smallest doc_id that holds it and is removed everywhere
else.

The text is normalised once into arrays of hashes; only hashes are exploded and
shuffled.  A line on every page is one pair per task and site after map-side
aggregation; where documents meet the boilerplate lines again, those are
broadcast if they were counted to be few, else every line is spread over salts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh, table

#: Boilerplate lines (16 bytes each) up to which they are broadcast, and the salts of a line beyond.
FEW_LINES, SALTS = 1_000_000, 32


def _normal_lines(text: Column) -> Column:
    flat = F.regexp_replace(F.lower(text), r"[\x20\x09\x0B-\x0D]+", " ")
    return F.split(F.trim(flat), " ?\n ?")


def line_hashes(text: Column) -> Column:
    """One hash per line of the text, null for empty lines."""
    return F.transform(_normal_lines(text), lambda x: F.when(x != "", F.xxhash64(x)))


def boilerplate(lines: DataFrame, min_sites: int, lg_k: int) -> DataFrame:
    """(line, first_doc) of lines on min_sites sites or more; lines: doc_id, site, hashes."""
    seen = lines.select("doc_id", "site", F.explode(F.array_distinct(F.filter("hashes", lambda x: x.isNotNull()))).alias("line"))
    pairs = table(seen.groupBy("line", "site").agg(F.min("doc_id").alias("first_doc")), "pairs")
    spread = (
        pairs.groupBy("line")
        .agg(F.min("site").alias("lo"), F.max("site").alias("hi"), F.min("first_doc").alias("first_doc"))
        .where("lo <> hi")
        .select("line", "first_doc")
    )
    wide = table(pairs.select("line", "site").join(spread, "line"), "wide")
    sketched = table(
        wide.groupBy("line").agg(
            F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k))).alias("sites"), F.min("first_doc").alias("first_doc")
        ),
        "sketched",
    )
    # four standard errors of the sketch, and one site at least
    margin = max(1.0, 4 * 1.04 / 2 ** (lg_k / 2) * min_sites)
    near = F.abs(F.col("sites") - min_sites) <= margin
    exact = (
        wide.join(sketched.where(near).select("line"), "line", "left_semi")
        .groupBy("line")
        .agg(F.count("*").alias("n"), F.min("first_doc").alias("first_doc"))
        .where(F.col("n") >= min_sites)
        .select("line", "first_doc")
    )
    return sketched.where(~near & (F.col("sites") > min_sites)).select("line", "first_doc").unionByName(exact)


def _met(lines: DataFrame, common: DataFrame) -> DataFrame:
    """(doc_id, line, first_doc) of the lines that are common; a hot line is no hot task."""
    rows = lines.select("doc_id", F.explode(F.array_distinct("hashes")).alias("line"))
    if common.count() <= FEW_LINES:
        return rows.join(F.broadcast(common), "line")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    every = common.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(every, ["line", "salt"]).drop("salt")


def _judged(docs: DataFrame, min_sites: int, lg_k: int, n_lines: str, n_removed: str) -> DataFrame:
    """docs with text replaced and the counts under two names that docs does not have."""
    gone_id, gone, kept = fresh([*docs.columns, n_lines, n_removed], "gone_id", "gone", "left_over")
    lines = table(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("source").alias("site"), line_hashes(F.col("text")).alias("hashes")
        ).where("text is not null"),
        "lines",
    )
    common = table(boilerplate(lines, min_sites, lg_k), "boilerplate")
    drops = (
        _met(lines, common)
        .where(~F.col("doc_id").eqNullSafe(F.col("first_doc")))
        .groupBy(F.col("doc_id").alias(gone_id))
        .agg(F.collect_set("line").alias(gone))
    )
    joined = docs.join(drops, F.col("doc_id").cast("long").eqNullSafe(F.col(gone_id)), "left")
    raw = F.split("text", "\n")
    stays = F.transform(line_hashes(F.col("text")), lambda x: ~F.coalesce(F.array_contains(gone, x), F.lit(False)))
    left = F.filter(F.arrays_zip(raw.alias("l"), stays.alias("s")), lambda z: z["s"])
    joined = joined.withColumn(kept, F.when(F.col(gone).isNotNull(), F.transform(left, lambda z: z["l"])))
    count = F.when(F.coalesce(F.length("text"), F.lit(0)) == 0, 0).otherwise(F.size(raw))
    text = F.when(F.col(kept).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return joined.select(
        *[text.alias(c) if c == "text" else F.col(c) for c in docs.columns],
        count.cast("long").alias(n_lines),
        F.when(F.col(kept).isNull(), 0).otherwise(F.size(raw) - F.size(kept)).cast("long").alias(n_removed),
    )


def remove_boilerplate(docs: DataFrame, min_sites: int = 5, lg_k: int = 12) -> DataFrame:
    """docs with text replaced, plus n_lines and n_removed (long).

    A site is a value of source; null counts as one site.  Null and empty texts
    have no lines and pass through (n_lines 0).  Rows that repeat a doc_id or
    lack one are ordinary rows; the copy kept is that of the smallest doc_id,
    and a line that only rows without doc_id hold stays in all of them.
    Other columns pass through, whatever their names; columns named n_lines or
    n_removed are replaced.  An empty table gives an empty result.
    """
    return _judged(docs.drop("n_lines", "n_removed"), min_sites, lg_k, "n_lines", "n_removed")


def without_boilerplate(docs: DataFrame, **options) -> DataFrame:
    """docs with boilerplate lines taken out and n_chars brought up to date.

    A document whose words were all in lines that another document keeps holds
    nothing of its own any more and goes; a text that had no words to begin with
    stays as it is.  All other columns pass through, n_lines and n_removed too.
    """
    names = docs.columns
    n_lines, n_removed = fresh(names, "n_lines", "n_removed")
    out = _judged(docs, options.get("min_sites", 5), options.get("lg_k", 12), n_lines, n_removed)
    emptied = (F.col(n_removed) > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    out = out.where(~F.coalesce(emptied, F.lit(False)))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col(n_removed) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*names)


#: The digest of op4_line_dedup for DuckDB.
ORACLE = """
with lines as (
  select doc_id, source, u.i, u.raw,
    trim(regexp_replace(lower(u.raw), '[\\x20\\x09\\x0B-\\x0D]+', ' ', 'g'), ' ') as norm
  from documents, unnest(list_transform(string_split(text, chr(10)), lambda x, i: {'raw': x, 'i': i})) as t(u)
  where length(text) > 0
), eligible as (
  select *, norm <> '' as ok from lines
), spread as (
  select norm, min(doc_id) as first_doc from eligible where ok
  group by norm having count(distinct coalesce(source, chr(1))) >= 5
), judged as (
  select e.*, s.norm is not null and e.doc_id is distinct from s.first_doc as gone
  from eligible e left join spread s on e.ok and e.norm = s.norm
), rebuilt as (
  select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_removed,
    coalesce(string_agg(raw, chr(10) order by i) filter (where not gone), '') as text
  from judged group by doc_id
)
select d.doc_id, coalesce(r.n_lines, 0)::bigint as n_lines, coalesce(r.n_removed, 0)::bigint as n_removed,
  md5(coalesce(r.text, d.text)) as text_md5
from documents d left join rebuilt r using (doc_id)
"""
