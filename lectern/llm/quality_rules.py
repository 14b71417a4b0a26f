"""Quality rules with cross-document line frequency, in DataFrame operations only.

Per document: counts of words, characters, symbols, repeated lines and words in
repeated three-word windows.  Across documents: normalised lines are hashed, and
for every host the distinct documents that hold a line are counted (copies of
one text on a host are one document).  Lines above the host's limit are taken
out of the texts; a document that loses more than half of its words that way is
depleted, which is judged by the text that is left.

Texts are read twice: once for the hashes of their lines, and once for the
counts and the removal.  Windows of a text are compared inside its row (a sort
of its hashes, and only where two of them are equal), so no word is ever
shuffled.  Frequent lines meet the texts as one broadcast list per host where
they were counted to be few, else every text meets its own in a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .line_dedup import line_hashes
from .shared import table

SYMBOLS = "#*$%&|<>"
_BLANK = r"[\x20\x09-\x0D]+"
#: Frequent lines (8 bytes each) up to which the lists are broadcast: of all hosts, and of one, as each of its rows meets its list.
FEW_LINES, HOST_LINES = 1_000_000, 4_000
#: Parts into which a host's frequent line is spread beyond.
SALTS = 32


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, _BLANK), "")


def window_ids(w: Column) -> Column:
    """One id per three-word window, null where no two windows fit."""
    at = F.sequence(F.lit(0), F.size(w) - 3)
    return F.when(F.size(w) >= 4, F.transform(at, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))


def _named(docs: DataFrame) -> DataFrame:
    """doc_id, text as it came, host, copy: the two name a host's distinct texts."""
    known = F.coalesce("text", F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("source").alias("host")
    ).withColumn("copy", F.xxhash64(known, F.length(known)))


def frequent_lines(docs: DataFrame, min_docs: int, host_share: float) -> tuple[DataFrame, DataFrame]:
    """(host, copy, hashes) of every distinct text of a host, and (host, line) of the lines above the host's limit."""
    hashes = F.array_distinct(F.filter(line_hashes(F.coalesce("text", F.lit(""))), lambda x: x.isNotNull()))
    rows = _named(docs).select("host", "copy", hashes.alias("hashes"))
    texts = table(rows.groupBy("host", "copy").agg(F.first("hashes").alias("hashes")), "texts")
    hosts = texts.groupBy("host").agg(F.count("*").alias("docs"))
    often = (
        texts.select("host", F.explode("hashes").alias("line"))
        .groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > min_docs)
        .join(hosts, "host").where(F.col("n") > host_share * F.col("docs")).select("host", "line")
    )
    return texts, table(often, "often")


def _with_taken(docs: DataFrame, texts: DataFrame, often: DataFrame) -> DataFrame:
    """docs with taken: hashes among which are all frequent lines of the row's text, null for none."""
    total, longest = often.groupBy("host").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    if total <= FEW_LINES and longest <= HOST_LINES:
        return docs.join(F.broadcast(often.groupBy("host").agg(F.collect_list("line").alias("taken"))), "host", "left")
    held = texts.select("host", "copy", F.explode("hashes").alias("line")).withColumn("salt", F.pmod("copy", F.lit(SALTS)).cast("int"))
    every = often.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = held.join(every, ["host", "line", "salt"]).groupBy("host", "copy").agg(F.collect_list("line").alias("taken"))
    return docs.join(own, ["host", "copy"], "left")


def _taken_out(rows: DataFrame) -> DataFrame:
    """rows with left: the text without the lines in taken, null where it holds none of them."""
    rows = rows.withColumn("hashes", F.when(F.col("taken").isNotNull(), line_hashes(F.col("text"))))
    rows = rows.withColumn("gone", F.array_intersect("hashes", "taken")).drop("taken")
    # a lookup reads one of about sqrt(n) parts, so that a long text of many such lines is not quadratic
    parts = F.ceil(F.sqrt(F.size("gone"))).cast("long")
    rows = rows.withColumn("parts", F.when(F.size("gone") > 0, parts))
    cut = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda p: F.filter("gone", lambda x: F.pmod(x, "parts") == p))
    rows = rows.withColumn("gone", cut)
    lines = F.arrays_zip(F.split("text", "\n").alias("l"), F.col("hashes").alias("x"))
    stays = F.filter(lines, lambda z: ~F.coalesce(F.array_contains(F.get("gone", F.pmod(z["x"], "parts").cast("int")), z["x"]), F.lit(False)))
    left = F.array_join(F.transform(stays, lambda z: z["l"]), "\n")
    return rows.withColumn("left", F.when(F.col("parts").isNotNull(), left)).drop("hashes", "gone", "parts")


def profile(rows: DataFrame) -> DataFrame:
    """rows with the counts of text, and with n_left: the words of left."""
    text = F.coalesce("text", F.lit(""))
    one = rows.select(
        "doc_id", "text", "left",
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("own_lines"),
        words(text).alias("w"),
        F.when(F.col("left").isNotNull(), F.size(words(F.col("left")))).alias("w_left"),
    )
    two = one.select(
        "doc_id", "text", "left", "word_chars", "n_symbols",
        F.size("w").cast("long").alias("n_words"),
        (F.size("own_lines") - F.size(F.array_distinct("own_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce("w_left", F.size("w")).cast("long").alias("n_left"),
        window_ids(F.col("w")).alias("ids"),
    )
    # most texts repeat no window; only the others are sorted
    sortable = F.when(F.size("ids") > F.size(F.array_distinct("ids")), F.col("ids"))
    placed = F.array_sort(F.transform(sortable, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    three = two.withColumn("s", placed).drop("ids")
    last = F.size("s") - 1
    # in sorted order equal ids are neighbours
    hit = F.filter(
        "s",
        lambda z, k: F.coalesce(F.when(k > 0, z["x"] == F.get(F.col("s"), k - 1)["x"]), F.lit(False))
        | F.coalesce(F.when(k < last, z["x"] == F.get(F.col("s"), k + 1)["x"]), F.lit(False)),
    )
    spots = F.flatten(F.transform(hit, lambda z: F.array(z["i"], z["i"] + 1, z["i"] + 2)))
    return three.withColumn(
        "n_repeat_words", F.when(F.col("s").isNull(), 0).otherwise(F.size(F.array_distinct(spots))).cast("long")
    ).drop("s")


def quality_rules(
    docs: DataFrame, min_docs: int = 10, host_share: float = 0.02, least_left: float = 0.5
) -> DataFrame:
    """One row per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, removed_words, base_failed, kept, and text: what is left of it.

    A line is taken out of a host's documents when more than min_docs distinct
    documents of the host, and more than host_share of them, hold it.  A document
    is depleted when less than least_left of its words are left.  kept is false
    for documents that fail the base rules (fewer than 50 words, or more than
    half of the words in repeated windows) and for depleted ones.  The counts up
    to n_repeat_words and the base rules are those of the text as it came.

    Hosts are values of source; null is one host.  Null and empty texts have no
    words, fail the base rules and stay as they are; lines without a word stay in
    any text.  Repeated rows and null doc_ids are ordinary rows; an empty table
    gives an empty result; further columns are ignored.
    """
    texts, often = frequent_lines(docs, min_docs, host_share)
    rows = profile(_taken_out(_with_taken(_named(docs), texts, often))).withColumn("removed_words", F.col("n_words") - F.col("n_left"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    depleted = F.col("n_left") < least_left * F.col("n_words")
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed_words",
        failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), F.coalesce("left", "text").alias("text"),
    )


ORACLE = """
with base as (select doc_id, source, coalesce(text, '') as text from documents),
w as (
  select doc_id, text, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from base
), win as (
  select doc_id, unnest(range(1, len(w) - 1)) as i, w from w where len(w) >= 3
), win2 as (
  select doc_id, i, list_slice(w, i, i + 2) as g from win
), rep as (
  select doc_id, i, count(*) over (partition by doc_id, g) as c from win2
), cov as (
  select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from rep where c > 1) group by doc_id
), ownl as (
  select doc_id, count(*) - count(distinct l) as n_dup from (select doc_id, unnest(string_split(text, chr(10))) as l from base)
  where regexp_matches(l, '[^\\x20\\x09-\\x0D]') group by doc_id
), raw as (
  select doc_id, source, text, unnest(string_split(text, chr(10))) as l from base
), norm as (
  select doc_id, source, text, trim(regexp_replace(lower(l), '[\\x20\\x09\\x0B-\\x0D]+', ' ', 'g'), ' ') as l from raw
), held as (
  select *, length(l) - length(replace(l, ' ', '')) + 1 as n from norm where l <> ''
), hosts as (
  select source, count(distinct text) as docs from base group by source
), often as (
  select h.source, l from held h join hosts o on h.source is not distinct from o.source
  group by h.source, l, o.docs having count(distinct text) > 10 and count(distinct text) > 0.02 * o.docs
), lost as (
  select doc_id, sum(n) as lost from held h join often o on h.source is not distinct from o.source and h.l = o.l group by doc_id
), counts as (
  select b.doc_id, len(w.w) as n_words, length(regexp_replace(b.text, '[\\x20\\x09-\\x0D]', '', 'g')) as word_chars,
    length(b.text) - length(regexp_replace(b.text, '[#*$%&|<>]', '', 'g')) as n_symbols,
    coalesce(n_dup, 0) as n_dup_lines, coalesce(cov.n, 0) as n_repeat_words, coalesce(lost, 0) as removed_words
  from base b join w using (doc_id) left join cov using (doc_id) left join ownl using (doc_id) left join lost using (doc_id)
), judged as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from counts
)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols,
  n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, removed_words::bigint as removed_words,
  base_failed, not base_failed and not (n_words - removed_words < 0.5 * n_words) as kept
from judged
"""
