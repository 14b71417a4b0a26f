"""Dictionary tagging of texts: scan, boundaries, scopes, overlap resolution, audits."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import islice

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T

from .folds import kept_in_order
from .relational import overlaps_resolved


#: Dictionary surfaces in one automaton; a larger dictionary is taken in several passes over the text.
SURFACES = 500_000


#: Rows that a worker hands on at once.
ROWS = 20_000


def occurrences(texts: DataFrame, surfaces: DataFrame, bounded: bool = True, shown: str | None = None) -> DataFrame:
    """(id, owner, start, end, surface): every place in texts(id, owner, text) where a surface stands, overlaps included.

    bounded: no letter directly before or after.  Surfaces go into Aho-Corasick
    automata of at most SURFACES each, which read a text once whatever their
    number; offsets count code points.  shown: a column of texts as long as text
    is; what it reads at a place becomes a further column of that name.
    """
    named = surfaces.where("surface is not null and surface <> ''").select("surface").distinct()
    passes = max(1, -(-named.count() // SURFACES))
    columns, schema = ["id", "owner", "text"], f"id {dict(texts.dtypes)['id']}, owner string, start int, end int, surface string"
    if shown:
        columns, schema = [*columns, shown], f"{schema}, {shown} string"
    found = []
    for k in range(passes):
        words = [r.surface for r in named.where(F.pmod(F.xxhash64("surface"), F.lit(passes)) == k).collect()]  # about SURFACES
        found.append(texts.select(*columns).mapInPandas(_finder(words, bounded, shown), schema))
    return reduce(DataFrame.unionByName, found)


def _in_pieces(rows: Iterator[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    """Frames of at most ROWS rows, so that a worker never holds what a whole batch or a long text makes."""
    while piece := list(islice(rows, ROWS)):
        yield pd.DataFrame(piece, columns=columns)


def _finder(words: list[str], bounded: bool, shown: str | None = None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = ahocorasick.Automaton()
        for w in words:
            automaton.add_word(w, w)
        automaton.make_automaton()

        def places() -> Iterator[tuple]:
            for batch in batches:
                for key, owner, text, *other in batch.itertuples(index=False, name=None):
                    for last, w in automaton.iter(text) if text and words else ():
                        start, end = last + 1 - len(w), last + 1
                        if bounded and ((start and text[start - 1].isalpha()) or (end < len(text) and text[end].isalpha())):
                            continue
                        yield (key, owner, start, end, w, *[o[start:end] for o in other])

        yield from _in_pieces(places(), ["id", "owner", "start", "end", "surface", *([shown] if shown else [])])

    return run


def letter_runs(sections: DataFrame, capitalised: bool = False) -> DataFrame:
    """(id, token, start, end, surface, before): a row per letter run of the folded text, as letter_tokens has them.

    Rows leave the worker in pieces, so memory follows neither a batch's number of
    words nor a text's length.  capitalised: runs that begin with a small letter stay behind.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for key, text, folded in zip(batch["id"], batch["text"], batch["folded"], strict=True):
                    for token, start, end, surface, before in T.runs_of(text, folded):
                        if not (capitalised and surface[:1].islower()):
                            yield key, token, start, end, surface, before

        yield from _in_pieces(rows(), ["id", "token", "start", "end", "surface", "before"])

    kind = dict(sections.dtypes)["id"]
    return sections.select("id", "text", T.fold(F.col("text")).alias("folded")).mapInPandas(run, f"id {kind}, token string, start int, end int, surface string, before string")


def scan(sections: DataFrame, entries: DataFrame) -> DataFrame:
    """(id, start, end, surface, entity, heuristic): dictionary surfaces in texts, longest first.

    sections: id, owner, text; entries: surface, entity, scopes (array of owners,
    null: everywhere), heuristic.  Matches are case-sensitive and bounded by
    non-letters; offsets count code points.  Of overlapping places the first
    counts, of those that begin together the longest.  A scoped entry that fits
    the owner beats an unscoped one of the same surface; a heuristic entry counts
    only in its scopes; a place without an entry that fits is still taken.
    """
    places = occurrences(sections.select(F.col("id").cast("long").alias("id"), "owner", "text"), entries)
    step = lambda last, z: (z[1], True) if last is None or z[0] >= last else (last, False)
    taken = kept_in_order(places, ["id", "owner"], ["start", F.desc("end")], ["start", "end"], None, step)
    scoped = F.col("scopes").isNotNull()
    known = entries.groupBy("surface").agg(F.sort_array(F.collect_list(F.struct((~scoped).alias("last"), "entity", "scopes", F.coalesce("heuristic", F.lit(False)).alias("heuristic")))).alias("e"))
    fits = F.filter("e", lambda z: z["scopes"].isNull() | F.array_contains(z["scopes"], F.col("owner")))
    best = taken.join(known, "surface").withColumn("best", F.get(fits, F.lit(0))).where("best is not null")
    return best.select("id", "start", "end", "surface", "best.entity", "best.heuristic")


def tag_terms(sections: DataFrame, terms: DataFrame, endings: tuple[str, ...], names_need_capital: bool = True) -> DataFrame:
    """Spans of inflected terms: a token that is the form, or its stem and a listed ending.

    terms: form (folded), stem (null: exact only), entity, name (boolean).  A
    name must begin with a capital in the ORIGINAL text.  An automaton of the
    forms each term can take reads the text once; only what it finds leaves a worker.
    """
    forms = terms.select("entity", "name", F.explode(F.when(F.col("stem").isNull(), F.array("form")).otherwise(
        F.array_union(F.array("form"), F.transform(F.array(*map(F.lit, endings)), lambda e: F.concat("stem", e)))
    )).alias("token"))
    # a token is a whole run of letters: a form with other signs is none
    texts = sections.select("id", F.lit(None).cast("string").alias("owner"), T.fold(F.col("text")).alias("text"), F.col("text").alias("shown"))
    found = occurrences(texts, forms.where(F.col("token").rlike(r"^\p{L}+$")).select(F.col("token").alias("surface")), shown="shown")
    tokens = found.select("id", F.col("surface").alias("token"), "start", "end", F.col("shown").alias("surface"))
    hits = tokens.join(F.broadcast(forms), "token")
    if names_need_capital:
        hits = hits.where(~F.col("name") | F.col("surface").rlike(r"^\p{Lu}"))
    return hits.select("id", "start", "end", "surface", "entity", F.lit(False).alias("heuristic")).distinct()


def annotate(*layers: DataFrame) -> DataFrame:
    """Spans of several scans, without overlaps inside a section."""
    spans = layers[0]
    for more in layers[1:]:
        spans = spans.unionByName(more)
    return overlaps_resolved(spans, "id")


def entity_index(spans: DataFrame) -> DataFrame:
    """(entity, occurrences, sections): by occurrences, then entity."""
    return spans.groupBy("entity").agg(F.count("*").alias("occurrences"), F.countDistinct("id").alias("sections"))


def proper_noun_audit(sections: DataFrame, spans: DataFrame, blocklist: DataFrame, ambiguous: DataFrame) -> DataFrame:
    """(token, state, n) of capitalised words that begin no sentence: tagged, heuristic, blocklisted, ambiguous or untagged."""
    words = letter_runs(sections, capitalised=True).select(
        "id", "start", "end", F.col("surface").alias("token"), T.ends_sentence(F.col("before")).alias("initial")
    ).where(F.col("token").rlike(r"^\p{Lu}\p{Ll}") & ~F.col("initial"))
    s = spans.select("id", F.col("start").alias("_s"), F.col("end").alias("_e"), F.col("heuristic").cast("int").alias("h"))
    hit = words.join(s, (words["id"] == s["id"]) & (s["_s"] < words["end"]) & (s["_e"] > words["start"]), "left").select(words["*"], "h")
    one = hit.groupBy("id", "start", "end", "token").agg(F.min("h").alias("h"))
    flagged = one.join(F.broadcast(blocklist.select("token").distinct().withColumn("b", F.lit(True))), "token", "left").join(
        F.broadcast(ambiguous.select("token").distinct().withColumn("a", F.lit(True))), "token", "left"
    )
    state = F.when(F.col("h") == 0, "tagged").when(F.col("h") == 1, "heuristic").when(F.col("b"), "blocklisted").when(F.col("a"), "ambiguous").otherwise("untagged")
    return flagged.groupBy("token", state.alias("state")).agg(F.count("*").alias("n"))


def recall_audit(sections: DataFrame, surfaces: DataFrame, spans: DataFrame) -> DataFrame:
    """(surface, found, tagged, missed): dictionary surfaces in the text against the spans that cover them."""
    everywhere = surfaces.select("surface", F.col("surface").alias("entity"), F.lit(None).cast("array<string>").alias("scopes"), F.lit(False).alias("heuristic"))
    found = scan(sections, everywhere)
    s = spans.select("id", F.col("start").alias("_s"), F.col("end").alias("_e"))
    hit = found.join(s, (found["id"] == s["id"]) & (s["_s"] < found["end"]) & (s["_e"] > found["start"]), "left_semi").groupBy("surface").agg(F.count("*").alias("tagged"))
    total = found.groupBy("surface").agg(F.count("*").alias("found")).join(hit, "surface", "left").na.fill(0, ["tagged"])
    return total.select("surface", "found", "tagged", (F.col("found") - F.col("tagged")).alias("missed"))


def _untagged(places: DataFrame, spans: DataFrame) -> DataFrame:
    s = spans.select(F.col("id").alias("_id"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    return places.join(s, (F.col("id") == F.col("_id")) & (F.col("_s") < F.col("end")) & (F.col("_e") > F.col("start")), "left_anti")


def _audited(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy("key", "state").agg(F.count("*").alias("n")).select(F.lit(name).alias("audit"), "key", "state", "n")


def missed_places(name: str, sections: DataFrame, entries: DataFrame, ledger: DataFrame, spans: DataFrame) -> DataFrame:
    """(audit, key, state, n): untagged places of one language, name-1 of dictionary entries and name-2 of the ledger.

    entries: surface, scopes; ledger: surface, reason (left out on purpose).  A
    place of an entry is unexpected if an entry of the surface fits the section's
    owner, else scoped out; a place of the ledger has its reason.
    """
    own = _untagged(occurrences(sections.select("id", "owner", "text"), entries), spans)
    scoped = entries.groupBy("surface").agg(F.bool_or(F.col("scopes").isNull()).alias("open"), F.flatten(F.collect_list("scopes")).alias("owners"))
    fits = F.col("open") | F.coalesce(F.array_contains("owners", F.col("owner")), F.lit(False))
    first = own.join(scoped, "surface").select(F.col("surface").alias("key"), F.when(fits, "unexpected").otherwise("scoped out").alias("state"))
    rest = ledger.join(entries.select("surface"), "surface", "left_anti").groupBy("surface").agg(F.min("reason").alias("state"))
    second = _untagged(occurrences(sections.select("id", "owner", "text"), rest), spans).join(rest, "surface").select(F.col("surface").alias("key"), "state")
    return _audited(first, f"{name}-1").unionByName(_audited(second, f"{name}-2"))


def unnamed_entities(name: str, sections: DataFrame, entities: DataFrame, entries: DataFrame) -> DataFrame:
    """name-3: entities(entity, label) without a surface whose label stands in the text; claimed if another's surface is that label."""
    bare = entities.join(entries.select("entity").distinct(), "entity", "left_anti").select("entity", F.col("label").alias("surface"))
    claimed = entries.select("surface").distinct().withColumn("c", F.lit(True))
    found = occurrences(sections.select("id", "owner", "text"), bare).join(bare, "surface").join(claimed, "surface", "left")
    return _audited(found.select(F.col("entity").alias("key"), F.when(F.col("c"), "claimed").otherwise("gap").alias("state")), f"{name}-3")


def one_sided_entities(name: str, here: DataFrame, there: DataFrame, skips: DataFrame, by_design: DataFrame) -> DataFrame:
    """name-3 of a second language: entities tagged there and never here, without those skipped; works and the like apart.

    here and there: spans; skips and by_design: entity.  n counts the places there.
    """
    rows = there.select("entity").join(here.select("entity"), "entity", "left_anti").join(skips.select("entity"), "entity", "left_anti")
    marked = rows.join(by_design.select("entity").distinct().withColumn("d", F.lit(True)), "entity", "left")
    return _audited(marked.select(F.col("entity").alias("key"), F.when(F.col("d"), "by design").otherwise("candidate").alias("state")), f"{name}-3")


def dead_entries(sections: DataFrame, entries: DataFrame) -> DataFrame:
    """DEAD: surfaces that stand nowhere, and scoped ones that stand nowhere in their scopes; n is the number of entries."""
    seen = occurrences(sections.select("id", "owner", "text"), entries).groupBy("surface").agg(F.collect_set("owner").alias("owners"))
    rows = entries.select("surface", "scopes").join(seen, "surface", "left")
    state = F.when(F.col("owners").isNull(), "nowhere").when(F.col("scopes").isNotNull() & ~F.arrays_overlap("scopes", "owners"), "not in scope")
    return _audited(rows.select(F.col("surface").alias("key"), state.alias("state")).where("state is not null"), "DEAD")


def candidate_entries(names: DataFrame, blocklist: DataFrame) -> DataFrame:
    """Dictionary entries from entity names: surface, entity, scopes, heuristic, and skipped(reason) rows.

    names: entity, name, kind, qids (array).  A surface of several entities is
    one entry if all share an external id; otherwise works lose against other
    kinds, and what is still ambiguous is skipped, as are blocklisted surfaces.
    """
    groups = names.groupBy(F.col("name").alias("surface")).agg(
        F.sort_array(F.collect_set(F.struct((F.col("kind") == "work").cast("int").alias("w"), "entity"))).alias("c"),
        F.collect_list("qids").alias("q"),
    )
    shared = F.size(F.aggregate(F.slice("q", F.lit(2), F.size("q")), F.col("q")[0], lambda a, b: F.array_intersect(a, b))) > 0
    others = F.filter("c", lambda z: z["w"] == 0)
    pick = F.when(F.size("c") == 1, F.col("c")[0]["entity"]).when(shared, F.col("c")[0]["entity"]).when(F.size(others) == 1, others[0]["entity"])
    blocked = groups.join(F.broadcast(blocklist.select(F.col("token").alias("surface")).distinct().withColumn("b", F.lit(True))), "surface", "left")
    reason = F.when(F.col("b"), "blocklisted").when(pick.isNull(), "ambiguous")
    return blocked.select("surface", F.when(reason.isNull(), pick).alias("entity"), F.lit(None).cast("array<string>").alias("scopes"), F.lit(False).alias("heuristic"), reason.alias("skipped"))


def collision_audit(entities: DataFrame, curated: DataFrame, kinds: tuple[str, str] = ("source", "philosopher")) -> DataFrame:
    """(entity, surfaces, others, resolution) of entities of the first kind whose surfaces are also the second kind's.

    entities: entity, label, kind, qids (array); curated: label.  Surfaces are the
    label and, of several words, a capitalised first one of three letters or more;
    labels that join names have none.  Resolved as curated, as shared-qid if every
    other one shares an external id, else uncurated.
    """
    label = F.trim("label")
    first = F.split(label, r"\s+")[0]
    more = F.when(label.rlike(r"\s") & first.rlike("^[A-Z]") & (F.length(first) >= 3), first)
    found = F.when(label.rlike(r"[,/]| or "), F.array().cast("array<string>")).otherwise(F.array_compact(F.array(F.when(F.length(label) >= 3, label), more)))
    ids = F.array_sort(F.array_distinct(F.coalesce("qids", F.array().cast("array<string>"))))
    every = entities.select("entity", "label", "kind", ids.alias("qids"), F.explode(F.array_distinct(found)).alias("surface"))
    mine, other = (every.where(F.col("kind") == k) for k in kinds)
    # what an entity meets follows from its surface and ids alone: classes of equal ids are counted, entities never paired
    classes = other.select(F.col("surface").alias("s"), F.col("qids").alias("oq")).distinct()
    own = mine.select("surface", "qids").distinct().withColumn("q", F.explode("qids"))
    same = own.join(classes.withColumn("x", F.explode("oq")), (F.col("surface") == F.col("s")) & F.col("q").eqNullSafe(F.col("x"))).select("surface", "qids", "oq").distinct()
    hits = same.groupBy("surface", "qids").agg(F.count("*").alias("hits"))
    total = classes.groupBy(F.col("s").alias("surface")).agg(F.count("*").alias("classes"))
    met = other.groupBy("surface").agg(F.sort_array(F.collect_set("label")).alias("ol")).join(total, "surface")
    each = mine.join(met, "surface").join(hits, ["surface", "qids"], "left")
    rows = each.groupBy("entity", "label").agg(
        F.sort_array(F.collect_set("surface")).alias("surfaces"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("ol")))).alias("others"),
        F.bool_and(F.coalesce("hits", F.lit(0)) == F.col("classes")).alias("same"),
    )
    known = rows.join(curated.select("label").distinct().withColumn("c", F.lit(True)), "label", "left")
    resolution = F.when(F.col("c"), "curated").when(F.col("same"), "shared-qid").otherwise("uncurated")
    return known.select("entity", "surfaces", "others", resolution.alias("resolution"))


def unique_link(entities: DataFrame, objects: DataFrame) -> DataFrame:
    """(entity, object): the object with the entity's category and label if just one has it, else null."""
    one = objects.groupBy("category", "label").agg(F.when(F.count("*") == 1, F.first("object")).alias("object"))
    return entities.join(one, ["category", "label"], "left").groupBy("entity").agg(F.when(F.countDistinct("object") == 1, F.min("object")).alias("object"))
