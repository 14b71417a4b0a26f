"""Derived views: places, chronology, transmission, grounded answers, rendering, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T

from .folds import kept_in_order
from .graph import settled
from .relational import certainty_rank, first_per, sent

#: Ages above this are legend and date nothing.
OLDEST = 110

# How a dated statement tells a floruit.
FLORUIT = (
    "^(Flourish|Lived in the|Was (already )?an old man|Became head|Was head of the school|Succeeded .* head of the school|"
    "Rose to be head|Assumed the headship|Presided over the school|Came to Athens)"
)

# Signs of a work's fate in a note, in the order they are tried.
LOST, EXTANT, SPURIOUS = r"(?i)\bburnt\b|\bburned\b|\bdestroyed\b", r"(?i)\bextant\b|\bsurvive", "(?i)spurious|not genuine|forged"


# ---------------------------------------------------------------- chronology


def event_kind(value: Column, prop: Column) -> Column:
    """flourished, died or born, from the wording first and the property second."""
    return (
        F.when(value.rlike(FLORUIT), "flourished")
        .when(value.rlike(r"^Was\b") & value.rlike(r"(?i)\bdied\b"), "died")
        .when(prop == "birthDate", "born").otherwise("died")
    )


def year_role(value: Column, kind: Column) -> Column:
    """What the year dates: its kind, a floruit, or an observation of an age that dates neither end."""
    observed = value.rlike(r"(?i)^was\s") & ~value.rlike("(?i)^was an old man")
    return F.when(kind == "flourished", kind).when(observed, "observation").when(value.rlike("(?i)floruit|flourish"), "flourished").otherwise(kind)


def timeline(claims: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """(name, birth, death, floruit, approx_birth, approx_death, place) in order of the earliest plausible anchor.

    claims: subject, property (birthDate, deathDate), value, certainty, ord.  The
    best certainty dates an end, the first among equals; an end that is missing
    comes from the age at death, then from observations in order.  members: name,
    anchor, years, age; people who died so many years before someone dated.
    """
    value = F.col("value")
    kind = event_kind(value, F.col("property"))
    e = claims.where(F.col("property").isin("birthDate", "deathDate")).select(
        F.col("subject").alias("name"), value, kind.alias("kind"), year_role(value, kind).alias("role"), T.bce_year(value)["year"].alias("year"),
        T.age(value).alias("age"), certainty_rank(F.col("certainty")).alias("rank"), "ord",
    )
    order = F.struct("rank", "ord")
    best = lambda what, when: F.min_by(what, F.when(when & F.col(what).isNotNull(), order))
    seen = (F.col("role") == "observation") & F.col("year").isNotNull() & (F.col("age") <= OLDEST)
    rows = e.groupBy("name").agg(
        *[best("year", F.col("role") == r).alias(r) for r in ("born", "died", "flourished")],
        best("age", (F.col("kind") == "died") & (F.col("age") <= OLDEST)).alias("age"),
        F.min_by(F.col("year") - F.col("age"), F.when(seen, F.col("ord"))).alias("obs_birth"),
        F.min_by("year", F.when(seen & value.rlike(r"(?i)\bdied\b"), F.col("ord"))).alias("obs_death"),
    )
    birth, death = F.coalesce("born", F.col("died") - F.col("age"), "obs_birth"), F.coalesce("died", F.col("born") + F.col("age"), "obs_death")
    out = rows.select(
        "name", birth.alias("birth"), death.alias("death"), F.col("flourished").alias("floruit"),
        (F.col("born").isNull() & birth.isNotNull()).alias("approx_birth"), (F.col("died").isNull() & death.isNotNull()).alias("approx_death"),
    ).where("birth is not null or death is not null or floruit is not null")
    if members is not None:
        dated = out.where("death is not null").select(F.col("name").alias("anchor"), F.col("death").alias("_d"))
        late = (F.col("_d") - F.col("years")).alias("death")
        early = F.when(F.col("age") <= OLDEST, F.col("_d") - F.col("years") - F.col("age"))
        more = members.join(dated, "anchor").select(
            "name", early.alias("birth"), late, F.lit(None).cast("int").alias("floruit"), early.isNotNull().alias("approx_birth"), F.lit(True).alias("approx_death")
        )
        out = out.unionByName(more)
    return out.withColumn("anchor_year", F.coalesce("birth", F.col("floruit") - 40, F.col("death") - 70, F.lit(0)))


def axis_ticks(rows: DataFrame, step: int = 50, margin: int = 20) -> DataFrame:
    """(tick): multiples of step around all years of birth, death and floruit; a default span without any."""
    lo, hi = F.min(F.least("birth", "death", "floruit")), F.max(F.greatest("birth", "death", "floruit"))
    ends = rows.agg(F.coalesce(lo, F.lit(-700)).alias("lo"), F.coalesce(hi, F.lit(-100)).alias("hi"))
    first, last = F.floor((F.col("lo") - margin) / step) * step, F.ceil((F.col("hi") + margin) / step) * step
    return ends.select(F.explode(F.sequence(first, last, F.lit(step).cast("long"))).alias("tick"))


# ---------------------------------------------------------------- places, works, groups


def place_events(claims: DataFrame, coordinates: DataFrame, accounts: DataFrame, mention_places: DataFrame) -> DataFrame:
    """(label, lat, lon, events): places of claims with coordinates, and mentioned places that are not among them.

    claims: subject, property, value, ord; an event of a death carries the
    accounts (subject, account) of how it came.  coordinates: label, lat, lon.
    """
    told = accounts.groupBy("subject").agg(F.sort_array(F.collect_list("account")).alias("accounts"))
    rows = claims.join(coordinates, F.col("value") == F.col("label")).join(told, "subject", "left")
    of_death = F.when(F.col("property") == "deathPlace", F.col("accounts"))
    event = F.struct("ord", "subject", "property", of_death.alias("accounts"))
    found = rows.groupBy("label", "lat", "lon").agg(F.sort_array(F.collect_list(event)).alias("events"))
    rest = mention_places.join(found.select("label"), "label", "left_anti").select("label", "lat", "lon")
    return found.unionByName(rest.withColumn("events", F.array().cast(dict(found.dtypes)["events"])))


def transmission(claims: DataFrame) -> DataFrame:
    """(work, ref, status), distinct, of claims that someone wrote a work: lost, extant, spurious, disputed.

    The note decides first, then a disputed certainty; claims without a sign are left out.
    """
    note = F.coalesce("note", F.lit(""))
    status = (
        F.when(note.rlike(LOST), "lost").when(note.rlike(EXTANT), "extant")
        .when((F.col("certainty") == "disputed") & note.rlike(SPURIOUS), "spurious")
        .when(F.col("certainty") == "disputed", "disputed-authorship")
    )
    rows = claims.where(F.col("property") == "wrote").select(F.col("value").alias("work"), "ref", status.alias("status"))
    return rows.where("status is not null").distinct()


def entity_sets(claims: DataFrame) -> DataFrame:
    """(kind, name), distinct: values by their type, and the authorities of claims and of their chains."""
    values = claims.select(F.col("value_type").alias("kind"), F.col("value").alias("name"))
    said = claims.select(F.lit("authority").alias("kind"), F.col("according_to").alias("name"))
    chained = claims.select(F.lit("authority").alias("kind"), F.explode("chain").alias("name"))
    return values.unionByName(said).unionByName(chained).where("name is not null").distinct()


def associates(members: DataFrame, founders: DataFrame, links: DataFrame, drawable: DataFrame) -> DataFrame:
    """(name, school, anchor, teacher, teacher_asserted): members with their school's founder and one drawable teacher.

    A school without a founder is an error; an asserted teacher beats a hedged
    one, else the first.
    """
    at = members.join(founders, "school", "left")
    known = F.assert_true(F.col("founder").isNotNull(), F.concat(F.lit("no founder for "), "school"))
    at = at.withColumn("_c", known).where("_c is null").drop("_c")
    ends = drawable.select(F.col("name").alias("teacher")).unionByName(members.select(F.col("name").alias("teacher"))).distinct()
    legs = links.join(ends, "teacher", "left_semi").join(members.select(F.col("name").alias("pupil")), "pupil", "left_semi")
    one = first_per(legs, ["pupil"], F.desc("asserted"), "ord").select(F.col("pupil").alias("name"), "teacher", F.col("asserted").alias("teacher_asserted"))
    return at.join(one, "name", "left").select("name", "school", F.col("founder").alias("anchor"), "teacher", "teacher_asserted")


def verse_genre(source: Column, author: Column, own: str) -> Column:
    """epigram for anthology sources and for the collection's own author, else null."""
    return F.when(source.startswith("Anth. Pal.") | source.startswith("Anth. Plan.") | (author == own), "epigram")


# ---------------------------------------------------------------- answers


def verbalised(subject: Column, predicate: Column, obj: Column) -> Column:
    return F.trim(F.concat_ws(" ", subject, predicate, obj))


def grounded_lines(retrieved: DataFrame, mentions: DataFrame, assertions: DataFrame, most: int = 12) -> DataFrame:
    """(query, place, assertion, text, passage_rank): stored assertions that ground an answer.

    retrieved: query, section, rank; mentions: section, entity; assertions: id,
    subject, object, section, certainty, text.  An assertion counts if it stands
    in a retrieved section and touches an entity some retrieved section mentions;
    order: section's rank, certainty, entity's best rank, id.
    """
    # few assertions stand in a retrieved section; only their ids meet entities (an id may have rows elsewhere, whose ends count too)
    retrieved = settled(retrieved.select("query", "section", "rank"))
    entity = retrieved.join(mentions, "section").groupBy("query", "entity").agg(F.min("rank").alias("entity_rank"))
    near = settled(assertions.join(sent(retrieved.withColumnRenamed("rank", "passage_rank")), "section"))
    ends = assertions.join(sent(near.select("id").distinct()), "id", "left_semi").select("id", F.explode(F.array_distinct(F.filter(F.array("subject", "object"), lambda x: x.isNotNull()))).alias("entity"))
    asked = near.select("query", "id").distinct().join(ends.distinct(), "id")
    touching = asked.join(entity, ["query", "entity"]).groupBy("query", "id").agg(F.min("entity_rank").alias("entity_rank"))
    found = near.join(touching, ["query", "id"])
    window = Window.partitionBy("query").orderBy("passage_rank", certainty_rank(F.col("certainty")), "entity_rank", "id")
    return found.withColumn("place", F.row_number().over(window)).where(F.col("place") <= most).select("query", "place", F.col("id").alias("assertion"), "text", "passage_rank")


def layer_search(rows: DataFrame, subjects: list[str], scores: DataFrame | None, limit: int) -> DataFrame:
    """Rows of the named subjects (any case) by score, those without one last in order; scores: doc, score."""
    own = rows.where(F.lower("subject").isin(*[s.lower() for s in subjects]))
    if scores is None:
        return own.orderBy("doc").limit(limit)
    return own.join(scores, "doc", "left").orderBy(F.round(F.coalesce("score", F.lit(0.0)), 9).desc(), "doc").limit(limit).drop("score")


def answer_subgraph(rows: DataFrame, seeds: list[str], nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges (a, b) among the nodes that an answer's cells or the seeds name."""
    cells = rows.select(F.explode(F.array(*[F.col(c).cast("string") for c in rows.columns])).alias("name"))
    named = cells.unionByName(rows.sparkSession.createDataFrame([(s,) for s in seeds], "name string")).distinct()
    inside = nodes.select("name").join(named, "name", "left_semi")
    at = lambda c: inside.select(F.col("name").alias(c))
    return edges.join(at("a"), "a", "left_semi").join(at("b"), "b", "left_semi").select(*edges.columns)


def rendered(sections: DataFrame, spans: DataFrame) -> DataFrame:
    """(id, pieces): the text as plain and tagged pieces in order.

    spans: id, start, end, surface, entity.  A span is skipped if it begins
    before the last one ended, ends past the text, or no longer reads as its
    surface.
    """
    span = F.struct("start", "end", "surface", "entity")
    given = sections.select("id", "text").join(spans.groupBy("id").agg(F.collect_list(span).alias("s")), "id")
    reads = lambda z: (z["end"] <= F.length("text")) & (F.substring(F.col("text"), z["start"] + 1, z["end"] - z["start"]) == z["surface"])
    usable = given.select("id", F.explode(F.filter("s", reads)).alias("z")).select("id", "z.*")
    step = lambda last, z: (z[1], True) if z[0] >= last else (last, False)
    kept = kept_in_order(usable, ["id"], ["start", "end", "surface", "entity"], ["start", "end"], 0, step)
    rows = sections.join(kept.groupBy("id").agg(F.sort_array(F.collect_list(span)).alias("s")), "id", "left")
    none = F.array().cast("array<struct<text:string,entity:string>>")
    piece = lambda t, e: F.struct(t.alias("text"), e.cast("string").alias("entity"))

    def plain(a: Column, b: Column) -> Column:
        return F.when(b > a, F.array(piece(F.substring(F.col("text"), a + 1, b - a), F.lit(None)))).otherwise(none)

    ends = lambda k: F.coalesce(F.get("s", k)["end"], F.lit(0))
    tagged = F.flatten(F.transform("s", lambda z, k: F.concat(plain(ends(k - 1), z["start"]), F.array(piece(z["surface"], z["entity"])))))
    return rows.select("id", F.concat(F.coalesce(tagged, none), plain(ends(F.size(F.coalesce("s", F.array().cast(dict(rows.dtypes)["s"]))) - 1), F.length("text"))).alias("pieces"))


# ---------------------------------------------------------------- summaries


def run_summary(runs: DataFrame) -> DataFrame:
    """(run, topics, lines, depth)."""
    return runs.groupBy("run").agg(F.countDistinct("topic").alias("topics"), F.count("*").alias("lines"), F.max("rank").alias("depth"))


def batch_summaries(batches: DataFrame, uploads: DataFrame, pools: DataFrame) -> DataFrame:
    """(id, pool_label, annotator, items, submitted): batches with their pool's label and whether anything came in."""
    came = uploads.where("batch is not null").select(F.col("batch").alias("id")).distinct().withColumn("_s", F.lit(True))
    rows = batches.join(pools, "pool", "left").join(came, "id", "left")
    return rows.select("id", F.col("label").alias("pool_label"), "annotator", F.size("items").alias("items"), F.coalesce("_s", F.lit(False)).alias("submitted"))


def blind_items(batch: DataFrame, items: DataFrame, passages: DataFrame) -> DataFrame:
    """(place, item, text) of a batch for a judge: nothing about runs, ranks or scores."""
    rows = batch.select(F.posexplode("items").alias("place", "item")).join(items.select("item", "passage"), "item")
    return rows.join(passages.select(F.col("id").alias("passage"), "text"), "passage").select("place", "item", "text")


def breakdown(rows: DataFrame, **defaults: str) -> DataFrame:
    """(facet, value, n): rows per value of every column, with a default for nulls."""
    pairs = F.array(*[F.struct(F.lit(c).alias("facet"), F.coalesce(F.col(c).cast("string"), F.lit(d)).alias("value")) for c, d in defaults.items()])
    return rows.select(F.explode(pairs).alias("x")).groupBy("x.facet", "x.value").agg(F.count("*").alias("n"))
