"""Filters, joins, aggregations, windows and set operations of the annotated collection.

Curated lists have an order that decides winners and ties; it is the column
``ord`` throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import kept_in_order
from .graph import settled

# How sure a statement is, best first.
CERTAINTY = ("asserted", "reported", "disputed", "conjectured")


def certainty_rank(value: Column) -> Column:
    """Place in CERTAINTY, 4 for anything else."""
    out = F.lit(len(CERTAINTY))
    for i, name in reversed(list(enumerate(CERTAINTY))):
        out = F.when(value == name, i).otherwise(out)
    return out


# ---------------------------------------------------------------- filters


def matching(rows: DataFrame, equal: dict | None = None, equal_folded: dict | None = None, contains: dict | None = None) -> DataFrame:
    """All given conditions at once: equality, equality after trim and lower case, case-insensitive substring."""
    for c, v in (equal or {}).items():
        rows = rows.where(F.col(c) == v)
    for c, v in (equal_folded or {}).items():
        rows = rows.where(F.lower(F.trim(c)) == v.strip().lower())
    for c, v in (contains or {}).items():
        rows = rows.where(F.contains(F.lower(c), F.lit(v.lower())))
    return rows


def any_contains(needle: str, *columns: Column) -> Column:
    """Whether one of the columns holds the needle, whatever the case; nulls do not."""
    low = F.lit(needle.lower())
    return reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(c), low), F.lit(False)) for c in columns])


def page(rows: DataFrame, *order: str, offset: int = 0, limit: int = 50) -> DataFrame:
    """A page in order, with ``total`` rows before the cut (counted apart, no window over all rows)."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(offset).limit(limit).join(F.broadcast(total), how="cross")


def violations(**checks: DataFrame) -> DataFrame:
    """(rule, key): the offending keys of every check, each a frame with a column key."""
    frames = [df.select(F.lit(rule).alias("rule"), F.col("key").cast("string").alias("key")) for rule, df in checks.items()]
    return reduce(DataFrame.unionByName, frames)


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n")).where("n > 1").select("key")


def dangling(rows: DataFrame, column: str, target: DataFrame, key: str) -> DataFrame:
    """Values of rows.column that target.key does not hold."""
    return rows.where(F.col(column).isNotNull()).select(F.col(column).alias("key")).join(target.select(F.col(key).alias("key")), "key", "left_anti").distinct()


def mismatched(a: DataFrame, a_key: str, b: DataFrame, b_key: str) -> DataFrame:
    """Keys on one side only (a bijection check)."""
    return dangling(a, a_key, b, b_key).unionByName(dangling(b, b_key, a, a_key))


def require_none(problems: DataFrame) -> DataFrame:
    """An empty result, or an error that names a violation; evaluated with the query."""
    first = problems.agg(F.min(F.concat_ws(": ", "rule", "key")).alias("worst"))
    return first.select(F.assert_true(F.col("worst").isNull(), F.concat(F.lit("constraint broken: "), F.col("worst"))).alias("ok"))


# ---------------------------------------------------------------- joins


def few(rows: DataFrame, most: int = 200_000) -> bool:
    return rows.limit(most + 1).count() <= most


def sent(rows: DataFrame) -> DataFrame:
    """rows, marked for broadcast if they have been counted and are few."""
    return F.broadcast(rows) if few(rows) else rows


def first_per(rows: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row per key in the given order."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(window)).where("_n = 1").drop("_n")


def resolve_owned(refs: DataFrame, sections: DataFrame) -> DataFrame:
    """(row, id) for refs(row, ref, owner): the candidate the owner owns, else the first in reading order.

    sections: id, short, owner, ord; several may share a short reference.
    """
    cand = refs.join(sections.select(F.col("short").alias("ref"), "id", F.col("owner").alias("_o"), "ord"), "ref")
    mine = F.coalesce((F.col("_o") == F.col("owner")).cast("int"), F.lit(0))
    best = cand.groupBy("row").agg(F.min(F.struct((-mine).alias("m"), "ord", "id")).alias("b"))
    return best.select("row", "b.id")


def resolve_all(refs: DataFrame, sections: DataFrame) -> DataFrame:
    """(row, id) for every candidate."""
    return refs.join(sections.select(F.col("short").alias("ref"), "id"), "ref").select("row", "id").distinct()


def resolve_passes(rows: DataFrame, sections: DataFrame) -> DataFrame:
    """(row, id) for rows(row, refs, subject, object): the subject's section of any ref, else the object's, else any.

    Inside a pass the first ref of the list wins, then reading order; rows that
    resolve nowhere stay with a null id.
    """
    each = rows.select("row", "subject", "object", F.posexplode("refs").alias("pos", "ref"))
    cand = each.join(sections.select(F.col("short").alias("ref"), "id", F.col("owner").alias("_o"), "ord"), "ref")
    rank = F.when(F.col("_o") == F.col("subject"), 0).when(F.col("_o") == F.col("object"), 1).otherwise(2)
    best = cand.groupBy("row").agg(F.min(F.struct(rank.alias("p"), "pos", "ord", "id")).alias("b"))
    return rows.select("row").join(best, "row", "left").select("row", "b.id")


def resolve_pinned(refs: DataFrame, sections: DataFrame, pins: DataFrame) -> DataFrame:
    """(row, id): a pin of (row, ref) wins, otherwise all candidates; distinct."""
    pinned = refs.join(pins, ["row", "ref"])
    rest = refs.join(pins.select("row", "ref"), ["row", "ref"], "left_anti")
    return pinned.select("row", "id").unionByName(resolve_all(rest, sections)).distinct()


def best_associate(edges: DataFrame) -> DataFrame:
    """One teacher per pupil: an asserted link before a hedged one, else the first."""
    return first_per(edges, ["pupil"], F.desc("asserted"), "ord")


#: Rows of titles in a block of works; a task holds two blocks at once, and as many pairs as PAIRS.
BLOCK_ROWS, PAIRS = 1_000_000, 1_000_000


def shared_title_pairs(titles: DataFrame) -> DataFrame:
    """(a, b) of different works, a < b, that share a title; titles(work, title) may repeat.

    Works are dealt to blocks, and every two blocks meet in one task with their
    titles' lists: a pair has one such task, which tells it once however many
    titles it shares.  A block is packed once into the checkpoint folder, and the
    tasks that it meets others in read it there: rows are shuffled once, pairs never.
    """
    blocks = max(8, -(-titles.count() // BLOCK_ROWS))
    kind = dict(titles.dtypes)["work"]
    rows = titles.where("work is not null and title is not null").select("title", "work")
    dealt = rows.repartition(blocks, "work").distinct().coalesce(blocks)  # no more blocks, where the session deals to more
    packed = settled(dealt.mapInArrow(_block_packed, "block int, lists binary"))
    one, other = packed.toDF("i", "one"), packed.toDF("j", "other")
    cells = one.hint("shuffle_replicate_nl").join(other, F.col("i") <= F.col("j"))
    return cells.mapInArrow(_blocks_met, f"a {kind}, b {kind}")


def _block_packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for a task's rows: every title with the list of its works, compressed."""
    held = [batch for batch in batches if batch.num_rows]
    if not held:
        return
    rows = pa.Table.from_batches(held).sort_by([("title", "ascending"), ("work", "ascending")]).combine_chunks()
    title, work = (rows.column(c).chunk(0) for c in ("title", "work"))
    firsts = np.flatnonzero(np.diff(title.dictionary_encode().indices.to_numpy(), prepend=-1))
    lists = pa.ListArray.from_arrays(pa.array(np.append(firsts, len(title)), pa.int32()), work)
    block = pa.RecordBatch.from_arrays([title.take(pa.array(firsts)), lists], ["title", "works"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, block.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(block)
    yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "lists"])


def _blocks_met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _cells_paired(_cells_opened(batches))


def _cells_opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(i, j, second, title, works) of packed blocks' cells; a block that meets itself comes once."""
    for batch in batches:
        for k in range(batch.num_rows):
            i, j = batch.column("i")[k].as_py(), batch.column("j")[k].as_py()
            for second in (False, True)[: 1 + (i < j)]:
                block = pa.ipc.open_stream(batch.column("other" if second else "one")[k].as_buffer()).read_next_batch()
                same = [pa.array(np.full(block.num_rows, x)) for x in (i, j, second)]
                yield pa.RecordBatch.from_arrays([*same, *block.columns], ["i", "j", "second", "title", "works"])


def _cells_paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, cell = [], None
    for batch in batches:
        cut = pc.add(pc.multiply(batch.column("i").cast("int64"), 1 << 32), batch.column("j").cast("int64")).to_numpy()
        bounds = [0, *(np.flatnonzero(cut[1:] != cut[:-1]) + 1).tolist(), len(cut)]
        for lo, hi in zip(bounds, bounds[1:], strict=False):
            if hi > lo and cut[lo] != cell:
                yield from _pairs_of(held)
                held, cell = [], cut[lo]
            held.append(batch.slice(lo, hi - lo))
    yield from _pairs_of(held)


def _pairs_of(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct pairs (a, b) of one cell: of its first and its second block, or of a single block's works."""
    if not batches:
        return
    rows = pa.Table.from_batches(batches).combine_chunks()
    lists = rows.column("works").chunk(0)
    n = np.diff(lists.offsets.to_numpy())
    named = lists.flatten().dictionary_encode()
    order = pc.sort_indices(named.dictionary)
    rank = np.empty(len(order), np.int32)
    rank[order.to_numpy()] = np.arange(len(order), dtype=np.int32)
    values, works = named.dictionary.take(order), rank[named.indices.to_numpy()]
    title = np.repeat(rows.column("title").chunk(0).dictionary_encode().indices.to_numpy(), n)
    second = np.repeat(rows.column("second").chunk(0).to_numpy(zero_copy_only=False), n)
    alone = bool((rows.column("i")[0].as_py()) == rows.column("j")[0].as_py())
    del rows, lists, named, order, rank
    left = np.flatnonzero(~second)
    left = left[np.argsort(works[left], kind="stable")]
    right = left if alone else np.flatnonzero(second)
    right = right[np.argsort(title[right], kind="stable")]
    # the works of the other side by title, those numbered from 0
    seen = np.zeros(len(values), bool)
    seen[works[right]] = True
    there, b = np.flatnonzero(seen).astype(np.int32), (np.cumsum(seen, dtype=np.int32) - 1)[works[right]]
    starts = np.searchsorted(title[right], np.arange(title.max(initial=-1) + 2))
    a, t = works[left], title[left]
    del title, works, second, left, right, seen
    size = (starts[t + 1] - starts[t]).astype(np.int64)
    done = np.concatenate([[0], np.cumsum(size)])
    firsts = np.concatenate([np.flatnonzero(np.diff(a, prepend=-1)), [len(a)]])
    width, at = len(there), 0
    # which candidate has told a pair, by pair of the works at hand; 0 where none has
    room = max(width, 8 * PAIRS)
    told = np.zeros(room, np.int32)
    while at < len(firsts) - 1 and width:
        # whole works until their candidates are many or the table is full
        to = max(at + 1, min(int(np.searchsorted(done[firsts], done[firsts[at]] + PAIRS, "right")) - 1, at + room // width))
        lo, hi = firsts[at], firsts[to]
        own = np.repeat(np.arange(to - at) * width, np.diff(firsts[at : to + 1]))
        kept = []
        for x, y in _pieces(done[lo : hi + 1], PAIRS):
            s = size[lo + x : lo + y]
            place = np.arange(s.sum()) + np.repeat(starts[t[lo + x : lo + y]] - (done[lo + x : lo + y] - done[lo + x]), s)
            pair = np.repeat(own[x:y], s) + b[place]
            if kept:
                pair = pair[told[pair] == 0]
            mine = np.arange(1, len(pair) + 1, dtype=np.int32)
            told[pair] = mine
            kept.append(pair[told[pair] == mine])
        for pair in kept:
            told[pair] = 0
            p = pair // width
            p, q = a[firsts[at:to]][p], there[pair - p * width]
            up = p < q
            for p, q in ((p[up], q[up]),) if alone else ((p[up], q[up]), (q[~up], p[~up])):
                for x in range(0, len(p), PAIRS):
                    yield pa.RecordBatch.from_arrays([values.take(pa.array(c[x : x + PAIRS])) for c in (p, q)], ["a", "b"])
        at = to


def _pieces(done: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of places whose sums (done: cumulative, from any start) stay near most."""
    x = 0
    while x < len(done) - 1:
        y = max(x + 1, int(np.searchsorted(done, done[x] + most, "right")) - 1)
        yield x, y
        x = y


#: Members of a block of a group: two blocks meet in one place.
MEMBERS = 2_000


def homonyms(names: DataFrame, same: DataFrame | None = None) -> DataFrame:
    """(slug, a, b): different entities with one slug, a < b, minus pairs known to be the same.

    The pairs of a slug are made block by block, so a hot slug is spread; an
    entity brings the list of those it is known to be, so no pair is shuffled.
    """
    one = names.where("slug is not null and entity is not null").select("entity", "slug").distinct()
    blocks = F.ceil(F.count("*") / MEMBERS).cast("int")
    dealt = one.join(one.groupBy("slug").agg(blocks.alias("n")), "slug").withColumn("block", F.pmod(F.xxhash64("entity"), F.col("n")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    x, y = dealt.select("slug", F.col("entity").alias("a"), F.col("block").alias("i"), every.alias("j")), dealt.select("slug", F.col("entity").alias("b"), every.alias("i"), F.col("block").alias("j"))
    apart = F.col("a") < F.col("b")
    if same is not None:
        known = same.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).groupBy("a").agg(F.collect_set("b").alias("known"))
        x = x.join(known, "a", "left")
        apart = apart & ~F.coalesce(F.array_contains("known", F.col("b")), F.lit(False))
    return x.join(y, ["slug", "i", "j"]).where(apart).select("slug", "a", "b")


def collisions(names: DataFrame) -> DataFrame:
    """(slug, n): slugs of more than one entity."""
    return names.groupBy("slug").agg(F.countDistinct("entity").alias("n")).where("n > 1")


def covered(spans: DataFrame, by: DataFrame) -> DataFrame:
    """spans(key, start, end) that overlap one of by(key, start, end): start < other end and end > other start."""
    o = by.select(F.col("key"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    return spans.join(o, (spans["key"] == o["key"]) & (o["_s"] < spans["end"]) & (o["_e"] > spans["start"]), "left_semi")


def uncovered(spans: DataFrame, by: DataFrame) -> DataFrame:
    o = by.select(F.col("key"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    return spans.join(o, (spans["key"] == o["key"]) & (o["_s"] < spans["end"]) & (o["_e"] > spans["start"]), "left_anti")


def reconcile(rows: DataFrame, entities: DataFrame) -> DataFrame:
    """(row, target): the entity with the row's external id, else with its label, else a minted key.

    rows: row, qid, label (match form); entities: entity, qid, label.
    """
    by_id = entities.where("qid is not null").groupBy("qid").agg(F.min("entity").alias("e1"))
    by_label = entities.groupBy("label").agg(F.min("entity").alias("e2"))
    return rows.join(by_id, "qid", "left").join(by_label, "label", "left").select(
        "row", F.coalesce("e1", "e2", F.concat(F.lit("new:"), "label")).alias("target")
    )


def patched(rows: DataFrame, patches: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """rows with the patches' non-null values; a patch that hits no row or changes nothing is an error."""
    p = patches.select(F.col(key), *[F.col(c).alias(f"_p_{c}") for c in columns])
    both = rows.join(p, key, "left")
    changes = reduce(lambda a, b: a | b, [F.col(f"_p_{c}").isNotNull() & ~F.col(f"_p_{c}").eqNullSafe(F.col(c)) for c in columns])
    idle = both.join(p.select(key), key, "left_semi").where(~changes).select(F.col(key).alias("key"))
    problems = violations(unknown_row=dangling(patches, key, rows, key), changes_nothing=idle)
    out = both.select(*[F.coalesce(f"_p_{c}", c).alias(c) if c in columns else F.col(c) for c in rows.columns])
    return out.join(F.broadcast(require_none(problems)), how="cross").where("ok is null").drop("ok")


def claim_answers(claims: DataFrame, asked: DataFrame) -> DataFrame:
    """(subject, property, id, how) for asked(subject, property): direct, reverse (value is the subject), rivals.

    claims: id, subject, property, value, conflicts (array of ids).  Distinct.
    """
    direct = asked.join(claims, ["subject", "property"]).select("subject", "property", "id", F.lit("direct").alias("how"), "conflicts")
    c = claims.select(F.col("value").alias("subject"), "property", "id", "conflicts")
    reverse = asked.join(c, ["subject", "property"]).select("subject", "property", "id", F.lit("reverse").alias("how"), "conflicts")
    base = direct.unionByName(reverse)
    rivals = base.select("subject", "property", F.explode("conflicts").alias("id")).join(claims.select("id"), "id", "left_semi")
    every = base.drop("conflicts").unionByName(rivals.select("subject", "property", "id", F.lit("rival").alias("how")))
    return every.groupBy("subject", "property", "id").agg(F.min("how").alias("how"))


# ---------------------------------------------------------------- aggregations


def tally(rows: DataFrame, key: Column, order: str = "ord") -> DataFrame:
    """(key, n, first): counts per key without nulls; first is where the key first stands."""
    return rows.select(key.alias("key"), F.col(order).alias("o")).where("key is not null").groupBy("key").agg(F.count("*").alias("n"), F.min("o").alias("first"))


def layer_matrix(layers: dict[str, DataFrame], key: str) -> DataFrame:
    """One row per key of any layer with the layers' counts side by side, 0 where one is missing."""
    rows = reduce(DataFrame.unionByName, [df.select(F.col(key), F.lit(name).alias("layer")) for name, df in layers.items()])
    return rows.groupBy(key).pivot("layer", list(layers)).count().na.fill(0)


def distinct_pairs(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: the number of distinct unordered pairs."""
    return rows.select(F.countDistinct(F.least(a, b), F.greatest(a, b)).alias("pairs"))


def all_agree(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) if all rows of a key have one and the same value, else null."""
    v = F.col(value)
    same = (F.count(v) == F.count("*")) & (F.min(v) == F.max(v))
    return rows.groupBy(key).agg(F.when(same, F.min(v)).alias(value))


def best_value(rows: DataFrame, keys: list[str], value: str, rank: Column) -> DataFrame:
    """The value of the best rank per key; among equals the first in order."""
    return rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min_by(value, F.struct(rank, "ord")).alias(value))


def itineraries(stops: DataFrame) -> DataFrame:
    """(person, places, n): births, then the rest in order, then deaths; two distinct places at least.

    stops: person, place, kind, ord.
    """
    phase = F.when(F.col("kind") == "birth", 0).when(F.col("kind") == "death", 2).otherwise(1)
    rows = stops.groupBy("person").agg(F.sort_array(F.collect_list(F.struct(phase.alias("p"), "ord", "place"))).alias("s"), F.countDistinct("place").alias("d"))
    return rows.where("d >= 2").select("person", F.transform("s", lambda x: x["place"]).alias("places"), F.size("s").alias("n"))


def life_spans(events: DataFrame) -> DataFrame:
    """(person, birth, death, floruit, derived): an end that is missing comes from the other and the age.

    events: person, role (birth, death, floruit, age), year, rank, ord; ages above 110 do not count.
    """
    pick = lambda role: F.min_by(F.when(F.col("role") == role, F.col("year")), F.when((F.col("role") == role) & F.col("year").isNotNull(), F.struct("rank", "ord")))
    rows = events.groupBy("person").agg(*[pick(r).alias(r) for r in ("birth", "death", "floruit", "age")])
    sane = F.when(F.col("age") <= 110, F.col("age"))
    birth, death = F.coalesce("birth", F.col("death") - sane), F.coalesce("death", F.col("birth") + sane)
    return rows.select(
        "person", birth.alias("birth"), death.alias("death"), "floruit",
        ((F.col("birth").isNull() & birth.isNotNull()) | (F.col("death").isNull() & death.isNotNull())).alias("derived"),
    )


def year_bounds(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, first, last, approx, refs): least and greatest BCE year in the texts of a key, negative."""
    years = F.transform(F.regexp_extract_all(text, F.lit(r"(\d{2,4})(?=[^()]*BCE)"), F.lit(1)), lambda y: -y.cast("int"))
    rows = texts.select(key, F.explode(years).alias("y"), F.coalesce(F.contains(F.col(text), F.lit("c. ")), F.lit(False)).alias("a"), "ref")
    return rows.groupBy(key).agg(F.min("y").alias("first"), F.max("y").alias("last"), F.bool_or("a").alias("approx"), F.sort_array(F.collect_set("ref")).alias("refs"))


def upper_median(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The element at place floor(n / 2) of the sorted values (not an interpolated percentile)."""
    one = rows.where(F.col(value).isNotNull())
    n = F.count("*").over(Window.partitionBy(*keys))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(value))
    return one.select(*keys, value, n.alias("_n"), place.alias("_p")).where("_p = _n div 2 + 1").select(*keys, F.col(value).alias("median"))


# ---------------------------------------------------------------- windows and order


def neighbours_in_order(rows: DataFrame, key: str, order: str, by: list[str] | None = None) -> DataFrame:
    """Adds prev and next of key in reading order, within the groups of by (or the whole table)."""
    window = Window.partitionBy(*(by or [])).orderBy(order)
    return rows.withColumns({"prev": F.lag(key).over(window), "next": F.lead(key).over(window)})


def first_writer(rows: DataFrame, short: str, full: str) -> DataFrame:
    """Adds shorthand: the first row with a short reference keeps it, later ones use the full id."""
    n = F.row_number().over(Window.partitionBy(short).orderBy("ord"))
    return rows.withColumn("shorthand", F.when(n == 1, F.col(short)).otherwise(F.col(full)))


def section_order(section_id: Column) -> list[Column]:
    """Sort columns of 'book.chapter.section': a chapter that is no number comes first, then number and suffix."""
    p = F.split(section_id, r"\.")
    last = F.element_at(p, -1)
    return [p[0].cast("int"), F.coalesce(F.get(p, F.lit(1)).try_cast("int"), F.lit(-1)), F.regexp_extract(last, r"^(\d+)", 1).try_cast("int"), F.regexp_extract(last, r"^\d*(.*)$", 1)]


def placed(rows: DataFrame, lead: list[Column], rest: list[Column | str], name: str = "place") -> DataFrame:
    """Adds the row's place, from 1, in the order of lead and then rest; lead holds no nulls.

    Two-level: rows are counted per value of lead, the counts are summed in order
    (a row per value), and only rows of one value are put in order together.
    """
    keyed = rows.withColumn("_lead", F.struct(*[c.alias(f"c{i}") for i, c in enumerate(lead)]))
    counts = keyed.groupBy("_lead").agg(F.count("*").alias("_c"))
    before = Window.orderBy("_lead").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_lead", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o"))
    inside = F.row_number().over(Window.partitionBy("_lead").orderBy(*rest))
    return keyed.withColumn("_i", inside).join(offsets, "_lead").withColumn(name, F.col("_o") + F.col("_i")).drop("_lead", "_i", "_o")


def overlaps_resolved(spans: DataFrame, key: str) -> DataFrame:
    """Spans that do not overlap, per key: earliest start, then longest, then not heuristic; greedy.

    spans: key, start, end, heuristic and further columns.  One scan in order
    that remembers where the last kept span ended.
    """
    rest = [c for c in spans.columns if c not in (key, "start", "end", "heuristic")]
    step = lambda last, z: (z[1], True) if last is None or z[0] >= last else (last, False)
    out = kept_in_order(spans, [key], ["start", F.desc("end"), "heuristic", *rest], ["start", "end"], None, step)
    return out.select(key, "start", "end", "heuristic", *rest)


def runs(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Adjacent rows of one value merged: keys, run (from 1), value, n, from, to."""
    window = Window.partitionBy(*keys).orderBy(order)
    change = F.when(F.col(value).eqNullSafe(F.lag(value).over(window)) & (F.row_number().over(window) > 1), 0).otherwise(1)
    marked = rows.withColumn("_c", change).withColumn("run", F.sum("_c").over(window))
    return marked.groupBy(*keys, "run").agg(F.first(value).alias(value), F.count("*").alias("n"), F.min(order).alias("from"), F.max(order).alias("to"))


def greedy_budget(items: DataFrame, key: str, size: str, budget: int) -> DataFrame:
    """Items in order while they fit; one that does not is skipped and the next is tried."""
    step = lambda used, z: (used + z[0], True) if z[0] is not None and used + z[0] <= budget else (used, False)
    rest = [c for c in items.columns if c not in (key, "ord")]
    return kept_in_order(items, [key], ["ord", *rest], [size], 0, step).select(key, "ord", *rest)


def suggestions(entities: DataFrame, needle: str, most: int = 9) -> DataFrame:
    """Entity names near a word: prefix first, then edit distance of at most two; group rank, then uses.

    entities: entity, label, uses.
    """
    word = F.lower("label")
    d = F.levenshtein(word, F.lit(needle.lower()), 2)
    score = F.when(F.startswith(word, F.lit(needle.lower())), 0).when(d >= 0, d)
    found = entities.withColumn("score", score).where("score is not null")
    w = Window.partitionBy("label")
    ranked = found.withColumns({"best": F.min("score").over(w), "group_size": F.count("*").over(w)})
    return ranked.orderBy("best", "label", F.desc("uses"), "entity").limit(most)


def drift(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(side, key): rows missing from b and rows b has too many."""
    x, y = a.select(key), b.select(key)
    return x.exceptAll(y).withColumn("side", F.lit("missing")).unionByName(y.exceptAll(x).withColumn("side", F.lit("extra")))


def shared_by_all(rows: DataFrame, key: str, value: str, member: str) -> DataFrame:
    """(key, value): values that all members of a key have."""
    total = rows.groupBy(key).agg(F.countDistinct(member).alias("n"))
    each = rows.groupBy(key, value).agg(F.countDistinct(member).alias("c"))
    return each.join(total, key).where("c = n").select(key, value)
