"""Near-duplicate documents by circulant MinHash, banding and exact verification.

Method.  A document is its set of distinct five-word shingles (64-bit ids).  Two
permutations of the 32-bit universe make all signature coordinates: the first
scatters the shingles once, the second is shifted circularly by one fixed step
per coordinate.  Bands of the signature collide; inside colliding buckets the
signatures are compared, and every pair that can reach the threshold ends up in
one coarse family.  Families are then verified on the full sets.

Scale.  Documents with equal sets are one class from the start, so copies cost
one row.  Buckets and families of any size are cut into blocks of bounded rows
and bytes.  Every block first meets itself and a few representatives of its
group, which costs one row per member; members that come together with most of
their group that way need no further comparison, as only a spanning forest of
links is wanted.  Those left apart are then compared with the whole group in
tiles of two blocks, so no link is lost; that step alone can grow faster than
the group, with the number of members left apart.  A tile returns a spanning
forest, never all pairs.  The text is read twice and never shuffled; the sets of
documents that have no candidate are never kept.

Misses.  At similarity 0.85 a pair shares no band with probability
(1 - 0.85**4)**20 < 4e-7 and falls below the agreement asked for with
probability < 1e-7; all that remains is checked exactly.  At 0.80 these are
3e-5 and 4e-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Forest, connected_components, drop_table, fresh, groups, table, trimmed
from .wordhash import mix64, shingle_ids, shingles, words_of

BANDS, ROWS = 20, 4
#: Share of equal coordinates below which a pair cannot plausibly reach the threshold.
AGREE = 0.6
#: Rows and shingles of a block; a tile holds two blocks.
BLOCK_ROWS, BLOCK_SHINGLES = 512, 1_000_000
#: Members of a large group that every block of it is compared with first.
REPRESENTATIVES = 8
_STEP = np.uint32(0x9E3779B1)


def _permute(x: np.ndarray, out: np.ndarray) -> None:
    """A fixed permutation of the 32-bit integers, in place on x, with out as scratch."""
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, None)):
        np.right_shift(x, np.uint32(shift), out=out)
        np.bitwise_xor(x, out, out=x)
        if factor:
            np.multiply(x, np.uint32(factor), out=x)


def circulant_signatures(ids: np.ndarray, begins: np.ndarray, coordinates: int) -> np.ndarray:
    """Row i: the signature of the non-empty run ids[begins[i]:begins[i+1]].

    Coordinate k is the least value of the second permutation over the first
    permutation's values moved back by k steps round the circle of 2**32.
    """
    scattered = (mix64(ids) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    work, scratch = np.empty_like(scattered), np.empty_like(scattered)
    out = np.empty((len(begins), coordinates), dtype=np.uint32)
    for k in range(coordinates):
        shift = np.uint32((k * int(_STEP)) & 0xFFFFFFFF)
        np.subtract(scattered, shift, out=work)
        _permute(work, scratch)
        out[:, k] = np.minimum.reduceat(work, begins)
    return out


def _describe(n: int, coordinates: int):
    """doc_id, text -> doc_id, n_shingles, two halves of a fingerprint of the set, signature."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            doc_ids = batch["doc_id"]
            for first, offsets, words in words_of(batch["text"].tolist()):
                size = len(offsets) - 1
                counts, f1, f2 = np.zeros(size, np.int64), np.zeros(size, np.uint64), np.zeros(size, np.uint64)
                runs, begins, at, have = [], [], 0, []
                for i in range(size):
                    own = words[offsets[i] : offsets[i + 1]]
                    if not len(own):
                        continue
                    own = np.unique(shingle_ids(own, min(n, len(own))))
                    counts[i] = len(own)
                    f1[i] = np.add.reduce(mix64(own))
                    f2[i] = np.add.reduce(mix64(own ^ np.uint64(0x5851F42D4C957F2D)))
                    runs.append(own)
                    begins.append(at)
                    have.append(i)
                    at += len(own)
                sig: list[bytes | None] = [None] * size
                if runs:
                    rows = circulant_signatures(np.concatenate(runs), np.array(begins), coordinates)
                    for i, row in zip(have, rows, strict=True):
                        sig[i] = row.tobytes()
                yield pd.DataFrame(
                    {
                        "doc_id": doc_ids.iloc[first : first + size].reset_index(drop=True),
                        "n_shingles": counts,
                        "f1": f1.view(np.int64),
                        "f2": f2.view(np.int64),
                        "sig": sig,
                    }
                )

    return run


def _joined(components: pd.Series) -> Forest:
    """A forest in which rows of one component already stand together."""
    forest, first = Forest(len(components)), {}
    for k, c in enumerate(components.tolist()):
        forest.join(first.setdefault(c, k), k)
    return forest


def _agreeing(coordinates: int, least: int):
    """Sorted (bucket, i, j, id, component, sig) rows -> spanning edges of agreeing signatures."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a_out: list[int] = []
        b_out: list[int] = []
        for g in groups(batches, ["bucket", "i", "j"]):
            ids = g["id"].to_numpy()
            sig = np.frombuffer(b"".join(g["sig"]), dtype=np.uint32).reshape(len(ids), coordinates)
            forest = _joined(g["component"])
            for x, y in _close_pairs(sig, least):
                if forest.join(x, y):
                    a_out.append(ids[x])
                    b_out.append(ids[y])
            if len(a_out) > 50_000:
                yield pd.DataFrame({"a": a_out, "b": b_out})
                a_out, b_out = [], []
        yield pd.DataFrame({"a": np.array(a_out, np.int64), "b": np.array(b_out, np.int64)})

    return run


def _close_pairs(sig: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Pairs of rows that agree in at least so many coordinates, most agreeing first."""
    n = len(sig)
    if n == 2:
        return [(0, 1)] if int((sig[0] == sig[1]).sum()) >= least else []
    found, score = [], []
    step = max(1, 2_000_000 // (n * 4))
    columns = np.ascontiguousarray(sig.T)
    for lo in range(0, n, step):
        same = np.zeros((min(step, n - lo), n - lo), dtype=np.uint8)
        for column in columns:
            same += column[lo : lo + step, None] == column[None, lo:]
        x, y = np.nonzero(same >= least)
        keep = y > x
        found.append(np.stack((x[keep] + lo, y[keep] + lo), axis=1))
        score.append(same[x[keep], y[keep]])
    pairs, marks = np.concatenate(found), np.concatenate(score)
    return pairs[np.argsort(-marks.astype(np.int16), kind="stable")].tolist()


def _sets(n: int):
    """id, text -> id, first half of the fingerprint, sorted set as bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first, offsets, words in words_of(batch["text"].tolist()):
                size = len(offsets) - 1
                sets = [shingles(words[offsets[i] : offsets[i + 1]], n) for i in range(size)]
                prints = np.array([np.add.reduce(mix64(s)) for s in sets], dtype=np.uint64)
                ids = batch["id"].to_numpy()[first : first + size]
                yield pd.DataFrame({"id": ids, "f1": prints.view(np.int64), "set": [s.tobytes() for s in sets]})

    return run


def _verified(coordinates: int, least: int, percent: int):
    """Sorted tiles of families -> spanning edges of pairs that hold on the full sets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a_out: list[int] = []
        b_out: list[int] = []
        for g in groups(batches, ["family", "i", "j"]):
            ids = g["id"].to_numpy()
            sig = np.frombuffer(b"".join(g["sig"]), dtype=np.uint32).reshape(len(ids), coordinates)
            sets = [np.frombuffer(s, dtype=np.uint64) for s in g["set"]]
            forest = _joined(g["component"])
            for x, y in _close_pairs(sig, least):
                p, q = sets[x], sets[y]
                small, large = sorted((len(p), len(q)))
                if 100 * small < percent * large or forest.root(x) == forest.root(y):
                    continue
                common = _common(p, q)
                if 100 * common >= percent * (len(p) + len(q) - common):
                    forest.join(x, y)
                    a_out.append(ids[x])
                    b_out.append(ids[y])
        yield pd.DataFrame({"a": np.array(a_out, np.int64), "b": np.array(b_out, np.int64)})

    return run


def _common(p: np.ndarray, q: np.ndarray) -> int:
    both = np.concatenate((p, q))
    both.sort(kind="stable")  # merges two sorted runs
    return int((both[1:] == both[:-1]).sum())


def _beside_representatives(placed: DataFrame, key: str) -> DataFrame:
    """Tiles (i, 0) of groups: a block of members and, in groups of several blocks, the representatives.

    placed: key, id, blocks (of the group) and further columns.
    """
    own = placed.withColumn("i", F.pmod(F.xxhash64("id", key), F.col("blocks")).cast("int"))
    slot = F.pmod(F.xxhash64("id", F.lit("representative")), F.lit(REPRESENTATIVES))
    large = placed.where("blocks > 1")
    chosen = large.groupBy(key, slot.alias("slot")).agg(F.min("id").alias("id")).select(key, "id")
    beside = large.join(chosen, [key, "id"], "left_semi").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return own.unionByName(beside).select("*", F.lit(0).alias("j"), F.col("id").alias("component")).drop("blocks")


def _rest_beside_all(placed: DataFrame, key: str, found: DataFrame) -> DataFrame | None:
    """Tiles (i, j) of large groups: a block of members apart from the group's main component, and a block of all.

    found: id, component so far.  None if no member was left apart.
    """
    large = placed.where("blocks > 1")
    if large.isEmpty():
        return None
    marked = large.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    counted = marked.groupBy(key, "component").agg(F.count("*").alias("c"))
    # one row per large group
    main = counted.groupBy(key).agg(F.max(F.struct("c", "component")).alias("m"), F.sum("c").alias("all")).where(F.col("all") > F.col("m.c"))
    main = table(main.select(key, F.col("m.component").alias("main"), (1 - F.col("m.c") / F.col("all")).alias("share")), "apart")
    if main.isEmpty():
        return None
    marked = marked.join(main, key).withColumn("rests", F.ceil(F.col("share") * F.col("blocks")).cast("int"))
    block = lambda n: F.pmod(F.xxhash64("id", key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rest = marked.where("component <> main").withColumn("i", block("rests")).withColumn("j", every("blocks"))
    whole = marked.withColumn("i", every("rests")).withColumn("j", block("blocks"))
    return rest.unionByName(whole).drop("blocks", "rests", "main", "share")


def _met(tiles: DataFrame, key: str, payload: list[str], run) -> DataFrame:
    rows = tiles.select(key, "i", "j", "id", "component", *payload).repartition(key, "i", "j")
    return rows.sortWithinPartitions(key, "i", "j", "id").mapInPandas(trimmed(run), "a long, b long")


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 85) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Two documents are linked when 100 * |intersection| >= percent * |union| of
    their sets of n-word shingles; component_id is the smallest doc_id reachable
    over links, and kept marks the documents that carry it.

    Null or empty texts have an empty set and link with nothing.  Rows that
    repeat a doc_id are one document with several texts and share a component.
    Rows without a doc_id link with nothing: component_id is null, kept is true.
    An empty table gives an empty result; other columns are ignored.
    """
    if percent < 80:
        raise ValueError("bands and agreement are set for thresholds of 80 percent or more")
    coordinates = BANDS * ROWS
    least = int(AGREE * coordinates) if percent >= 85 else int((AGREE - 0.05) * coordinates)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    described = table(
        plain.mapInPandas(trimmed(_describe(n, coordinates)), "doc_id long, n_shingles long, f1 long, f2 long, sig binary"),
        "minhash",
    )
    useful = described.where("doc_id is not null and sig is not null")
    # copies: one class per set, whatever its number of rows
    classes = table(
        useful.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("id"), F.max("sig").alias("sig")),
        "classes",
    )
    keys = F.array(*[F.xxhash64(F.lit(b), F.substring("sig", 1 + 4 * ROWS * b, 4 * ROWS)) for b in range(BANDS)])
    banded = classes.select("id", F.explode(keys).alias("bucket"))
    crowded = (
        banded.groupBy("bucket")
        .agg(F.count("*").alias("n"))
        .where("n > 1")
        .select("bucket", F.ceil(F.col("n") / F.lit(BLOCK_ROWS)).cast("int").alias("blocks"))
    )
    members = table(banded.join(crowded, "bucket"), "members")
    known = classes.select("id", "f1", "sig")
    sig = classes.select("id", "sig")
    agree = lambda tiles: _met(tiles.join(sig, "id"), "bucket", ["sig"], _agreeing(coordinates, least))
    families = table(connected_components(agree(_beside_representatives(members, "bucket"))), "families")
    rest = _rest_beside_all(members, "bucket", families)
    if rest is not None:
        edges = families.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(agree(rest))
        families = table(connected_components(edges), "families")
    families = families.withColumnRenamed("component", "family")
    sets = (
        plain.join(families.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
        .select(F.col("doc_id").alias("id"), "text")
        .mapInPandas(trimmed(_sets(n)), "id long, f1 long, set binary")
    )
    body = table(
        families.join(known, "id").join(sets.where("length(set) > 0").dropDuplicates(["id", "f1"]), ["id", "f1"]), "sets"
    )
    blocks = body.groupBy("family").agg(
        F.greatest(
            F.ceil(F.count("*") / F.lit(BLOCK_ROWS)), F.ceil(F.sum(F.length("set")) / F.lit(8 * BLOCK_SHINGLES))
        ).cast("int").alias("blocks")
    )
    placed = body.select("family", "id", "sig", "set").join(blocks, "family")
    verify = lambda tiles: _met(tiles, "family", ["sig", "set"], _verified(coordinates, least, percent))
    links = table(verify(_beside_representatives(placed, "family")), "links")
    if not blocks.where("blocks > 1").isEmpty():
        rest = _rest_beside_all(placed, "family", connected_components(links))
        if rest is not None:
            links = links.unionByName(table(verify(rest), "links"))
    # a document's other texts and its copies join the component of its class
    same = useful.join(classes.drop("sig"), ["f1", "f2", "n_shingles"]).where("doc_id <> id")
    linked = connected_components(links.unionByName(same.select(F.col("doc_id").alias("a"), F.col("id").alias("b"))))
    out = described.select("doc_id", "n_shingles").join(linked.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    for done in (members, body):
        drop_table(done)
    component = F.coalesce("component", "doc_id")
    return out.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def deduplicated(docs: DataFrame, n: int = 5, percent: int = 85) -> DataFrame:
    """One row of docs per component of near_duplicates, with its columns.

    The row with the smallest doc_id stays.  Rows that repeat a doc_id are one
    document, of which the row with the least hash of all its columns stays, so
    reruns agree; rows without a doc_id all stay.  Columns of any name pass
    through.
    """
    own, row, least = fresh(docs.columns, "own_id", "row", "least")
    dropped = near_duplicates(docs, n, percent).where("not kept").select(F.col("doc_id").alias(own)).distinct()
    left = docs.join(dropped, F.col("doc_id").cast("long") == F.col(own), "left_anti")
    repeated = docs.where("doc_id is not null").groupBy(F.col("doc_id").alias(own)).count().where("count > 1").select(own)
    same = F.col("doc_id") == F.col(own)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = (
        left.join(repeated, same, "left_semi").select("doc_id", whole.alias(row), F.xxhash64(F.to_json(whole)).alias(least))
        .groupBy("doc_id").agg(F.min_by(row, least).alias(row)).select(f"{row}.*")
    )
    return left.join(repeated, same, "left_anti").unionByName(one)


#: near_duplicates on all pairs that share a shingle, for DuckDB.
ORACLE = """
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w
  from documents
), s as (
  select distinct doc_id, array_to_string(w[i:i + 4], ' ') as sh
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from w where len(w) > 0)
), n as (
  select doc_id, count(*) as n from s group by doc_id
), common as (
  select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b using (sh) where a.doc_id < b.doc_id group by all
), links as (
  select a, b from common join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)
), ends as (
  select a, b from links union all select b, a from links
), reach(id, c) as (
  select doc_id, doc_id from documents
  union
  select p.b, r.c from reach r join ends p on p.a = r.id
), comp as (
  select id, min(c) as c from reach group by id
)
select doc_id, coalesce(n.n, 0)::bigint as n_shingles, c as component_id, doc_id = c as kept
from documents join comp on id = doc_id left join n using (doc_id)
"""
