"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Sizes are words.  Targets come from the weights (water-filled under a cap of
three times a source's size).  A source's target is taken in whole passes over
its documents plus a partial pass: a prefix, in a hashed order, that fits the
rest, and the one further document whose size is nearest to what is then left.

The copies taken are cut into blocks (so many that a shard gets about
SHARD_BLOCKS of them, at every size), the sources' block counts are quotas, and
a binary tree splits them among the output shards: every node draws its left
half's counts from the multivariate hypergeometric distribution, so the shards'
quotas are exact, random and add up.  Blocks are disjoint runs of a source's
permuted copies; a shard is put in order by a hash of its own.

Orders and cumulative sums are two-level (a hash bucket, then inside it): rows
are put in order within a bucket, and a source's buckets, a row each, are summed
in order.  Up to MAX_SOURCES the driver holds a row per source and the tree's
counts (sources x shards).  Beyond, targets come from aggregates alone, sources
are joined by shuffles, and the tree splits the totals of SOURCE_GROUPS groups of
sources, each of which then splits its counts among its sources in a task of its
own; counts drawn group by group follow the same distribution.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import fresh, table

WEIGHTS = (5, 2, 1)
CAP = 3
BUCKET_ROWS = 2000
FITS = 8
#: Share of a source's target below which a gap is left alone; FITS are the documents that may be added to close it.
NEAR = 0.002
#: Copies per run in which a shard's rows are dealt.
RUN_ROWS = 2000
#: Sources of which the driver holds a row each, and the groups that larger numbers are split by.
MAX_SOURCES, SOURCE_GROUPS = 100_000, 4096
#: Blocks per shard aimed at.
SHARD_BLOCKS = 1024


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> dict[str | None, float]:
    """Words per source: all words shared by weight, none above cap times its size."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {name: weights[i % len(weights)] for i, (name, _) in enumerate(order)}
    size = dict(order)
    out: dict[str | None, float] = {}
    free, rest = set(size), float(sum(size.values()))
    while free:
        unit = rest / sum(weight[s] for s in free)
        over = [s for s in free if unit * weight[s] > cap * size[s]]
        if not over:
            out |= {s: unit * weight[s] for s in free}
            break
        for s in over:
            out[s] = float(cap * size[s])
            free.remove(s)
        rest = float(sum(size.values())) - math.fsum(out.values())
    return out


def targets_table(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """targets() of sizes(source, words) for any number of sources; only sums go to the driver.

    A source is held down by the cap once the share of a unit of weight exceeds
    cap times its words by weight; that share only grows from round to round.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1  # a row per source
    weight = F.array(*map(F.lit, weights))[F.pmod(place, F.lit(len(weights)))]
    rows = table(sizes.select("source", "words", weight.alias("weight")), "sources")
    unit, held = 0.0, -1
    while True:
        over = F.col("words") * cap < F.col("weight") * F.lit(unit)
        total, taken, free, n = rows.agg(
            F.sum("words"), F.sum(F.when(over, F.col("words") * cap)), F.sum(F.when(~over, F.col("weight"))), F.count_if(over)
        ).first()
        if not free or n == held:
            break
        held, unit = n, (float(total) - float(taken or 0)) / float(free)
    target = F.least(F.col("words") * float(cap), F.col("weight") * F.lit(float(unit)))
    return rows.select("source", "words", target.alias("target"))


def split_quotas(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """counts[shard, source]: exact quotas of the shards; shard totals differ by one at most."""
    out = np.zeros((shards, len(quotas)), dtype=np.int64)
    total = sum(quotas)
    ends = [total * k // shards for k in range(shards + 1)]

    def split(lo: int, hi: int, own: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = own
            return
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, lo, hi])
        left = rng.multivariate_hypergeometric(own, ends[mid] - ends[lo], method="marginals")
        split(lo, mid, left)
        split(mid, hi, own - left)

    split(0, shards, np.array(quotas, dtype=np.int64))
    return out


def _before(keys: list[str], by: str) -> Window:
    return Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)


def _hash(*parts) -> Column:
    return F.xxhash64("doc_id", "copy", *[F.lit(p) if isinstance(p, int) else p for p in parts])


def mix(docs: DataFrame, shards: int = 16, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(plan, copies) of a mix.

    plan: doc_id, source, copy (hash of the text), m (rows that are equal in
    these), size, source_size, target, times.  copies: doc_id, source, copy, m,
    pass, shard, place; a row for every time a document is taken.
    Null texts have size 0.  Null sources are one source, the last.  Rows equal
    in doc_id, source and text are taken equally often.  A document of size 0 is
    taken in whole passes only.  All decisions hash doc_id and text, so reruns
    agree.
    """
    spark = docs.sparkSession
    size = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    nodes = table(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
            F.xxhash64(F.col("text").cast("string")).alias("copy"), size.alias("size"),
        ).groupBy("doc_id", "source", "copy").agg(F.count("*").alias("m"), F.max("size").alias("size")),
        "nodes",
    )
    sizes = table(nodes.groupBy("source").agg(F.sum(F.col("m") * F.col("size")).alias("words"), F.sum("m").alias("rows")), "sizes")
    n_sources, n_rows = sizes.agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0))).first()
    few = n_sources <= MAX_SOURCES
    bounded = F.broadcast if few else lambda df: df  # what has a row per source
    buckets = max(1, math.ceil(n_rows / BUCKET_ROWS))
    if few:
        words = {r["source"]: int(r["words"]) for r in sizes.collect()}
        goal = targets(list(words.items()))
        goals = spark.createDataFrame([(s, words[s], goal[s]) for s in words], "source string, words long, target double")
    else:
        goals = targets_table(sizes.select("source", "words"))
    passes = F.when(F.col("words") == 0, (F.col("target") > 0).cast("int")).otherwise(F.least(F.lit(CAP), F.floor(F.col("target") / F.col("words"))).cast("int"))
    facts = goals.select("source", F.col("words").alias("source_size"), "target", passes.alias("passes"), (F.col("target") - passes * F.col("words")).alias("rest"))
    facts = facts if few else table(facts, "facts")

    def with_facts(df: DataFrame) -> DataFrame:
        f = bounded(facts.withColumnRenamed("source", "_s"))
        return df.join(f, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")

    seen = with_facts(nodes).withColumn("bucket", F.pmod(_hash(seed), F.lit(buckets))).withColumn("w", F.col("m") * F.col("size"))
    sums = seen.groupBy("source", "bucket", "rest").agg(F.sum("w").alias("sum"))
    sums = sums.withColumn("off", F.coalesce(F.sum("sum").over(_before(["source"], "bucket")), F.lit(0)))
    # whole buckets that fit; only the bucket the rest ends in is put in order
    full = sums.where("off + sum <= rest").select("source", "bucket")
    last = sums.where("off <= rest and off + sum > rest").select("source", "bucket", "off")
    inside = Window.partitionBy("source", "bucket").orderBy(_hash(seed, 1), "doc_id", "copy").rowsBetween(Window.unboundedPreceding, 0)
    null_safe = lambda a, b, *more: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source")) if not more else (
        F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source")) & (F.col(f"{a}.bucket") == F.col(f"{b}.bucket"))
    )
    same_node = lambda a, b: (
        F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & null_safe(a, b) & F.col(f"{a}.copy").eqNullSafe(F.col(f"{b}.copy"))
    )
    body = seen.alias("n").join(full.alias("f"), null_safe("n", "f", "bucket"), "left_semi").select("n.doc_id", "n.source", "n.copy", "n.w")
    edge = (
        seen.alias("n").join(bounded(last).alias("l"), null_safe("n", "l", "bucket"))  # a row per source
        .select("n.*", "l.off").withColumn("end", F.col("off") + F.sum("w").over(inside))
        .where("end <= rest").select("doc_id", "source", "copy", "w")
    )
    chosen = table(body.unionByName(edge).withColumn("yes", F.lit(1)), "chosen")
    got = chosen.groupBy("source").agg(F.sum("w").alias("got"))
    marked = table(
        nodes.alias("n").join(
            chosen.alias("c"),
            same_node("n", "c"),
            "left",
        ).select("n.*", F.coalesce("c.yes", F.lit(0)).alias("part")),
        "marked",
    )
    # documents that fit what is left
    gap = with_facts(got.alias("g").select("source", "got")).select("source", (F.col("rest") - F.col("got")).alias("gap"))
    none = with_facts(nodes.select("source").distinct()).select("source", F.col("rest").alias("gap"))
    gap = none.alias("a").join(gap.alias("b"), null_safe("a", "b"), "left").select("a.source", F.coalesce("b.gap", "a.gap").alias("gap"))
    picked = None  # at most FITS rows per source
    for k in range(FITS):
        # later rounds may take a document of the partial pass once more, within the cap
        fresh = F.col("part") == 0 if k < FITS // 2 else F.col("passes") + F.col("part") < CAP
        pool = with_facts(marked).where(fresh).select(*marked.columns, (F.col("m") * F.col("size")).alias("w"))
        left = gap
        if picked is not None:
            pool = pool.alias("n").join(bounded(picked.alias("c")), same_node("n", "c"), "left_anti")
            taken = picked.groupBy("source").agg(F.sum("w").alias("used"))
            left = gap.alias("a").join(taken.alias("b"), null_safe("a", "b"), "left").select(
                "a.source", (F.col("gap") - F.coalesce("used", F.lit(0))).alias("gap")
            )
        # the largest that still fits; at the end the nearest, above or below
        off = F.abs(F.col("w") - F.col("gap"))
        may = (off < F.col("gap")) if k == FITS - 1 else (F.col("w") <= F.col("gap")) & (F.col("w") > 0)
        best = (
            pool.alias("n").join(bounded(left).alias("g"), null_safe("n", "g")).select("n.*", "g.gap").where(may)
            .groupBy("source").agg(F.min(F.struct(off.alias("off"), _hash(seed, 2).alias("h"), "doc_id", "copy", "w")).alias("best"))
            .select("source", F.col("best.doc_id").alias("doc_id"), F.col("best.copy").alias("copy"), F.col("best.w").alias("w"))
        )
        picked = table(best if picked is None else picked.unionByName(best), "picked")
        used = picked.groupBy("source").agg(F.sum("w").alias("used")).alias("u")
        open_ = with_facts(gap).alias("f").join(used, null_safe("f", "u"), "left")
        if open_.where(F.abs(F.col("gap") - F.coalesce("used", F.lit(0))) > NEAR * F.col("target")).isEmpty():
            break
    joined = marked.alias("n").join(bounded(picked.withColumn("more", F.lit(1))).alias("c"), same_node("n", "c"), "left").select(
        "n.*", F.coalesce("c.more", F.lit(0)).alias("more")
    )
    plan = table(
        with_facts(joined).select(
            "doc_id", "source", "copy", "m", "size", "source_size", "target",
            F.least(F.lit(CAP), F.col("passes") + F.col("part") + F.col("more")).cast("int").alias("times"),
        ),
        "plan",
    )
    return plan, _dealt(plan, buckets, shards, seed)


def _grouped_bounds(totals: DataFrame, block: int, shards: int, seed: int) -> DataFrame:
    """(_s, ends): where each source's copies end in every shard, for any number of sources.

    totals: source, c.  The tree splits the blocks of at most SOURCE_GROUPS groups;
    a group's share of a shard is then drawn from the blocks its sources have left.
    """
    group = F.pmod(F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull()), F.lit(SOURCE_GROUPS)).cast("int")
    own = table(totals.select(F.col("source").alias("_s"), group.alias("g"), F.ceil(F.col("c") / F.lit(block)).cast("long").alias("n")), "groups")
    rows = sorted((r["g"], int(r["n"])) for r in own.groupBy("g").agg(F.sum("n").alias("n")).collect())
    tree = split_quotas([n for _, n in rows], shards, seed)
    shares = {g: tree[:, i].tolist() for i, (g, _) in enumerate(rows)}

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_s", na_position="last")
        left, rng = part["n"].to_numpy(dtype=np.int64), np.random.default_rng([seed, int(part["g"].iloc[0])])
        ends = np.zeros((len(part), shards), dtype=np.int64)
        for k, n in enumerate(shares[int(part["g"].iloc[0])]):
            drawn = rng.multivariate_hypergeometric(left, n, method="marginals")
            left = left - drawn
            ends[:, k] = drawn
        return pd.DataFrame({"_s": part["_s"], "ends": list(np.cumsum(ends, axis=1) * block)})

    return own.groupBy("g").applyInPandas(run, "_s string, ends array<long>")


def _dealt(plan: DataFrame, buckets: int, shards: int, seed: int) -> DataFrame:
    """Every copy's shard and place: disjoint runs of each source's permuted copies by the tree's quotas."""
    spark = plan.sparkSession
    each = plan.where("times > 0").select(
        "doc_id", "source", "copy", "m", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("pass")
    )
    each = each.withColumn("bucket", F.pmod(_hash(F.col("pass"), seed), F.lit(buckets)))
    sums = table(each.groupBy("source", "pass", "bucket").agg(F.count("*").alias("c")), "blocks")
    totals = sums.groupBy("source").agg(F.sum("c").alias("c"))
    n_sources, copies = totals.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    block = max(1, copies // (shards * SHARD_BLOCKS))
    if n_sources <= MAX_SOURCES:
        rows = sorted(((r["source"], int(r["c"])) for r in totals.collect()), key=lambda x: (x[0] is None, x[0] or ""))
        ends = np.cumsum(split_quotas([math.ceil(c / block) for _, c in rows], shards, seed), axis=0) * block
        bounds = F.broadcast(spark.createDataFrame([(s, [int(x) for x in ends[:, i]]) for i, (s, _) in enumerate(rows)], "_s string, ends array<long>"))
    else:
        bounds = _grouped_bounds(totals, block, shards, seed)
    sums = sums.withColumn("off", F.coalesce(F.sum("c").over(Window.partitionBy("source").orderBy("pass", "bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy("source", "pass", "bucket").orderBy(_hash(F.col("pass"), seed, 3), "doc_id", "copy")
    ranked = each.withColumn("rank", F.row_number().over(inside)).alias("e").join(
        sums.alias("s"),
        F.col("e.source").eqNullSafe(F.col("s.source")) & (F.col("e.pass") == F.col("s.pass")) & (F.col("e.bucket") == F.col("s.bucket")),
    ).select("e.doc_id", "e.source", "e.copy", "e.m", "e.pass", (F.col("s.off") + F.col("e.rank") - 1).alias("rank"))
    placed = ranked.join(bounds, F.col("source").eqNullSafe(F.col("_s")))
    return placed.select(
        "doc_id", "source", "copy", "m", "pass",
        F.size(F.filter("ends", lambda e: e <= F.col("rank"))).alias("shard"), _hash(F.col("pass"), seed, 4).alias("place"),
    )


def mix_report(docs: DataFrame, shards: int = 16, seed: int = 7) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken, shards (of its copies)."""
    plan, copies = mix(docs, shards, seed)
    where = copies.groupBy("doc_id", "source", "copy").agg(F.sort_array(F.collect_list("shard")).alias("shards"))
    same = (
        F.col("p.doc_id").eqNullSafe(F.col("w.doc_id")) & F.col("p.source").eqNullSafe(F.col("w.source")) & F.col("p.copy").eqNullSafe(F.col("w.copy"))
    )
    return plan.alias("p").join(where.alias("w"), same, "left").select(
        "p.doc_id", "p.size", "p.source_size", "p.target", (F.col("p.size") * F.col("p.times")).alias("taken"),
        F.coalesce("w.shards", F.array().cast("array<int>")).alias("shards"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("p.m"))).alias("_row"),
    ).drop("_row")


def mixed_documents(docs: DataFrame, shards: int = 16, seed: int = 7) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with its columns alone.

    A shard's rows lie together in runs of its own random order.
    """
    names = docs.columns
    parts = ("doc_id", "source", "copy", "shard", "place")
    digest, *own = fresh(names, "digest", *[f"taken_{p}" for p in parts])
    doc_id, source, copy, shard, place = own
    copies = table(mix(docs, shards, seed)[1], "copies")
    key = docs.withColumn(digest, F.xxhash64(F.col("text").cast("string")))
    taken = copies.select(*[F.col(c).alias(o) for c, o in zip(parts, own, strict=True)])
    same = (
        F.col("doc_id").cast("long").eqNullSafe(F.col(doc_id))
        & F.col("source").cast("string").eqNullSafe(F.col(source))
        & (F.col(digest) == F.col(copy))
    )
    run = F.pmod(F.shiftright(place, 32), F.lit(max(1, round(copies.count() / shards / RUN_ROWS))))
    return key.join(taken, same).repartition(shard, run).sortWithinPartitions(shard, place).select(*names)
