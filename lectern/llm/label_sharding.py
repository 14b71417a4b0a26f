"""Sharding by balanced label propagation, in DataFrame operations only.

Documents that share a group (the registered query: equal texts) are linked.
Links are kept as the two-column relation document - group, never as pairs, so a
group of any size costs one row per member.  Labels (shards) start from a hash;
in every round each group counts its members by label, documents ask to move to
the label most of their group carries (of several, if it needs several shards), and a table of at most shards**2 quotas
lets through as many as balance and slack allow.  Groups that fit a shard move
whole: the choice hashes the group; a group larger than a shard cannot and moves
row by row.  A last pass lays all documents out by label and group and cuts that
line into shards whose row counts differ by one at most, so a group is cut only
where a shard ends.

Only ids, hashes and labels are shuffled; the text is read once.  A large group
lies in consecutive parts of the layout, and no window runs over more than one
bucket or part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import table

#: Rows of a layout bucket on average, and of a part of a larger group.
BUCKET_ROWS = 2000


def nodes_of(docs: DataFrame) -> DataFrame:
    """row, doc_id, size, text_crc32 and grp (equal texts share it); null texts count as empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text, F.length(text)).alias("grp"),
    )


def propagate(nodes: DataFrame, shards: int, rounds: int, slack: float) -> DataFrame:
    """Adds label and n (members of the group) to a written table of nodes.

    Only rows with links take room and move; rows of groups of one fill, at the
    end, what the others leave free.  A group larger than a shard is drawn to as
    many labels as it needs, the most frequent ones.
    """
    total = nodes.count()
    fair = max(1.0, total / shards)
    cap = fair * (1 + slack)
    groups = table(nodes.groupBy("grp").agg(F.count("*").alias("n")), "groups")
    start = F.pmod(F.xxhash64("doc_id", "row", F.lit("start")), F.lit(shards)).cast("int")
    own = table(nodes.select("row", "grp", start.alias("label")).join(groups, "grp"), "labels")
    now = own.where("n > 1")
    for k in range(rounds):
        votes = now.groupBy("grp", "label", "n").agg(F.count("*").alias("c"))
        # at most one place per shard for a group
        ranked = votes.groupBy("grp", "n").agg(F.sort_array(F.collect_list(F.struct("c", F.xxhash64("grp", "label", F.lit(k)).alias("t"), "label")), asc=False).alias("v"))
        room = F.least(F.size("v"), F.ceil(F.col("n") / F.lit(fair)).cast("int"))
        wish = ranked.select("grp", F.transform(F.slice("v", F.lit(1), room), lambda z: z["label"]).alias("places"))
        aim = F.col("places")[F.pmod(F.xxhash64("row", F.lit(k)), F.size("places")).cast("int")]
        moving = now.join(wish, "grp").where(~F.array_contains("places", F.col("label"))).withColumn("to", aim).drop("places")
        moving = table(moving, "moving")
        demand = table(moving.groupBy(F.col("label").alias("i"), F.col("to").alias("j")).agg(F.count("*").alias("d")), "demand")
        fill = now.groupBy(F.col("label").alias("j")).agg(F.count("*").alias("size"))
        inward = demand.groupBy("j").agg(F.sum("d").alias("all_in"))
        back = demand.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("d").alias("e"))
        quota = (
            demand.join(back, ["i", "j"], "left").join(inward, "j").join(fill, "j", "left")
            .select(
                F.col("i").alias("label"),
                F.col("j").alias("to"),
                # a swap keeps both sizes; what is free below the cap is shared among the rest
                F.least(
                    F.lit(1.0),
                    (
                        F.least("d", F.coalesce("e", F.lit(0)))
                        + F.greatest(F.lit(0.0), F.lit(cap) - F.coalesce("size", F.lit(0))) * F.col("d") / F.col("all_in")
                    ) / F.col("d"),
                ).alias("share"),
            )
        )
        # the quotas are at most shards**2 rows
        draw = F.pmod(F.xxhash64("grp", F.when(F.col("n") > fair, F.col("row")), F.lit(k)), F.lit(1_000_003)) / 1_000_003.0
        moved = (
            moving.join(F.broadcast(quota), ["label", "to"]).where(draw < F.col("share")).select("row", F.col("to").alias("new"))
        )
        now = table(
            now.join(moved, "row", "left").select("row", "grp", F.coalesce("new", "label").alias("label"), "n"), "labels"
        )
    taken = {r["label"]: r["c"] for r in now.groupBy("label").agg(F.count("*").alias("c")).collect()}  # a row per shard
    free = [max(0.0, fair - taken.get(k, 0)) for k in range(shards)]
    at = F.pmod(F.xxhash64("row", F.lit("fill")), F.lit(1 << 30)) / F.lit(float(1 << 30)) * F.lit(sum(free))
    bound, gap = 0.0, F.lit(shards - 1)
    steps = []
    for k in range(shards - 1):
        bound += free[k]
        steps.append((k, bound))
    for k, bound in reversed(steps):
        gap = F.when(at < bound, k).otherwise(gap)
    alone = own.where("n = 1").withColumn("label", gap.cast("int"))
    return now.select("row", "grp", "label", "n").unionByName(alone.select("row", "grp", "label", "n"))


def balanced_shards(docs: DataFrame, shards: int = 24, rounds: int = 4, slack: float = 0.1) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    law is ``rows``: the shards' row counts differ by one at most; slot counts
    from 0 within a shard without gaps.  size is the text's UTF-8 bytes plus 8
    (null text: 8, and it is grouped with the empty text; crc32 of no bytes is
    0).  Null and repeated doc_ids are ordinary rows.  An empty table gives an
    empty result; further columns of docs are ignored.  grown_shard is null.
    """
    nodes = table(nodes_of(docs), "nodes")
    total = nodes.count()
    labels = propagate(nodes, shards, rounds, slack)
    buckets = max(1, round(total / (shards * BUCKET_ROWS)))
    large = F.col("n") > BUCKET_ROWS
    parts = F.ceil(F.col("n") / F.lit(BUCKET_ROWS))
    laid = table(
        labels.select(
            "row",
            "grp",
            "label",
            F.struct(
                F.pmod("grp", F.lit(buckets)).alias("bucket"),
                F.when(large, F.col("grp")).otherwise(0).alias("large"),
                F.when(large, F.pmod(F.xxhash64("row"), parts)).otherwise(0).alias("part"),
            ).alias("at"),
        ),
        "layout",
    )
    counts = laid.groupBy("label", "at").agg(F.count("*").alias("c"))
    before = Window.partitionBy("label").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)  # a row per bucket or part
    whole = laid.groupBy("label").agg(F.count("*").alias("c"))  # one row per shard
    base = whole.alias("x").join(whole.alias("y"), F.col("y.label") < F.col("x.label"), "left").groupBy(
        F.col("x.label").alias("label")
    ).agg(F.coalesce(F.sum("y.c"), F.lit(0)).alias("base"))
    offsets = counts.select("label", "at", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("off")).join(
        F.broadcast(base), "label"
    )
    inside = Window.partitionBy("label", "at").orderBy("grp", "row")
    place = F.col("base") + F.col("off") + F.row_number().over(inside) - 1
    slots = laid.join(offsets, ["label", "at"]).select("row", place.alias("p"))
    shard = F.expr(f"(p * {shards}) div {max(1, total)}")
    begin = F.expr(f"((p * {shards}) div {max(1, total)} * {total} + {shards - 1}) div {shards}")
    return nodes.join(slots, "row").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        shard.cast("int").alias("shard"),
        (F.col("p") - begin).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def cut_links(placed: DataFrame, group: str = "text_crc32", shard: str = "shard") -> DataFrame:
    """One row (links, cut): the links that hold every group together, and those between two shards.

    A group of n rows needs n - 1 links; laid shard by shard, one less than its
    number of shards is cut.  That is the number the propagation keeps small.
    """
    cells = placed.groupBy(group, shard).agg(F.count("*").alias("c"))
    each = cells.groupBy(group).agg(F.sum("c").alias("n"), F.count("*").alias("k"))
    return each.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("links"), F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("cut"))
