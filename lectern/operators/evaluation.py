"""Evaluation of rankings: relevance files, metrics, pooling, judging, agreement, significance."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The kinds of questions that should not be answered, each reported even without topics.
ABSTAIN_TYPES = ("false_premise", "underspecified", "homonym")


# ---------------------------------------------------------------- relevance


def expand_ref(ref: Column) -> Column:
    """Candidate ids of 'b.c.s' or 'b.c.s1-b.c.s2' (same book and chapter); [] if it is neither."""
    span = F.split(ref, "-")
    a, b = F.split(span[0], r"\."), F.split(F.get(span, F.lit(1)), r"\.")
    lo, hi = F.try_element_at(a, F.lit(3)).try_cast("int"), F.try_element_at(b, F.lit(3)).try_cast("int")
    valid = (F.size(a) == 3) & (F.size(b) == 3) & (a[0] == b[0]) & (a[1] == b[1]) & (hi >= lo)
    stem = F.concat(a[0], F.lit("."), a[1], F.lit("."))
    ids = F.transform(F.sequence(lo, F.greatest(lo, hi)), lambda s: F.concat(stem, s.cast("string")))
    none = F.array().cast("array<string>")
    return F.when(~ref.contains("-"), F.array(ref)).when(valid, ids).otherwise(none)


def parse_qrels(lines: DataFrame, passages: DataFrame) -> dict[str, DataFrame]:
    """Relevance lines (line_no, value: JSON) -> qrels, topics, reasons and errors.

    qrels(topic, passage, grade): the best grade per passage, grades above 0
    whose reference resolves against passages(id).  A reason for having no
    passage is kept from rows of grade 0 only.
    """
    row = F.from_json("value", "topic_id string, relevance double, full_cts_urn string, no_gold_passage_reason string")
    good = lines.where(F.trim("value") != "").withColumn("r", row).withColumn("bad", F.col("r").isNull() | F.expr("try_parse_json(value) is null"))
    flat = good.select("line_no", "bad", "r.*").withColumns(
        {"grade": F.coalesce("relevance", F.lit(0.0)), "reason": F.coalesce("no_gold_passage_reason", F.lit("")), "topic": F.coalesce("topic_id", F.lit(""))}
    )
    known = flat.where("not bad and topic <> ''")
    ref = F.element_at(F.split(F.coalesce("full_cts_urn", F.lit("")), ":"), -1)
    rows = known.where("grade > 0").withColumn("ref", ref)
    hits = (
        rows.select("line_no", "topic", "grade", F.explode(expand_ref(F.col("ref"))).alias("passage"))
        .join(passages.select(F.col("id").alias("passage")), "passage", "left_semi")
    )
    lost = rows.where("full_cts_urn is not null and full_cts_urn <> ''").join(hits.select("line_no").distinct(), "line_no", "left_anti")
    said = lambda df, text: df.select("line_no", F.lit(text).alias("error"))
    errors = (
        said(flat.where("bad"), "invalid JSON")
        .unionByName(said(flat.where("not bad and topic = ''"), "missing topic_id"))
        .unionByName(said(known.where("reason <> '' and grade > 0"), "a reason for no passage stands on a relevant row"))
        .unionByName(said(rows.where("full_cts_urn is null or full_cts_urn = ''"), "a relevant row names no passage"))
        .unionByName(said(lost, "the passage named is not known"))
    )
    last = F.max_by("reason", "line_no")
    return {
        "qrels": hits.groupBy("topic", "passage").agg(F.max("grade").alias("grade")),
        "topics": known.select("topic").distinct(),
        "reasons": known.where("reason <> '' and grade <= 0").groupBy("topic").agg(last.alias("reason")),
        "errors": errors,
    }


#: Words of a needle that are looked up as one hash before the texts are compared.
ANCHOR = 5


def holding(docs: DataFrame, needles: DataFrame) -> DataFrame:
    """(topic, passage) of docs(passage, text) that hold a whole needle(topic, needle) as a substring.

    Blank-separated words inside a needle (all but its first and last, which may
    be parts of words in the text) stand in the text as they are, so an equi-join
    on the hash of the first ANCHOR of them finds the candidates and the texts
    decide.  Needles of fewer words have no such anchor and are held against
    every text by themselves.
    """
    words = F.split("needle", " ")
    inner = F.slice(words, 2, ANCHOR)
    known = needles.select("topic", "needle", F.when(F.size(words) >= ANCHOR + 2, F.xxhash64(inner)).alias("anchor"))
    tokens = docs.select("passage", F.split("text", " ").alias("w")).where(F.size("w") >= ANCHOR + 2)
    windows = F.transform(F.sequence(F.lit(1), F.size("w") - ANCHOR + 1), lambda i: F.xxhash64(F.slice("w", i, ANCHOR)))
    near = (
        tokens.select("passage", F.explode(F.array_distinct(windows)).alias("anchor"))
        .join(known.where("anchor is not null").select("topic", "anchor"), "anchor").select("topic", "passage")
    )
    found = near.join(docs, "passage").join(known.select("topic", "needle"), "topic")
    short = docs.join(known.where("anchor is null").select("topic", "needle"), F.contains("text", "needle"))
    return found.where(F.contains("text", "needle")).select("topic", "passage").unionByName(short.select("topic", "passage")).distinct()


# ---------------------------------------------------------------- metrics


def score_topics(run: DataFrame, qrels: DataFrame, topics: DataFrame, k: int = 10) -> DataFrame:
    """Per topic: n_relevant, first_rank (null: none in the top k), relevant_in_k, dcg, ideal.

    run: topic, passage, rank; of two lines with one rank the later (``ord``, if
    there) counts.  Gains are linear, discounts log2(rank + 1), the ideal is cut at k.
    """
    order = F.col("ord") if "ord" in run.columns else F.col("passage")
    cut = (
        run.where(F.col("rank").between(1, k))
        .withColumn("_w", F.row_number().over(Window.partitionBy("topic", "rank").orderBy(order.desc()))).where("_w = 1")
    )
    hits = cut.join(qrels, ["topic", "passage"]).groupBy("topic").agg(
        F.min("rank").alias("first_rank"), F.count("*").alias("relevant_in_k"), F.sum(F.col("grade") / F.log2(F.col("rank") + 1)).alias("dcg")
    )
    place = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("grade"), "passage"))
    ideal = qrels.withColumn("i", place).groupBy("topic").agg(
        F.count("*").alias("n_relevant"), F.sum(F.when(F.col("i") <= k, F.col("grade") / F.log2(F.col("i") + 1))).alias("ideal")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return topics.join(ideal, "topic", "left").join(hits, "topic", "left").select(
        *topics.columns, zero("n_relevant"), "first_rank", zero("relevant_in_k"), F.coalesce("dcg", F.lit(0.0)).alias("dcg"), F.coalesce("ideal", F.lit(0.0)).alias("ideal")
    )


def run_metrics(scored: DataFrame, *by: str) -> DataFrame:
    """n_topics, n_scored, n_excluded, mrr, recall, ndcg, hit over answerable topics; 0 without any.

    Topics that must be abstained from are left out first, then those without a
    passage for a stated reason; unresolvable ones count as topics only.
    """
    answerable = scored.where("not must_abstain")
    excluded = (F.col("n_relevant") == 0) & F.col("reason").isNotNull()
    scoreable = F.col("n_relevant") > 0
    part = {
        "mrr": F.coalesce(1 / F.col("first_rank"), F.lit(0.0)),
        "recall": F.col("relevant_in_k") / F.col("n_relevant"),
        "ndcg": F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).otherwise(0.0),
        "hit": F.when(F.col("first_rank").isNotNull(), 1.0).otherwise(0.0),
    }
    means = [F.coalesce(F.avg(F.when(scoreable, x)), F.lit(0.0)).alias(n) for n, x in part.items()]
    return answerable.groupBy(*by).agg(
        F.count_if(~excluded).alias("n_topics"), F.count_if(scoreable).alias("n_scored"), F.count_if(excluded).alias("n_excluded"), *means
    )


def abstain_report(scored: DataFrame) -> DataFrame:
    """(abstain_type, n_topics, n_with_evidence, evidence_hit) with a row for every type."""
    spark = scored.sparkSession
    kinds = spark.createDataFrame([(t,) for t in ABSTAIN_TYPES], "abstain_type string")
    found = scored.where("must_abstain").groupBy("abstain_type").agg(
        F.count("*").alias("n_topics"), F.count_if(F.col("n_relevant") > 0).alias("n_with_evidence"),
        F.count_if((F.col("n_relevant") > 0) & F.col("first_rank").isNotNull()).alias("evidence_hit"),
    )
    return kinds.join(found, "abstain_type", "left").na.fill(0)


def compare_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """(topic, rank_a, rank_b, outcome) of two runs' first relevant ranks; ties are left out."""
    both = a.select("topic", F.col("first_rank").alias("rank_a")).join(b.select("topic", F.col("first_rank").alias("rank_b")), "topic", "full")
    miss = F.lit(1 << 30)
    x, y = F.coalesce("rank_a", miss), F.coalesce("rank_b", miss)
    outcome = F.when(F.col("rank_a").isNull() & F.col("rank_b").isNull(), "both miss").when(x < y, "A wins").when(x > y, "B wins")
    return both.withColumn("outcome", outcome).where("outcome is not null")


def resumed(topics: DataFrame, path: str, schema: str, answered: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of all topics under path; only topics without any are answered now, and their rows appended.

    answered: topics still open -> rows with a column topic (schema names all
    columns).  An interrupted run leaves whole appended batches or nothing, so
    the next call goes on where it stopped.
    """
    spark = topics.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
    open_ = topics
    if there:
        open_ = topics.join(spark.read.schema(schema).parquet(path).select("topic").distinct(), "topic", "left_anti")
    names = spark.createDataFrame([], schema).columns
    answered(open_).select(*names).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


# ---------------------------------------------------------------- pooling and judging


def shuffle_key(seed: str, item: Column) -> Column:
    """Order of a deterministic shuffle: SHA-256 of seed, NUL and item."""
    return F.sha2(F.concat(F.lit(seed), F.lit("\u0000"), item), 256)


def pool(runs: DataFrame, depth: int, pool_id: str) -> DataFrame:
    """(item, topic, passage, from_runs, shuffle): the runs' lines to a depth, shuffled by hash."""
    item = F.concat(F.lit(f"{pool_id}:"), F.col("topic"), F.lit(":"), F.col("passage"))
    return (
        runs.where(F.col("rank") <= depth).groupBy("topic", "passage").agg(F.sort_array(F.collect_set("run")).alias("from_runs"))
        .withColumn("item", item).withColumn("shuffle", shuffle_key(pool_id, F.col("item")))
    )


def latest(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row per key by the order columns."""
    window = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_n", F.row_number().over(window)).where("_n = 1").drop("_n")


def escalated(batches: DataFrame, judgments: DataFrame) -> DataFrame:
    """Items with a third judge: in a live resolution batch, or judged by the judge of a revoked one."""
    issued = batches.where("resolution").select("annotator", "revoked", F.explode("items").alias("item"))
    arrived = issued.where("revoked").join(judgments.select("item", "annotator"), ["item", "annotator"], "left_semi")
    return issued.where("not revoked").select("item").unionByName(arrived.select("item")).distinct()


def resolve_items(judgments: DataFrame, adjudications: DataFrame, targets: DataFrame) -> DataFrame:
    """(item, n, grades, method, grade): adjudicated, else unanimous, else a strict majority of the target.

    judgments: item, annotator, grade; adjudications: item, grade; targets: item, target.
    Majority needs a target of 3 or more; unresolved items keep a null method.
    """
    counts = judgments.groupBy("item", "grade").agg(F.count("*").alias("c"))
    best = counts.groupBy("item").agg(
        F.sum("c").alias("n"), F.count("*").alias("grades"),
        F.min(F.struct((-F.col("c")).alias("c"), F.col("grade").alias("g"))).alias("top"),
    )
    rows = targets.join(best, "item", "left").join(adjudications.select("item", F.col("grade").alias("ruled")), "item", "left")
    n = F.coalesce("n", F.lit(0))
    unanimous = (n >= F.col("target")) & (F.col("grades") == 1)
    majority = (F.col("target") >= 3) & (-F.col("top.c") * 2 > F.col("target"))
    method = F.when(F.col("ruled").isNotNull(), "adjudicated").when(unanimous, "unanimous").when(majority, "majority")
    return rows.withColumn("method", method).select(
        "item", "target", n.alias("n"), F.coalesce("grades", F.lit(0)).alias("grades"), "method",
        F.when(F.col("method") == "adjudicated", F.col("ruled")).when(F.col("method").isNotNull(), F.col("top.g")).alias("grade"),
    )


def coverage(resolved: DataFrame, target: int) -> DataFrame:
    """One row: items by number of judgments and by how they stand."""
    open_ = F.col("method").isNull()
    full = F.col("n") >= F.col("target")
    count = lambda c, name: F.count_if(c).alias(name)
    return resolved.agg(
        count(F.col("n") == 0, "zero"), count(F.col("n") == 1, "one"), count(F.col("n") >= 2, "two_plus"), count(full, "complete"),
        *[count(F.col("method") == m, m) for m in ("unanimous", "majority", "adjudicated")],
        count(open_ & full, "needs_arbitration"),
        count(open_ & ~full & (F.col("target") > target) & (F.col("n") >= target), "awaiting_third"),
    )


def disagreements(resolved: DataFrame) -> DataFrame:
    """(item, state) of items with two judgments or more that differ and are not settled by the judges."""
    state = F.when(F.col("method") == "adjudicated", "adjudicated").when(F.col("n") < F.col("target"), "awaiting_third").otherwise("deadlock")
    return resolved.where("n >= 2 and grades > 1 and (method is null or method = 'adjudicated')").select("item", state.alias("state"))


def issue_batch(items: DataFrame, judgments: DataFrame, batches: DataFrame, annotator: str, target: int, size: int | None = None) -> DataFrame:
    """Items for a judge: none of theirs, none with enough judges; begun ones first, then in shuffled order."""
    held = batches.where("not revoked").select(F.explode("items").alias("item"), "annotator")
    engaged = judgments.select("item", "annotator").unionByName(held).groupBy("item").agg(F.collect_set("annotator").alias("who"))
    rows = items.join(engaged, "item", "left").withColumn("who", F.coalesce("who", F.array().cast("array<string>")))
    free = rows.where(~F.array_contains("who", annotator) & (F.size("who") < target))
    out = free.orderBy((F.size("who") == 0).cast("int"), "shuffle").select("item", "topic", "passage")
    return out if size is None else out.limit(size)


def resolution_batch(resolved: DataFrame, judgments: DataFrame, batches: DataFrame, annotator: str) -> DataFrame:
    """Deadlocked items (two judgments that differ, no ruling) for a fresh third judge."""
    held = batches.where("not revoked").select(F.explode("items").alias("item"), "annotator")
    engaged = judgments.select("item", "annotator").unionByName(held).groupBy("item").agg(F.collect_set("annotator").alias("who"))
    stuck = resolved.where("n = 2 and grades > 1 and (method is null or method <> 'adjudicated')")
    return stuck.join(engaged, "item").where(~F.array_contains("who", annotator) & (F.size("who") < 3)).select("item")


def ingest(rows: DataFrame, batches: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(accepted, rejected, summary): rows need item, annotator and grade, and a batch of theirs with the item.

    The summary has the number accepted, rejected, and of stored judgments replaced.
    """
    owned = batches.select(F.col("id").alias("batch"), "annotator", F.explode("items").alias("item"))
    whole = rows.where("item is not null and annotator is not null and grade is not null")
    good = whole.join(owned, ["batch", "annotator", "item"], "left_semi")
    bad = rows.where("item is null or annotator is null or grade is null").withColumn("reason", F.lit("incomplete row")).unionByName(
        whole.join(owned, ["batch", "annotator", "item"], "left_anti").withColumn("reason", F.lit("not in a batch of this judge"))
    )
    replaced = stored.join(good, ["item", "annotator"], "left_semi")
    count = lambda df, name: df.agg(F.count("*").alias(name))
    summary = count(good, "accepted").join(count(bad, "rejected")).join(count(replaced, "replaced"))
    return good, bad, summary


def qrels_lines(items: DataFrame, resolved: DataFrame, pool_id: str, depth: int) -> DataFrame:
    """(ord, line): 'topic 0 passage grade' for resolved items and a last line with the number of the others."""
    rows = items.join(resolved, "item", "left")
    done = rows.where("method is not null").select(F.col("shuffle").alias("ord"), F.format_string("%s 0 %s %s", "topic", "passage", F.col("grade").cast("string")).alias("line"))
    tail = rows.agg(F.count_if(F.col("method").isNull()).alias("n")).select(
        F.lit("~").alias("ord"), F.format_string(f"# unresolved_items=%d pool={pool_id} depth={depth}", "n").alias("line")
    )
    return done.unionByName(tail)


# ---------------------------------------------------------------- agreement


def krippendorff_alpha(judgments: DataFrame, unit: str, value: str, scale: str = "interval", by: list[str] | None = None) -> DataFrame:
    """alpha over units with two values or more; null without any or without variation.

    Only sums per unit and overall are needed: the pairs within a unit and the
    pairs of all values have closed forms (interval: squares; nominal: a histogram).
    """
    by = by or []
    if scale == "interval":
        v = F.col(value).cast("double")
        units = judgments.groupBy(*by, unit).agg(F.count("*").alias("m"), F.sum(v).alias("s"), F.sum(v * v).alias("q")).where("m >= 2")
        total = units.groupBy(*by).agg(
            F.sum((2 * F.col("m") * F.col("q") - 2 * F.col("s") * F.col("s")) / (F.col("m") - 1)).alias("o"),
            F.sum("m").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"),
        )
        spread = 2 * F.col("n") * F.col("q") - 2 * F.col("s") * F.col("s")
    else:
        cells = judgments.groupBy(*by, unit, value).agg(F.count("*").alias("c"))
        units = cells.groupBy(*by, unit).agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("c2")).where("m >= 2")
        marks = cells.join(units.select(*by, unit), [*by, unit], "left_semi").groupBy(*by, value).agg(F.sum("c").alias("c"))
        squares = marks.groupBy(*by).agg(F.sum(F.col("c") * F.col("c")).alias("v2"))
        total = units.groupBy(*by).agg(F.sum((F.col("m") * F.col("m") - F.col("c2")) / (F.col("m") - 1)).alias("o"), F.sum("m").alias("n"))
        total = total.join(squares, by) if by else total.join(squares)
        spread = F.col("n") * F.col("n") - F.col("v2")
    expected = spread / (F.col("n") * (F.col("n") - 1))
    return total.select(*by, F.when(expected != 0, 1 - (F.col("o") / F.col("n")) / expected).alias("alpha"))


def cohen_kappa(judgments: DataFrame, unit: str, value: str) -> DataFrame:
    """(annotator_a, annotator_b, n_shared, observed, kappa) for pairs with shared units; kappa null at certainty."""
    a = judgments.select(unit, F.col("annotator").alias("annotator_a"), F.col(value).alias("va"))
    b = judgments.select(unit, F.col("annotator").alias("annotator_b"), F.col(value).alias("vb"))
    pair = ["annotator_a", "annotator_b"]
    cells = a.join(b, unit).where("annotator_a < annotator_b").groupBy(*pair, "va", "vb").agg(F.count("*").alias("c"))
    n = cells.groupBy(*pair).agg(F.sum("c").alias("n_shared"), F.sum(F.when(F.col("va") == F.col("vb"), F.col("c")).otherwise(0)).alias("agree"))
    left = cells.groupBy(*pair, F.col("va").alias("v")).agg(F.sum("c").alias("ca"))
    right = cells.groupBy(*pair, F.col("vb").alias("v")).agg(F.sum("c").alias("cb"))
    chance = left.join(right, [*pair, "v"]).groupBy(*pair).agg(F.sum(F.col("ca") * F.col("cb")).alias("x"))
    po, pe = F.col("agree") / F.col("n_shared"), F.coalesce("x", F.lit(0)) / (F.col("n_shared") * F.col("n_shared"))
    return n.join(chance, pair, "left").select(*pair, "n_shared", po.alias("observed"), F.when(pe != 1, (po - pe) / (1 - pe)).alias("kappa"))


# ---------------------------------------------------------------- significance


FLIPS, DRAWS, SEED = 20_000, 10_000, 42


def _low_product(a: Column, b: Column) -> Column:
    """The low 32 bits of the product of two 32-bit numbers, without leaving 63 bits."""
    mask = F.lit(0xFFFFFFFF)
    low = a.bitwiseAND(F.lit(0xFFFF)) * b
    high = (F.shiftrightunsigned(a, 16) * b).bitwiseAND(F.lit(0xFFFF))
    return (low + high * F.lit(0x10000)).bitwiseAND(mask)


def seeded_draw(n: Column, seed: int) -> Column:
    """The n-th number (from 0) of the 32-bit generator mulberry32 with a seed, in 0..1.

    The generator's state is a counter, so every number of the one ordered stream
    can be made by itself, on any worker.
    """
    mask = F.lit(0xFFFFFFFF)
    # Fixed values of the generator: its step, and the shifts 15, 7 and 14 with the odd factors 1 and 61.
    step = (n + 1).bitwiseAND(mask)
    state = (_low_product(F.lit(0x6D2B79F5), step) + F.lit(seed & 0xFFFFFFFF)).bitwiseAND(mask)
    t = _low_product(state.bitwiseXOR(F.shiftrightunsigned(state, 15)), state.bitwiseOR(F.lit(1)))
    t = ((t + _low_product(t.bitwiseXOR(F.shiftrightunsigned(t, 7)), t.bitwiseOR(F.lit(61)))).bitwiseAND(mask)).bitwiseXOR(t)
    return t.bitwiseXOR(F.shiftrightunsigned(t, 14)) / F.lit(4294967296.0)


def paired_tests(diffs: DataFrame, flips: int = FLIPS, draws: int = DRAWS, seed: int = SEED) -> DataFrame:
    """(test, n, observed, low, high, p) of paired differences diffs(test, topic, d), tests in order.

    p is the share of sign flips with a mean at least as extreme, one added to
    both counts (1 if all differences are 0); low and high are the 95 percent
    percentile interval of the mean under resampling of topics.  All tests draw
    from one stream, test by test, flips before resamples, topics in order, so a
    published report can be repeated number by number.
    """
    topics = Window.partitionBy("test").orderBy("topic")
    own = diffs.select("test", (F.row_number().over(topics) - 1).alias("j"), F.col("d").cast("double").alias("d"))
    shape = own.groupBy("test").agg(F.count("*").alias("n"), F.avg("d").alias("observed"), F.max(F.abs("d")).alias("most"))
    used = F.col("n") * (F.when(F.col("most") == 0, 0).otherwise(flips) + F.lit(draws))
    before = Window.orderBy("test").rowsBetween(Window.unboundedPreceding, -1)  # a row per test
    shape = shape.withColumn("start", F.coalesce(F.sum(used).over(before), F.lit(0)))

    def each(rows: DataFrame, times: int, first: Column) -> DataFrame:
        """A row per test, draw and topic with its number of the stream."""
        spread = rows.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).repartition("test", "draw")
        spread = spread.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)))
        return spread.withColumn("u", seeded_draw(first + F.col("draw") * F.col("n") + F.col("i"), seed))

    flipped = each(shape.where("most > 0"), flips, F.col("start")).join(own.withColumnRenamed("j", "i"), ["test", "i"])
    means = flipped.groupBy("test", "draw", "n", "observed").agg((F.sum(F.when(F.col("u") < 0.5, F.col("d")).otherwise(-F.col("d"))) / F.col("n")).alias("mean"))
    extreme = means.groupBy("test").agg(F.count_if(F.abs("mean") >= F.abs("observed") - 1e-12).alias("extreme"))
    begin = F.col("start") + F.when(F.col("most") == 0, 0).otherwise(F.col("n") * flips)
    picked = each(shape, draws, begin).withColumn("j", F.floor(F.col("u") * F.col("n"))).join(own, ["test", "j"])
    sampled = picked.groupBy("test", "draw").agg((F.sum("d") / F.count("*")).alias("mean"))
    place = F.row_number().over(Window.partitionBy("test").orderBy("mean"))
    low, high = int(0.025 * draws) + 1, -int(-0.975 * draws // 1)
    ends = sampled.withColumn("place", place).groupBy("test").agg(
        F.max(F.when(F.col("place") == low, F.col("mean"))).alias("low"), F.max(F.when(F.col("place") == high, F.col("mean"))).alias("high")
    )
    p = F.when(F.col("most") == 0, 1.0).otherwise((F.col("extreme") + 1) / F.lit(flips + 1))
    return shape.join(ends, "test").join(extreme, "test", "left").select("test", "n", "observed", "low", "high", p.alias("p"))


def sign_flip_p(diffs: DataFrame, flips: int = FLIPS, seed: int = SEED) -> DataFrame:
    """(observed, p) of one test; diffs: topic, d."""
    return paired_tests(diffs.withColumn("test", F.lit(0)), flips, 1, seed).select("observed", "p")


def bootstrap_interval(diffs: DataFrame, draws: int = DRAWS, seed: int = SEED) -> DataFrame:
    """(low, high) of one test, whose resamples follow FLIPS sign flips in the stream; diffs: topic, d."""
    return paired_tests(diffs.withColumn("test", F.lit(0)), FLIPS, draws, seed).select("low", "high")


def positive_control(scored: DataFrame, stored: DataFrame, *by: str, within: float = 1e-9) -> DataFrame:
    """(by, metric, recomputed, stored, holds): means over the per-topic rows against aggregates stored with a run.

    stored: by, n_scored, mrr, recall, hit.  What does not hold means that the
    topics tested are not those the run was scored on.
    """
    names = ("n_scored", "mrr", "recall", "hit")
    pairs = lambda df: df.select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("x")) for c in names])).alias("z")).select(*by, "z.metric", "z.x")
    mine = pairs(run_metrics(scored.where("reason is null"), *by)).withColumnRenamed("x", "recomputed")
    both = mine.join(pairs(stored).withColumnRenamed("x", "stored"), [*by, "metric"], "full")
    return both.select(*by, "metric", "recomputed", "stored", F.coalesce(F.abs(F.col("recomputed") - F.col("stored")) <= within, F.lit(False)).alias("holds"))
