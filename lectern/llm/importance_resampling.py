"""Quality selection by importance resampling over hashed n-grams.

Words and word pairs are hashed into BUCKETS buckets.  Two multinomial models
are fitted: the target's (documents labelled good) and the raw text's (all
documents).  A document's log ratio is the sum over its n-grams of the log ratio
of the two.  The n-grams of one document are not independent draws, as the
product of the models would have it: a document's topic and language shift all
of them together, and in a long text the sum piles that up.  The sum is therefore
divided by the design effect 1 + (n - 1) r, where r, the correlation of n-grams
within a document, is estimated from the documents the target is fitted on; the
rule is the same for every length and size.  Gumbel noise is added to this log
weight and the documents with the k largest keys are the sample, which is
sampling without replacement by those weights.

k is not a share fixed in advance: it is the number of documents, counted over
all of them, whose log weight reaches the cut that best separates the labelled
documents that were not used for the fit.

Fitting uses at most ``max_labels`` labelled documents (those with the smallest
hash); everything else covers all documents.  Per-task counts are summed by
Spark; the k-th largest key is found by narrowing a histogram, never by a
global sort.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh, table, trimmed
from .wordhash import shingle_ids, words_of

BUCKETS = 10_000
#: Pseudo-counts per target n-gram, dealt like the raw text, that smooth the target's model.
SHRINK = 0.1
#: One labelled document in so many is kept from the fit, to place the cut.
HELD = 3
#: Weight of a good document lost against a bad one kept, in placing the cut.
GOOD_WEIGHT = 4.0
_BINS = 2000


def _buckets(words: np.ndarray) -> np.ndarray:
    """Buckets of all words and word pairs."""
    pairs = shingle_ids(words, 2) if len(words) > 1 else words[:0]
    return (np.concatenate((words, pairs)) % np.uint64(BUCKETS)).astype(np.int64)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """text -> one row of bucket counts per task."""
    total = np.zeros(BUCKETS, dtype=np.int64)
    for batch in batches:
        for _, offsets, words in words_of(batch["text"].tolist()):
            total += np.bincount((words % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
            if len(words) > 1:
                ids = (shingle_ids(words, 2) % np.uint64(BUCKETS)).astype(np.int64)
                inner = np.ones(len(ids), dtype=bool)  # pairs across two texts do not count
                cut = offsets[1:-1]
                inner[cut[(cut > 0) & (cut < len(words))] - 1] = False
                total += np.bincount(ids[inner], minlength=BUCKETS)
    if total.any():
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at.astype(np.int32), "n": total[at]})


def _model(texts: DataFrame) -> np.ndarray:
    rows = texts.select("text").mapInPandas(trimmed(_count), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS)  # BUCKETS rows at most
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Per bucket, the log ratio of the target's and the raw text's models; 0 without either."""
    if not target.sum() or not raw.sum():
        return np.zeros(BUCKETS)
    raw = raw + 1.0
    base = raw / raw.sum()
    prior = SHRINK * target.sum()
    return np.log((target + prior * base) / (target.sum() + prior)) - np.log(base)


def _weigh(ratio: np.ndarray):
    """text -> n (of n-grams), log_ratio and the sum of the squared log ratios."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n, total, squares = np.zeros(len(batch), np.int64), np.zeros(len(batch)), np.zeros(len(batch))
            for first, offsets, words in words_of(batch["text"].tolist()):
                for i in range(len(offsets) - 1):
                    own = words[offsets[i] : offsets[i + 1]]
                    if len(own):
                        found = ratio[_buckets(own)]
                        n[first + i], total[first + i], squares[first + i] = len(found), found.sum(), found @ found
            yield batch.drop(columns="text").assign(n=n, log_ratio=total, squares=squares)

    return run


def correlation(weighed: DataFrame) -> float:
    """Correlation within documents (analysis of variance) of the log ratios; 0 without two documents of n-grams."""
    n, s = F.col("n"), F.col("log_ratio")
    sums = [F.count("*"), F.sum(n), F.sum(n * n), F.sum(s), F.sum("squares"), F.sum(s * s / n)]
    k, grams, n2, total, squares, between = (float(x or 0) for x in weighed.where("n > 0").agg(*sums).first())
    if k < 2 or grams <= k:
        return 0.0
    size = (grams - n2 / grams) / (k - 1)
    among = (between - total * total / grams) / (k - 1)
    within = (squares - between) / (grams - k)
    whole = among + (size - 1) * within
    return max(0.0, (among - within) / whole) if whole > 0 else 0.0


def gumbel(*parts: Column, seed: int) -> Column:
    """Standard Gumbel noise from a hash of the columns."""
    u = (F.shiftrightunsigned(F.xxhash64(*parts, F.lit(seed)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return -F.log(-F.log(u))


def kth_largest(values: DataFrame, name: str, k: int) -> float:
    """The k-th largest value of a written table's column, by narrowing a histogram.

    Every round counts at most _BINS bins of the interval that holds it; ties end
    the search once the interval holds one value.
    """
    if k <= 0:
        return float("inf")
    lo, hi = values.agg(F.min(name), F.max(name)).first()
    while lo < hi:  # both ends are values, in different bins, so every round leaves fewer values
        inside = values.where((F.col(name) >= lo) & (F.col(name) <= hi))
        bin_ = F.least(F.floor((F.col(name) - lo) / (hi - lo) * _BINS), F.lit(_BINS - 1)).cast("int")
        rows = inside.groupBy(bin_.alias("b")).agg(F.count("*").alias("n"), F.min(name).alias("lo"), F.max(name).alias("hi")).collect()
        above = values.where(F.col(name) > hi).count()
        for r in sorted(rows, key=lambda r: -r["b"]):
            if above + r["n"] >= k:
                lo, hi = r["lo"], r["hi"]
                break
            above += r["n"]
    return float(lo)


def best_cut(good: np.ndarray, bad: np.ndarray) -> float:
    """The cut with the least weighted share of good values below it plus share of bad values at or above it."""
    if not len(good) or not len(bad):
        return float("-inf")
    values = np.unique(np.concatenate((good, bad)))
    cuts = np.concatenate(([values[0] - 1], (values[1:] + values[:-1]) / 2))
    good, bad = np.sort(good), np.sort(bad)
    loss = GOOD_WEIGHT * np.searchsorted(good, cuts) / len(good) + 1 - np.searchsorted(bad, cuts) / len(bad)
    return float(cuts[int(loss.argmin())])


def resample(docs: DataFrame, labels: DataFrame, max_labels: int = 20_000, seed: int = 11) -> DataFrame:
    """One row per row of docs: doc_id, log_ratio, log_weight, gumbel_key, kept.

    labels: doc_id, quality (1 is good) and toxic (1 is never target).  Without
    both good and bad labelled documents nothing can be told apart and all rows
    are kept.  A null or empty text has log ratio and weight 0, as the empty product.
    Rows that repeat doc_id and text share one key and are kept or dropped
    together; rows without a doc_id draw by their text.  Labels of unknown
    documents and null labels are ignored, of repeated labels the lowest quality
    counts.  An empty table gives an empty result; further columns are ignored.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marks = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
        .orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(max_labels)
    )  # at most max_labels rows
    marks = table(marks, "labels")
    labelled = table(own.join(F.broadcast(marks), "doc_id"), "labelled")
    held = F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(HELD)) == 0
    fitted = (F.col("quality") == 1) & (F.col("toxic") == 0) & ~held
    ratio = log_ratio(_model(labelled.where(fitted)), _model(own))
    measured = table(
        own.withColumn("h", F.xxhash64("text")).mapInPandas(
            trimmed(_weigh(ratio)), "doc_id long, h long, n long, log_ratio double, squares double"
        ),
        "weights",
    )
    share = correlation(measured.join(F.broadcast(marks), "doc_id").where(fitted))
    effect = 1 + F.greatest(F.col("n") - 1, F.lit(0)) * F.lit(share)
    weighed = measured.select("doc_id", "h", "log_ratio", (F.col("log_ratio") / effect).alias("log_weight"))
    known = weighed.join(F.broadcast(marks), "doc_id").where(held).select("quality", "log_weight").toPandas()
    cut = best_cut(known.log_weight[known.quality == 1].to_numpy(), known.log_weight[known.quality != 1].to_numpy())
    k = weighed.where(F.col("log_weight") >= cut).count()
    keyed = weighed.withColumn("gumbel_key", F.col("log_weight") + gumbel(F.col("doc_id"), F.col("h"), seed=seed))
    threshold = kth_largest(keyed, "gumbel_key", k)
    return keyed.select("doc_id", "log_ratio", "log_weight", "gumbel_key", (F.col("gumbel_key") >= threshold).alias("kept"), "h")


def selected(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that the sample holds, with their columns."""
    own, digest = fresh(docs.columns, "own_id", "digest")
    gone = resample(docs, labels, **options).where("not kept").select(F.col("doc_id").alias(own), F.col("h").alias(digest)).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(own)) & (F.xxhash64(F.col("text").cast("string")) == F.col(digest))
    return docs.join(gone, same, "left_anti")
