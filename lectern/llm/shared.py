"""Helpers of the training-data operators: shared tables, row access, components."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none (tests in local mode) a temporary folder
    is set instead.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    found = "file://" + tempfile.mkdtemp(prefix="lectern-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def table(df: DataFrame, name: str) -> DataFrame:
    """Writes df once as Parquet to the shared folder and reads it back.

    It cuts the lineage, survives the loss of executors and can be pruned by
    column, which a checkpoint of rows cannot.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._lectern_path = path
    return out


def drop_table(df: DataFrame) -> None:
    """Deletes a table made by table() whose rows nothing will read again."""
    path = getattr(df, "_lectern_path", None)
    if path:
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as keep it apart from the columns taken (in any case)."""
    low = {c.lower() for c in taken}
    out = []
    for name in names:
        while name.lower() in low:
            name = f"_{name}"
        low.add(name.lower())
        out.append(name)
    return out


def groups(
    batches: Iterator[pd.DataFrame], keys: list[str]
) -> Iterator[pd.DataFrame]:
    """Whole groups out of batches that are sorted by keys; a group may span batches."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        change = (batch[keys].values[1:] != batch[keys].values[:-1]).any(axis=1).nonzero()[0] + 1
        bounds = [0, *change.tolist(), len(batch)]
        for a, b in zip(bounds, bounds[1:], strict=False):
            part = batch.iloc[a:b]
            if held and a == 0 and (held[-1][keys].values[-1] == part[keys].values[0]).all():
                held.append(part)
                continue
            if held:
                yield held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)
            held = [part]
    if held:
        yield held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)


def _give_back() -> None:
    """Returns freed memory to the system, which a worker that waits for its next task would keep."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU C library
        pass


Batches = Iterator[pd.DataFrame]


def trimmed(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """The same function over batches; its worker gives memory back at the end of the task."""

    @functools.wraps(run)
    def out(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            _give_back()

    return out


class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over undirected edges (a, b).

    Alternating large-star and small-star rounds: every round is two
    aggregations and two equi-joins, the number of rounds follows the logarithm
    of the largest component, and no neighbour list is ever collected, so a hub
    of any degree is harmless.  Ids without an edge are absent.  Rounds are
    written to the shared folder.
    """
    state = table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    mark = None
    while True:
        both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # every edge now points from a node to a smaller one
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(low.select("a", F.col("m").alias("b")))
            .where("a <> b")
            .distinct()
        )
        new = table(small, "cc")
        got = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop_table(state)
        state = new
        if got == mark:
            return state.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
                state.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
            )
        mark = got
