"""Citation tree: references, ranges and navigation.

sections: id, book, short (book.section), ord.  Books and sections are the two
levels of the tree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .relational import first_per


def reference_index(sections: DataFrame) -> DataFrame:
    """(ref, id, kind): books, full ids, and short references (the first section that has one)."""
    books = sections.select(F.col("book").cast("string").alias("ref")).distinct().select("ref", F.col("ref").alias("id"), F.lit("book").alias("kind"))
    full = sections.select(F.col("id").alias("ref"), "id", F.lit("section").alias("kind"))
    short = first_per(sections, ["short"], "ord").select(F.col("short").alias("ref"), "id", F.lit("section").alias("kind"))
    known = books.select("ref").unionByName(full.select("ref"))
    return books.unionByName(full).unionByName(short.join(known, "ref", "left_anti"))


def tree_statistics(sections: DataFrame) -> DataFrame:
    """One row: short references of several sections, sections that share one, and those that fall back to the full id."""
    groups = sections.groupBy("short").agg(F.count("*").alias("c"))
    shared = F.col("c") > 1
    total = lambda x, name: F.coalesce(F.sum(F.when(shared, x)), F.lit(0)).alias(name)
    return groups.agg(total(F.lit(1), "ambiguous"), total(F.col("c"), "colliding"), total(F.col("c") - 1, "fallbacks"))


def section_range(sections: DataFrame, start: str, end: str) -> DataFrame:
    """Sections from start to end in reading order, both included; a reversed range is turned round."""
    ends = sections.where(F.col("id").isin(start, end)).agg(F.min("ord").alias("lo"), F.max("ord").alias("hi"), F.count_distinct("id").alias("n"))
    rows = sections.join(F.broadcast(ends.where(F.col("n") == len({start, end}))), how="cross")
    return rows.where(F.col("ord").between(F.col("lo"), F.col("hi"))).drop("lo", "hi", "n")


def navigate(sections: DataFrame, ref: str | None = None, down: int | None = None) -> DataFrame:
    """(level, id, parent, ord) below or beside a reference.

    No reference: books (down 1) or everything (-1 or 2 and more).  A book with
    down other than 0: its sections.  down 0: siblings.  A section alone: itself.
    """
    if ref is None and down is None:
        raise ValueError("a reference or a depth is needed")
    book = F.col("book").cast("string")
    books = sections.groupBy(book.alias("id")).agg(F.min("ord").alias("ord")).select(
        F.lit(1).alias("level"), "id", F.lit(None).cast("string").alias("parent"), "ord"
    )
    leaves = sections.select(F.lit(2).alias("level"), "id", book.alias("parent"), "ord")
    if ref is None:
        return books if down == 1 else books.unionByName(leaves)
    index = reference_index(sections).where(F.col("ref") == ref)
    if down == 0:
        mine = F.broadcast(index.where("kind = 'section'").select("id")).join(leaves, "id").select(F.col("parent").alias("p"))
        beside = leaves.join(mine, leaves["parent"] == mine["p"], "left_semi")
        return beside.unionByName(books.join(index.where("kind = 'book'").select("kind"), how="cross").drop("kind"))
    is_book = index.where("kind = 'book'").select(F.col("id").alias("parent"))
    below = leaves.join(F.broadcast(is_book), "parent", "left_semi").select("level", "id", "parent", "ord")
    itself = leaves.join(F.broadcast(index.where("kind = 'section'").select("id")), "id", "left_semi").select("level", "id", "parent", "ord")
    if down is None:
        return itself.unionByName(books.join(F.broadcast(index.where("kind = 'book'").select("id")), "id", "left_semi").select("level", "id", "parent", "ord"))
    return below.unionByName(itself)
