"""The pipeline's stages on a small table, and the registered queries."""

from __future__ import annotations

import random

import corpus_pipeline
from lectern.llm import queries

from .helpers import DOC_SCHEMA, corpus, prose


def test_stages(spark, tmp_path):
    rng = random.Random(8)
    rows = corpus(n=60) + [(600 + i, " ".join(f"J{rng.randrange(9)}!!" for _ in range(90)), "aa", "s2", 0) for i in range(20)]
    rows += [(700 + i, prose(rng, 80), "bb", "s1", 0) for i in range(40)]
    spark.createDataFrame(rows, DOC_SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    marks = [(i, 1, 0) for i in range(60)] + [(600 + i, 0, 0) for i in range(20)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert len(corpus_pipeline.STAGES) in (4, 5)
    counts = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        counts.append(docs.count())
    ids = {r.doc_id for r in docs.collect()}
    assert not ids & set(range(600, 620)) and counts[0] < len(rows) and counts[2] < counts[1]
    assert sorted(map(tuple, docs.collect()), key=repr) == sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()), key=repr)


def test_stages_on_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], DOC_SCHEMA)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0


def test_stages_on_hostile_rows(spark, tmp_path):
    """A hot source, a large group of copies, a very long text, nulls everywhere and columns of any name."""
    from pyspark.sql import functions as F

    rng = random.Random(9)
    rows = [(i, prose(rng, 60), "aa", "hot" if i % 3 else f"s{i}", 0) for i in range(150)]
    rows += [(1000 + i, rows[1][1], "aa", "hot", 0) for i in range(120)] + [(2000, prose(rng, 60_000, 5000), "aa", "long", 0)]
    rows += [(None, None, None, None, None), (2001, "", None, None, None), (2002, None, "aa", "hot", None), (2003, " \n", "aa", None, 2), rows[0], rows[0]]
    extra = ("copy", "_copy", "gone", "n_lines", "n_removed", "own_id", "digest", "taken_doc_id", "least", "row", "h", "size")
    docs = spark.createDataFrame(rows, DOC_SCHEMA).select("*", *[F.lit(c).alias(c) for c in extra])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(30)] + [(None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert all(r[c] == c for r in docs.select(*extra).distinct().collect() for c in extra)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert last.count() == docs.count() > 50
    r = last.orderBy(F.desc("n_tokens")).first()
    assert len(r.ids) == r.n_tokens


def test_lines_of_any_length_go(spark):
    text = lambda i: f"own {i}\n\nAll rights  reserved.\n版权所有侵权必究\n"
    rows = [(i, text(i), "aa", f"s{i}", len(text(i))) for i in range(6)]
    got = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, spark.createDataFrame(rows, DOC_SCHEMA), "").collect()}
    assert got == {0: text(0)} | {i: f"own {i}\n\n" for i in range(1, 6)}


def test_near_copies_from_four_fifths(spark):
    a = [f"w{i}" for i in range(100)]
    b = [f"v{i}" if i in (30, 70) else w for i, w in enumerate(a)]
    p, q = ({tuple(x[i : i + 5]) for i in range(96)} for x in (a, b))
    assert 0.80 <= len(p & q) / len(p | q) < 0.85
    rows = [(i, " ".join(x), "aa", "s", 0) for i, x in enumerate((a, b))]
    got = corpus_pipeline.near_copies(spark, spark.createDataFrame(rows, DOC_SCHEMA), "").collect()
    assert [r.doc_id for r in got] == [0]


def test_one_query_per_operator():
    names = queries.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert set(queries.oracle_sql()) <= set(names)
