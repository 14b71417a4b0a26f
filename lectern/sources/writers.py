"""Serialisers: N-Triples and Turtle lines, JSON-LD, RDF/XML, TEI, snapshots, manifests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import turtle_escape, xml_escape


def term(value: Column, kind: Column, lang: Column, datatype: Column) -> Column:
    """One term in N-Triples syntax."""
    quoted = F.concat(F.lit('"'), turtle_escape(value), F.lit('"'))
    typed = F.when(lang.isNotNull(), F.concat(quoted, F.lit("@"), lang)).when(datatype.isNotNull(), F.concat(quoted, F.lit("^^<"), datatype, F.lit(">"))).otherwise(quoted)
    return F.when(kind == "literal", typed).when(kind == "bnode", value).otherwise(F.concat(F.lit("<"), value, F.lit(">")))


def ntriples(graph: DataFrame) -> DataFrame:
    """(line): one statement per line, also valid Turtle."""
    o = term(F.col("o"), F.col("o_kind"), F.col("lang"), F.col("datatype"))
    subject = F.when(F.startswith("s", F.lit("_:")), F.col("s")).otherwise(F.concat(F.lit("<"), "s", F.lit(">")))
    return graph.select(F.concat(subject, F.lit(" <"), "p", F.lit("> "), o, F.lit(" .")).alias("line")).distinct()


def compacted(line: Column, prefixes: dict[str, str]) -> Column:
    """A statement with <namespace + name> written as prefix:name, longest namespace first."""
    for name, start in sorted(prefixes.items(), key=lambda x: -len(x[1])):
        line = F.regexp_replace(line, "<" + "".join("\\" + c if c in r".?+*()[]{}|^$\\" else c for c in start) + r"([A-Za-z_][\w-]*)>", f"{name}:$1")
    return line


def json_ld(graph: DataFrame) -> DataFrame:
    """(s, json): one node object per subject; values per predicate in order."""
    value = F.when(F.col("o_kind") == "literal", F.to_json(F.struct(F.col("o").alias("@value"), F.col("lang").alias("@language"), F.col("datatype").alias("@type")))).otherwise(
        F.to_json(F.struct(F.col("o").alias("@id")))
    )
    per = graph.distinct().groupBy("s", "p").agg(F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_list(value)), ","), F.lit("]")).alias("v"))
    key = F.regexp_replace(F.to_json(F.struct(F.col("p").alias("k"))), r'^\{"k":|\}$', "")
    subject = F.regexp_replace(F.to_json(F.struct(F.col("s").alias("k"))), r'^\{"k":|\}$', "")
    rows = per.groupBy("s").agg(F.array_join(F.sort_array(F.collect_list(F.concat(key, F.lit(":"), "v"))), ",").alias("body"))
    return rows.select("s", F.concat(F.lit('{"@id":'), subject, F.lit(","), "body", F.lit("}")).alias("json"))


def rdf_xml(graph: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """(s, xml): one description per subject; a predicate that no namespace covers is an error."""
    name = F.lit(None).cast("string")
    for prefix, start in sorted(prefixes.items(), key=lambda x: len(x[1])):
        rest = F.substring("p", F.lit(len(start) + 1), F.length("p"))
        name = F.when(F.startswith("p", F.lit(start)) & rest.rlike(r"^[A-Za-z_][\w.-]*$"), F.concat(F.lit(f"{prefix}:"), rest)).otherwise(name)
    name = F.coalesce(name, F.raise_error(F.concat(F.lit("no qualified name for "), "p")).cast("string"))
    lang = F.when(F.col("lang").isNotNull(), F.concat(F.lit(' xml:lang="'), "lang", F.lit('"'))).when(F.col("datatype").isNotNull(), F.concat(F.lit(' rdf:datatype="'), "datatype", F.lit('"'))).otherwise("")
    literal = F.concat(F.lit("<"), "q", lang, F.lit(">"), xml_escape(F.col("o")), F.lit("</"), "q", F.lit(">"))
    link = F.concat(F.lit("<"), "q", F.lit(' rdf:resource="'), xml_escape(F.col("o")), F.lit('"/>'))
    rows = graph.distinct().withColumn("q", name).withColumn("e", F.when(F.col("o_kind") == "literal", literal).otherwise(link))
    per = rows.groupBy("s").agg(F.array_join(F.sort_array(F.collect_list("e")), "").alias("body"))
    return per.select("s", F.concat(F.lit('<rdf:Description rdf:about="'), xml_escape(F.col("s")), F.lit('">'), "body", F.lit("</rdf:Description>")).alias("xml"))


def passage_triples(sections: DataFrame, spans: DataFrame, base: str) -> DataFrame:
    """Passages (type, label, text, citation) and their stand-off annotations as triples: one row becomes several."""
    iri = lambda *c: F.concat(F.lit(base), *c)
    t = lambda s, p, o, kind="iri", lang=None: F.struct(s.alias("s"), F.lit(p).alias("p"), o.cast("string").alias("o"), F.lit(kind).alias("o_kind"), F.lit(lang).cast("string").alias("lang"), F.lit(None).cast("string").alias("datatype"))
    at = iri(F.lit("passage/"), F.col("id").cast("string"))
    passage = F.array(
        t(at, "type", F.lit(base + "Passage")), t(at, "label", F.col("label"), "literal", "en"), t(at, "text", F.col("text"), "literal"),
        t(at, "citation", F.col("id"), "literal"), t(at, "life", iri(F.lit("life/"), F.col("owner"))),
    )
    note = iri(F.lit("annotation/"), F.concat_ws("-", F.col("id").cast("string"), F.col("start").cast("string")))
    annotation = F.array(
        t(note, "type", F.lit(base + "Annotation")), t(note, "body", iri(F.lit("entity/"), F.col("entity"))), t(note, "target", at),
        t(note, "start", F.col("start"), "literal"), t(note, "end", F.col("end"), "literal"), t(note, "exact", F.col("surface"), "literal"),
    )
    rows = sections.select(F.explode(passage).alias("t")).select("t.*")
    return rows.unionByName(spans.select(F.explode(annotation).alias("t")).select("t.*"))


def section_subgraph(graph: DataFrame, seeds: DataFrame) -> DataFrame:
    """Triples of the seeds (s) and one hop of the nodes they refer to."""
    own = graph.join(seeds.distinct(), "s", "left_semi")
    hop = graph.join(own.where("o_kind <> 'literal'").select(F.col("o").alias("s")).distinct().join(seeds, "s", "left_anti"), "s", "left_semi")
    return own.select(*graph.columns).unionByName(hop.select(*graph.columns))


def _tei_parts(sections: DataFrame) -> DataFrame:
    """(o, book, x): one element per book, its sections in order, escaped."""
    item = F.concat(F.lit('<div type="section" n="'), xml_escape(F.col("id").cast("string")), F.lit('"><p>'), xml_escape(F.coalesce("text", F.lit(""))), F.lit("</p></div>"))
    books = sections.groupBy("book").agg(F.min("ord").alias("o"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", item.alias("x")))), lambda z: z["x"]), "").alias("b"))
    return books.select("o", "book", F.concat(F.lit('<div type="book" n="'), F.col("book").cast("string"), F.lit('">'), "b", F.lit("</div>")).alias("x"))


def _tei(title: str, body: Column) -> Column:
    return F.concat(F.lit(f"<TEI><teiHeader><title>{title}</title></teiHeader><text><body>"), body, F.lit("</body></text></TEI>")).alias("xml")


def tei_books(sections: DataFrame, title: str) -> DataFrame:
    """(book, xml): a document per book, so a collection of any size is written in parallel."""
    return _tei_parts(sections).select("book", _tei(title, F.col("x")))


def tei_document(sections: DataFrame, title: str) -> DataFrame:
    """One row (xml): books in order in one document; for a section, a range or a book, not for a large collection."""
    whole = _tei_parts(sections).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o", "x"))), lambda z: z["x"]), "").alias("all"))
    return whole.select(_tei(title, F.col("all")))


def snapshot_lines(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(ord, line): canonical JSON, keys in the given order, nulls left out."""
    return rows.select("ord", F.to_json(F.struct(*columns)).alias("line"))


def snapshot_hash(lines: DataFrame) -> DataFrame:
    """(sha256, n) of all lines in order, joined by newlines.

    One hash over one body is sequential by definition: the sorted lines stream
    through one task, which holds a batch of them and never the body.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, n = hashlib.sha256(), 0
        for batch in batches:
            for line in batch.column("line").to_pylist():
                digest.update(b"\n" if n else b"")
                digest.update((line or "").encode())
                n += 1
        yield pa.RecordBatch.from_pydict({"sha256": [digest.hexdigest()], "n": [n]})

    rows = lines.where("line is not null").select("ord", "line").repartition(1).sortWithinPartitions("ord", "line")
    return rows.mapInArrow(run, "sha256 string, n long")


def write_dataset(df: DataFrame, path: str) -> DataFrame:
    """Writes Parquet and returns a one-row manifest (rows, files, bytes, digest); an empty output is an error.

    The digest is order-free: the sum of row hashes, so it is made in parallel.
    """
    df.write.mode("overwrite").parquet(path)
    back = df.sparkSession.read.parquet(path)
    sums = back.agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*back.columns).cast("decimal(38,0)")).cast("string").alias("digest")).withColumn(
        "_c", F.assert_true(F.col("rows") > 0, F.lit("nothing was written"))
    )
    files = df.sparkSession.read.format("binaryFile").load(f"{path}/*.parquet").select("length").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
    return sums.where("_c is null").drop("_c").join(F.broadcast(files), how="cross")
