"""Readers: line-JSON tables, corpora, marked-up documents, workbooks, vectors, triples.

All tables are read by Spark's readers with stated schemas; Python parses only
what has mixed content or order that SQL cannot express, in Arrow batches.
"""

from __future__ import annotations

import base64
import io
import re
import unicodedata
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A line-JSON table; blank lines are skipped, nothing is inferred."""
    return spark.read.schema(schema).json(path)


def read_json_directory(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document per file, with its file name for ordering."""
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("file", F.input_file_name())


def corpus(original: DataFrame, translated: DataFrame | None) -> DataFrame:
    """Sections with their translation (null where there is none, or no table of them)."""
    if translated is None:
        return original.withColumn("text_en", F.lit(None).cast("string"))
    return original.join(translated.select("id", "text_en"), "id", "left")


def parse_batch(lines: DataFrame, fields: str, key: str, defaults: dict[str, str] | None = None) -> DataFrame:
    """Rows of JSON lines (value); # comments, blanks and rows without the key go; gaps get defaults."""
    rows = lines.where(F.trim("value") != "").where(~F.ltrim("value").startswith("#"))
    flat = rows.select(F.from_json("value", fields).alias("r")).select("r.*")
    for c, v in (defaults or {}).items():
        flat = flat.withColumn(c, F.coalesce(c, F.lit(v)))
    return flat.where(F.col(key).isNotNull() & (F.col(key) != ""))


def parsed_lines(lines: DataFrame, fields: str, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(good, bad) rows of (line_no, value): bad ones carry the first rule they break, or 'invalid JSON'."""
    flat = lines.where(F.trim("value") != "").withColumn("ok", F.expr("try_parse_json(value) is not null")).withColumn("r", F.from_json("value", fields)).select("line_no", "ok", "r.*")
    error = F.when(~F.col("ok"), "invalid JSON")
    for text, holds in rules.items():
        error = error.when(~F.coalesce(holds, F.lit(False)), text)
    checked = flat.withColumn("error", error)
    return checked.where("error is null").drop("ok", "error"), checked.where("error is not null").select("line_no", "error")


# ---------------------------------------------------------------- marked-up text


def _fragments(element: ET.Element, drop: frozenset[str]) -> Iterator[str]:
    """Text depth first; a dropped element goes, what follows it stays."""
    if element.text:
        yield element.text
    for child in element:
        if child.tag.rpartition("}")[2] not in drop:
            yield from _fragments(child, drop)
        if child.tail:
            yield child.tail


def flattened(element: ET.Element, drop: frozenset[str] = frozenset({"note"})) -> str:
    """Fragments with white space collapsed each, joined by one blank, empty ones left out."""
    parts = (" ".join(f.split()) for f in _fragments(element, drop))
    return unicodedata.normalize("NFC", " ".join(p for p in parts if p))


def tei_sections(documents: DataFrame, drop: tuple[str, ...] = ("note",)) -> DataFrame:
    """(doc, id, book, chapter, section, text, ord) of documents(doc, xml): body div > book > chapter > section by @n."""
    gone = frozenset(drop)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, xml in zip(batch["doc"], batch["xml"], strict=True):
                if not xml:
                    continue
                order = 0
                for book, chapter, element in _tei_walk(ET.fromstring(xml)):
                    n = element.get("n")
                    rows.append((doc, f"{book}.{chapter}.{n}", book, chapter, n, flattened(element, gone), order))
                    order += 1
            yield pd.DataFrame(rows, columns=["doc", "id", "book", "chapter", "section", "text", "ord"])

    return documents.select("doc", "xml").mapInPandas(run, "doc string, id string, book string, chapter string, section string, text string, ord int")


def _tei_walk(root: ET.Element) -> Iterator[tuple[str, str, ET.Element]]:
    part = lambda e: e.get("subtype") or e.get("type")
    tag = lambda e: e.tag.rpartition("}")[2]
    for book in (e for e in root.iter() if tag(e) == "div" and part(e) == "book"):
        for chapter in (e for e in book.iter() if tag(e) == "div" and part(e) == "chapter"):
            for section in (e for e in chapter.iter() if tag(e) == "div" and part(e) == "section"):
                yield book.get("n"), chapter.get("n"), section


def with_metadata(sections: DataFrame, meta: DataFrame) -> DataFrame:
    """Sections with their chapter's metadata; an unknown chapter is an error."""
    out = sections.join(F.broadcast(meta.withColumn("_k", F.lit(True))), ["book", "chapter"], "left")
    known = F.assert_true(F.col("_k"), F.concat(F.lit("unknown chapter "), "book", F.lit("."), "chapter"))
    return out.withColumn("_c", known).where("_c is null").drop("_k", "_c")


def tei_quotes(documents: DataFrame) -> DataFrame:
    """(doc, section, pos, lines, source): block quotes outside notes, split at <l>, with a note directly before as source."""

    def quotes(element: ET.Element) -> Iterator[tuple[list[str], str | None]]:
        before = None
        for child in element:
            name = child.tag.rpartition("}")[2]
            if name == "quote":
                own = [flattened(x) for x in child.iter() if x.tag.rpartition("}")[2] == "l"]
                yield [x for x in own if x] or [flattened(child)], before
            elif name != "note":
                yield from quotes(child)
            before = flattened(child, frozenset()) if name == "note" and not (child.tail or "").strip() else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, xml in zip(batch["doc"], batch["xml"], strict=True):
                for book, chapter, element in _tei_walk(ET.fromstring(xml)) if xml else ():
                    for pos, (lines, source) in enumerate(quotes(element)):
                        rows.append((doc, f"{book}.{chapter}.{element.get('n')}", pos, lines, source))
            yield pd.DataFrame(rows, columns=["doc", "section", "pos", "lines", "source"])

    return documents.select("doc", "xml").mapInPandas(run, "doc string, section string, pos int, lines array<string>, source string")


def aligned(left: DataFrame, right: DataFrame) -> DataFrame:
    """left(section, pos, lines) with right's lines at the same place, if the section has equally many on both sides."""
    n = lambda df, name: df.groupBy("section").agg(F.count("*").alias(name))
    same = n(left, "a").join(n(right, "b"), "section").where("a = b").select("section")
    other = right.join(same, "section", "left_semi").select("section", "pos", F.col("lines").alias("translated"))
    return left.join(other, ["section", "pos"], "left")


def html_text(html: Column) -> Column:
    """Visible text of a page by expressions alone: scripts, styles, comments and tags off, entities decoded, blanks collapsed."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


# ---------------------------------------------------------------- references


_ROMAN = r"^[IVXLC]+$"


def roman_value(token: Column) -> Column:
    """Value of a Roman numeral of I, V, X, L, C."""
    digit = lambda c: F.when(c == "I", 1).when(c == "V", 5).when(c == "X", 10).when(c == "L", 50).when(c == "C", 100).otherwise(0)
    digits = F.transform(F.split(token, ""), digit)
    signed = F.transform(digits, lambda d, i: F.when(d < F.coalesce(F.get(digits, i + 1), F.lit(0)), -d).otherwise(d))
    return F.aggregate(signed, F.lit(0), lambda a, x: a + x)


def parse_refs(raw: Column) -> Column:
    """struct<refs, clean> of 'II 5, 7; III 12': a numeral sets the book that bare numbers inherit; other tokens unset clean."""
    parts = F.filter(F.split(raw, r"[\s,;]+"), lambda t: t != "")
    zero = F.struct(F.lit(0).alias("book"), F.array().cast("array<string>").alias("refs"), F.lit(True).alias("clean"))

    def step(acc: Column, t: Column) -> Column:
        number = F.when(acc["book"] > 0, F.concat(acc["book"].cast("string"), F.lit("."), t))
        return (
            F.when(t.rlike(_ROMAN), F.struct(roman_value(t).alias("book"), acc["refs"].alias("refs"), acc["clean"].alias("clean")))
            .when(t.rlike(r"^\d+[a-z]?$") & number.isNotNull(), F.struct(acc["book"].alias("book"), F.array_append(acc["refs"], number).alias("refs"), acc["clean"].alias("clean")))
            .otherwise(F.struct(acc["book"].alias("book"), acc["refs"].alias("refs"), F.lit(False).alias("clean")))
        )

    done = F.aggregate(parts, zero, step)
    return F.struct(F.array_distinct(done["refs"]).alias("refs"), done["clean"].alias("clean"))


# ---------------------------------------------------------------- workbooks, vectors, triples


def read_workbook(spark: SparkSession, path: str, header: list[str] | None = None) -> DataFrame:
    """(sheet, row, cells) of workbooks: a map of column name to text per row; another header is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                yield pd.DataFrame(list(_workbook_rows(content, header)), columns=["sheet", "row", "cells"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(run, "sheet string, row int, cells map<string,string>")


def _workbook_rows(content: bytes, header: list[str] | None) -> Iterator[tuple[str, int, dict[str, str]]]:
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        strings = []
        if "xl/sharedStrings.xml" in z.namelist():
            strings = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iterfind("m:si", ns)]
        for name in sorted(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n)):
            titles: dict[str, str] = {}
            for i, row in enumerate(ET.fromstring(z.read(name)).iterfind(".//m:row", ns)):
                cells = {}
                for c in row.iterfind("m:c", ns):
                    value = c.findtext("m:v", None, ns)
                    text = strings[int(value)] if c.get("t") == "s" and value else "".join(t.text or "" for t in c.iter(f"{{{ns['m']}}}t")) or value or ""
                    cells[re.sub(r"\d", "", c.get("r", ""))] = text.strip()
                if not titles:
                    titles = cells
                    if header is not None and list(titles.values()) != header:
                        raise ValueError(f"{name}: header {list(titles.values())} is not {header}")
                else:
                    yield name.rsplit("/", 1)[1][:-4], i, {t: cells.get(k, "") for k, t in titles.items()}


def read_vector_blob(rows: DataFrame, dim: int, model: str | None = None) -> DataFrame:
    """(id, v) of rows(model, dim, ids, blob): base64 float32, one block per row; empty if anything does not fit.

    A mismatch of model, dimension or length means there is no index, not an error.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for m, d, ids, blob in zip(batch["model"], batch["dim"], batch["ids"], batch["blob"], strict=True):
                raw = base64.b64decode(blob)
                if d != dim or (model is not None and m != model) or len(raw) != 4 * dim * len(ids):
                    continue
                yield pd.DataFrame({"id": list(ids), "v": list(np.frombuffer(raw, dtype="<f4").reshape(len(ids), dim))})

    return rows.select("model", "dim", "ids", "blob").mapInPandas(run, "id string, v array<float>")


def embedded(sections: DataFrame, encode: Callable[[list[str]], np.ndarray], prefix: str = "passage: ", words: int = 400, batch: int = 32) -> DataFrame:
    """(id, v): unit vectors of sections(id, header, body) by an encoder given as a function of a list of texts.

    A text is prefix, header and body, cut to so many words, as the model reads no
    more; the encoder is called in the workers with batches.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for lo in range(0, len(part), batch):
                own = part.iloc[lo : lo + batch]
                v = np.asarray(encode(own["text"].tolist()), dtype=np.float32)
                norm = np.linalg.norm(v, axis=1, keepdims=True)
                yield pd.DataFrame({"id": own["id"], "v": list(v / np.where(norm == 0, 1, norm))})

    body = F.array_join(F.slice(F.split(F.trim(F.concat_ws(" ", "header", "body")), r"\s+"), 1, words), " ")
    return sections.select("id", F.concat(F.lit(prefix), body).alias("text")).mapInPandas(run, f"id {dict(sections.dtypes)['id']}, v array<float>")


def merge_parts(parts: DataFrame) -> DataFrame:
    """parts(start, end, model, dim) in order, after a check that they meet without a gap and agree."""
    from pyspark.sql import Window

    order = Window.orderBy("start")  # a row per part file
    gap = F.coalesce(F.lag("end").over(order) == F.col("start"), F.col("start") == 0)
    same = (F.min("model").over(Window.partitionBy()) == F.max("model").over(Window.partitionBy())) & (F.min("dim").over(Window.partitionBy()) == F.max("dim").over(Window.partitionBy()))
    checked = parts.withColumn("ok", gap & same)
    return checked.withColumn("_c", F.assert_true("ok", F.lit("parts do not meet or differ"))).where("_c is null").drop("ok", "_c")


# Possessive, so that a long literal needs no stack.
_NT = r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(?:<([^>]*)>|(_:\S+)|"([^"\\]*+(?:\\.[^"\\]*+)*+)"(?:@([A-Za-z0-9-]+)|\^\^<([^>]*)>)?)\s*\.\s*(?:#.*)?$'


def unescaped(text: Column) -> Column:
    """Escapes of N-Triples undone in one pass.

    Escaped backslashes are the places where the text is split first, so no other
    escape is ever looked for across them.
    """

    def unicode(part: Column) -> Column:
        short = F.concat(F.decode(F.unhex(F.substring(part, 3, 4)), "UTF-16BE"), F.substring(part, F.lit(7), F.length(part)))
        long = F.concat(F.decode(F.unhex(F.substring(part, 3, 8)), "UTF-32"), F.substring(part, F.lit(11), F.length(part)))
        return F.when(part.startswith("\\u"), short).when(part.startswith("\\U"), long).otherwise(part)

    def plain(part: Column) -> Column:
        for escape, char in (("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\\b", "\b"), ("\\f", "\f"), ('\\"', '"'), ("\\'", "'")):
            part = F.replace(part, F.lit(escape), F.lit(char))
        return part

    def piece(part: Column) -> Column:
        cut = F.split(part, r"(?=\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})")
        return F.array_join(F.transform(cut, lambda x: plain(unicode(x))), "")

    whole = F.array_join(F.transform(F.split(text, r"\\\\"), piece), "\\")
    return F.when(text.contains("\\"), whole).otherwise(text)


def read_ntriples(lines: DataFrame) -> DataFrame:
    """(s, s_kind, p, o, o_kind, lang, datatype) of N-Triples lines (value), as a set; comments and blanks go.

    Lines that are none of these are left to rejected_lines.
    """
    g = lambda i: F.regexp_extract("value", _NT, i)
    literal = F.col("value").rlike(r'^\s*\S+\s+<[^>]*>\s+"')
    rows = lines.where(F.col("value").rlike(_NT))
    return rows.select(
        unescaped(F.regexp_replace(g(1), "^<|>$", "")).alias("s"),
        F.when(g(1).startswith("_:"), "bnode").otherwise("iri").alias("s_kind"), unescaped(g(2)).alias("p"),
        F.when(literal, unescaped(g(5))).when(g(4) != "", g(4)).otherwise(unescaped(g(3))).alias("o"),
        F.when(literal, "literal").when(g(4) != "", "bnode").otherwise("iri").alias("o_kind"),
        F.nullif(g(6), F.lit("")).alias("lang"), F.nullif(unescaped(g(7)), F.lit("")).alias("datatype"),
    ).distinct()


def rejected_lines(lines: DataFrame) -> DataFrame:
    """Lines (value) that are neither statements, comments nor blank."""
    return lines.where(F.col("value").isNotNull() & ~F.col("value").rlike(_NT) & ~F.col("value").rlike(r"^\s*(#.*)?$"))


def read_prefixes(text: str) -> dict[str, str]:
    """Prefix table of a document's header."""
    return dict(re.findall(r"(?m)^\s*@prefix\s+([\w-]*):\s*<([^>]*)>\s*\.", text))
