"""What a published collection says about itself: entry point, collection, data set descriptions, shapes, sitemap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import xml_escape

# Contexts, namespaces and versions of the formats.
DTS_CONTEXT, DTS_VERSION = "https://distributed-text-services.github.io/specifications/context/1-alpha1.json", "1-alpha"
PREFIXES = {
    "void": "http://rdfs.org/ns/void#", "dcterms": "http://purl.org/dc/terms/", "dcat": "http://www.w3.org/ns/dcat#", "sh": "http://www.w3.org/ns/shacl#",
    "owl": "http://www.w3.org/2002/07/owl#", "skos": "http://www.w3.org/2004/02/skos/core#", "xsd": "http://www.w3.org/2001/XMLSchema#",
}


def _templates(base: str) -> dict[str, str]:
    return {
        "collection": f"{base}/collection{{?id,page,nav}}", "navigation": f"{base}/navigation{{?resource,ref,start,end,down,tree,page}}",
        "document": f"{base}/document{{?resource,ref,start,end,tree,mediaType}}",
    }


def entry_point(base: str) -> dict:
    """The entry point of a text service with its three request templates."""
    return {"@context": DTS_CONTEXT, "dtsVersion": DTS_VERSION, "@id": f"{base}/", "@type": "EntryPoint", **_templates(base)}


def collection(base: str, works: list[dict], title: str, id: str | None = None) -> dict | None:
    """The root collection with its resources, or one resource by id; None for an unknown id.

    works: dicts of id, title, and what else a resource says.
    """
    resources = {w["id"]: {"@id": w["id"], "@type": "Resource", "totalParents": 1, "totalChildren": 0, **{k: v for k, v in w.items() if k != "id"}, **_templates(base)} for w in works}
    head = {"@context": DTS_CONTEXT, "dtsVersion": DTS_VERSION}
    if id not in (None, "", "root", "general"):
        return head | resources[id] if id in resources else None
    return head | {
        "@id": "root", "@type": "Collection", "title": title, "totalParents": 0, "totalChildren": len(resources),
        "collection": _templates(base)["collection"], "member": list(resources.values()),
    }


def sitemap(paths: DataFrame, base: str) -> DataFrame:
    """(ord, line) of a sitemap of paths(ord, path, lastmod): a line per address, head and foot around them.

    Lines are made in parallel; '/' is the base itself.
    """
    address = F.concat(F.lit(base.rstrip("/")), F.col("path"))
    line = F.concat(F.lit("  <url><loc>"), xml_escape(address), F.lit("</loc>"), F.coalesce(F.concat(F.lit("<lastmod>"), F.col("lastmod").cast("string"), F.lit("</lastmod>")), F.lit("")), F.lit("</url>"))
    body = paths.select(F.col("ord").cast("long").alias("ord"), line.alias("line"))
    frame = paths.sparkSession.createDataFrame(
        [(-2, '<?xml version="1.0" encoding="UTF-8"?>'), (-1, '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), (1 << 62, "</urlset>")], "ord long, line string"
    )
    return frame.unionByName(body)


def _literal(column: str):
    return F.concat(F.lit('"'), F.col(column).cast("string"), F.lit('"^^<' + PREFIXES["xsd"] + 'integer>'))


def _described(rows: DataFrame, subject: str, statements: list[tuple[str, str]]) -> DataFrame:
    fixed = rows.sparkSession.createDataFrame([(f"<{subject}> <{p}> {o} .",) for p, o in statements], "line string")
    return fixed.unionByName(rows.select("line"))


def void_document(statistics: DataFrame, dataset: str, title: str, licence: str) -> DataFrame:
    """Statement lines of a VoID description: title, licence and the counted triples and links.

    statistics: statistic, n as void_statistics makes them ('triples', 'sameAs <target>').
    """
    void, dct, owl = PREFIXES["void"], PREFIXES["dcterms"], PREFIXES["owl"]
    links = F.concat(F.lit(f"<{dataset}/links/"), F.regexp_replace(F.substring_index("statistic", " ", -1), r"[^\w-]", "_"), F.lit(">"))
    lines = F.when(F.col("statistic") == "triples", F.array(F.concat(F.lit(f"<{dataset}> <{void}triples> "), _literal("n"), F.lit(" .")))).otherwise(F.array(
        F.concat(links, F.lit(f" <{PREFIXES['void']}subjectsTarget> <{dataset}> .")), F.concat(links, F.lit(f" <{void}linkPredicate> <{owl}sameAs> .")),
        F.concat(links, F.lit(f" <{void}triples> "), _literal("n"), F.lit(" .")),
    ))
    rows = statistics.select(F.explode(lines).alias("line"))
    rdf = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
    return _described(rows, dataset, [(rdf, f"<{void}Dataset>"), (dct + "title", f'"{title}"'), (dct + "license", f"<{licence}>")])


def dcat_document(manifest: DataFrame, dataset: str, title: str, licence: str) -> DataFrame:
    """Statement lines of a DCAT description with a distribution per file(name, media_type, bytes)."""
    dcat, dct = PREFIXES["dcat"], PREFIXES["dcterms"]
    at = F.concat(F.lit(f"<{dataset}/file/"), F.col("name"), F.lit(">"))
    lines = F.array(
        F.concat(F.lit(f"<{dataset}> <{dcat}distribution> "), at, F.lit(" .")), F.concat(at, F.lit(f" <{dcat}mediaType> "), F.lit('"'), F.col("media_type"), F.lit('" .')),
        F.concat(at, F.lit(f" <{dcat}byteSize> "), _literal("bytes"), F.lit(" .")),
    )
    rdf = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
    return _described(manifest.select(F.explode(lines).alias("line")), dataset, [(rdf, f"<{dcat}Dataset>"), (dct + "title", f'"{title}"'), (dct + "license", f"<{licence}>")])


def shapes_document(rules: DataFrame, base: str) -> DataFrame:
    """Statement lines of SHACL shapes of rules(node_type, path, min_count, max_count); null counts set no bound."""
    sh, rdf = PREFIXES["sh"], "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
    name = lambda c: F.regexp_replace(c, r"[^\w]", "_")
    shape = F.concat(F.lit(f"<{base}/shape/"), name("node_type"), F.lit(">"))
    rule = F.concat(F.lit(f"<{base}/shape/"), name("node_type"), F.lit("/"), name("path"), F.lit(">"))
    say = lambda s, p, o: F.concat(s, F.lit(f" <{p}> "), o, F.lit(" ."))
    iri = lambda c: F.concat(F.lit("<"), F.col(c), F.lit(">"))
    lines = F.array(
        say(shape, rdf, F.lit(f"<{sh}NodeShape>")), say(shape, sh + "targetClass", iri("node_type")), say(shape, sh + "property", rule), say(rule, sh + "path", iri("path")),
        F.when(F.col("min_count").isNotNull(), say(rule, sh + "minCount", _literal("min_count"))), F.when(F.col("max_count").isNotNull(), say(rule, sh + "maxCount", _literal("max_count"))),
    )
    return rules.select(F.explode(F.filter(lines, lambda x: x.isNotNull())).alias("line")).distinct()
