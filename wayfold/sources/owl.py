"""Ontologies in RDF/XML: read as rows, drawn as a graph, and written from triples."""

from __future__ import annotations

from xml.sax.saxutils import quoteattr

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions.names import local_name
from wayfold.operators.closure import cut

NAMESPACE = "http://example.org/uddl#"


def _named(elements: DataFrame, tag: str) -> DataFrame:
    """doc, ord and name of elements with rdf:about."""
    about = F.nullif(F.col("attrs")["rdf:about"], F.lit(""))
    return elements.where(F.col("tag") == tag).where(about.isNotNull()).select("doc", "ord", local_name(about).alias("name"))


def _refers(elements: DataFrame, tag: str) -> DataFrame:
    """doc, ord, at (the parent's place) and to (what rdf:resource names) of elements."""
    to = F.nullif(F.col("attrs")["rdf:resource"], F.lit(""))
    return elements.where((F.col("tag") == tag) & to.isNotNull()).select("doc", "ord", F.element_at("above", -1).alias("at"), local_name(to).alias("to"))


def _last(named: DataFrame) -> DataFrame:
    """doc, name, first and at: where a name stands first and last."""
    return named.groupBy("doc", "name").agg(F.min("ord").alias("first"), F.max("ord").alias("at"))


def classes(elements: DataFrame) -> DataFrame:
    """doc, name and ord of each class, by its first place."""
    return _last(_named(elements, "owl:Class")).select("doc", "name", F.col("first").alias("ord"))


def class_links(elements: DataFrame, tag: str = "rdfs:subClassOf") -> DataFrame:
    """doc, name, ord, k and to: what a class's last element refers to by tag (owl:disjointWith is the other use).

    A class that is named again without them, as a member of a list, so has none: the last element counts.
    """
    links = _refers(elements, tag).withColumnRenamed("ord", "k")
    return _last(_named(elements, "owl:Class")).join(links, ["doc", "at"]).select("doc", "name", F.col("first").alias("ord"), "k", "to")


def properties(elements: DataFrame, tag: str = "owl:ObjectProperty") -> DataFrame:
    """doc, name, domain, range and inverse of each property, from its last element; the first of several references counts."""
    out = _last(_named(elements, tag)).select("doc", "name", "at")
    for column, link in (("domain", "rdfs:domain"), ("range", "rdfs:range"), ("inverse", "owl:inverseOf")):
        # What the first such child refers to; a child without a reference stands for none.
        child = elements.where(F.col("tag") == link).select("doc", F.element_at("above", -1).alias("at"), "ord", F.nullif(F.col("attrs")["rdf:resource"], F.lit("")).alias("to"))
        first = child.groupBy("doc", "at").agg(F.min_by(F.struct("to"), "ord").alias("x")).select("doc", "at", local_name(F.col("x.to")).alias(column))
        out = out.join(first, ["doc", "at"], "left")
    return out.drop("at")


def stats(elements: DataFrame) -> DataFrame:
    """doc and nine counts: elements that declare or name a class, properties of both kinds, individuals, subclass
    relations, domains, ranges, inverses and disjoint pairs (those of lists, and those of single statements)."""
    about = F.nullif(F.col("attrs")["rdf:about"], F.lit("")).isNotNull()
    to = F.nullif(F.col("attrs")["rdf:resource"], F.lit("")).isNotNull()
    tag = F.col("tag")
    parents = elements.where(about & tag.isin("owl:Class", "owl:ObjectProperty", "owl:DatatypeProperty")).select("doc", F.col("ord").alias("parent"), tag.alias("of"))
    child = elements.where(to & tag.isin("rdfs:subClassOf", "owl:disjointWith", "rdfs:domain", "rdfs:range", "owl:inverseOf"))
    child = child.withColumn("parent", F.element_at("above", -1)).join(parents, ["doc", "parent"])
    # Of a property the first domain, range and inverse count; of a class all.
    child = child.withColumn("key", F.when(F.col("of") == "owl:Class", F.col("ord")).otherwise(F.col("parent"))).groupBy("doc", "tag", "of", "key").agg(F.lit(1).alias("one"))
    links = child.groupBy("doc").agg(
        F.count_if((tag == "rdfs:subClassOf") & (F.col("of") == "owl:Class")).alias("subclass_relations"),
        F.count_if((tag == "rdfs:domain") & (F.col("of") != "owl:Class")).alias("property_domains"),
        F.count_if((tag == "rdfs:range") & (F.col("of") != "owl:Class")).alias("property_ranges"),
        F.count_if((tag == "owl:inverseOf") & (F.col("of") == "owl:ObjectProperty")).alias("inverse_properties"),
        F.count_if((tag == "owl:disjointWith") & (F.col("of") == "owl:Class")).alias("stated"),
    )
    lists = elements.where(tag == "owl:AllDisjointClasses").select("doc", F.col("ord").alias("list"))
    members = elements.where(tag == "owl:Class").withColumn("list", F.explode("above")).join(lists, ["doc", "list"]).groupBy("doc", "list").agg(F.count("*").alias("m"))
    pairs = members.groupBy("doc").agg(F.sum(F.expr("m * (m - 1) div 2")).alias("listed"))
    counts = elements.groupBy("doc").agg(*(F.count_if(about & (tag == t)).alias(n) for n, t in (("classes", "owl:Class"), ("object_properties", "owl:ObjectProperty"), ("datatype_properties", "owl:DatatypeProperty"), ("individuals", "owl:NamedIndividual"))))
    out = counts.join(links, "doc", "left").join(pairs, "doc", "left").na.fill(0)
    return out.select("doc", "classes", "object_properties", "datatype_properties", "individuals", "subclass_relations", "property_domains", "property_ranges", "inverse_properties", (F.col("stated") + F.col("listed")).alias("disjoint_classes"))


def mermaid(elements: DataFrame) -> DataFrame:
    """doc, ord and line of a graph of each ontology: classes by name, their parents, disjoint pairs once each, and
    properties with a domain and a range as edges; a property that an earlier one names as its inverse shares its edge."""
    known = classes(elements)
    names = known.select("doc", F.col("name").alias("to"))
    style = "    classDef entity fill:#ffffff,stroke:#000000,stroke-width:1px,color:#000000;"
    docs = elements.select("doc").distinct()
    head = docs.select("doc", F.lit(0).alias("part"), F.lit("").alias("a"), F.inline(F.array(*(F.struct(F.lit(i).alias("b"), F.lit(x).alias("line")) for i, x in enumerate(("graph LR", style))))))
    node = known.select("doc", F.lit(1).alias("part"), F.col("name").alias("a"), F.lit(0).alias("b"), F.format_string("    %s[%s]:::entity", "name", "name").alias("line"))
    place = F.format_string("%012d", F.col("ord"))
    parent = class_links(elements).join(names, ["doc", "to"], "left_semi").select("doc", F.lit(2).alias("part"), place.alias("a"), F.col("k").alias("b"), F.format_string("    %s -->|subClassOf| %s", "name", "to").alias("line"))
    apart = class_links(elements, "owl:disjointWith").join(names, ["doc", "to"], "left_semi")
    # A pair is drawn where it is stated first.
    apart = apart.groupBy("doc", F.least("name", "to").alias("x"), F.greatest("name", "to").alias("y")).agg(F.min(F.struct("ord", "k", "name", "to")).alias("p")).select("doc", "p.*")
    apart = apart.select("doc", F.lit(3).alias("part"), place.alias("a"), F.col("k").alias("b"), F.format_string("    %s -.-|disjointWith| %s", "name", "to").alias("line"))
    whole = properties(elements).where("domain is not null and range is not null")
    drawn = whole.join(_shared(whole), ["doc", "name"], "left_anti")
    label = F.concat_ws("/", "name", "inverse")
    edge = drawn.join(names.withColumnRenamed("to", "domain"), ["doc", "domain"], "left_semi").join(names.withColumnRenamed("to", "range"), ["doc", "range"], "left_semi")
    edge = edge.select("doc", F.lit(4).alias("part"), F.col("name").alias("a"), F.lit(0).alias("b"), F.concat(F.lit("    "), "domain", F.lit(" -->|"), label, F.lit("| "), "range").alias("line"))
    rows = head.unionByName(node).unionByName(parent).unionByName(apart).unionByName(edge)
    return rows.select("doc", (F.row_number().over(Window.partitionBy("doc").orderBy("part", "a", "b")) - 1).alias("ord"), "line")


def _shared(whole: DataFrame) -> DataFrame:
    """doc and name of the properties that an earlier drawn one has as its inverse."""
    # Earlier by name, so the relation has no cycles: what is settled at one length of the chain stays settled.
    pairs = cut(whole.where("inverse > name").select("doc", "name", "inverse"))
    shared = pairs.select("doc", F.col("inverse").alias("name")).distinct()
    while True:
        nxt = cut(pairs.join(shared, ["doc", "name"], "left_anti").select("doc", F.col("inverse").alias("name")).distinct())
        if nxt.exceptAll(shared).isEmpty() and shared.exceptAll(nxt).isEmpty():
            return nxt
        shared = nxt


def rdf_xml(triples: DataFrame, restrictions: DataFrame | None = None, namespace: str = NAMESPACE) -> str:
    """RDF/XML text of an ontology's triples (see ``ontology.triples``) and restrictions; an ontology's size is that of its model."""
    base = namespace if namespace.endswith("#") else namespace + "#"
    uri = lambda x: quoteattr(x if x.startswith("http") else base + x)
    rows = sorted((r.s, r.p, r.o) for r in triples.collect())
    bounds = sorted((r["class"], r.property, r.on_class, r.kind, r.n) for r in restrictions.collect()) if restrictions is not None else []
    of: dict[str, list[tuple[str, str]]] = {}
    for s, p, o in rows:
        of.setdefault(s, []).append((p, o))
    kinds = {k: [s for s, p, o in rows if p == "a" and o == k] for k in ("ObjectProperty", "Class", "NamedIndividual")}
    out = ['<?xml version="1.0" encoding="UTF-8"?>', f'<rdf:RDF xmlns="{base}" xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:owl="http://www.w3.org/2002/07/owl#" xml:base="{base}">', f"\t<owl:Ontology rdf:about={quoteattr(base)}/>"]
    links = {"subClassOf": "rdfs:subClassOf", "subPropertyOf": "rdfs:subPropertyOf", "domain": "rdfs:domain", "range": "rdfs:range", "inverseOf": "owl:inverseOf", "type": "rdf:type"}
    for kind, subjects in kinds.items():
        for s in subjects:
            out.append(f"\t<owl:{kind} rdf:about={uri(s)}>")
            union = [o for p, o in of[s] if p == "rangeUnion"]
            if union:
                out.append('\t\t<rdfs:range>\n\t\t\t<owl:Class>\n\t\t\t\t<owl:unionOf rdf:parseType="Collection">')
                out += [f"\t\t\t\t\t<owl:Class rdf:about={uri(o)}/>" for o in union]
                out.append("\t\t\t\t</owl:unionOf>\n\t\t\t</owl:Class>\n\t\t</rdfs:range>")
            for p, o in of[s]:
                if p in links:
                    out.append(f"\t\t<{links[p]} rdf:resource={uri(o)}/>")
                elif kind == "NamedIndividual" and p != "a":
                    out.append(f"\t\t<{p} rdf:resource={uri(o)}/>")
            if kind == "Class":
                word = {"exact": "qualifiedCardinality", "min": "minQualifiedCardinality", "max": "maxQualifiedCardinality"}
                for _, p, o, k, n in (b for b in bounds if b[0] == s):
                    out.append(f'\t\t<rdfs:subClassOf>\n\t\t\t<owl:Restriction>\n\t\t\t\t<owl:onProperty rdf:resource={uri(p)}/>\n\t\t\t\t<owl:onClass rdf:resource={uri(o)}/>\n\t\t\t\t<owl:{word[k]} rdf:datatype="http://www.w3.org/2001/XMLSchema#nonNegativeInteger">{n}</owl:{word[k]}>\n\t\t\t</owl:Restriction>\n\t\t</rdfs:subClassOf>')
            out.append(f"\t</owl:{kind}>")
    members = [s for s, p, o in rows if p == "memberOf" and o == "AllDisjointClasses"]
    if members:
        out.append('\t<owl:AllDisjointClasses>\n\t\t<owl:members rdf:parseType="Collection">')
        out += [f"\t\t\t<owl:Class rdf:about={uri(m)}/>" for m in members]
        out.append("\t\t</owl:members>\n\t</owl:AllDisjointClasses>")
    return "\n".join([*out, "</rdf:RDF>", ""])
