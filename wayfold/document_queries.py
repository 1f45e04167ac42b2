"""Queries over documents: models in XMI and ontologies in RDF/XML, each with the SQL that recomputes it from the same elements."""

from __future__ import annotations

from xml.sax.saxutils import quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.sources import owl, xmi, xml

Node = tuple[str, dict[str, str], list]

# A platform and a conceptual layer; nested packages, a chain of realizations, bounds of all kinds, three sorts of participants.
_C, _L, _P = "conceptual:", "logical:", "platform:"
XMI: Node = ("model", {}, [
    ("package", {"name": "concepts"}, [
        ("element", {"xmi:type": _C + "Observable", "xmi:id": "o1", "name": "Heat"}, []),
        ("element", {"xmi:type": _C + "Observable", "xmi:id": "o2", "name": "Place"}, []),
        ("package", {"name": "inner"}, [
            ("element", {"xmi:type": _C + "Entity", "xmi:id": "e1", "name": "Thing"}, [
                ("composition", {"xmi:type": _C + "Composition", "xmi:id": "c1", "rolename": "place", "type": "o2", "lowerBound": "0", "upperBound": "*"}, []),
                ("composition", {"xmi:type": _C + "Composition", "xmi:id": "c9", "type": "o2"}, []),
            ]),
            ("element", {"xmi:type": _C + "Entity", "xmi:id": "e2", "name": "Motor", "specializes": "e1"}, [
                ("group", {}, [("composition", {"xmi:type": _C + "Composition", "xmi:id": "c2", "rolename": "heat", "type": "m1", "lowerBound": "*", "upperBound": "*"}, [])]),
                ("composition", {"xmi:type": _C + "Composition", "xmi:id": "c3", "rolename": "drive", "type": "gone"}, []),
                ("composition", {"xmi:type": _C + "Composition", "xmi:id": "c4", "rolename": "spare", "type": "o1", "lowerBound": "x", "upperBound": "many"}, []),
            ]),
            ("element", {"xmi:type": _C + "Entity", "xmi:id": "e3", "specializes": "e1"}, []),
            ("element", {"xmi:type": _C + "Entity", "xmi:id": "e2", "name": "Motor"}, []),
        ]),
    ]),
    ("package", {"name": "ties"}, [
        ("element", {"xmi:type": _C + "Association", "xmi:id": "a1", "name": "Thing_PartOf_Motor"}, [
            ("participant", {"xmi:type": _C + "Participant", "xmi:id": "p1", "rolename": "assembly", "type": "e2", "lowerBound": "1", "upperBound": "1", "sourceLowerBound": "0", "sourceUpperBound": "*"}, []),
            ("participant", {"xmi:type": _C + "Participant", "xmi:id": "p2", "rolename": "part", "type": "e1", "upperBound": "*"}, []),
            ("composition", {"xmi:type": _C + "Composition", "xmi:id": "c5", "rolename": "mount", "type": "o2"}, []),
        ]),
        ("element", {"xmi:type": _C + "Association", "xmi:id": "a2", "name": "Thing_Observe_Motor", "specializes": "a1"}, [
            ("participant", {"xmi:type": _C + "Participant", "xmi:id": "p3", "rolename": "observed", "type": "e2"}, [
                ("path", {"xmi:type": _C + "ParticipantPathNode", "projectedParticipant": "p1"}, [
                    ("node", {"xmi:type": _C + "CharacteristicPathNode", "projectedCharacteristic": "p2"}, [
                        ("node", {"xmi:type": _C + "CharacteristicPathNode", "projectedCharacteristic": "c1"}, []),
                    ]),
                ]),
            ]),
            ("participant", {"xmi:type": _C + "Participant", "xmi:id": "p4", "rolename": "observer", "type": "e1"}, [("path", {"xmi:type": _C + "CharacteristicPathNode", "projectedCharacteristic": "c1"}, [])]),
            ("participant", {"xmi:type": _C + "Participant", "xmi:id": "p5", "rolename": "lost", "type": "nowhere"}, []),
        ]),
    ]),
    ("package", {"name": "layers"}, [
        ("element", {"xmi:type": _L + "Measurement", "xmi:id": "m1", "name": "HeatMeasure", "realizes": "m2"}, []),
        ("element", {"xmi:type": _L + "Measurement", "xmi:id": "m2", "name": "HeatBase", "realizes": "o1"}, []),
        ("element", {"xmi:type": _L + "Measurement", "xmi:id": "m3", "name": "Round", "realizes": "m4"}, []),
        ("element", {"xmi:type": _L + "Measurement", "xmi:id": "m4", "name": "Robin", "realizes": "m3"}, []),
        ("element", {"xmi:type": _P + "Entity", "xmi:id": "f1", "name": "Motor_P", "realizes": "l1"}, []),
        ("element", {"xmi:type": _L + "Entity", "xmi:id": "l1", "name": "Motor_L", "realizes": "e2"}, []),
        ("element", {"xmi:type": _P + "Query", "xmi:id": "q1", "name": "heats", "specification": "SELECT heat&#10;FROM Motor"}, []),
        ("element", {"xmi:type": _P + "Query", "xmi:id": "q2", "name": "none"}, []),
        ("element", {"xmi:type": _P + "Query", "xmi:id": "q3", "name": "two", "specification": "SELECT place &lt;x&gt; &amp; y FROM Thing"}, []),
    ]),
])

_OWL_CLASSES = [("Entity", [], []), ("Rover", ["Entity", "Unknown"], ["Heat"]), ("Probe", ["Rover"], []), ("Heat", [], ["Rover", "Entity"])]
#: Name, domain, range and inverse; carries and carriedBy, and the chain a1, a2, a3, share edges.
_OWL_PROPERTIES = [("carries", "Rover", "Probe", "carriedBy"), ("carriedBy", "Probe", "Rover", "carries"), ("measures", "Probe", "Heat", None), ("idle", "Probe", None, None), ("a1", "Rover", "Heat", "a2"), ("a2", "Rover", "Heat", "a3"), ("a3", "Probe", "Heat", None), ("far", "Rover", "Elsewhere", None)]
_BASE = "http://example.org/space#"
OWL: Node = ("rdf:RDF", {"xmlns:rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "xmlns:rdfs": "http://www.w3.org/2000/01/rdf-schema#", "xmlns:owl": "http://www.w3.org/2002/07/owl#"}, [
    *(("owl:Class", {"rdf:about": _BASE + n}, [*(("rdfs:subClassOf", {"rdf:resource": _BASE + p}, []) for p in up), *(("owl:disjointWith", {"rdf:resource": _BASE + d}, []) for d in apart)]) for n, up, apart in _OWL_CLASSES),
    *(("owl:ObjectProperty", {"rdf:about": _BASE + n}, [(t, {"rdf:resource": _BASE + x}, []) for t, x in (("rdfs:domain", d), ("rdfs:range", r), ("owl:inverseOf", i)) if x]) for n, d, r, i in _OWL_PROPERTIES),
    ("owl:DatatypeProperty", {"rdf:about": _BASE + "mass"}, [("rdfs:domain", {"rdf:resource": _BASE + "Rover"}, [])]),
    ("owl:NamedIndividual", {"rdf:about": _BASE + "spirit"}, []),
    ("owl:AllDisjointClasses", {}, [("owl:members", {}, [("owl:Class", {"rdf:about": _BASE + n}, []) for n in ("Mass", "Length", "Time")])]),
])


def text(node: Node, spaces: str = "") -> str:
    tag, attrs, below = node
    inside = "".join(text(x) for x in below)
    return f"<{tag}{spaces}{''.join(f' {k}={quoteattr(v)}' for k, v in attrs.items())}>{inside}</{tag}>"


XMI_TEXT = text(XMI, ' xmlns:xmi="http://www.omg.org/XMI"')
OWL_TEXT = text(OWL)


def _elements(spark: SparkSession, content: str) -> DataFrame:
    return xml.elements(spark.createDataFrame([("doc", bytearray(content.encode()))], "doc string, content binary"))


def _flat(node: Node, up: int | None, out: list) -> list:
    at = len(out)
    out.append((at, up, node[0], node[1]))
    for x in node[2]:
        _flat(x, at, out)
    return out


def _values(node: Node, attributes: list[str]) -> str:
    quote = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'"
    return ", ".join(f"({at}, {'NULL' if up is None else up}, {quote(tag)}, {', '.join(quote(a.get(k)) for k in attributes)})" for at, up, tag, a in _flat(node, None, []))


_X = f"""e(ord, parent, tag, {', '.join(xmi.ATTRIBUTES)}) AS (VALUES {_values(XMI, list(xmi.ATTRIBUTES.values()))}),
  above(ord, up) AS (SELECT ord, parent FROM e WHERE parent IS NOT NULL UNION SELECT above.ord, e.parent FROM above JOIN e ON e.ord = above.up WHERE e.parent IS NOT NULL),
  ids AS (SELECT id, max(ord) AS ord FROM e WHERE id IS NOT NULL GROUP BY id),
  el AS (SELECT e.* FROM e JOIN ids USING (ord)),
  chain(id, here, depth) AS (SELECT id, id, 0 FROM ids UNION SELECT chain.id, el.realizes, depth + 1 FROM chain JOIN ids ON ids.id = chain.here JOIN e el ON el.ord = ids.ord WHERE el.realizes IS NOT NULL AND depth < 9),
  real AS (SELECT chain.id, arg_min(e.name, depth) AS name FROM chain JOIN ids ON ids.id = chain.here JOIN e ON e.ord = ids.ord WHERE contains(e.xtype, 'conceptual:Observable') GROUP BY chain.id)"""
def _bound(c: str, default: str, otherwise: str) -> str:
    return f"CASE WHEN coalesce({c}, '{default}') = '*' THEN -1 ELSE coalesce(TRY_CAST(coalesce({c}, '{default}') AS INT), {otherwise}) END"


_XMI_SQL = f"""WITH RECURSIVE {_X},
  own AS (SELECT min(ord) AS ord FROM e WHERE name IS NOT NULL AND (starts_with(xtype, 'conceptual:Entity') OR starts_with(xtype, 'conceptual:Association')) GROUP BY id),
  o AS (SELECT e.ord AS owner, e.name AS subject, e.xtype, e.specializes FROM e JOIN own USING (ord)),
  steps AS (
    SELECT p.ord AS place, -1 AS k, '->' || pr.rolename || '[' || (SELECT a.name FROM above b JOIN e a ON a.ord = b.up WHERE b.ord = pr.ord AND contains(a.xtype, 'Association') ORDER BY b.up DESC LIMIT 1) || ']' AS step
    FROM e p JOIN above x ON x.up = p.ord JOIN e path ON path.ord = x.ord AND path.tag = 'path' AND contains(path.xtype, 'ParticipantPathNode') JOIN el pr ON pr.id = path.participant WHERE p.tag = 'participant'
    UNION ALL SELECT p.ord, n.ord, '.' || ch.rolename FROM e p JOIN above x ON x.up = p.ord JOIN e n ON n.ord = x.ord AND n.tag = 'node' JOIN el ch ON ch.id = n.characteristic WHERE p.tag = 'participant'
    UNION ALL SELECT p.ord, 0, '.' || ch.rolename FROM e p JOIN above x ON x.up = p.ord JOIN e path ON path.ord = x.ord AND path.tag = 'path' AND contains(path.xtype, 'CharacteristicPathNode') JOIN el ch ON ch.id = path.characteristic WHERE p.tag = 'participant'),
  path AS (SELECT place, string_agg(step, '' ORDER BY k) AS steps FROM steps GROUP BY place),
  t AS (
    SELECT owner, 0 AS kind, owner AS ord, subject, 'specializes' AS predicate, el.name AS object_raw, '' AS rolename, NULL AS mult FROM o JOIN el ON el.id = o.specializes WHERE starts_with(o.xtype, 'conceptual:Entity')
    UNION ALL SELECT owner, 1, e.ord, subject, 'composes', real.name, e.rolename, (CASE WHEN e.lower = '*' THEN CASE WHEN e.upper = '*' THEN -1 ELSE 1 END ELSE coalesce(TRY_CAST(coalesce(e.lower, '1') AS INT), CASE WHEN e.upper = '*' THEN -1 ELSE 1 END) END) || ' ' || ({_bound('e.upper', '1', '-1')})
      FROM o JOIN above x ON x.up = o.owner JOIN e ON e.ord = x.ord JOIN real ON real.id = e.type WHERE e.tag = 'composition' AND e.rolename IS NOT NULL
    UNION ALL SELECT owner, 2, e.ord, subject, 'associates', el.name || coalesce(steps, ''), e.rolename, concat_ws(' ', {_bound('e.lower', '1', '-1')}, {_bound('e.upper', '1', '-1')}, {_bound('e.src_lower', '0', '-1')}, {_bound('e.src_upper', '-1', '-1')})
      FROM o JOIN above x ON x.up = o.owner JOIN e ON e.ord = x.ord JOIN el ON el.id = e.type LEFT JOIN path ON path.place = e.ord WHERE e.tag = 'participant' AND e.rolename IS NOT NULL AND starts_with(o.xtype, 'conceptual:Association'))
  SELECT (row_number() OVER (ORDER BY owner, kind, ord) - 1)::INT AS seq, subject, predicate, object_raw, rolename, mult FROM t"""


def xmi_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return xmi.tuples(_elements(spark, XMI_TEXT)).select("seq", "subject", "predicate", "object_raw", "rolename", F.array_join("mult", " ").alias("mult"))


def xmi_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return xmi.queries(_elements(spark, XMI_TEXT)).select("name", "text")


def realizes_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return xmi.realized(xmi.typed(_elements(spark, XMI_TEXT))).select("id", "name")


_O = f"""c(name, parents, apart) AS (VALUES {', '.join(f"('{n}', {p}::VARCHAR[], {d}::VARCHAR[])" for n, p, d in _OWL_CLASSES)}, ('Mass', [], []), ('Length', [], []), ('Time', [], [])),
  p(name, domain, range, inverse) AS (VALUES {', '.join('(' + ', '.join('NULL' if x is None else repr(x) for x in row) + ')' for row in _OWL_PROPERTIES)}),
  n AS (SELECT *, row_number() OVER () AS i FROM c)"""


def owl_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes with their parents, and properties with domain, range and inverse."""
    e = _elements(spark, OWL_TEXT)
    parents = owl.class_links(e).groupBy("name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "to"))), lambda x: x.to), ",").alias("parents"))
    none = F.lit(None).cast("string")
    classes = owl.classes(e).join(parents, "name", "left").select("name", F.lit("class").alias("kind"), F.coalesce("parents", F.lit("")).alias("parents"), none.alias("domain"), none.alias("range"), none.alias("inverse"))
    return classes.unionByName(owl.properties(e).select("name", F.lit("property").alias("kind"), F.lit("").alias("parents"), "domain", "range", "inverse"))


def owl_mermaid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return owl.mermaid(_elements(spark, OWL_TEXT)).select("ord", "line")


def owl_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return owl.stats(_elements(spark, OWL_TEXT)).drop("doc")


_COUNT = lambda c: f"(SELECT count({c}) FROM p)"
QUERIES = {f.__name__: f for f in (xmi_scan, xmi_queries, realizes_chain, owl_scan, owl_mermaid, owl_stats)}
ORACLES = {
    "xmi_scan": _XMI_SQL,
    "xmi_queries": f"WITH RECURSIVE {_X} SELECT name, replace(replace(replace(replace(specification, '&#10;', chr(10)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS text FROM e WHERE starts_with(xtype, 'platform:Query') AND specification IS NOT NULL",
    "realizes_chain": f"WITH RECURSIVE {_X} SELECT id, name FROM real",
    "owl_scan": f"WITH {_O} SELECT name, 'class' AS kind, array_to_string(parents, ',') AS parents, NULL::VARCHAR AS domain, NULL::VARCHAR AS range, NULL::VARCHAR AS inverse FROM c UNION ALL SELECT name, 'property', '', domain, range, inverse FROM p",
    # a2 shares a1's edge, so a3 is not named by a drawn property; carries shares that of carriedBy.
    "owl_mermaid": f"""WITH {_O}, lines AS (
      SELECT 0 AS part, '' AS a, 0 AS b, 'graph LR' AS line UNION ALL SELECT 0, '', 1, '    classDef entity fill:#ffffff,stroke:#000000,stroke-width:1px,color:#000000;'
      UNION ALL SELECT 1, name, 0, '    ' || name || '[' || name || ']:::entity' FROM n
      UNION ALL SELECT 2, lpad(i::VARCHAR, 9, '0'), k, '    ' || name || ' -->|subClassOf| ' || parents[k] FROM (SELECT *, unnest(range(1, len(parents) + 1)) AS k FROM n) WHERE parents[k] IN (SELECT name FROM n)
      UNION ALL SELECT 3, lpad(min(i)::VARCHAR, 9, '0'), arg_min(k, i), '    ' || arg_min(name, i) || ' -.-|disjointWith| ' || arg_min(apart[k], i) FROM (SELECT *, unnest(range(1, len(apart) + 1)) AS k FROM n) WHERE apart[k] IN (SELECT name FROM n) GROUP BY least(name, apart[k]), greatest(name, apart[k])
      UNION ALL SELECT 4, name, 0, '    ' || domain || ' -->|' || name || coalesce('/' || inverse, '') || '| ' || range FROM p WHERE domain IN (SELECT name FROM n) AND range IN (SELECT name FROM n)
        AND name NOT IN (SELECT inverse FROM p q WHERE q.name < q.inverse AND q.domain IS NOT NULL AND q.range IS NOT NULL AND q.name NOT IN (SELECT inverse FROM p r WHERE r.name < r.inverse AND r.domain IS NOT NULL AND r.range IS NOT NULL)))
      SELECT (row_number() OVER (ORDER BY part, a, b) - 1)::INT AS ord, line FROM lines""",
    "owl_stats": f"WITH {_O} SELECT (SELECT count(*) FROM c) AS classes, {_COUNT('*')} AS object_properties, 1::BIGINT AS datatype_properties, 1::BIGINT AS individuals, (SELECT sum(len(parents)) FROM c)::BIGINT AS subclass_relations, {_COUNT('domain')} + 1 AS property_domains, {_COUNT('range')} AS property_ranges, {_COUNT('inverse')} AS inverse_properties, (SELECT sum(len(apart)) FROM c)::BIGINT + 3 AS disjoint_classes",
}
