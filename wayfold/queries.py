"""Queries over the tables and over a model text, each with the SQL that recomputes it independently."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions.names import latex_escape, latex_query, local_name, path_start, path_steps, union_text
from wayfold import document_queries
from wayfold.operators import analysis, observation, ontology
from wayfold.operators.closure import ancestors
from wayfold.operators.instance import Binding, Catalog, execute
from wayfold.plans.binder import Pattern, bind, patterns
from wayfold.plans.grammar import parse_query
from wayfold.plans.progressive import progressive
from wayfold.sources.model import Model, frame, parse_model

# --- Instance mode: the tables as a model ----------------------------------------------------------

TABLES = """
(Region, composes, Key, regionkey)
(Region, composes, Name, name)
(Nation, composes, Key, nationkey)
(Nation, composes, Name, name)
(Nation, composes, Region, region)
(Customer, composes, Key, custkey)
(Customer, composes, Name, name)
(Customer, composes, Balance, acctbal)
(Customer, composes, Segment, mktsegment)
(Customer, composes, Nation, nation)
(Supplier, composes, Key, suppkey)
(Supplier, composes, Name, name)
(Supplier, composes, Balance, acctbal)
(Supplier, composes, Nation, nation)
(Part, composes, Key, partkey)
(Part, composes, Brand, brand)
(Orders, composes, Key, orderkey)
(Orders, composes, Priority, priority)
(Orders, composes, Price, totalprice)
(Orders, composes, Customer, customer)
(Lineitem, composes, Number, linenumber)
(Lineitem, composes, Quantity, quantity)
(Lineitem, associates[1, 1][0, -1], Orders, order)
(Lineitem, associates[1, 1][0, -1], Part, part)
(Lineitem, associates[1, 1][0, -1], Supplier, supplier)
(Lineitem, associates[1, 1][0, -1], Orders.customer, buyer)
"""

#: Of each type: table, identity, and columns by role.
COLUMNS = {
    "Region": ("region", "r_regionkey", {"regionkey": "r_regionkey", "name": "r_name"}),
    "Nation": ("nation", "n_nationkey", {"nationkey": "n_nationkey", "name": "n_name", "region": "n_regionkey"}),
    "Customer": ("customer", "c_custkey", {"custkey": "c_custkey", "name": "c_name", "acctbal": "c_acctbal", "mktsegment": "c_mktsegment", "nation": "c_nationkey"}),
    "Supplier": ("supplier", "s_suppkey", {"suppkey": "s_suppkey", "name": "s_name", "acctbal": "s_acctbal", "nation": "s_nationkey"}),
    "Part": ("part", "p_partkey", {"partkey": "p_partkey", "brand": "p_brand"}),
    "Orders": ("orders", "o_orderkey", {"orderkey": "o_orderkey", "priority": "o_orderpriority", "totalprice": "o_totalprice", "customer": "o_custkey"}),
    "Lineitem": ("lineitem", None, {"linenumber": "l_linenumber", "quantity": "l_quantity", "order": "l_orderkey", "part": "l_partkey", "supplier": "l_suppkey", "buyer": "l_orderkey"}),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    return Catalog({t: Binding(table(spark, sf_dir, name), id_, roles) for t, (name, id_, roles) in COLUMNS.items()})


INSTANCE = {
    "uddl_project": ("SELECT ALL name, acctbal AS balance, mktsegment FROM Customer", "SELECT c_name AS name, c_acctbal AS balance, c_mktsegment AS mktsegment FROM customer"),
    "uddl_select_star": ("SELECT * FROM Nation", "SELECT n_name AS name, n_nationkey AS nationkey, n_regionkey AS region FROM nation"),
    "uddl_entity_wildcard": (
        "SELECT o.orderkey, c.* FROM Orders AS o JOIN Customer AS c ON o.customer",
        "SELECT o_orderkey AS orderkey, c_acctbal AS acctbal, c_custkey AS custkey, c_mktsegment AS mktsegment, c_name AS name, c_nationkey AS nation FROM orders JOIN customer ON o_custkey = c_custkey",
    ),
    "uddl_type_ref": (
        "SELECT l.linenumber, Nation.name AS nation FROM Lineitem AS l JOIN Orders AS o ON l.order JOIN Customer AS c ON o.customer JOIN Supplier AS s ON l.supplier JOIN Nation AS n1 ON c.nation JOIN Nation AS n2 ON s.nation",
        """WITH x AS (SELECT l_linenumber, n1.n_name AS a, n2.n_name AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
           JOIN supplier ON l_suppkey = s_suppkey JOIN nation n1 ON c_nationkey = n1.n_nationkey JOIN nation n2 ON s_nationkey = n2.n_nationkey)
           SELECT l_linenumber AS linenumber, a AS nation FROM x UNION ALL SELECT l_linenumber, b FROM x""",
    ),
    "uddl_join_forward": ("SELECT o.orderkey, c.name FROM Orders AS o JOIN Customer AS c ON o.customer", "SELECT o_orderkey AS orderkey, c_name AS name FROM orders JOIN customer ON o_custkey = c_custkey"),
    "uddl_join_forward_eq": ("SELECT o.orderkey, c.name FROM Orders AS o JOIN Customer AS c ON c = o.customer", "SELECT o_orderkey AS orderkey, c_name AS name FROM orders JOIN customer ON o_custkey = c_custkey"),
    "uddl_join_reverse": ("SELECT c.name, o.orderkey FROM Customer AS c JOIN Orders AS o ON o.customer = c", "SELECT c_name AS name, o_orderkey AS orderkey FROM customer JOIN orders ON o_custkey = c_custkey"),
    "uddl_chain": (
        "SELECT l.quantity, r.name AS region FROM Lineitem AS l JOIN Orders AS o ON l.order JOIN Customer AS c ON o.customer JOIN Nation AS n ON c.nation JOIN Region AS r ON n.region",
        "SELECT l_quantity AS quantity, r_name AS region FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    ),
    "uddl_diamond": (
        """SELECT n.name AS nation, c.custkey AS cust, o.orderkey AS ord, s.suppkey AS supp FROM Nation AS n
           JOIN Customer AS c ON c.nation = n JOIN Orders AS o ON o.customer = c JOIN Lineitem AS l ON l.order = o JOIN Supplier AS s ON l.supplier AND s.nation = n""",
        """SELECT n_name AS nation, c_custkey AS cust, o_orderkey AS ord, s_suppkey AS supp FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey
           JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = n_nationkey""",
    ),
    "uddl_self_join": (
        "SELECT a.name AS one, b.name AS other, r.name AS region FROM Region AS r JOIN Nation AS a ON a.region = r JOIN Nation AS b ON b.region = r",
        "SELECT a.n_name AS one, b.n_name AS other, r_name AS region FROM region JOIN nation a ON a.n_regionkey = r_regionkey JOIN nation b ON b.n_regionkey = r_regionkey",
    ),
    "uddl_path_participant": (
        "SELECT l.linenumber, c.name AS buyer FROM Lineitem AS l JOIN Customer AS c ON l.buyer",
        "SELECT l_linenumber AS linenumber, c_name AS buyer FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey",
    ),
}


def _instance(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: execute(parse_query(text), parse_model(TABLES), catalog(spark, sf_dir))


# --- Observation mode: individuals made from orders ------------------------------------------------


def _individuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    x = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey)  # nation is fixed in size
    hop = lambda p, t: F.struct(F.lit(p).alias("property"), F.col(t).alias("target"))
    return x.select(F.concat(F.lit("ord_"), F.col("o_orderkey").cast("string")).alias("name"), F.col("o_orderpriority").alias("observable"), F.lit("Orders").alias("start"), F.array(hop("hasOrdersComposition_customer", "c_mktsegment"), hop("hasCustomerComposition_nation", "n_name")).alias("hops"))


def _triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observation.individual_triples(_individuals(spark, sf_dir))


TRIPLES_SQL = """
  ind AS (SELECT 'ord_' || o_orderkey AS s, o_orderpriority AS obs, c_mktsegment AS seg, n_name AS nat FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
  triples AS (SELECT DISTINCT s, p, o FROM (
    SELECT s, 'a' AS p, 'Observation' AS o FROM ind UNION ALL SELECT s, 'hasObservable', obs FROM ind UNION ALL SELECT s, 'hasOrders', 'Orders' FROM ind
    UNION ALL SELECT s, 'hasOrdersComposition_customer', seg FROM ind UNION ALL SELECT s, 'hasCustomerComposition_nation', nat FROM ind))"""

_COMMON = [("a", "Observation"), ("hasOrders", "Orders")]
#: query, projection, branch and terms; the last query's second projection matches nothing.
BRANCHES = [
    (0, 0, 0, [*_COMMON, ("hasObservable", "1-URGENT"), ("hasOrdersComposition_customer", "BUILDING")]),
    (1, 0, 0, [*_COMMON, ("hasObservable", "2-HIGH"), ("hasOrdersComposition_customer", "MACHINERY")]),
    (1, 0, 1, [*_COMMON, ("hasObservable", "2-HIGH"), ("hasCustomerComposition_nation", "NATION_1")]),
    (2, 0, 0, [*_COMMON, ("hasObservable", "1-URGENT"), ("hasOrdersComposition_customer", "BUILDING"), ("hasCustomerComposition_nation", "NATION_10")]),
    (2, 1, 0, [*_COMMON, ("hasObservable", "5-LOW"), ("hasOrdersComposition_customer", "FURNITURE"), ("hasCustomerComposition_nation", "NATION_11")]),
    (3, 0, 0, [*_COMMON, ("hasObservable", "1-URGENT")]),
    (3, 1, 0, [*_COMMON, ("hasObservable", "1-URGENT"), ("hasCustomerComposition_nation", "Nowhere")]),
]
PATTERNS = [Pattern(q, i, b, k, p, o) for q, i, b, terms in BRANCHES for k, (p, o) in enumerate(terms)]

MATCH_SQL = (
    "patterns(query_id, proj, branch, k, p, o) AS (VALUES " + ", ".join(f"({x.query}, {x.proj}, {x.branch}, {x.k}, '{x.p}', '{x.o}')" for x in PATTERNS) + """),
  need AS (SELECT query_id, proj, branch, count(*) AS n FROM patterns GROUP BY ALL),
  matches AS (SELECT query_id, proj, branch, s FROM patterns JOIN triples USING (p, o) GROUP BY query_id, proj, branch, s
    HAVING count(DISTINCT k) = (SELECT n FROM need WHERE need.query_id = patterns.query_id AND need.proj = patterns.proj AND need.branch = patterns.branch))"""
)
VERIFY_SQL = "SELECT query_id, bool_and(n > 0) AS ok FROM (SELECT x.query_id, x.proj, count(s) AS n FROM (SELECT DISTINCT query_id, proj FROM patterns) x LEFT JOIN matches USING (query_id, proj) GROUP BY ALL) GROUP BY query_id"


def _match(only: list[int]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: observation.match(_triples(spark, sf_dir), [p for p in PATTERNS if p.query in only])


def obs_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observation.rows(_triples(spark, sf_dir), PATTERNS, 2)


def obs_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observation.verify(_triples(spark, sf_dir), PATTERNS)


# --- Graph operators at the tables' size -----------------------------------------------------------


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as an association of its customer and its suppliers."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("association"), F.lit("buyer").alias("rolename"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("entity"))
    s = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("association"), F.lit("seller").alias("rolename"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("entity"))
    return o.unionByName(s.distinct())


LINKS_SQL = "links AS (SELECT o_orderkey AS association, 'buyer' AS rolename, 'C' || o_custkey AS entity FROM orders UNION ALL SELECT DISTINCT l_orderkey, 'seller', 'S' || l_suppkey FROM lineitem)"


def co_participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.co_participants(_links(spark, sf_dir))


def partof_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.part_pairs(_links(spark, sf_dir), "buyer", "seller")


def centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("a"), F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("b"))
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("a"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("b"))
    parts = table(spark, sf_dir, "orders").select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("entity"))
    return analysis.centrality(c.unionByName(s), parts)


CENTRALITY_SQL = """WITH e AS (SELECT 'N' || c_nationkey AS a, 'C' || c_custkey AS b FROM customer UNION ALL SELECT 'N' || s_nationkey, 'S' || s_suppkey FROM supplier),
  near AS (SELECT entity, count(DISTINCT x) AS n FROM (SELECT a AS entity, b AS x FROM e UNION ALL SELECT b, a FROM e) GROUP BY entity),
  parts AS (SELECT 'C' || o_custkey AS entity, count(*) AS n FROM orders GROUP BY 1)
  SELECT coalesce(near.entity, parts.entity) AS entity, coalesce(near.n, 0)::BIGINT AS neighbours, coalesce(parts.n, 0)::BIGINT AS compositions, (coalesce(near.n, 0) + coalesce(parts.n, 0))::BIGINT AS degree
  FROM near FULL JOIN parts ON near.entity = parts.entity"""


def individual_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observation.individual_names(table(spark, sf_dir, "events").select(F.col("event_type").alias("characteristic"), F.col("event_id").alias("seq")))


def specializes_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer -> nation -> region -> World."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    edges = c.select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("child"), F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("parent"))
    edges = edges.unionByName(n.select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("child"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("parent")))
    edges = edges.unionByName(r.select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("child"), F.lit("World").alias("parent")))
    return ancestors(edges)


CLOSURE_SQL = """WITH RECURSIVE e(child, parent) AS (SELECT 'C' || c_custkey, 'N' || c_nationkey FROM customer UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation UNION ALL SELECT 'R' || r_regionkey, 'World' FROM region),
  t(child, ancestor, depth) AS (SELECT child, parent, 1 FROM e UNION SELECT t.child, e.parent, t.depth + 1 FROM t JOIN e ON t.ancestor = e.child) SELECT child, ancestor, min(depth) AS depth FROM t GROUP BY 1, 2"""


def property_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return analysis.property_usage(o.select(F.concat(F.lit("p"), F.col("o_orderkey").cast("string")).alias("name"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("domain"), F.when(F.col("o_custkey") % 3 == 0, F.col("o_orderstatus")).alias("range"), F.when(F.col("o_totalprice") > 100000, F.lit("inv")).alias("inverse")))


def disjoint_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.disjoint_pairs(table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")))


# --- Model text ------------------------------------------------------------------------------------

MODEL = """(Vehicle, composes[1, 1], Hull, hull)
(Vehicle, composes[1, 4], Motor, motor)
(Vehicle, composes, Serial)
(Truck, specializes, Vehicle)
(Truck, composes[0, *], Motor, motor)
(Hull, composes, Place, place)
(Hull, composes, Heat, heat)
(Motor, composes, Serial, serial)
(Motor, composes, Heat, heat)
(Probe, composes, Mode, mode)
(Vehicle_PartOf_Motor, associates[1, 1][0, -1], Vehicle, assembly)
(Vehicle_PartOf_Motor, associates[1, -1][1, 1], Motor, part)
(Vehicle_PartOf_Motor, composes, Place, mount)
(Probe_Observe_Motor, associates, Probe, observer)
(Probe_Observe_Motor, associates, Vehicle_PartOf_Motor.part, observed)
(Probe_Observe_Motor, composes, Validity, validity)
(Gauge_Observe_Hull, associates, Probe)
(Gauge_Observe_Hull, associates, Hull, observed)
(Gauge_Observe_Hull, composes, Validity)
(Car, specializes, Truck)
(Probe, specializes, Device)"""

#: Individuals of observables; one path has a step that the model does not know.
INSTANCES = """
(Place, instance, Vehicle.hull.place, place)
(Heat, instance, Vehicle->assembly[Vehicle_PartOf_Motor].part.heat, heat)
(Heat, instance, Probe_Observe_Motor.observed.heat, heat_1)
(Size, instance, Vehicle.wheel.size, size)"""

MODEL_QUERIES = [
    "SELECT hull.place, Vehicle.serial FROM Vehicle JOIN Hull AS hull ON Vehicle.hull",
    "SELECT m.heat, o.validity, p.mode FROM Vehicle AS v JOIN Vehicle_PartOf_Motor AS vp ON vp.assembly = v JOIN Motor AS m ON vp.part AND v.motor JOIN Probe_Observe_Motor AS o ON o.observed = m JOIN Probe AS p ON o.observer",
    "SELECT * FROM Motor",
]
PATHS = ["Vehicle.hull.place", "Vehicle->assembly[Vehicle_PartOf_Motor].part.heat", "Vehicle.motor->observed[Probe_Observe_Motor].observer.mode", "Vehicle.wheel.size", "Motor", "Probe->observer[Probe_Observe_Motor].validity"]


def _lines(text: str) -> str:
    return "lines(seq, line) AS (VALUES " + ", ".join(f"({i}, '{x}')" for i, x in enumerate(text.split("\n"))) + ")"


_TUPLES = r""",
  cells AS (SELECT seq, list_transform(regexp_extract_all(line[2:-2], '(?:\[[^\]]*\]|[^,\[])+'), lambda x: trim(x)) AS c FROM lines),
  tuples AS (SELECT seq, c[1] AS subject, trim(regexp_extract(c[2], '^[^\[]*')) AS predicate, c[3] AS object_raw, c[2] AS spec,
    coalesce(c[4], lower(regexp_extract(c[3], '([A-Za-z_0-9]+)$', 1)[1]) || regexp_extract(c[3], '([A-Za-z_0-9]+)$', 1)[2:]) AS rolename,
    list_filter(list_transform(string_split_regex(regexp_replace(regexp_extract(c[2], '\[.*$'), '[\[\]]+', ',', 'g'), ','), lambda x: trim(x)), lambda x: x <> '') AS given FROM cells),
  model AS (SELECT seq, subject, predicate, object_raw, rolename, CASE WHEN len(given) > 0 THEN given WHEN predicate = 'composes' THEN ['1', '1'] WHEN predicate = 'associates' THEN ['-1', '-1', '-1', '-1'] END AS mult,
    CASE WHEN predicate IN ('associates', 'instance') THEN regexp_extract(object_raw, '^[A-Za-z_0-9]+') ELSE object_raw END AS object, predicate NOT IN ('associates', 'instance') OR NOT regexp_matches(object_raw, '[.>]') AS direct FROM tuples),
  facts AS (SELECT * FROM model WHERE predicate <> 'instance'),
  kinds AS (SELECT subject AS name, CASE WHEN bool_or(predicate = 'associates') THEN 'association' ELSE 'entity' END AS kind FROM facts GROUP BY subject
    UNION ALL SELECT DISTINCT object_raw, 'observable' FROM facts WHERE predicate <> 'associates' AND object_raw NOT IN (SELECT subject FROM facts))"""
TUPLES_SQL = _lines(MODEL) + _TUPLES
_ALL_SQL = _lines(MODEL + INSTANCES) + _TUPLES

# Where paths lead: first the roles of direct objects, then those whose objects are paths, then the paths asked for.
_STEPS = r"regexp_extract_all({x}, '(\.[A-Za-z_0-9]+|->[A-Za-z_0-9]+\[[A-Za-z_0-9]+\])')"


def _walk_sql(name: str, source: str, roles: str, stay: bool = False) -> str:
    """name(path, steps, n, here): where each path of source stands after n steps; null after an unknown one, or (stay) where it was."""
    return f"""{name}(path, steps, n, here) AS (SELECT path, {_STEPS.format(x='path')}, 0, regexp_extract(path, '^[A-Za-z_0-9]+') FROM {source}
    UNION ALL SELECT w.path, w.steps, w.n + 1, CASE WHEN starts_with(w.steps[w.n + 1], '->') THEN regexp_extract(w.steps[w.n + 1], '\\[(.*)\\]', 1) ELSE {'coalesce(r.leads, w.here)' if stay else 'r.leads'} END
      FROM {name} w LEFT JOIN {roles} r ON r.subject = w.here AND '.' || r.rolename = w.steps[w.n + 1] WHERE w.n < len(w.steps))"""


def _roles_sql(paths: str, stay: bool = False) -> str:
    """CTEs after tuples: roles(subject, rolename, leads, predicate) and walk over paths(path)."""
    return f"""first_role AS (SELECT subject, rolename, arg_min(object, seq) AS leads, arg_min(predicate, seq) AS predicate, arg_min(direct, seq) AS direct, arg_min(object_raw, seq) AS path FROM facts WHERE predicate IN ('composes', 'associates') GROUP BY ALL),
  plain AS (SELECT * FROM first_role WHERE direct), far AS (SELECT DISTINCT path FROM first_role WHERE NOT direct), {_walk_sql('inner_walk', 'far', 'plain')},
  roles AS (SELECT subject, rolename, leads, predicate FROM plain UNION ALL SELECT f.subject, f.rolename, coalesce(w.here, regexp_extract(path, '([A-Za-z_0-9]+)(?:\\[.*)?$', 1)), f.predicate FROM first_role f JOIN inner_walk w USING (path) WHERE NOT f.direct AND w.n = len(w.steps)),
  {paths}, {_walk_sql('walk', 'paths', 'roles', stay)}"""


_HOPS_SQL = """hops AS (SELECT w.path, w.n::INT AS ord, 'has' || w.here || CASE WHEN starts_with(step, '->') THEN 'Participant_' ELSE 'Composition_' END || role AS property, len(w.steps) AS steps,
    CASE WHEN starts_with(step, '->') THEN regexp_extract(step, '\\[(.*)\\]', 1) ELSE r.leads END AS target, CASE WHEN starts_with(step, '->') THEN 'isParticipantIn' ELSE coalesce(r.predicate, 'associates') END AS upper
    FROM (SELECT *, steps[n + 1] AS step, regexp_extract(steps[n + 1], '^(?:\\.|->)([A-Za-z_0-9]+)', 1) AS role FROM walk WHERE n < len(steps) AND here IS NOT NULL) w LEFT JOIN roles r ON r.subject = w.here AND r.rolename = w.role)"""


def _model(spark: SparkSession) -> DataFrame:
    return frame(spark, MODEL)


def _whole(spark: SparkSession) -> DataFrame:
    return frame(spark, MODEL + INSTANCES)


def _bound():
    m: Model = parse_model(MODEL)
    return m, [bind(parse_query(q), m) for q in MODEL_QUERIES]


def _paths(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p,) for p in PATHS], "path string")


def model_scan(spark, sf_dir):
    return _model(spark).select("seq", "subject", "predicate", "object_raw", "rolename", F.array_join("mult", " ").alias("mult"))


def multiplicity_parse(spark, sf_dir):
    return _model(spark).select("seq", F.posexplode("mult").alias("i", "token"))


def rolename_default(spark, sf_dir):
    return _model(spark).where("predicate <> 'instance'").select("subject", "object_raw", "rolename")


def path_parse(spark, sf_dir):
    return _paths(spark).select("path", path_start(F.col("path")).alias("start"), F.posexplode(path_steps(F.col("path"))).alias("ord", "step"))


def path_render(spark, sf_dir):
    again = F.concat(path_start(F.col("path")), F.array_join(path_steps(F.col("path")), ""))
    return _paths(spark).agg(union_text(F.array_sort(F.collect_list(again))).alias("text"))


def tuple_render(spark, sf_dir):
    return analysis.tuple_text(_model(spark))


def classify(spark, sf_dir):
    return analysis.classify(_model(spark))


def type_resolve(spark, sf_dir):
    return analysis.resolve(_paths(spark), _model(spark))


def observable_of(spark, sf_dir):
    return analysis.observables(_paths(spark).where("path <> 'Motor'"), _model(spark))


def query_paths(spark, sf_dir):
    _, bound = _bound()
    rows = [(q, i, n, str(p)) for q, b in enumerate(bound) for i, (n, u) in enumerate(b.shown) for p in u.paths]
    return spark.createDataFrame(rows, "query_id int, proj int, name string, path string")


def prefix_closure(spark, sf_dir):
    steps = path_steps(F.col("path"))
    x = _paths(spark).select(path_start(F.col("path")).alias("start"), steps.alias("steps")).select("start", "steps", F.explode(F.sequence(F.lit(0), F.size("steps"))).alias("n"))
    return x.select(F.concat("start", F.array_join(F.slice("steps", F.lit(1), F.col("n")), "")).alias("prefix"), F.col("n").alias("depth")).distinct()


def path_deps(spark, sf_dir):
    # Each prefix's own shorter prefixes, kept where they are prefixes of the paths: an equi-join.
    x = prefix_closure(spark, sf_dir)
    steps = path_steps(F.col("prefix"))
    shorter = x.where("depth > 0").select(F.col("prefix").alias("path"), steps.alias("steps"), F.explode(F.sequence(F.lit(0), F.col("depth") - 1)).alias("n"))
    shorter = shorter.select("path", F.concat(path_start(F.col("path")), F.array_join(F.slice("steps", F.lit(1), F.col("n")), "")).alias("needs"))
    return shorter.join(x.select(F.col("prefix").alias("needs")), "needs").select("path", "needs")


def path_union_eq(spark, sf_dir):
    rows = [(0, ["A.b", "A.c"], ["A.c", "A.b", "A.b"]), (1, ["A.b"], ["A.b", "A.c"]), (2, [], [])]
    df = spark.createDataFrame(rows, "id int, x array<string>, y array<string>")
    return df.select("id", (F.array_sort(F.array_distinct("x")) == F.array_sort(F.array_distinct("y"))).alias("same"), (F.size(F.array_except("x", "y")) == 0).alias("within"))


def individuals(spark, sf_dir):
    _, bound = _bound()
    # The order of alternatives is that of the query's binding.
    rows = [(i, str(p)) for i, p in enumerate(p for b in bound for _, u in b.shown for p in u.paths)]
    paths = spark.createDataFrame(rows, "seq long, path string")
    x = paths.join(analysis.observables(paths.select("path").distinct(), _model(spark)), "path")
    named = observation.individual_names(x.select(F.regexp_extract("path", r"\.(\w+)$", 1).alias("characteristic"), "seq", "path", "observable"))
    return named.select("name", "path", "observable")


def entity_attributes(spark, sf_dir):
    return analysis.attributes(_model(spark))


def entity_compositions(spark, sf_dir):
    return analysis.attributes(_model(spark), entities=True)


def model_stats(spark, sf_dir):
    return analysis.model_stats(_model(spark))


def query_stats(spark, sf_dir):
    rows = [(i, len(b.shown), len(b.query.joins), sum(len(j.on) for j in b.query.joins)) for i, b in enumerate(_bound()[1])]
    df = spark.createDataFrame(rows, "query_id int, projections int, joins int, conditions int")
    return df.agg(F.count("*").alias("queries"), *(f(c).alias(f"{n}_{c}") for c in ("projections", "joins", "conditions") for n, f in (("sum", F.sum), ("avg", F.avg), ("max", F.max))))


def sparql_stats(spark, sf_dir):
    m, bound = _bound()
    rows = [(x.query, x.proj, x.branch, x.p, x.o) for x in patterns(bound, m)]
    df = spark.createDataFrame(rows, "query_id int, proj int, branch int, p string, o string")
    return df.groupBy("query_id").agg(F.count_distinct("proj").alias("vars"), F.count("*").alias("triples"))


def sparql_summary(spark, sf_dir):
    return sparql_stats(spark, sf_dir).agg(F.count("*").alias("queries"), *(f(c).alias(f"{n}_{c}") for c in ("vars", "triples") for n, f in (("sum", F.sum), ("avg", F.avg), ("max", F.max))))


def composition_detail(spark, sf_dir):
    return analysis.composition_detail(_model(spark))


def pattern_assoc(spark, sf_dir):
    names = analysis.classify(_model(spark)).where("kind = 'association'")
    return names.select("name", F.contains("name", F.lit("_Observe_")).alias("observes"), F.contains("name", F.lit("_PartOf_")).alias("part_of"))


def model_centrality(spark, sf_dir):
    return analysis.model_centrality(_model(spark))


def local_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", local_name(F.col("url")).alias("name"))


def latex(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", latex_escape(F.concat(F.lit("{\\^~%$&_}"), "p_brand", F.lit("_"), "p_type")).alias("text"))


def owl_triples(spark, sf_dir):
    return ontology.triples(_whole(spark))


def owl_restrictions(spark, sf_dir):
    m = _model(spark)
    parents = m.where("predicate = 'specializes'").select(F.col("subject").alias("child"), F.col("object_raw").alias("parent"))
    return analysis.restrictions(m, ancestors(parents))


def ontology_stats(spark, sf_dir):
    return ontology.stats(ontology.triples(_whole(spark)))


def hop_properties(spark, sf_dir):
    return analysis.hop_rows(_paths(spark).where("path <> 'Motor'"), _model(spark))


def associations_of(spark, sf_dir):
    return analysis.associations_of(_model(spark))


def top_central(spark, sf_dir):
    """The customer or nation of the highest degree; of several the one that comes first by name."""
    ranked = centrality(spark, sf_dir).withColumn("place", F.regexp_extract("entity", r"(\d+)$", 1).cast("long") * 4 + F.expr("locate(substr(entity, 1, 1), 'CNS')"))
    return analysis.top_first(ranked, "entity", "degree", "place")


def disjoint_links(spark, sf_dir):
    """Disjoint pairs from either side, and back to one row a pair."""
    pairs = disjoint_pairs(spark, sf_dir)
    ways = analysis.both_ways(pairs)
    back = analysis.one_way(ways).select(F.col("a").alias("name"), F.col("b").alias("other"), F.lit("once").alias("kind"))
    return ways.withColumn("kind", F.lit("each")).unionByName(back)


def latex_queries(spark, sf_dir):
    """Page addresses of many lines as LaTeX, cut to eight lines."""
    return table(spark, sf_dir, "pages").select("page_id", latex_query(F.replace(F.col("url"), F.lit("/"), F.lit("\n"))).alias("text"))


def progressive_queries(spark, sf_dir):
    rows = [(i, text, shows) for i, (text, shows) in enumerate(progressive(parse_model(MODEL), "Vehicle"))]
    return spark.createDataFrame(rows, "ord int, text string, shows string")


def model_mermaid(spark, sf_dir):
    return analysis.mermaid(_model(spark))


_V = [
    model_scan, multiplicity_parse, rolename_default, path_parse, path_render, tuple_render, classify, type_resolve, observable_of, query_paths, prefix_closure, path_deps, path_union_eq, individuals, entity_attributes, entity_compositions,
    model_stats, query_stats, sparql_stats, composition_detail, pattern_assoc, model_centrality, owl_triples, owl_restrictions, ontology_stats, hop_properties, model_mermaid,
    sparql_summary, associations_of, top_central, disjoint_links, latex_queries, progressive_queries,
]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{name: _instance(text) for name, (text, _) in INSTANCE.items()},
    "obs_triples": _triples, "obs_match": _match([0, 2, 3]), "obs_match_union": _match([1]), "obs_rows": obs_rows, "obs_verify": obs_verify,
    "centrality": centrality, "co_participants": co_participants, "partof_pairs": partof_pairs, "individual_names": individual_names,
    "specializes_closure": specializes_closure, "property_usage": property_usage, "disjoint_pairs": disjoint_pairs, "local_name": local_names, "latex_escape": latex,
    **{f.__name__: f for f in _V},
    **document_queries.QUERIES,
}

_P = "paths(path) AS (VALUES " + ", ".join(f"('{p}')" for p in PATHS) + ")"
_STEP = r"regexp_extract_all(path, '(\.[A-Za-z_0-9]+|->[A-Za-z_0-9]+\[[A-Za-z_0-9]+\])')"
_W = f"WITH {TUPLES_SQL} "
# Worked by hand from the texts above.
_BOUND = [
    (0, 0, "place", "Vehicle.hull.place"), (0, 1, "serial", "Vehicle.serial"),
    (1, 0, "heat", "Vehicle->assembly[Vehicle_PartOf_Motor].part.heat"), (1, 0, "heat", "Vehicle.motor.heat"),
    (1, 1, "validity", "Vehicle->assembly[Vehicle_PartOf_Motor].part->observed[Probe_Observe_Motor].validity"), (1, 1, "validity", "Vehicle.motor->observed[Probe_Observe_Motor].validity"),
    (1, 2, "mode", "Vehicle->assembly[Vehicle_PartOf_Motor].part->observed[Probe_Observe_Motor].observer.mode"), (1, 2, "mode", "Vehicle.motor->observed[Probe_Observe_Motor].observer.mode"),
    (2, 0, "heat", "Motor.heat"), (2, 1, "serial", "Motor.serial"),
]

ORACLES: dict[str, str] = {
    **{name: sql for name, (_, sql) in INSTANCE.items()},
    "obs_triples": f"WITH {TRIPLES_SQL} SELECT s, p, o FROM triples",
    "obs_match": f"WITH {TRIPLES_SQL}, {MATCH_SQL} SELECT query_id, proj, branch, s FROM matches WHERE query_id IN (0, 2, 3)",
    "obs_match_union": f"WITH {TRIPLES_SQL}, {MATCH_SQL} SELECT query_id, proj, branch, s FROM matches WHERE query_id = 1",
    "obs_rows": f"WITH {TRIPLES_SQL}, {MATCH_SQL} SELECT a.s AS obs_0, b.s AS obs_1 FROM matches a, matches b WHERE a.query_id = 2 AND b.query_id = 2 AND a.proj = 0 AND b.proj = 1",
    "obs_verify": f"WITH {TRIPLES_SQL}, {MATCH_SQL} {VERIFY_SQL}",
    "centrality": CENTRALITY_SQL,
    "co_participants": f"WITH {LINKS_SQL} SELECT a.association, a.entity, b.entity AS other FROM links a JOIN links b ON a.association = b.association AND a.rolename <> b.rolename",
    "partof_pairs": f"WITH {LINKS_SQL} SELECT a.association, a.entity AS buyer, b.entity AS seller FROM links a JOIN links b USING (association) WHERE a.rolename = 'buyer' AND b.rolename = 'seller'",
    "individual_names": "SELECT event_type AS characteristic, event_id AS seq, CASE WHEN n = 0 THEN event_type ELSE event_type || '_' || n END AS name FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS n FROM events)",
    "specializes_closure": CLOSURE_SQL,
    "property_usage": "SELECT *, ((domain IS NOT NULL)::INT + (range IS NOT NULL)::INT + (inverse IS NOT NULL)::INT)::INT AS score FROM (SELECT 'p' || o_orderkey AS name, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS domain, CASE WHEN o_custkey % 3 = 0 THEN o_orderstatus END AS range, CASE WHEN o_totalprice > 100000 THEN 'inv' END AS inverse FROM orders)",
    "disjoint_pairs": "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_name < b.n_name",
    "local_name": "SELECT page_id, CASE WHEN contains(url, '#') THEN string_split(url, '#')[-1] ELSE string_split(url, '/')[-1] END AS name FROM pages",
    "latex_escape": r"SELECT p_partkey, '\{\textbackslash\{\}\textasciicircum{}\textasciitilde{}\%\$\&\_\}' || replace(replace(p_brand || '_' || p_type, '#', '\#'), '_', '\_') AS text FROM part",
    "model_scan": _W + "SELECT seq, subject, predicate, object_raw, rolename, array_to_string(mult, ' ') AS mult FROM model",
    "multiplicity_parse": _W + "SELECT seq, (unnest(range(len(mult))))::INT AS i, unnest(mult) AS token FROM model WHERE mult IS NOT NULL",
    "rolename_default": _W + "SELECT subject, object_raw, rolename FROM model",
    "path_parse": f"WITH {_P} SELECT path, regexp_extract(path, '^[A-Za-z_0-9]+') AS start, unnest(range(len({_STEP})))::INT AS ord, unnest({_STEP}) AS step FROM paths",
    "path_render": f"WITH {_P} SELECT '{{' || string_agg(path, ' | ' ORDER BY path) || '}}' AS text FROM paths",
    "tuple_render": _W + "SELECT seq, '(' || subject || ', ' || predicate || CASE WHEN len(mult) >= 4 THEN '[' || mult[1] || ', ' || mult[2] || '][' || mult[3] || ', ' || mult[4] || ']' WHEN len(mult) >= 2 THEN '[' || mult[1] || ', ' || mult[2] || ']' ELSE '' END || ', ' || object_raw || ', ' || rolename || ')' AS line FROM model",
    "classify": _W + "SELECT name, kind FROM kinds",
    "type_resolve": f"WITH RECURSIVE {TUPLES_SQL}, {_roles_sql(_P)} SELECT path, here AS type FROM walk WHERE n = len(steps)",
    "observable_of": f"WITH RECURSIVE {TUPLES_SQL}, {_roles_sql(_P)} SELECT w.path, coalesce((SELECT arg_min(object_raw, seq) FROM facts m WHERE m.predicate = 'composes' AND m.subject = w.here AND '.' || m.rolename = w.steps[len(w.steps)]), regexp_extract(w.path, '([A-Za-z_0-9]+)$', 1)) AS observable FROM walk w WHERE len(w.steps) > 0 AND n = len(steps) - 1",
    "query_paths": "SELECT * FROM (VALUES " + ", ".join(map(repr, _BOUND)) + ") t(query_id, proj, name, path)",
    "prefix_closure": f"WITH {_P}, s AS (SELECT regexp_extract(path, '^[A-Za-z_0-9]+') AS start, {_STEP} AS steps FROM paths), x AS (SELECT start, steps, unnest(range(len(steps) + 1)) AS n FROM s) SELECT DISTINCT start || array_to_string(steps[1:n], '') AS prefix, n::INT AS depth FROM x",
    "path_deps": f"WITH {_P}, s AS (SELECT regexp_extract(path, '^[A-Za-z_0-9]+') AS start, {_STEP} AS steps FROM paths), x AS (SELECT start, steps, unnest(range(len(steps) + 1)) AS n FROM s), y AS (SELECT start, steps, n, unnest(range(n)) AS m FROM x) SELECT DISTINCT start || array_to_string(steps[1:n], '') AS path, start || array_to_string(steps[1:m], '') AS needs FROM y",
    "path_union_eq": "SELECT id, list_sort(list_distinct(x)) = list_sort(list_distinct(y)) AS same, len(list_filter(x, lambda e: NOT list_contains(y, e))) = 0 AS within FROM (VALUES (0, ['A.b', 'A.c'], ['A.c', 'A.b', 'A.b']), (1, ['A.b'], ['A.b', 'A.c']), (2, []::VARCHAR[], []::VARCHAR[])) t(id, x, y)",
    "entity_attributes": _W + "SELECT subject, rolename, object_raw AS object FROM model WHERE predicate = 'composes' AND object_raw NOT IN (SELECT subject FROM model)",
    "entity_compositions": _W + "SELECT subject, rolename, object_raw AS object FROM model WHERE predicate = 'composes' AND object_raw IN (SELECT subject FROM model)",
    "model_stats": _W + "SELECT (SELECT count(*) FROM kinds WHERE kind = 'entity') AS entities, (SELECT count(*) FROM kinds WHERE kind = 'association') AS associations, (SELECT count(*) FROM kinds WHERE kind = 'observable') AS observables, count(*) FILTER (predicate = 'composes') AS compositions, count(*) FILTER (predicate = 'associates') AS participants, count(*) FILTER (predicate = 'specializes') AS generalizations FROM model",
    "query_stats": "SELECT count(*) AS queries, " + ", ".join(f"{f}({c})::{'DOUBLE' if f == 'avg' else 'BIGINT' if f == 'sum' else 'INT'} AS {f}_{c}" for c in ("projections", "joins", "conditions") for f in ("sum", "avg", "max")) + " FROM (VALUES (2, 1, 1), (3, 4, 5), (2, 0, 0)) t(projections, joins, conditions)",
    "sparql_stats": "SELECT query_id, vars::BIGINT AS vars, triples::BIGINT AS triples FROM (VALUES (0, 2, 7), (1, 3, 33), (2, 2, 6)) t(query_id, vars, triples)",
    "composition_detail": _W + "SELECT subject, count(*) AS n, string_agg(rolename || ':' || object_raw, ', ' ORDER BY seq) AS detail FROM model WHERE predicate = 'composes' GROUP BY subject",
    "pattern_assoc": _W + "SELECT name, contains(name, '_Observe_') AS observes, contains(name, '_PartOf_') AS part_of FROM kinds WHERE kind = 'association'",
    "model_centrality": _W + ", e AS (SELECT subject AS a, object AS b FROM model WHERE predicate = 'associates'), near AS (SELECT entity, count(DISTINCT x) AS n FROM (SELECT a AS entity, b AS x FROM e UNION ALL SELECT b, a FROM e) GROUP BY 1), parts AS (SELECT subject AS entity, count(*) AS n FROM model WHERE predicate = 'composes' GROUP BY 1) SELECT coalesce(near.entity, parts.entity) AS entity, coalesce(near.n, 0)::BIGINT AS neighbours, coalesce(parts.n, 0)::BIGINT AS compositions, (coalesce(near.n, 0) + coalesce(parts.n, 0))::BIGINT AS degree FROM near FULL JOIN parts ON near.entity = parts.entity",
    "owl_triples": _W + "SELECT DISTINCT * FROM (SELECT * FROM (VALUES ('Entity', 'a', 'Class'), ('Association', 'a', 'Class'), ('Observable', 'a', 'Class'), ('Observation', 'a', 'Class'), ('Association', 'subClassOf', 'Entity')) t(s, p, o) UNION ALL SELECT name, 'a', 'Class' FROM kinds UNION ALL SELECT name, 'subClassOf', upper(kind[1]) || kind[2:] FROM kinds WHERE name NOT IN (SELECT subject FROM model WHERE predicate = 'specializes') UNION ALL SELECT subject, 'subClassOf', object_raw FROM model WHERE predicate = 'specializes' UNION ALL SELECT rolename, 'subPropertyOf', predicate FROM model WHERE predicate IN ('composes', 'associates'))",
    "owl_restrictions": f"WITH RECURSIVE {TUPLES_SQL}, {_roles_sql('paths AS (SELECT DISTINCT object_raw AS path FROM facts WHERE predicate = $$associates$$ AND NOT direct)')}, "
    "typed AS (SELECT m.subject, m.predicate, m.mult, CASE WHEN m.direct THEN m.object ELSE coalesce(w.here, regexp_extract(m.object_raw, '([A-Za-z_0-9]+)$', 1)) END AS object FROM facts m LEFT JOIN walk w ON NOT m.direct AND w.path = m.object_raw AND w.n = len(w.steps) WHERE m.predicate IN ('composes', 'associates')), "
    "up(child, ancestor) AS (SELECT subject, object_raw FROM model WHERE predicate = 'specializes' UNION SELECT up.child, m.object_raw FROM up JOIN model m ON m.subject = up.ancestor AND m.predicate = 'specializes'), "
    "d AS (SELECT subject, predicate, object, TRY_CAST(mult[1] AS INT) AS lo0, TRY_CAST(mult[2] AS INT) AS hi0 FROM typed m WHERE NOT EXISTS (SELECT 1 FROM up JOIN typed a ON a.subject = up.ancestor WHERE up.child = m.subject AND a.predicate = m.predicate AND a.object = m.object)), "
    "b AS (SELECT subject, predicate, object, CASE WHEN lo0 >= 0 THEN lo0 END AS lo, CASE WHEN hi0 >= 0 THEN hi0 END AS hi FROM d) "
    "SELECT DISTINCT subject AS class, predicate AS property, object AS on_class, kind, n FROM (SELECT *, 'exact' AS kind, lo AS n FROM b WHERE lo = hi UNION ALL SELECT *, 'min', lo FROM b WHERE lo IS DISTINCT FROM hi AND lo IS NOT NULL UNION ALL SELECT *, 'max', hi FROM b WHERE lo IS DISTINCT FROM hi AND hi IS NOT NULL)",
    "model_mermaid": _W + "SELECT -1 AS ord, 'classDiagram' AS line UNION ALL SELECT seq, CASE predicate WHEN 'specializes' THEN '  ' || object || ' <|-- ' || subject WHEN 'composes' THEN '  ' || subject || ' *-- ' || object || ' : ' || rolename ELSE '  ' || subject || ' --> ' || object || ' : ' || rolename END FROM model",
}
_SEEN_SQL = "coalesce((SELECT arg_min(object_raw, seq) FROM facts m WHERE m.predicate = 'composes' AND m.subject = w.here AND '.' || m.rolename = w.steps[len(w.steps)]), regexp_extract(w.path, '([A-Za-z_0-9]+)$', 1))"
_INST = "inst AS (SELECT subject AS class, rolename AS name, object_raw AS path FROM model WHERE predicate = 'instance'), paths AS (SELECT DISTINCT path FROM inst)"
_OWL_SQL = f"""WITH RECURSIVE {_ALL_SQL}, {_roles_sql(_INST, True)}, {_HOPS_SQL},
  up(child, ancestor) AS (SELECT subject, object_raw FROM facts WHERE predicate = 'specializes' UNION SELECT up.child, m.object_raw FROM up JOIN facts m ON m.subject = up.ancestor AND m.predicate = 'specializes'),
  t AS (
    SELECT * FROM (VALUES ('composes', 'a', 'ObjectProperty'), ('composes', 'domain', 'Entity'), ('composes', 'rangeUnion', 'Entity'), ('composes', 'rangeUnion', 'Observable'), ('isComposedBy', 'a', 'ObjectProperty'), ('isComposedBy', 'inverseOf', 'composes'),
      ('associates', 'a', 'ObjectProperty'), ('associates', 'domain', 'Association'), ('associates', 'rangeUnion', 'Entity'), ('associates', 'rangeUnion', 'Observable'), ('isParticipantIn', 'a', 'ObjectProperty'), ('isParticipantIn', 'inverseOf', 'associates'),
      ('hasContextRoot', 'a', 'ObjectProperty'), ('hasContext', 'a', 'ObjectProperty'), ('hasObservable', 'a', 'ObjectProperty'), ('hasObservable', 'domain', 'Observation'), ('hasObservable', 'range', 'Observable'),
      ('Entity', 'a', 'Class'), ('Association', 'a', 'Class'), ('Association', 'subClassOf', 'Entity'), ('Observable', 'a', 'Class'), ('Observation', 'a', 'Class')) x(s, p, o)
    UNION SELECT name, 'a', 'Class' FROM kinds
    UNION SELECT name, 'subClassOf', upper(kind[1]) || kind[2:] FROM kinds WHERE kind = 'observable' OR name NOT IN (SELECT child FROM up WHERE ancestor IN ('Entity', 'Association') OR ancestor IN (SELECT subject FROM facts))
    UNION SELECT subject, 'subClassOf', object_raw FROM facts WHERE predicate = 'specializes'
    UNION SELECT name, 'memberOf', 'AllDisjointClasses' FROM kinds WHERE kind = 'observable'
    UNION SELECT rolename, 'a', 'ObjectProperty' FROM facts WHERE predicate = 'associates'
    UNION SELECT regexp_extract(x, '^(?:\\.|->)([A-Za-z_0-9]+)', 1), 'a', 'ObjectProperty' FROM (SELECT unnest({_STEPS.format(x='object_raw')}) AS x FROM facts WHERE predicate = 'associates')
    UNION SELECT name, 'a', 'NamedIndividual' FROM inst UNION SELECT name, 'type', 'Observation' FROM inst UNION SELECT name, 'hasObservable', class FROM inst
    UNION SELECT name, property, target FROM inst JOIN hops USING (path) WHERE target IS NOT NULL
    UNION SELECT property, 'a', 'ObjectProperty' FROM hops UNION SELECT property, 'subPropertyOf', upper FROM hops
    UNION SELECT name, 'has' || regexp_extract(path, '^[A-Za-z_0-9]+'), regexp_extract(path, '^[A-Za-z_0-9]+') FROM inst
    UNION SELECT 'has' || regexp_extract(path, '^[A-Za-z_0-9]+'), 'a', 'ObjectProperty' FROM inst UNION SELECT 'has' || regexp_extract(path, '^[A-Za-z_0-9]+'), 'subPropertyOf', 'hasContextRoot' FROM inst)"""
_N = lambda c: f"count(*) FILTER ({c})"

ORACLES |= {
    "owl_triples": _OWL_SQL + " SELECT s, p, o FROM t",
    "ontology_stats": _OWL_SQL + f""" SELECT {_N("o = 'Class' OR p IN ('memberOf', 'rangeUnion')")} AS classes, {_N("o = 'Class'")} AS declared_classes, {_N("o = 'ObjectProperty'")} AS object_properties, 0::BIGINT AS datatype_properties, {_N("o = 'NamedIndividual'")} AS individuals,
      {_N("p = 'subClassOf'")} AS subclass_relations, {_N("p = 'domain'")} AS property_domains, {_N("p = 'range'")} AS property_ranges, {_N("p = 'inverseOf'")} AS inverse_properties, (SELECT count(*) FROM kinds a, kinds b WHERE a.kind = 'observable' AND b.kind = 'observable' AND a.name < b.name) AS disjoint_classes FROM t""",
    "hop_properties": f"WITH RECURSIVE {TUPLES_SQL}, {_roles_sql(_P)}, {_HOPS_SQL} SELECT path, ord, property, target, upper FROM hops WHERE ord < steps - 1",
    "individuals": f"WITH RECURSIVE {TUPLES_SQL}, {_roles_sql('shown(seq, path) AS (VALUES ' + ', '.join(f'({i}, {p!r})' for i, (_, _, _, p) in enumerate(_BOUND)) + '), paths AS (SELECT DISTINCT path FROM shown)')} "
    f"SELECT regexp_extract(path, '([A-Za-z_0-9]+)$', 1) || CASE WHEN n = 0 THEN '' ELSE '_' || n END AS name, path, observable FROM (SELECT shown.*, (SELECT {_SEEN_SQL} FROM walk w WHERE w.path = shown.path AND w.n = len(w.steps) - 1) AS observable, row_number() OVER (PARTITION BY regexp_extract(path, '([A-Za-z_0-9]+)$', 1) ORDER BY seq) - 1 AS n FROM shown)",
    "sparql_summary": "SELECT count(*) AS queries, " + ", ".join(f"{f}({c})::{'DOUBLE' if f == 'avg' else 'BIGINT'} AS {f}_{c}" for c in ("vars", "triples") for f in ("sum", "avg", "max")) + " FROM (VALUES (2, 7), (3, 33), (2, 6)) t(vars, triples)",
    "associations_of": f"WITH RECURSIVE {TUPLES_SQL}, {_roles_sql('paths AS (SELECT DISTINCT object_raw AS path FROM facts WHERE predicate = $$associates$$ AND NOT direct)')}, d AS (SELECT * FROM facts WHERE predicate = 'associates') SELECT a.object AS entity, a.subject AS association, a.rolename, b.object AS target FROM d a JOIN d b ON a.subject = b.subject AND a.rolename <> b.rolename WHERE a.direct AND b.direct UNION ALL SELECT d.object, d.subject, d.rolename, w.here FROM d JOIN walk w ON w.path = d.object_raw AND w.n = len(w.steps) WHERE NOT d.direct AND w.here IS NOT NULL",
    "top_central": f"SELECT entity, degree FROM ({CENTRALITY_SQL}) ORDER BY degree DESC, regexp_extract(entity, '([0-9]+)$', 1)::BIGINT, entity[1] LIMIT 1",
    "disjoint_links": "SELECT a.n_name AS name, b.n_name AS other, 'each' AS kind FROM nation a JOIN nation b ON a.n_name <> b.n_name UNION ALL SELECT a.n_name, b.n_name, 'once' FROM nation a JOIN nation b ON a.n_name < b.n_name",
    "latex_queries": r"""WITH x AS (SELECT page_id, list_filter(list_transform(string_split(replace(replace(regexp_replace(replace(url, '/', chr(10)), '([{}_&%$#])', '\\\1', 'g'), '^', '\textasciicircum{}'), '~', '\textasciitilde{}'), chr(10)), lambda l: trim(l)), lambda l: l <> '') AS lines FROM pages)
      SELECT page_id, '\begin{minipage}{\linewidth}\raggedright\scriptsize ' || list_aggregate(list_transform(CASE WHEN len(lines) > 8 THEN lines[1:7] || ['...'] ELSE lines END, lambda l: '\texttt{' || l || '}'), 'string_agg', ' \\ ') || ' \end{minipage}' AS text FROM x""",
}
ORACLES |= document_queries.ORACLES
