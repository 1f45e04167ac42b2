"""Grammar, binding both ways, execution in both modes, and every query against its SQL."""

import glob
import os

import duckdb
import pytest

from tests.conftest import DATA
from wayfold import queries as own
from wayfold.operators.closure import ancestors
from wayfold.plans.binder import Pattern, bind, path_patterns, sparql, unbind
from wayfold.plans.grammar import QuerySyntaxError, parse_path, parse_query
from wayfold.sources.model import parse_model

AIR = """(AirSystem, composes, AirFrame, airFrame)
(AirSystem, composes, NavigationSystem, navSystem)
(AirSystem, composes, ControlSystem, ctrlSystem)
(AirFrame, composes, Position, pos)
(NavigationSystem, composes, Mode, mode)
(ControlSystem, composes, Mode, mode)
(Observe, associates, AirFrame, observed)
(Observe, associates, NavigationSystem, observer)
(Observe, composes, Validity, validity)
(Control, associates, ControlSystem, controller)
(Control, associates, AirFrame, controlled)
(Control, composes, Validity, validity)"""
P = parse_path
SEEN = "AirSystem.navSystem->observer[Observe]"


def joins(q):
    return [(j.source.type, sorted(map(str, j.on))) for j in q.joins]


@pytest.mark.parametrize(
    "text",
    ["SELECT *, x FROM A", "SELECT DISTINCT x FROM A", "SELECT x FROM A WHERE A.x", "SELECT x FROM A, B", "SELECT x FROM A JOIN B ON A.b LEFT JOIN C ON B.c", "SELECT x", "SELECT 1 FROM A", "SELECT A..b FROM A", "SELECT x FROM A JOIN B"],
)
def test_strict_grammar_rejects(text):
    with pytest.raises(QuerySyntaxError):
        parse_query(text)


def test_lenient_grammar_passes_over():
    assert str(parse_query("SELECT x FROM A, B", strict=False)) == "SELECT x FROM A"
    assert parse_query("SELECT DISTINCT x FROM A", strict=False).projections[0].alias == "x"


def test_text_round_trip():
    q = parse_query("select all a.x as y, B.* from A as a join B on a.b and B.c = a;")
    assert parse_query(str(q)) == q == parse_query(q.pretty())


@pytest.mark.parametrize("text", ["", ".a", "A->b", "A..b", "A.b->c[", "A b"])
def test_bad_paths(text):
    with pytest.raises(QuerySyntaxError):
        parse_path(text)


@pytest.mark.parametrize("on", ["A.x = B.y", "b", "A = B"])
def test_conditions_that_are_no_step(on):
    with pytest.raises(QuerySyntaxError):
        bind(parse_query(f"SELECT B.y FROM A JOIN B ON {on}"), parse_model("(A, composes, B, b)"))


def test_bind_diamond():
    m = parse_model(AIR)
    q = parse_query("SELECT AirFrame.pos, NavigationSystem.mode FROM AirSystem JOIN NavigationSystem ON AirSystem.navSystem JOIN Observe ON Observe.observer = NavigationSystem JOIN AirFrame ON Observe.observed AND AirSystem.airFrame")
    b = bind(q, m)
    assert [str(u) for _, u in b.shown] == [f"{{{SEEN}.observed.pos | AirSystem.airFrame.pos}}", "AirSystem.navSystem.mode"]
    assert "UNION" in sparql(b, m) and "SELECT ?obs_0_pos ?obs_1_mode" in sparql(b, m)
    assert path_patterns(P(f"{SEEN}.observed.pos"), m)[2:] == [("hasAirSystem", "AirSystem"), ("hasAirSystemComposition_navSystem", "NavigationSystem"), ("hasNavigationSystemParticipant_observer", "Observe"), ("hasObserveComposition_observed", "AirFrame")]


def test_two_aliases_by_type_name_are_the_same_union():
    m = parse_model("(B, associates, A, a)\n(C, associates, A, a)\n(D, associates, B, b)\n(D, associates, C, c)")
    one = bind(parse_query("SELECT D.x FROM A JOIN B ON B.a = A JOIN C ON C.a = A JOIN D ON D.b = B AND D.c = C"), m)
    two = bind(parse_query("SELECT D.x FROM A JOIN B ON B.a = A JOIN C ON C.a = A JOIN D AS d1 ON d1.b = B JOIN D AS d2 ON d2.c = C"), m)
    assert one.shown[0][1] == two.shown[0][1]


NAV = {"AirFrame": [P(f"{SEEN}.observed"), P("AirSystem.airFrame")], "NavigationSystem": [P("AirSystem.navSystem"), P(f"{SEEN}.observer")]}
CTRL = "AirSystem.ctrlSystem->controller[Control]"
BOTH = ["AirSystem.navSystem = NavigationSystem", "Observe.observer = NavigationSystem"]


@pytest.mark.parametrize(
    "paths, together, want",
    [
        ([f"{SEEN}.observed.pos"], {}, [("NavigationSystem", BOTH[:1]), ("Observe", BOTH[1:]), ("AirFrame", ["Observe.observed = AirFrame"])]),
        ([f"{SEEN}.observed.pos"], {"AirFrame": NAV["AirFrame"]}, [("NavigationSystem", BOTH[:1]), ("Observe", BOTH[1:]), ("AirFrame", ["AirSystem.airFrame = AirFrame", "Observe.observed = AirFrame"])]),
        ([f"{SEEN}.observed.pos", f"{SEEN}.observer.mode"], NAV, [("NavigationSystem", BOTH), ("Observe", BOTH[1:]), ("AirFrame", ["AirSystem.airFrame = AirFrame", "Observe.observed = AirFrame"])]),
        ([f"{SEEN}.observed.pos", f"{SEEN}.observer.mode", f"{SEEN}.validity"], NAV, [("NavigationSystem", BOTH), ("Observe", BOTH[1:]), ("AirFrame", ["AirSystem.airFrame = AirFrame", "Observe.observed = AirFrame"])]),
        (
            [f"{CTRL}.controlled.pos", f"{CTRL}.controller.mode", f"{CTRL}.validity"],
            {"AirFrame": [P(f"{CTRL}.controlled"), P("AirSystem.airFrame")], "ControlSystem": [P("AirSystem.ctrlSystem"), P(f"{CTRL}.controller")]},
            [("ControlSystem", ["AirSystem.ctrlSystem = ControlSystem", "Control.controller = ControlSystem"]), ("Control", ["Control.controller = ControlSystem"]), ("AirFrame", ["AirSystem.airFrame = AirFrame", "Control.controlled = AirFrame"])],
        ),
    ],
)
def test_paths_to_query(paths, together, want):
    q = unbind(map(P, paths), parse_model(AIR), together)
    assert joins(q) == want
    assert len(q.projections) == len(paths)


def test_lenient_model_text():
    m = parse_model("(A, composes, B)\n(A, b)\nnonsense\n(A, composes, C, c, d)\nSELECT b FROM A\nSELECT c FROM A;\nSELECT lost FROM A", strict=False)
    assert [(t.role, t.mult) for t in m.tuples] == [("b", ("1", "1")), ("c", ("1", "1"))]
    assert [str(q) for q in m.queries] == ["SELECT c FROM A"]


def test_closure_of_a_cycle(spark):
    got = ancestors(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), (None, "x")], "child string, parent string"))
    assert got.count() == 9 and got.where("child = ancestor and depth = 3").count() == 3


def test_late_conditions_and_unary_binary_alike(spark):
    from wayfold.operators.instance import execute

    m, c = parse_model(own.TABLES), own.catalog(spark, DATA)
    rows = lambda q: sorted(map(tuple, execute(parse_query(q), m, c).collect()))
    a = rows("SELECT o.orderkey, c.name FROM Orders AS o JOIN Customer AS c ON o.customer")
    assert a == rows("SELECT o.orderkey, c.name FROM Orders AS o JOIN Customer AS c ON o.customer = c") == rows("SELECT x.orderkey, y.name FROM Orders AS x JOIN Customer AS y ON y = x.customer")
    late = "SELECT n.name, s.suppkey FROM Nation AS n JOIN Supplier AS s ON l.supplier AND s.nation = n JOIN Customer AS c ON c.nation = n JOIN Orders AS o ON o.customer = c JOIN Lineitem AS l ON l.order = o"
    assert len(rows(late)) == len(rows(own.INSTANCE["uddl_diamond"][0]))


def test_superset_individuals_match(spark):
    from wayfold.operators.observation import match, verify

    t = spark.createDataFrame([("x", "a", "O"), ("x", "h", "1"), ("x", "h", "2"), ("y", "a", "O")], "s string, p string, o string")
    ps = [Pattern(0, 0, 0, 0, "a", "O"), Pattern(0, 0, 0, 1, "h", "1"), Pattern(1, 0, 0, 0, "h", "3")]
    assert [tuple(r) for r in match(t, ps).collect()] == [(0, 0, 0, "x")]
    assert {tuple(r) for r in verify(t, ps).collect()} == {(0, True), (1, False)}


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_bindings_are_the_whole_product(spark, monkeypatch, broadcast):
    from wayfold.operators import observation

    monkeypatch.setattr(observation, "BROADCAST_ROWS", broadcast)
    ps = [Pattern(0, 0, 0, 0, "a", "x"), Pattern(0, 1, 0, 0, "a", "y"), Pattern(0, 2, 0, 0, "a", "z"), Pattern(0, 3, 0, 0, "a", "none")]
    t = spark.createDataFrame([(f"{o}{i}", "a", o) for o, n in (("x", 3400), ("y", 3300), ("z", 1)) for i in range(n)], "s string, p string, o string")
    got = observation.rows(t, ps[:3], 0)  # more than 10,000,000 rows
    assert got.columns == ["obs_0", "obs_1", "obs_2"]
    n = got.selectExpr("count(*)", "count_if(obs_0 not like 'x%' or obs_1 not like 'y%' or obs_2 <> 'z0')", "count(distinct obs_0)", "count(distinct obs_1)").first()
    assert tuple(n) == (3400 * 3300, 0, 3400, 3300)
    few = observation.rows(t.where("o <> 'x' or s < 'x12'"), [*ps[2::-1]], 0).where("obs_1 < 'y11'").collect()
    assert len(few) == len(set(few)) == sum(f"x{i}" < "x12" for i in range(3400)) * sum(f"y{i}" < "y11" for i in range(3300))
    assert observation.rows(t, ps, 0).count() == 0 and observation.rows(t, ps, 0).columns == ["obs_0", "obs_1", "obs_2", "obs_3"]
    with pytest.raises(ValueError, match="11220000 combinations"):
        observation.rows(t, ps[:3], 0, most=10_000_000)


@pytest.mark.parametrize("name", sorted(own.QUERIES))
def test_query_against_sql(spark, name):
    df = own.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    tidy = lambda v: round(v, 6) if isinstance(v, float) else v
    got = sorted(repr([tidy(v) for v in r]) for r in df.select(*columns).collect())
    if name not in own.ORACLES:
        assert got
        return
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    r = c.execute(own.ORACLES[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == columns
    assert got == sorted(repr([tidy(row[names.index(x)]) for x in columns]) for row in r.fetchall())
