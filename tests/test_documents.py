"""Files, ontologies and commands: what is read, written and read again."""

import pytest
from pyspark.sql import functions as F

from wayfold import document_queries as docs
from wayfold import queries as own
from wayfold.__main__ import main
from wayfold.functions.names import latex_escape
from wayfold.operators import analysis, observation, ontology
from wayfold.operators.closure import ancestors
from wayfold.plans.binder import bind
from wayfold.plans.grammar import parse_path, parse_query
from wayfold.plans.progressive import progressive
from wayfold.sources import owl, xmi, xml
from wayfold.sources.model import frame, load, parse_model, sniff


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("models")
    (d / "concepts.face").write_text(docs.XMI_TEXT)
    (d / "concepts.data").write_text(docs.XMI_TEXT)
    (d / "vehicle.txt").write_text(own.MODEL + "\n" + "\n".join(q + ";" for q in own.MODEL_QUERIES))
    (d / "space.owl").write_text(docs.OWL_TEXT)
    return d


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_models_by_ending_and_by_content(spark, files):
    names = ("seq", "subject", "predicate", "object_raw", "rolename")
    by_name, by_content = load(spark, str(files / "concepts.face")), sniff(spark, str(files / "concepts.data"))
    assert sorted(rows(by_name, *names)) == sorted(rows(by_content, *names))
    assert ("Thing_Observe_Motor", "Motor->assembly[Thing_PartOf_Motor].part.place") in rows(by_name, "subject", "object_raw")
    text = load(spark, str(files / "vehicle.txt"))
    assert rows(text.orderBy("seq"), *names) == rows(sniff(spark, str(files / "vehicle.txt")).orderBy("seq"), *names) == rows(frame(spark, own.MODEL).orderBy("seq"), *names)


def test_paths_without_reverse_hops(spark):
    e = docs._elements(spark, docs.XMI_TEXT)
    assert ("observed", "Motor.part.place") in rows(xmi.tuples(e, reverse=False), "rolename", "object_raw")


def test_broken_xml_names_its_document(spark):
    bad = spark.createDataFrame([("one", bytearray(b"<a><b></a>")), ("none", None)], "doc string, content binary")
    with pytest.raises(Exception, match="one: "):
        xml.elements(bad).collect()
    assert xml.elements(bad.where("doc = 'none'")).count() == 0


def test_an_ontology_written_and_read_again(spark):
    m = frame(spark, own.MODEL + own.INSTANCES)
    parents = m.where("predicate = 'specializes'").select(F.col("subject").alias("child"), F.col("object_raw").alias("parent"))
    facts = m.where("predicate <> 'instance'")
    t = ontology.triples(m)
    text = owl.rdf_xml(t, analysis.restrictions(facts, ancestors(parents)))
    again = owl.stats(docs._elements(spark, text)).first().asDict()
    want = ontology.stats(t).first().asDict()
    assert {k: want[k] for k in again if k != "doc"} == {k: v for k, v in again.items() if k != "doc"}
    assert text.count("<owl:Restriction>") == analysis.restrictions(facts, ancestors(parents)).count()


def test_a_base_without_tuples_of_its_own_is_an_observable(spark):
    m = frame(spark, "(A, composes, X)\n(A, specializes, Base)\n(B, specializes, A)")
    assert set(rows(analysis.classify(m), "name", "kind")) == {("A", "entity"), ("B", "entity"), ("X", "observable"), ("Base", "observable")}
    below = set(rows(ontology.triples(m).where("p = 'subClassOf'"), "s", "o"))
    assert below == {("A", "Entity"), ("A", "Base"), ("B", "A"), ("X", "Observable"), ("Base", "Observable")}


def test_an_empty_model_is_an_empty_ontology(spark):
    m = frame(spark, "")
    assert ontology.triples(m).count() == 0 and ontology.stats(ontology.triples(m)).first().classes == 0


def test_roles_whose_objects_are_paths_through_such_roles(spark):
    m = frame(spark, "(A, composes, B, b)\n(B, composes, C, c)\n(P, associates, A.b, near)\n(Q, associates, P.near.c, far)\n(R, associates, R.self, self)")
    paths = spark.createDataFrame([("P.near",), ("Q.far",), ("R.self",)], "path string")
    assert dict(rows(analysis.resolve(paths, m), "path", "type")) == {"P.near": "B", "Q.far": "C", "R.self": "self"}
    model = parse_model("(A, composes, B, b)\n(B, composes, C, c)\n(P, associates, A.b, near)\n(Q, associates, P.near.c, far)\n(R, associates, R.self, self)")
    assert [model.type_of(parse_path(p)) for p in ("P.near", "Q.far", "R.self", "R.none")] == ["B", "C", "self", None]


def test_individual_names_of_any_order_and_nulls(spark):
    shown = spark.createDataFrame([("x", 0), ("x", 10**17), ("x", None), (None, 5), ("y", -(2**62)), ("x", 3)], "characteristic string, seq long")
    got = {(r.characteristic, r.seq): r.name for r in observation.individual_names(shown).collect()}
    assert got == {("x", None): "x", ("x", 0): "x_1", ("x", 3): "x_2", ("x", 10**17): "x_3", (None, 5): None, ("y", -(2**62)): "y"}


def test_closure_of_any_depth(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(70)], "child string, parent string")
    assert ancestors(edges).where("child = 'n0'").count() == 70


def test_latex_escapes_braces(spark):
    got = spark.createDataFrame([("a{b}_\\~",)], "x string").select(latex_escape(F.col("x"))).first()[0]
    assert got == "a\\{b\\}\\_\\textbackslash\\{\\}\\textasciitilde{}"


PLANT = """(Plant, composes, Mass, mass)
(Plant, composes, Age, age)
(Plant, composes, Code, code)
(Boiler, composes, Heat, heat)
(HeatSensor, composes, Mode, mode)
(Valve, composes, State, state)
(Boiler_PartOf_Plant, associates, Plant, assembly)
(Boiler_PartOf_Plant, associates, Boiler, part)
(HeatSensor_PartOf_Plant, associates, Plant, assembly)
(HeatSensor_PartOf_Plant, associates, HeatSensor, part)
(Valve_PartOf_Boiler, associates, Boiler, assembly)
(Valve_PartOf_Boiler, associates, Valve, part)
(HeatSensor_Observe_Boiler, associates, HeatSensor, observer)
(HeatSensor_Observe_Boiler, associates, Boiler, observed)
(HeatSensor_Observe_Boiler, composes, Heat, seen)"""


def test_progressive_queries():
    m = parse_model(PLANT)
    got = [text for text, _ in progressive(m, "Plant")]
    part = " JOIN Boiler_PartOf_Plant ON Boiler_PartOf_Plant.assembly = Plant JOIN Boiler ON Boiler_PartOf_Plant.part = Boiler"
    assert got[0] == "SELECT age, code FROM Plant"
    assert got[1] == f"SELECT age, code, Boiler.heat FROM Plant{part}"
    assert got[2].endswith(" JOIN Valve_PartOf_Boiler ON Valve_PartOf_Boiler.assembly = Boiler JOIN Valve ON Valve_PartOf_Boiler.part = Valve") and "Valve.state" in got[2]
    assert got[3].endswith(" JOIN HeatSensor_Observe_Boiler ON HeatSensor_Observe_Boiler.observer = HeatSensor") and "HeatSensor_Observe_Boiler.seen" in got[3]
    assert [len(bind(parse_query(q), m).shown) for q in got] == [2, 3, 4, 4]
    assert progressive(m, "Nothing") == [("SELECT identifier, name FROM Nothing", "Simple selection of Nothing attributes")]


def test_top_keeps_the_first_of_equals(spark):
    df = spark.createDataFrame([("b", 3, 1), ("a", 3, 0), ("c", 2, 2)], "name string, score int, place int")
    assert rows(analysis.top_first(df, "name", "score", "place"), "name", "score") == [("a", 3)]
    assert analysis.top_first(df.limit(0), "name", "score", "place").count() == 0


@pytest.mark.parametrize(
    "command, want",
    [
        (["ontology", "{d}/vehicle.txt", "-a", "-s", "{d}/patterns.txt"], 'rdf:about="http://example.org/uddl#heat"'),
        (["paths", "SELECT m.heat FROM Vehicle AS v JOIN Motor AS m ON v.motor", "--model", "{d}/vehicle.txt"], "heat: Vehicle.motor.heat"),
        (["paths", "Vehicle.motor.heat", "--model", "{d}/vehicle.txt"], "JOIN Motor"),
        (["sparql", "SELECT heat FROM Motor", "--model", "{d}/vehicle.txt"], "?obs_0_heat :hasObservable :Heat"),
        (["individuals", "{d}/vehicle.txt"], "(Heat, instance, Motor.heat, heat_2)"),
        (["xmi", "{d}/concepts.face"], "(Motor, specializes, Thing"),
        (["tuples", "{d}/vehicle.txt"], "(Vehicle, composes[1, 4], Motor, motor)"),
        (["query", "select a from B"], "FROM B"),
        (["path", "A.b->c[D]"], "->c[D]"),
        (["mermaid", "{d}/vehicle.txt"], "Vehicle *-- Hull : hull"),
        (["owl-mermaid", "{d}/space.owl"], "Rover -->|subClassOf| Entity"),
        (["model-stats", "{d}/vehicle.txt"], "compositions"),
        (["ontology-stats", "{d}/space.owl"], "disjoint_classes"),
        (["example-queries", "{d}/vehicle.txt", "--entity", "Vehicle"], "FROM Vehicle"),
    ],
)
def test_commands(spark, files, capsys, command, want):
    assert main([x.replace("{d}", str(files)) for x in command]) == 0
    assert want in capsys.readouterr().out
