
import pytest
from pyspark.sql import functions as F

from wayfold.__main__ import with_individuals
from wayfold.operators import analysis, ontology
from wayfold.plans.binder import bind, patterns
from wayfold.sources.model import lines_of, parse_model, scan

# What each type composes beside an identifier, its participants, and the four queries of the published model.
COMPOSED = {
    "Frame": ["Temperature temperature"],
    "Sensor": [],
    "Blade": ["Angle angle", "RadiantIntensity emissivity"],
    "Louver": ["HealthState healthState"],
    "SolarPanel": ["Orientation orientation", "Position position", "OperationalState operationalState", "HealthState healthState", "ElectricPotential electricPotential"],
    "Satellite": [],
    "Sun": ["Position position"],
    "Panel": ["Temperature temperature"],
    "Battery": ["ElectricPotential electricPotential"],
    "Blade_PartOf_Louver": ["HealthState healthState"],
    "SolarPanel_IncidenceAngle_Sun": ["Angle angle"],
    "SolarPanel_Charges_Battery": ["Power power", "ElectricCurrent electricCurrent", "HealthState healthState", "Temperature temperature", "ElectricPotential electricPotential"],
}
SENSORS = {"TemperatureSensor": "elementID_1", "PositionSensor": "elementID_2", "SunSensor": "elementID"}
PARTICIPANTS = {
    "Frame_PartOf_Louver": ["Louver assembly", "Frame part"],
    "TemperatureSensor_Observe_LouverFrame": ["TemperatureSensor observer", "Frame_PartOf_Louver.part observed"],
    "PositionSensor_Observe_LouverBlade": ["PositionSensor observer", "Blade_PartOf_Louver.part observed"],
    "Blade_PartOf_Louver": ["Louver assembly", "Blade part"],
    "Frame_PartOf_SolarPanel": ["Frame part", "SolarPanel assembly"],
    "TemperatureSensor_Observe_SolarPanel": ["TemperatureSensor observer", "SolarPanel.part observed"],
    "Louver_PartOf_Satellite": ["Satellite assembly", "Louver part"],
    "SolarPanel_PartOf_Satellite": ["Satellite assembly", "SolarPanel part"],
    "SolarPanel_IncidenceAngle_Sun": ["SolarPanel solarPanel", "SolarPanel.orientation solarPanelOrientation", "Sun.position sun"],
    "Panel_PartOf_SolarPanel": ["SolarPanel assembly", "Panel part"],
    "TemperatureSensor_PartOf_Satellite": ["Satellite assembly", "TemperatureSensor part"],
    "PositionSensor_PartOf_Satellite": ["Satellite assembly", "PositionSensor part"],
    "SunSenor_PartOf_Satellite": ["Satellite assembly", "SunSensor part"],
    "Battery_PartOf_Satellite": ["Satellite assembly", "Battery part"],
    "SolarPanel_Charges_Battery": ["SolarPanel charger", "Battery charged"],
    "SunSensor_Observe_IncidenceAngle": ["SunSensor observer", "SolarPanel_IncidenceAngle_Sun observed"],
}


def _part(association, alias, whole, part, joined):
    return f" JOIN {association} AS {alias} ON {alias}.assembly = {whole} JOIN {part} AS {joined} ON {alias}.part"


def _seen(association, alias, sensor, what, joined):
    return f" JOIN {association} AS {alias} ON {alias}.observer = {sensor} JOIN {what} AS {joined} ON {alias}.observed"


_PANEL = _part("SolarPanel_PartOf_Satellite", "sp", "s", "SolarPanel", "p")
_LOUVER = _part("Louver_PartOf_Satellite", "lp", "s", "Louver", "l")
_HEAT = _part("TemperatureSensor_PartOf_Satellite", "tp", "s", "TemperatureSensor", "t")
QUERIES = [
    "SELECT p.identifier AS a, p.healthState AS b, q.temperature AS c, i.angle AS d, p.operationalState AS e FROM Satellite AS s"
    + _PANEL + _HEAT + _seen("TemperatureSensor_Observe_SolarPanel", "ts", "t", "SolarPanel", "p2") + _part("Panel_PartOf_SolarPanel", "pp", "p2", "Panel", "q")
    + _part("SunSenor_PartOf_Satellite", "up", "s", "SunSensor", "u") + _seen("SunSensor_Observe_IncidenceAngle", "us", "u", "SolarPanel_IncidenceAngle_Sun", "i"),
    "SELECT p.identifier AS a, c.temperature AS b, c.electricPotential AS c1, c.electricCurrent AS d, c.power AS e, p.healthState AS f, c.healthState AS g FROM Satellite AS s" + _PANEL + " JOIN SolarPanel_Charges_Battery AS c ON c.charger = p",
    "SELECT l.identifier AS a, f.temperature AS b, b.angle AS c, b.emissivity AS d FROM Satellite AS s"
    + _LOUVER + _HEAT + _seen("TemperatureSensor_Observe_LouverFrame", "ts", "t", "Frame_PartOf_Louver", "fl") + " JOIN Frame AS f ON fl.part"
    + _part("PositionSensor_PartOf_Satellite", "op", "s", "PositionSensor", "o") + _seen("PositionSensor_Observe_LouverBlade", "os", "o", "Blade_PartOf_Louver", "bl") + " JOIN Blade AS b ON bl.part",
    "SELECT l.identifier AS a, l.healthState AS b, bp.healthState AS c FROM Satellite AS s" + _LOUVER + " JOIN Blade_PartOf_Louver AS bp ON bp.assembly = l",
]


def _text():
    out = [f"({s}, specializes, Sensor, )" for s in SENSORS] + [f"({s}, composes[1, 1], Identifier, {r})" for s, r in SENSORS.items()]
    for s in dict.fromkeys([*COMPOSED, *PARTICIPANTS]):
        out += [f"({s}, composes[1, 1], {', '.join(x.split())})" for x in ["Identifier identifier", *COMPOSED.get(s, [])]]
        out += [f"({s}, associates[1, 1][0, -1], {', '.join(x.split())})" for x in PARTICIPANTS.get(s, [])]
    return "\n".join([*out, *(q + ";" for q in QUERIES)])


@pytest.fixture(scope="module")
def file(tmp_path_factory):
    path = tmp_path_factory.mktemp("published") / "satellite.txt"
    path.write_text(_text())
    return str(path)


def test_model_counts(spark, file):
    m = scan(lines_of(spark, file))
    s = analysis.model_stats(m).first()
    assert (s.entities, s.associations, s.compositions, s.participants, s.observables) == (12, 16, 47, 33, 11)
    degree = {r.entity: r.degree for r in analysis.model_centrality(m).collect()}
    assert degree["SolarPanel"] == 12 and degree["Satellite"] == 7 and degree["SolarPanel_Charges_Battery"] == 8
    ranked = analysis.model_centrality(m).join(analysis.classify(m).withColumnRenamed("name", "entity"), "entity").withColumn("place", F.lit(0))
    top = {k: tuple(analysis.top_first(ranked.where(F.col("kind") == k), "entity", "degree", "place").first()) for k in ("entity", "association")}
    assert top == {"entity": ("SolarPanel", 12), "association": ("SolarPanel_Charges_Battery", 8)}


def test_query_counts():
    m = parse_model(_text())
    bound = [bind(q, m) for q in m.queries]
    assert [len(b.shown) for b in bound] == [5, 7, 4, 3]
    assert [sum(len(j.on) for j in b.query.joins) for b in bound] == [12, 3, 12, 3]
    triples = [sum(p.query == i for p in patterns(bound, m)) for i in range(4)]
    assert triples == [31, 40, 26, 16] and sum(triples) == 113


def test_ontology_counts(spark, file):
    m = with_individuals(spark, scan(lines_of(spark, file)), file)
    got = ontology.stats(ontology.triples(m)).first()
    assert (got.classes, got.declared_classes, got.object_properties, got.individuals) == (58, 43, 54, 19)
    assert (got.subclass_relations, got.property_domains, got.property_ranges, got.inverse_properties, got.disjoint_classes) == (40, 3, 1, 2, 55)
