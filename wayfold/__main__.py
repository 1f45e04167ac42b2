"""Commands: ``python -m wayfold COMMAND ...`` reads models, queries and ontologies and prints what the operators give."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.operators import analysis, observation, ontology
from wayfold.operators.closure import ancestors
from wayfold.plans.binder import bind, sparql, unbind
from wayfold.plans.grammar import QuerySyntaxError, parse_path, parse_query
from wayfold.plans.progressive import progressive
from wayfold.sources import owl, xmi, xml
from wayfold.sources.model import Model, driver_model, load, parse_model, sniff


def session() -> SparkSession:
    spark = SparkSession.builder.appName("wayfold").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _model(path: str | None) -> Model:
    if path is None:
        return Model([])
    if path.lower().endswith((".face", ".xml")):
        return driver_model(load(session(), path))
    return parse_model(Path(path).read_text(), strict=False)


def _queries(path: str) -> list:
    """The queries of a model file, in its order."""
    if not path.lower().endswith((".face", ".xml")):
        return parse_model(Path(path).read_text(), strict=False).queries
    out = []
    for r in xmi.queries(xml.elements(xml.documents(session(), path))).orderBy("seq").collect():
        try:
            out.append(parse_query(r.text, False))
        except QuerySyntaxError as e:
            print(f"query {r.name!r} is left out: {e}", file=sys.stderr)
    return out


def _lines(df: DataFrame, order: str) -> str:
    return "\n".join(r.line for r in df.orderBy(order).collect())


def _table(df: DataFrame) -> str:
    rows = df.collect()
    return "\n".join(["\t".join(df.columns), *("\t".join("" if v is None else str(v) for v in r) for r in rows)])


def with_individuals(spark: SparkSession, tuples: DataFrame, path: str) -> DataFrame:
    """tuples and an instance tuple for each alternative of what the file's queries project."""
    model = driver_model(tuples)
    paths = [str(p) for q in _queries(path) for _, u in bind(q, model, strict=False).shown for p in u.paths]
    rows = spark.createDataFrame(list(enumerate(paths)), "seq long, path string")
    seen = rows.join(analysis.observables(rows.select("path").distinct(), tuples), "path")
    named = observation.individual_names(seen.select(F.regexp_extract("path", r"\.(\w+)$", 1).alias("characteristic"), "seq", "path", "observable"))
    last = tuples.agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("last"), F.max("model_id").alias("model_id"))  # one row
    new = named.crossJoin(last).select("model_id", (F.col("seq") + F.col("last") + 1).cast("int").alias("seq"), F.col("observable").alias("subject"), F.lit("instance").alias("predicate"), F.col("path").alias("object_raw"), F.col("name").alias("rolename"), F.lit(None).cast("array<string>").alias("mult"))
    return tuples.unionByName(new)


def cmd_ontology(a: argparse.Namespace) -> str:
    spark = session()
    m = sniff(spark, a.file)
    if a.add_individuals:
        m = with_individuals(spark, m, a.file)
    parents = m.where("predicate = 'specializes'").select(F.col("subject").alias("child"), F.col("object_raw").alias("parent"))
    out = owl.rdf_xml(ontology.triples(m), analysis.restrictions(m.where("predicate <> 'instance'"), ancestors(parents)))
    if a.sparql:
        model = driver_model(m)
        Path(a.sparql).write_text("\n\n".join(sparql(bind(q, model, strict=False), model) for q in _queries(a.file)))
    return out


def cmd_paths(a: argparse.Namespace) -> str:
    model = _model(a.model)
    if any(x.split()[:1] and x.split()[0].upper() == "SELECT" for x in a.text):
        shown = (p for x in a.text for p in bind(parse_query(x), model, strict=False).shown)
        return "\n".join(f"{name}: {union}" for name, union in shown)
    groups = {name: [parse_path(p.strip()) for p in paths.split(",")] for name, paths in (j.split(":", 1) for j in a.and_join)}
    return unbind([parse_path(x) for x in a.text], model, groups).pretty()


def cmd_sparql(a: argparse.Namespace) -> str:
    model = _model(a.model)
    return sparql(bind(parse_query(a.query), model, strict=False), model, a.ns)


def cmd_individuals(a: argparse.Namespace) -> str:
    spark = session()
    m = with_individuals(spark, load(spark, a.model or a.file), a.file)
    return _lines(analysis.tuple_text(m if a.all else m.where("predicate = 'instance'")), "seq")


def cmd_tuples(a: argparse.Namespace) -> str:
    return _lines(analysis.tuple_text(load(session(), a.file)), "seq")


def cmd_query(a: argparse.Namespace) -> str:
    return parse_query(a.query).pretty()


def cmd_path(a: argparse.Namespace) -> str:
    return "\n".join([str(p := parse_path(a.path)), *(f"  {h}" for h in p.hops)])


def cmd_mermaid(a: argparse.Namespace) -> str:
    return _lines(analysis.mermaid(load(session(), a.file)), "ord")


def cmd_owl_mermaid(a: argparse.Namespace) -> str:
    return _lines(owl.mermaid(xml.elements(xml.documents(session(), a.file))), "ord")


def cmd_model_stats(a: argparse.Namespace) -> str:
    m = load(session(), a.file)
    return _table(analysis.model_stats(m)) + "\n\n" + _table(analysis.model_centrality(m).orderBy(F.desc("degree"), "entity"))


def cmd_ontology_stats(a: argparse.Namespace) -> str:
    return _table(owl.stats(xml.elements(xml.documents(session(), a.file))).drop("doc"))


def cmd_example_queries(a: argparse.Namespace) -> str:
    model = _model(a.file)
    entity = a.entity or model.tuples[0].subject
    return "\n\n".join(f"-- {shows}\n{parse_query(text).pretty()}" for text, shows in progressive(model, entity))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="wayfold", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)

    def add(name: str, run: Callable[[argparse.Namespace], str], *args: tuple) -> None:
        p = sub.add_parser(name, help=(run.__doc__ or name).split("\n")[0])
        p.set_defaults(run=run)
        p.add_argument("-o", "--output", help="write to this file")
        for names, options in args:
            p.add_argument(*names, **options)

    file, model = (["file"], {}), (["--model"], {})
    add("ontology", cmd_ontology, file, (["-a", "--add-individuals"], {"action": "store_true"}), (["-s", "--sparql"], {"help": "write the queries' patterns to this file"}))
    add("paths", cmd_paths, (["text"], {"nargs": "+"}), model, (["--and-join"], {"action": "append", "default": [], "metavar": "ALIAS:PATH,PATH"}))
    add("sparql", cmd_sparql, (["query"], {}), model, (["--ns"], {"default": owl.NAMESPACE}))
    add("individuals", cmd_individuals, file, model, (["-a", "--all"], {"action": "store_true"}))
    for name, run in (("xmi", cmd_tuples), ("tuples", cmd_tuples), ("mermaid", cmd_mermaid), ("owl-mermaid", cmd_owl_mermaid), ("model-stats", cmd_model_stats), ("ontology-stats", cmd_ontology_stats)):
        add(name, run, file)
    add("query", cmd_query, (["query"], {}))
    add("path", cmd_path, (["path"], {}))
    add("example-queries", cmd_example_queries, file, (["--entity"], {}))
    return top


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    out = a.run(a)
    if a.output:
        Path(a.output).write_text(out + "\n")
    else:
        print(out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
