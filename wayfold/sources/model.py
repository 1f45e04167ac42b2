"""Conceptual models: tuple files as DataFrames, and their driver-side form for binding queries.

A line is ``(Subject, predicate[lo, hi][lo, hi], Object-or-path, rolename)``; a query runs from a line that starts
with SELECT to one with a semicolon. ``scan`` reads files on the executors, one row a tuple, in file order (seq);
every lookup in a model takes the first match by seq.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions.names import default_role, multiplicities
from wayfold.plans.grammar import PathExpr, Query, QuerySyntaxError, parse_path, parse_query
from wayfold.sources import xmi, xml

#: Splits at commas outside brackets.
COMMA = r",(?![^\[]*\])"


@dataclass(frozen=True)
class Tuple_:
    seq: int
    subject: str
    predicate: str
    object: str
    role: str | None
    mult: tuple[str, ...] | None

    @property
    def path(self) -> PathExpr | None:
        """The object as a path, where the predicate takes one."""
        if self.predicate not in ("associates", "instance") or not self.object:
            return None
        try:
            return parse_path(self.object)
        except QuerySyntaxError:
            return None

    @property
    def start(self) -> str:
        p = self.path
        return p.start if p else self.object


class Model:
    """Tuples in file order, with lookups by subject and role."""

    def __init__(self, tuples: Iterable[Tuple_], queries: Iterable[Query] = ()):
        self.tuples, self.queries = list(tuples), list(queries)
        self.by_role: dict[tuple[str, str], Tuple_] = {}
        for t in self.tuples:
            if t.role is not None and t.predicate in ("composes", "associates"):
                self.by_role.setdefault((t.subject, t.role), t)

    def find(self, subject: str, role: str) -> Tuple_ | None:
        return self.by_role.get((subject, role))

    def type_of(self, path: PathExpr, mode: str = "final") -> str | None:
        """The type that a path leads to; None where a step is unknown. mode: an association's path object counts by where
        it leads (final), where it starts (start), or its last name (leaf)."""
        at: str | None = path.start
        for hop in path.hops:
            at = hop.assoc if hop.assoc is not None else self.leads(at, hop.role, mode)
            if at is None:
                return None
        return at

    def leads(self, owner: str, role: str, mode: str = "final", within: tuple[str, ...] = ()) -> str | None:
        """The type that an owner's role leads to; a path object that leads nowhere counts by its last role."""
        t = self.find(owner, role)
        if t is None:
            return None
        p = t.path
        if p is None or not p.hops:
            return t.start
        if mode == "start":
            return p.start
        at: str | None = p.start
        for hop in p.hops if mode == "final" and str(p) not in within else ():
            at = hop.assoc if hop.assoc is not None else self.leads(at, hop.role, mode, (*within, str(p)))
            if at is None:
                break
        else:
            if mode == "final" and str(p) not in within:
                return at
        return p.hops[-1].role

    def own_roles(self, entity: str) -> list[str]:
        """Sorted distinct rolenames that an entity composes itself."""
        return sorted({t.role for t in self.tuples if t.subject == entity and t.predicate == "composes" and t.role})

    def observable(self, owner: str | None, name: str) -> str:
        """What a characteristic observes; its own name if the model does not say."""
        t = next((t for t in self.tuples if t.subject == owner and t.role == name and t.predicate == "composes"), None)
        return t.object.rsplit(".", 1)[-1] if t else name


def parse_model(text: str, strict: bool = True) -> Model:
    """A model and its queries from a tuple file's text; lines that are neither are left out (strict: an error)."""
    tuples: list[Tuple_] = []
    queries: list[Query] = []
    buffer: list[str] | None = None
    for seq, raw in enumerate(text.split("\n")):
        line = raw.strip()
        if line.startswith("SELECT"):
            buffer = []
        if buffer is not None:
            buffer.append(line)
            if ";" in line:
                queries.append(parse_query("\n".join(buffer).split(";")[0], strict))
                buffer = None
            continue
        if not line:
            continue
        parts = [p.strip() for p in re.split(COMMA, line[1:-1])] if line[0] == "(" and line[-1] == ")" else []
        while parts and not parts[-1]:
            parts.pop()
        if len(parts) < 3:
            if strict:
                raise QuerySyntaxError(f"line {seq + 1}: {line!r}")
            continue
        word = parts[1].split("[")[0].strip()
        groups = [x.strip() for g in re.findall(r"\[(.*?)\]", parts[1]) for x in g.split(",") if x.strip()]
        mult = tuple(groups) or {"composes": ("1", "1"), "associates": ("-1",) * 4}.get(word)
        role = parts[3] if len(parts) > 3 else None
        if role is None and word != "instance":
            role = _role_of(word, parts[2])
        tuples.append(Tuple_(seq, parts[0], word, parts[2], role, mult))
    return Model(tuples, queries)


def _role_of(predicate: str, object_: str) -> str:
    if predicate == "associates":
        try:
            p = parse_path(object_)
            last = p.hops[-1].role if p.hops else p.start
        except QuerySyntaxError:
            last = object_.rsplit(".", 1)[-1]
    else:
        last = object_.rsplit(".", 1)[-1]
    return last[:1].lower() + last[1:]


def scan(lines: DataFrame) -> DataFrame:
    """model_id, seq, subject, predicate, object_raw, rolename and mult of each tuple; lines: model_id, seq, line.

    Lines of queries (from SELECT to a semicolon) are marked by running counts within the model and left out.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("model_id").orderBy("seq")
    line = F.trim("line")
    x = lines.select("model_id", "seq", line.alias("line"))
    x = x.withColumn("opens", F.sum(F.startswith("line", F.lit("SELECT")).cast("int")).over(w))
    after = Window.partitionBy("model_id", "opens").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    closed = F.coalesce(F.max(F.contains("line", F.lit(";")).cast("int")).over(after), F.lit(0)) == 1
    x = x.withColumn("in_query", (F.col("opens") > 0) & ~closed)
    x = x.where(~F.col("in_query") & F.startswith("line", F.lit("(")) & F.endswith("line", F.lit(")")))
    inner = F.regexp_replace(F.expr("substr(line, 2, length(line) - 2)"), r"(\s*,\s*)+$", "")
    x = x.withColumn("parts", F.transform(F.split(inner, COMMA), lambda x: F.trim(x))).where(F.size("parts") >= 3)
    word = F.trim(F.split(F.get("parts", F.lit(1)), r"\[")[0])
    x = x.select("model_id", "seq", F.get("parts", F.lit(0)).alias("subject"), word.alias("predicate"), F.get("parts", F.lit(2)).alias("object_raw"), F.get("parts", F.lit(3)).alias("given"), F.get("parts", F.lit(1)).alias("spec"))
    role = F.coalesce("given", F.when(F.col("predicate") != "instance", default_role(F.col("object_raw"))))
    return x.select("model_id", "seq", "subject", "predicate", "object_raw", role.alias("rolename"), multiplicities(F.col("predicate"), F.col("spec")).alias("mult"))


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """model_id (the file), seq and line of tuple files; line numbers are those of the file."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("model_id"), "value")
    return text.select("model_id", F.posexplode(F.split("value", "\r?\n")).alias("seq", "line"))


def frame(spark: SparkSession, text: str, model_id: str = "model") -> DataFrame:
    """A model text as a DataFrame of tuples."""
    df = spark.createDataFrame([(model_id, text)], "model_id string, value string")
    return scan(df.select("model_id", F.posexplode(F.split("value", "\n")).alias("seq", "line")))


def load(spark: SparkSession, path: str) -> DataFrame:
    """Tuples of the models in a file or folder, by the name's ending: .face and .xml are XMI, others tuple files."""
    if path.lower().endswith((".face", ".xml")):
        return xmi.tuples(xml.elements(xml.documents(spark, path)))
    return scan(lines_of(spark, path))


def sniff(spark: SparkSession, path: str) -> DataFrame:
    """Tuples of a file by its content: XMI if it is well-formed XML, else a tuple file."""
    found = xml.elements(xml.documents(spark, path))
    try:
        found.agg(F.count("*")).first()
    except Exception as e:
        if "XmlError" not in str(e):
            raise
        return scan(lines_of(spark, path))
    return xmi.tuples(found)


def driver_model(tuples: DataFrame) -> Model:
    """A model's driver-side form from its tuples; a model is metadata."""
    rows = tuples.orderBy("seq").collect()
    return Model(Tuple_(r.seq, r.subject, r.predicate, r.object_raw, r.rolename or None, tuple(r.mult) if r.mult else None) for r in rows)
