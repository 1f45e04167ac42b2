"""XML documents as rows: one a element, with its place, its ancestors and its attributes.

Documents are read whole, one to a row, and parsed where they lie; what the elements mean is left to joins over
the rows. Nesting may be of any depth.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Namespaces whose names keep a prefix; names of all others stand alone.
PREFIXES = {
    "http://www.omg.org/XMI": "xmi",
    "http://www.w3.org/1999/02/22-rdf-syntax-ns#": "rdf",
    "http://www.w3.org/2000/01/rdf-schema#": "rdfs",
    "http://www.w3.org/2002/07/owl#": "owl",
    "http://www.w3.org/XML/1998/namespace": "xml",
}

DDL = "doc string, ord int, above array<int>, tag string, attrs map<string, string>"


class XmlError(ValueError):
    """A document that is not well-formed."""


def _name(clark: str) -> str:
    if clark[:1] != "{":
        return clark
    space, local = clark[1:].split("}", 1)
    return f"{PREFIXES[space]}:{local}" if space in PREFIXES else local


def _rows(doc: str, content: bytes) -> list[tuple]:
    out: list[tuple] = []
    stack: list[int] = []
    try:
        for event, e in ElementTree.iterparse(io.BytesIO(content), ("start", "end")):
            if event == "start":
                out.append((doc, len(out), list(stack), _name(e.tag), [(_name(k), v) for k, v in e.attrib.items()]))
                stack.append(len(out) - 1)
            else:
                stack.pop()
                e.clear()
    except ElementTree.ParseError as error:
        raise XmlError(f"{doc}: {error}") from error
    return out


def elements(docs: DataFrame) -> DataFrame:
    """doc, ord (the element's place), above (its ancestors, the root first), tag and attrs; docs: doc and content (binary).

    A null content has no elements; a document that is not well-formed fails the query with its name.
    """
    schema = pa.schema([("doc", pa.string()), ("ord", pa.int32()), ("above", pa.list_(pa.int32())), ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, content in zip(b.column("doc").to_pylist(), b.column("content").to_pylist(), strict=True):
                rows = _rows(doc, content) if content is not None else []
                for i in range(0, len(rows), 10_000):
                    columns = zip(*rows[i : i + 10_000], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return docs.select("doc", F.col("content").cast("binary").alias("content")).mapInArrow(run, DDL)


def documents(spark: SparkSession, path: str) -> DataFrame:
    """doc (the file) and content of files."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("doc"), "content")
