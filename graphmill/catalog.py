"""Graphs as two tables, with their schemas and vocabularies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

SCHEMA_VERSION = 1
_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "boolean": T.BooleanType(), "double": T.DoubleType(), "map<string_string>": T.MapType(T.StringType(), T.StringType())}


def _struct(fields: str) -> T.StructType:
    """A struct of "name type, name type", without a session."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (f.split() for f in fields.split(", "))])


NODES = _struct(
    "project_id string, id string, file_path string, name string, qualified_name string, kind string, language string, start_byte int, end_byte int, start_line int, end_line int, signature string, return_type string, docstring string, parent string, "
    "complexity int, is_exported boolean, is_test boolean, is_entry_point boolean, file_hash string, extraction_confidence double, branch string"
)
EDGES = _struct("project_id string, from_id string, to_id string, kind string, confidence double, properties map<string_string>, source string, branch string")
PENDING = _struct("project_id string, from_file string, kind string, from_qn string, to_name string, confidence double, receiver_type string, base_type string, branch string")

ALIASES = {"project": "project_id", "qn": "qualified_name", "label": "kind", "confidence": "extraction_confidence"}
BOOLEANS = frozenset(("is_exported", "is_test", "is_entry_point"))
EDGE_KINDS = frozenset("CALLS HTTP_CALLS ASYNC_CALLS READS WRITES IMPORTS REFERENCES USES_VAR RENDERS INCLUDES LOADS".split())
_NUMBERS = (T.IntegerType, T.LongType, T.DoubleType, T.FloatType, T.ShortType, T.ByteType)


@dataclass
class Graph:
    """Nodes and edges of one or several projects; project None means all."""

    nodes: DataFrame
    edges: DataFrame
    project: str | None = None

    @property
    def properties(self) -> list[str]:
        return [f.name for f in NODES if f.name in self.nodes.columns]

    @property
    def numeric(self) -> frozenset[str]:
        return frozenset(f.name for f in self.nodes.schema if isinstance(f.dataType, _NUMBERS))


def symbol_id(file_path, qualified_name, kind):
    """Identity of a node within its project."""
    from pyspark.sql import functions as F

    return F.concat(file_path, F.lit("::"), qualified_name, F.lit("#"), kind)
