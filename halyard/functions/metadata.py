"""Metadata as canonical JSON text, and strict equality on it.

Two JSON values are equal iff their canonical texts are: object keys sorted, no
white space, integers and floats kept apart, floats in shortest form, -0.0 as
0.0. So the equality filter is a comparison of strings in the JVM.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import BadRequest


def canon(value: Any) -> str:
    """Canonical JSON text of a value."""
    if isinstance(value, float):
        if not math.isfinite(value):
            raise BadRequest("metadata has a number that is not finite")
        return repr(value + 0.0)
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canon(v)}" for k, v in sorted(value.items())) + "}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(canon, value)) + "]"
    return json.dumps(value, ensure_ascii=False)


def canon_map(metadata: dict[str, Any] | None) -> dict[str, str]:
    return {str(k): canon(v) for k, v in (metadata or {}).items()}


def from_json(df: DataFrame, column: str) -> DataFrame:
    """Replaces a column of JSON object text by its canonical map. Text that is
    no object is an error; null is an empty map."""
    at = df.columns.index(column)
    schema = ", ".join(f"`{f.name}` {'map<string,string>' if f.name == column else f.dataType.simpleString()}" for f in df.schema)

    def run(batches):
        for b in batches:
            maps = []
            for t in b.column(at).to_pylist():
                v = json.loads(t) if t is not None else {}
                if not isinstance(v, dict):
                    raise ValueError("metadata must be a JSON object")
                maps.append(list(canon_map(v).items()))
            cols = [pa.array(maps, pa.map_(pa.string(), pa.string())) if i == at else b.column(i) for i in range(b.num_columns)]
            yield pa.RecordBatch.from_arrays(cols, b.schema.names)

    return df.mapInArrow(run, schema)


@dataclass(frozen=True)
class Filter:
    """Equality on one top-level key; a missing key never matches, a JSON null
    only a null that is there."""

    key: str
    value: Any

    @classmethod
    def eq(cls, key: str, value: Any) -> Filter:
        return cls(key, value)

    @classmethod
    def parse(cls, body: dict) -> Filter:
        if not isinstance(body, dict) or body.get("op") != "eq" or not isinstance(body.get("key"), str) or "value" not in body:
            raise BadRequest("filter must be {op: eq, key, value}")
        return cls(body["key"], body["value"])

    def column(self, metadata: Column | str = "metadata") -> Column:
        return F.coalesce(F.try_element_at(F.col(metadata) if isinstance(metadata, str) else metadata, F.lit(self.key)) == F.lit(canon(self.value)), F.lit(False))
