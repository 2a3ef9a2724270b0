"""JSON texts by paths: where two values differ, masks before a comparison, containment facets, nested projections."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _canonical(v) -> str:
    return json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


_MISSING = object()


def differing(old, new) -> list[str]:
    """Paths, in order, at which two parsed values differ: as deep as objects go on, and lists of one length."""
    out, todo = [], [("$", old, new)]
    while todo:
        path, a, b = todo.pop()
        if a is not _MISSING and b is not _MISSING and _canonical(a) == _canonical(b):
            continue
        if isinstance(a, dict) and isinstance(b, dict):
            todo += [(f"{path}.{k}", a.get(k, _MISSING), b.get(k, _MISSING)) for k in sorted(a.keys() | b.keys(), reverse=True)]
        elif isinstance(a, list) and isinstance(b, list) and len(a) == len(b):
            todo += [(f"{path}[{k}]", a[k], b[k]) for k in reversed(range(len(a)))]
        else:
            out.append(path)
    return out


def with_differences(df: DataFrame, old: str, new: str, out: str = "paths") -> DataFrame:
    """df with the paths at which its JSON texts differ; null texts count as null, broken ones as their text."""
    def parsed(s):
        try:
            return None if s is None else json.loads(s)
        except ValueError:
            return {"text": s}

    def compare(batches):
        for batch in batches:
            a, b = batch.column(old).to_pylist(), batch.column(new).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([differing(parsed(x), parsed(y)) for x, y in zip(a, b, strict=True)], pa.list_(pa.string()))], names=[*batch.schema.names, out])

    return df.mapInArrow(compare, T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.StringType()))]))


def masked(value: Column, kind: T.DataType, path: list[str], marker: str = "<masked>") -> Column:
    """A nested column with what stands at a path replaced; "*" is every element of an array, missing fields are left alone.

    The place must hold text; anything else becomes null there, as a column keeps its type.
    """
    if not path:
        return F.when(value.isNotNull(), F.lit(marker) if isinstance(kind, T.StringType) else F.lit(None).cast(kind))
    head, rest = path[0], path[1:]
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: masked(x, kind.elementType, rest, marker)) if head == "*" else value
    if not isinstance(kind, T.StructType) or head not in kind.names:
        return value
    return value.withField(head, masked(value[head], kind[head].dataType, rest, marker))


def projected(df: DataFrame, paths: list[str]) -> DataFrame:
    """Only the named fields of nested columns ("a.b.c"), nested as before; the scan reads no others."""
    tree: dict = {}
    for p in paths:
        at = tree
        for part in p.split("."):
            at = at.setdefault(part, {})

    def field(prefix: str, below: dict) -> Column:
        return F.struct(*[field(f"{prefix}.{k}", v).alias(k) for k, v in below.items()]) if below else F.col(prefix)

    return df.select(*[field(k, v).alias(k) for k, v in tree.items()])


def json_facets(column: str, wanted: dict[str, object]) -> Column:
    """Does a JSON text have every key with a wanted value?  A list is any of its values; a key that holds an array has
    a value if an element equals it, otherwise the value itself must be equal."""
    out = F.lit(True)
    for key, values in wanted.items():
        held = F.get_json_object(column, f"$.{key}")
        values = [v if isinstance(v, str) else json.dumps(v) for v in (values if isinstance(values, (list, tuple)) else [values])]
        many = F.from_json(F.when(F.startswith(held, F.lit("[")), held), "array<string>")
        out &= F.coalesce(F.when(many.isNotNull(), F.arrays_overlap(many, F.array(*map(F.lit, values)))).otherwise(held.isin(*values)), F.lit(False))
    return out
