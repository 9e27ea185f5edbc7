"""Payloads of any keys: some are columns of their own, the rest is one VARIANT that filters reach into."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.operators.points import Range

#: What is promoted out of a chunk's metadata, with its type and default, and what is only kept outside of it.
PROMOTED = {"chunk_index": ("int", 0), "created_at": ("string", None), "updated_at": ("string", None), "document_version": ("int", 1)}
OUTSIDE = ("content", "document_id", "rag_namespace")


def _object(metadata: Column) -> Column:
    """JSON text of an object, or an object VARIANT, as a map of VARIANT; anything else is empty."""
    return F.coalesce(F.try_variant_get(metadata, "$", "map<string,variant>"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>")))


def stored(chunks: DataFrame, namespace: str, metadata: str = "metadata") -> DataFrame:
    """Chunks (id, content, document_id, ``metadata`` as JSON text, others) as a collection keeps them.

    PROMOTED fields become columns, OUTSIDE fields stand in no metadata, all others are the VARIANT ``metadata``.
    Text that is no JSON object counts as an empty one.
    """
    parsed = F.try_parse_json(F.col(metadata))
    inside = _object(parsed)
    rest = F.map_filter(inside, lambda k, _: ~k.isin(*PROMOTED, *OUTSIDE))
    up = [F.coalesce(F.try_variant_get(parsed, f"$.{name}", kind), F.lit(default).cast(kind)).alias(name) for name, (kind, default) in PROMOTED.items()]
    others = [c for c in chunks.columns if c not in (metadata, "rag_namespace", *PROMOTED)]
    return chunks.select(*others, F.lit(namespace).alias("rag_namespace"), *up, F.to_variant_object(rest).alias("metadata"))


def flattened(points: DataFrame) -> Column:
    """All of a stored payload as one map of VARIANT: what is inside metadata, and the columns, which win."""
    names = [*OUTSIDE, *PROMOTED]
    own = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(F.parse_json(F.to_json(F.struct(F.col(n).alias("v")), {"ignoreNullFields": "false"})) for n in names)))
    top = F.transform_values(own, lambda _, v: F.try_variant_get(v, "$.v", "variant"))
    inside = F.map_filter(_object(F.col("metadata")), lambda k, _: ~k.isin(*names))
    return F.map_concat(inside, top)


def value(points: DataFrame, name: str, kind: str) -> Column:
    """A field of a payload as ``kind``: the column if there is one, else the path inside metadata ('a.b' is b inside a)."""
    if name in points.columns:
        return F.col(name).cast(kind)
    return F.try_variant_get("metadata", f"$.{name}", kind)


def matching(points: DataFrame, filters: Mapping[str, Any]) -> DataFrame:
    """The points whose payload meets all filters, as ``points.predicate`` means them: a value, a list of them, None or a Range.

    A filter on a column reaches the scan; one on a path inside metadata is tested row by row, types by the value asked for.
    """
    kinds = {bool: "boolean", int: "long", float: "double", str: "string"}
    test = F.lit(True)
    for name, want in filters.items():
        if isinstance(want, Range):
            some = [x for x in (want.gt, want.gte, want.lt, want.lte) if x is not None]
            test = test & want.on(value(points, name, kinds.get(type(some[0]), "string") if some else "string"), stored_text=True)
            continue
        many = list(want) if isinstance(want, (list, tuple, set, frozenset)) else [want]
        given = [x for x in many if x is not None]
        c = value(points, name, kinds[type(given[0])] if given else "string")
        hit = c.isin(given) if given else F.lit(False)
        test = test & (F.coalesce(hit, F.lit(False)) | (c.isNull() if len(given) < len(many) else F.lit(False)))
    return points.where(F.coalesce(test, F.lit(False)))
