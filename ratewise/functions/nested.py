"""Nested values: a key dropped wherever it occurs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T


def drop_key(value: Column, kind: T.DataType, key: str) -> Column:
    """The value without the fields and map entries named ``key`` at any depth; ``kind`` is its type."""
    if isinstance(kind, T.StructType):
        kept = [drop_key(value[f.name], f.dataType, key).alias(f.name) for f in kind.fields if f.name != key]
        return F.when(value.isNotNull(), F.struct(*kept)) if kept else F.lit(None)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: drop_key(x, kind.elementType, key))
    if isinstance(kind, T.MapType):
        named = F.map_filter(value, lambda k, _: k != key) if isinstance(kind.keyType, T.StringType) else value
        return F.transform_values(named, lambda _, v: drop_key(v, kind.valueType, key))
    return value
