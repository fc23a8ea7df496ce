"""Field-level protection as column expressions: masks and AES-GCM, nested fields in place."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType

from tidewater.config import PiiRule

#: What a value without a length of its own is masked as; a null string too.
MASK = "****"


def masked(column: Column, kind: DataType) -> Column:
    """A string as so many asterisks as it has bytes; anything else, and null, as four."""
    if isinstance(kind, StringType):
        return F.coalesce(F.repeat(F.lit("*"), F.octet_length(column)), F.lit(MASK))
    return F.lit(MASK)


def encrypted(column: Column, kind: DataType, key: bytes) -> Column:
    """AES-256-GCM with a nonce for each value: base64 of nonce, text and tag. Null stays null; other types as their string."""
    if len(key) not in (16, 24, 32):
        raise ValueError("an AES key has 16, 24 or 32 bytes")
    data = column if isinstance(kind, BinaryType) else column.cast("string").cast("binary")
    return F.base64(F.aes_encrypt(data, F.lit(key), F.lit("GCM"), F.lit("NONE")))


def decrypted(column: Column, key: bytes) -> Column:
    return F.aes_decrypt(F.unbase64(column), F.lit(key), F.lit("GCM"), F.lit("NONE")).cast("string")


def _protected(column: Column, kind: DataType, rule: PiiRule, key: bytes | None) -> Column:
    if isinstance(kind, (StructType, MapType)):
        return column  # a rule for a whole object leaves it as it is
    if rule.kind == "masked":
        return masked(column, kind)
    if key is None:
        raise ValueError(f"field {rule.field!r} is to be encrypted, but there is no key")
    return encrypted(column, kind, key)


class _NoField(ValueError):
    """A rule's path leads to no field."""


def _within(column: Column, kind: DataType, path: list[str], rule: PiiRule, key: bytes | None) -> Column:
    if isinstance(kind, ArrayType) and (path or not isinstance(kind.elementType, (StructType, MapType))):
        # a path goes on in every element; a rule for an array of plain values holds for each of them
        return F.transform(column, lambda x: _within(x, kind.elementType, path, rule, key))
    if not path:
        return _protected(column, kind, rule, key)
    if isinstance(kind, StructType) and path[0] in kind.names:
        inner = _within(column.getField(path[0]), kind[path[0]].dataType, path[1:], rule, key)
        return F.when(column.isNotNull(), column.withField(f"`{path[0]}`", inner))
    if isinstance(kind, MapType) and isinstance(kind.keyType, StringType):
        # values of one map have one type: where protection changes it, the others become strings too
        made = lambda v: _within(v, kind.valueType, path[1:], rule, key)
        if isinstance(kind.valueType, (StringType, StructType, MapType, ArrayType)):
            return F.transform_values(column, lambda k, v: F.when(k == path[0], made(v)).otherwise(v))
        return F.transform_values(column, lambda k, v: F.when(k == path[0], made(v)).otherwise(v.cast("string")))
    raise _NoField(f"the rule for {rule.field!r} leads to no field: there is no {path[0]!r} in {kind.simpleString()}")


def protect(df: DataFrame, rules: Iterable[PiiRule], key: bytes | None = None, lacking: str = "error") -> DataFrame:
    """df with every rule's field protected in one projection.

    A path goes through structs, maps with string keys, and every element of arrays. A rule that leads to no field of
    the schema is an error, as a misspelt one would leave data in clear; lacking="ignore" says that fields may lack.
    The first rule of a field holds. Encryption differs each time it is evaluated: write the result before using it twice.
    """
    if lacking not in ("error", "ignore"):
        raise ValueError(f"lacking is error or ignore, not {lacking!r}")
    first: dict[str, PiiRule] = {}
    for r in rules:
        first.setdefault(r.field, r)
    out: dict[str, Column] = {}
    schema = df.schema
    for r in first.values():
        name, *path = [r.field] if r.field in schema.names else r.field.split(".")
        try:
            if name not in schema.names:
                raise _NoField(f"the rule for {r.field!r} leads to no field: there is no column {name!r}")
            # of one column several fields: each is checked in the schema as it was
            out[name] = _within(out.get(name, F.col(f"`{name}`")), schema[name].dataType, path, r, key)
        except _NoField:
            if lacking == "error":
                raise
    return df.withColumns(out) if out else df
