"""Canonical JSON as Spark expressions, and identities: SHA-256 digests of it.

The text is that of a JSON encoder that sorts keys by code point, puts `, ` and `: ` between items, and writes everything
beyond printable ASCII as \\uXXXX (two of them for a character beyond U+FFFF)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, IntegralType, MapType, NullType, StringType, StructType

#: Characters with an escape of their own.
_SHORT = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


@F.pandas_udf(StringType())
def _number(x: pd.Series) -> pd.Series:
    """The shortest text that reads as the same double; the JVM's isn't always the shortest."""
    if not (x.isna() | x.abs().lt(float("inf"))).all():
        raise ValueError("numbers must be finite")
    return x.map(repr, na_action="ignore")


def _unit(code: Column) -> Column:
    return F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(code), 4, "0")))


def _escaped(ch: Column) -> Column:
    code = F.ascii(ch)
    beyond = code - 0x10000
    pair = F.concat(_unit(F.lit(0xD800) + F.shiftright(beyond, 10)), _unit(F.lit(0xDC00) + beyond.bitwiseAND(0x3FF)))
    out = F.when(code > 0xFFFF, pair).when((code < 0x20) | (code > 0x7E), _unit(code)).otherwise(ch)
    for plain, short in _SHORT.items():
        out = F.when(ch == plain, F.lit(short)).otherwise(out)
    return out


def quoted(text: Column) -> Column:
    """A string as JSON. Texts of plain ASCII, the most, aren't taken apart."""
    plain = ~text.rlike(r'[^ -~]|["\\]')
    return F.concat(F.lit('"'), F.when(plain, text).otherwise(F.array_join(F.transform(F.split(text, ""), _escaped), "")), F.lit('"'))


def canonical(value: Column, kind: DataType, nested: bool = False) -> Column:
    """The canonical JSON of a column of that type; `null` for null."""
    if isinstance(kind, StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        parts = [F.concat(quoted(F.lit(f.name)), F.lit(": "), canonical(value.getField(f.name), f.dataType, nested)) for f in fields]
        text = F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))
    elif isinstance(kind, ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: canonical(x, kind.elementType, True)), ", "), F.lit("]"))
    elif isinstance(kind, MapType) and isinstance(kind.keyType, StringType):
        entry = lambda e: F.concat(quoted(e["key"]), F.lit(": "), canonical(e["value"], kind.valueType, True))
        keys = F.array_sort(F.map_keys(value))
        entries = F.transform(keys, lambda k: F.struct(k.alias("key"), F.element_at(value, k).alias("value")))
        text = F.concat(F.lit("{"), F.array_join(F.transform(entries, entry), ", "), F.lit("}"))
    elif isinstance(kind, StringType):
        text = quoted(value)
    elif isinstance(kind, (BooleanType, IntegralType)):
        text = value.cast("string")
    elif isinstance(kind, DoubleType) and not nested:
        text = _number(value)
    elif isinstance(kind, NullType):
        text = F.lit(None).cast("string")
    else:
        raise TypeError(f"{kind.simpleString()} has no canonical JSON here")
    return F.coalesce(text, F.lit("null"))


def identity(value: Column, kind: DataType) -> Column:
    """SHA-256 of the canonical JSON, in hexadecimal digits."""
    return F.sha2(canonical(value, kind), 256)
