"""Output encodings: values to JSON text, as Catalyst expressions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column as Expr
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.catalog import UNSIGNED, Column, Table, camel
from tessera.errors import QueryError
from tessera.functions.hashing import base58_text
from tessera.functions.predicates import is_integer


def quoted(text: Expr) -> Expr:
    """A JSON string; UTF-8 stays as it is. Null stays null."""
    whole = F.to_json(F.array(text))
    return F.when(text.isNotNull(), F.substring(whole, F.lit(2), F.length(whole) - 2))


def _marks(text: Expr) -> Expr:
    return F.concat(F.lit('"'), text, F.lit('"'))


def _unrenderable(name: str, kind: T.DataType) -> QueryError:
    return QueryError("MalformedChunkData", f"{name} is stored as {kind.simpleString()}, which its encoding does not render", name)


def _epoch(value: Expr, kind: T.DataType, unit: str, stored_seconds: bool) -> Expr:
    if isinstance(kind, T.TimestampNTZType):
        micros = F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), value)
    elif isinstance(kind, T.TimestampType):
        micros = F.unix_micros(value)
    else:
        return value.cast("string")
    # Integer division, so times before 1970 go towards zero.
    step = 1_000_000 if unit == "timestamp_second" else 1000
    return F.when(micros < 0, -F.floor(-micros / F.lit(step).cast("decimal(38,0)"))).otherwise(F.floor(micros / F.lit(step).cast("decimal(38,0)"))).cast("string")


def shortest(x: float) -> str:
    """The shortest digits that read back as ``x``: plain from 1e-5 up to 1e16, with an exponent beyond."""
    mantissa, _, exponent = repr(x).partition("e")
    if not exponent:
        return mantissa
    if int(exponent) != -5:
        return f"{mantissa}e{int(exponent)}"
    sign, digits = ("-", mantissa[1:]) if mantissa[0] == "-" else ("", mantissa)
    return f"{sign}0.0000{digits.replace('.', '')}"


def float_json(value: Expr) -> Expr:
    """A double's JSON text; null where it is no number. The JVM's own digits are not always the shortest, so this is an Arrow function."""

    @F.pandas_udf("string")
    def text(x: pd.Series) -> pd.Series:
        return pd.Series([shortest(v) if math.isfinite(v) else None for v in x.astype("float64").tolist()], dtype=object)

    return F.when(value.isNotNull(), text(value))


def raw_json(value: Expr, kind: T.DataType, name: str, encoding: str = "", declared: str = "", members: dict[str, str] | None = None) -> Expr:
    """JSON text of a value, null where it is null (or renders as null)."""
    if encoding == "json_verbatim":
        if not isinstance(kind, T.StringType):
            raise _unrenderable(name, kind)
        sound = F.try_parse_json(value).isNotNull()
        refuse = F.raise_error(F.lit(f"MalformedChunkData: {name} holds a value that is not JSON")).cast("string")
        return F.when(F.length(value) > 0, F.when(sound, value).otherwise(refuse))
    if encoding == "hex_bytes" and isinstance(kind, T.BinaryType):
        return _marks(F.concat(F.lit("0x"), F.lower(F.hex(value))))
    if encoding == "base58" and isinstance(kind, T.BinaryType):
        return _marks(base58_text(value))
    if encoding == "decimal_string":
        if is_integer(kind) or isinstance(kind, T.DecimalType):
            return _marks(value.cast("string"))
        if isinstance(kind, T.StringType):
            return quoted(value)
        raise _unrenderable(name, kind)
    if encoding == "hex_number":
        if not is_integer(kind):
            raise _unrenderable(name, kind)
        width = UNSIGNED[declared]
        # A negative value is the unsigned one's twin; what is too wide shows as eight bytes.
        wide = F.when(value < 0, value.cast("decimal(20,0)") + F.expr("18446744073709551616BD")).otherwise(value.cast("decimal(20,0)")) if not isinstance(kind, T.DecimalType) else value.cast("decimal(20,0)")
        digits = F.lower(F.conv(wide.cast("string"), 10, 16))
        limit = 1 << 8 * width
        if width == 8:
            return _marks(F.concat(F.lit("0x"), F.lpad(digits, 16, "0")))
        low = F.lower(F.conv((value.cast("decimal(20,0)") + F.lit(limit).cast("decimal(20,0)")).cast("string"), 10, 16))
        own = F.when((value < 0) & (value >= -limit // 2), F.lpad(low, 2 * width, "0")).when((value >= 0) & (value < limit), F.lpad(digits, 2 * width, "0")).otherwise(F.lpad(digits, 16, "0"))
        return _marks(F.concat(F.lit("0x"), own))
    if encoding == "solana_tx_version":
        if not is_integer(kind):
            raise _unrenderable(name, kind)
        return F.when(value == -1, F.lit('"legacy"')).otherwise(value.cast("string"))
    unit = encoding if encoding.startswith("timestamp_") else declared if declared.startswith("timestamp_") else ""
    if unit:
        if not (isinstance(kind, (T.TimestampType, T.TimestampNTZType)) or is_integer(kind)):
            raise _unrenderable(name, kind)
        return _epoch(value, kind, unit, declared == "timestamp_second")
    if isinstance(kind, T.BooleanType):
        return value.cast("string")
    if declared == "boolean" and is_integer(kind):
        return (value == 1).cast("string")
    if is_integer(kind):
        return value.cast("string")
    if isinstance(kind, T.DecimalType):
        return _marks(value.cast("string"))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
        return F.when(F.isnan(value) | (F.abs(value) == float("inf")), F.lit(None).cast("string")).when(whole, F.concat(value.cast("decimal(38,0)").cast("string"), F.lit(".0"))).otherwise(value.cast("string"))
    if isinstance(kind, T.StringType):
        return quoted(value)
    if isinstance(kind, T.BinaryType):
        return _marks(F.concat(F.lit("0x"), F.lower(F.hex(value))))
    if isinstance(kind, T.ArrayType):
        inner = F.transform(value, lambda x: or_null(raw_json(x, kind.elementType, name, "", "", members)))
        return F.concat(F.lit("["), F.array_join(inner, ","), F.lit("]"))
    if isinstance(kind, T.StructType):
        parts = [(camel(f.name), or_null(raw_json(value[f.name], f.dataType, f"{name}.{f.name}", (members or {}).get(f.name, "")))) for f in kind.fields]
        return F.when(value.isNotNull(), json_object(parts))
    raise _unrenderable(name, kind)


def or_null(text: Expr) -> Expr:
    return F.coalesce(text, F.lit("null"))


def json_object(parts: list[tuple[str, Expr]], more: list[Expr] | None = None) -> Expr:
    """An object of named JSON texts; ``more`` are texts with a leading comma or empty."""
    body = [x for i, (name, text) in enumerate(parts) for x in (F.lit(f'{"," if i else ""}"{name}":'), text)]
    if not more:
        return F.concat(F.lit("{"), *body, F.lit("}"))
    inner = F.concat(F.lit(""), *body, *more)
    return F.concat(F.lit("{"), inner if parts else F.regexp_replace(inner, "^,", ""), F.lit("}"))


def column_json(c: Column, schema: T.StructType) -> Expr:
    kind = schema[c.name].dataType
    nested = T.ArrayType if c.type.startswith("list_") else T.StructType if c.type == "struct" else None
    if nested and not isinstance(kind, nested) or not nested and isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        raise _unrenderable(c.name, kind)
    if isinstance(kind, T.DoubleType) and not c.encoding:
        return float_json(F.col(f"`{c.name}`"))
    return raw_json(F.col(f"`{c.name}`"), schema[c.name].dataType, c.name, c.encoding, c.type, dict(c.members))


def roll_json(columns: list[Column], schema: T.StructType) -> Expr:
    """One array of several columns: it ends at the first null; a list at its end is spread."""
    last = columns[-1] if isinstance(schema[columns[-1].name].dataType, T.ArrayType) else None
    heads = columns[:-1] if last else columns
    values = F.array(*[column_json(c, schema) for c in heads])
    stop = F.array_position(F.transform(values, lambda x: x.isNull()), True)
    tail = F.array().cast("array<string>")
    if last:
        kind = schema[last.name].dataType
        tail = F.coalesce(F.transform(F.col(f"`{last.name}`"), lambda x: or_null(raw_json(x, kind.elementType, last.name, last.encoding))), tail)
    own = F.when(stop > 0, F.slice(values, F.lit(1), (stop - 1).cast("int"))).otherwise(F.concat(values, tail))
    return F.concat(F.lit("["), F.array_join(own, ","), F.lit("]"))


def item_json(table: Table, shown: list[str], schema: T.StructType) -> Expr:
    """A row's object: selected columns in catalog order, rolls, then the groups of its variant."""
    varied = {c for groups in table.variants.values() for own in groups.values() for c in own}
    parts = []
    for f in shown:
        if f in table.rolls:
            parts.append((camel(f), roll_json([table.columns[c] for c in table.rolls[f]], schema)))
        elif f not in varied:
            parts.append((camel(f), or_null(column_json(table.columns[f], schema))))
    if not (chosen := [f for f in shown if f in varied]):
        return json_object(parts)
    more = F.lit("")
    for tag, groups in table.variants.items():
        text = []
        for group, own in groups.items():
            inner = [(camel(name), or_null(column_json(table.columns[table.variant_fields.get(c, c)], schema))) for c, name in own.items() if c in chosen]
            if inner and group == "_":
                text += [x for name, t in inner for x in (F.lit(f',"{name}":'), t)]
            elif inner:
                text += [F.lit(f',"{camel(group)}":'), json_object(inner)]
        if text:
            more = F.when(F.col(f"`{table.variant_column}`") == tag, F.concat(*text)).otherwise(more)
    return json_object(parts, [more])
