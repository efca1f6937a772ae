"""Source column types and how their text form becomes a typed Spark value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Type OID -> (source type name, table type name).
SOURCE_TYPES = {
    16: ("bool", "boolean"),
    17: ("bytea", "binary"),
    20: ("int8", "long"),
    21: ("int2", "int"),
    23: ("int4", "int"),
    25: ("text", "string"),
    700: ("float4", "float"),
    701: ("float8", "double"),
    1042: ("bpchar", "string"),
    1043: ("varchar", "string"),
    1082: ("date", "date"),
    1114: ("timestamp", "timestamp"),
    1184: ("timestamptz", "timestamptz"),
}
NUMERIC = 1700

# Types whose width is fixed never arrive as "unchanged" in an update.
FIXED_WIDTH = {16, 20, 21, 23, 700, 701, 1082, 1114, 1184}

TABLE_TYPES = {
    "boolean": T.BooleanType(),
    "binary": T.BinaryType(),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "string": T.StringType(),
    "float": T.FloatType(),
    "double": T.DoubleType(),
    "date": T.DateType(),
    "timestamp": T.TimestampNTZType(),
    "timestamptz": T.TimestampType(),
}


def table_type(oid: int) -> str:
    """Table type name of a source type; anything unknown is text."""
    return SOURCE_TYPES.get(oid, ("", "string"))[1]


def field_type(name: str) -> T.DataType:
    """Spark type of a table type name; anything unknown is text."""
    return TABLE_TYPES.get(name, T.StringType())


def spark_type(oid: int, typmod: int = -1) -> T.DataType:
    """Spark type of a source column. ``numeric`` takes precision and scale from its modifier."""
    if oid == NUMERIC and typmod is not None and typmod >= 4:
        precision, scale = ((typmod - 4) >> 16) & 0xFFFF, (typmod - 4) & 0xFFFF
        if precision <= 38 and scale <= precision:
            return T.DecimalType(precision, scale)
    return field_type(table_type(oid))


def source_type(data_type: T.DataType) -> str:
    """Source type name that describes a result column."""
    if isinstance(data_type, T.DecimalType):
        return "numeric"
    if isinstance(data_type, (T.ShortType, T.ByteType)):
        return "int2"
    for oid, (name, table) in SOURCE_TYPES.items():
        if oid not in (21, 1042, 1043) and TABLE_TYPES[table] == data_type:
            return name
    return "text"


def can_be_unchanged(oid: int) -> bool:
    """Whether an update may leave a column of this type out (large values stored apart)."""
    return oid not in FIXED_WIDTH


def wider(left: T.DataType, right: T.DataType) -> T.DataType:
    """Common type of two versions of a column."""
    if left == right:
        return left
    ladder = [T.IntegerType(), T.LongType()], [T.FloatType(), T.DoubleType()]
    for steps in ladder:
        if left in steps and right in steps:
            return steps[-1]
    if {type(left), type(right)} <= {T.IntegerType, T.FloatType, T.DoubleType}:
        return T.DoubleType()  # holds every 32-bit integer
    if {type(left), type(right)} == {T.DateType, T.TimestampNTZType}:
        return T.TimestampNTZType()
    if {type(left), type(right)} == {T.DateType, T.TimestampType}:
        return T.TimestampType()
    whole_numbers = {T.IntegerType: T.DecimalType(10, 0), T.LongType: T.DecimalType(19, 0)}
    if isinstance(left, T.DecimalType) != isinstance(right, T.DecimalType):
        left, right = whole_numbers.get(type(left), left), whole_numbers.get(type(right), right)
    if isinstance(left, T.DecimalType) and isinstance(right, T.DecimalType):
        scale = max(left.scale, right.scale)
        whole = max(left.precision - left.scale, right.precision - right.scale)
        if whole + scale <= 38:
            return T.DecimalType(whole + scale, scale)
    return T.StringType()


def decode_text(value: Column, data_type: T.DataType) -> Column:
    """Typed value of a text-format column; NULL where the text does not parse."""
    if isinstance(data_type, T.StringType):
        return value
    if isinstance(data_type, T.BinaryType):
        return F.when(value.startswith("\\x"), F.unhex(F.substring(value, 3, 2**31 - 1)))
    return value.try_cast(data_type)


def decode_binary(value: Column, data_type: T.DataType) -> Column:
    """Binary-format bytes, carried as hexadecimal text, for a binary or text column. Other
    types have no portable binary form, so such a value counts as undecodable."""
    if isinstance(data_type, T.BinaryType):
        return F.unhex(value)
    return F.try_validate_utf8(F.unhex(value).cast("string"))
