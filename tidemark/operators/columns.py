"""Column families of a DataFrame, by the rules the quality and feature operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def family(dt: T.DataType) -> str:
    """``int``, ``float``, ``bool``, ``datetime``, ``string`` or ``other``."""
    if isinstance(dt, T.BooleanType):
        return "bool"
    if isinstance(dt, T.IntegralType):
        return "int"
    if isinstance(dt, (T.FractionalType, T.DecimalType)):
        return "float"
    if isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    if isinstance(dt, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    return "other"


def dtype_name(dt: T.DataType) -> str:
    """The column-store name a dtype rule is matched against (``int64``, ``float64``, ``object``, ...)."""
    names = {"byte": "int8", "short": "int16", "integer": "int32", "long": "int64", "float": "float32", "double": "float64"}
    if dt.typeName() in names:
        return names[dt.typeName()]
    return {"bool": "bool", "datetime": "datetime64[ns]", "float": "float64"}.get(family(dt), "object")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if family(f.dataType) in ("int", "float")]


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if family(f.dataType) == "string"]


def datetime_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if family(f.dataType) == "datetime"]


def as_double(df: DataFrame, name: str) -> Column:
    """The column as double, NaN read as missing."""
    c = F.col(f"`{name}`").cast("double")
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        c = F.when(~F.isnan(c), c)
    return c


def missing(df: DataFrame, name: str) -> Column:
    c = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()
