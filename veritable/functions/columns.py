"""Choosing columns: by type family (F01) and by name hint."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)
_FLAT = (T.StringType, T.NumericType, T.BooleanType, T.BinaryType, *_TEMPORAL)

# ---- fixed values: name hints ----------------------------------------------
EMAIL_HINTS = ("email", "mail", "@")
PHONE_HINTS = ("phone", "tel", "mobile")
URL_HINTS = ("url", "website", "web", "link")
IP_HINTS = ("ip_address", "ip_addr", "ipv4")
IP_NAME = "ip"
DATE_HINTS = ("date", "dob", "birth")
TIME_TEXT_HINTS = ("_at", "_time", "date", "time")
STALE_EXEMPT_HINTS = ("birth", "dob", "founded", "hire", "established", "historical", "history")
NUMERIC_HINTS = (
    "price",
    "amount",
    "count",
    "quantity",
    "qty",
    "salary",
    "money",
    "fee",
    "total",
    "cost",
    "age",
    "num",
)
NUMERIC_EXEMPT_HINTS = ("date", "time", "timestamp")
IDENTIFIER_HINTS = ("_id", "id_", " id", "key", "code", "uuid", "hash")
# ---- end of fixed values ----------------------------------------------------


def col(name: str) -> Column:
    """Column by its literal name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def _of(df: DataFrame, kinds, cols: Iterable[str] | None) -> list[str]:
    wanted = None if cols is None else set(cols)
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, kinds) and (wanted is None or f.name in wanted)
    ]


def string_columns(df: DataFrame, cols: Iterable[str] | None = None) -> list[str]:
    return _of(df, T.StringType, cols)


def numeric_columns(df: DataFrame, cols: Iterable[str] | None = None) -> list[str]:
    return _of(df, T.NumericType, cols)


def temporal_columns(df: DataFrame, cols: Iterable[str] | None = None) -> list[str]:
    return _of(df, _TEMPORAL, cols)


def flat_columns(df: DataFrame, cols: Iterable[str] | None = None) -> list[str]:
    """Columns whose values can be counted and compared (no arrays, maps, structs)."""
    return _of(df, _FLAT, cols)


def family_of(dtype: T.DataType) -> str:
    if isinstance(dtype, T.StringType):
        return "string"
    if isinstance(dtype, T.NumericType):
        return "numeric"
    if isinstance(dtype, _TEMPORAL):
        return "temporal"
    return "other"


def hinted(names: Iterable[str], hints: Iterable[str]) -> list[str]:
    hints = tuple(hints)
    return [n for n in names if any(h in n.lower() for h in hints)]


def unhinted(names: Iterable[str], hints: Iterable[str]) -> list[str]:
    hints = tuple(hints)
    return [n for n in names if not any(h in n.lower() for h in hints)]


def ip_columns(names: Iterable[str]) -> list[str]:
    return [n for n in names if n.lower() == IP_NAME or any(h in n.lower() for h in IP_HINTS)]


def select_columns(df: DataFrame) -> DataFrame:
    """Type family and matching name hints of every column, as a table."""
    groups = {
        "email": EMAIL_HINTS,
        "phone": PHONE_HINTS,
        "url": URL_HINTS,
        "date": DATE_HINTS,
        "time": TIME_TEXT_HINTS,
        "numeric": NUMERIC_HINTS,
        "identifier": IDENTIFIER_HINTS,
        "stale_exempt": STALE_EXEMPT_HINTS,
    }
    rows = []
    for i, field in enumerate(df.schema.fields):
        hits = [g for g, hints in groups.items() if hinted([field.name], hints)]
        if ip_columns([field.name]):
            hits.append("ip")
        rows.append((i, field.name, field.dataType.simpleString(), family_of(field.dataType), hits))
    return df.sparkSession.createDataFrame(
        rows, "ordinal int, name string, type string, family string, hints array<string>"
    )
