"""Reading a dataset as a relation."""

from __future__ import annotations

from pyspark.errors import ParseException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritable.functions import predicates as P
from veritable.functions.columns import col, string_columns

# ---- fixed values -----------------------------------------------------------
PREVIEW = 20
# ---- end of fixed values ----------------------------------------------------


def sql(df: DataFrame, query: str, args=None, **tables: DataFrame) -> DataFrame:
    """A query over ``{data}`` (and further named tables), with bound parameters.

    ``args`` is a dict for ``:name`` or a list for ``?`` parameters.
    """
    text = query.strip().rstrip(";")
    if text.split(None, 1)[0].lower() not in ("select", "with"):
        raise ValueError("only SELECT and WITH queries are allowed")
    spark = df.sparkSession
    try:
        # Spark runs a write after a WITH clause at once; as a subquery only a query can be parsed.
        spark.sql(f"SELECT * FROM (\n{text}\n)", args=args, data=df, **tables)
    except ParseException as exc:
        raise ValueError("not a read-only query") from exc
    return spark.sql(text, args=args, data=df, **tables)


def row_count(df: DataFrame) -> DataFrame:
    """S09, as one row."""
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def describe(df: DataFrame) -> DataFrame:
    """Ordered names and types."""
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(
        rows, "ordinal int, name string, type string, nullable boolean"
    )


def formula_warnings(df: DataFrame, keys: list[str], limit: int | None = None) -> DataFrame:
    """Cells that a spreadsheet would run as a formula; with ``limit``, the first by key and column."""
    names = string_columns(df)
    cells = [
        F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("column"), col(c).alias("value"))
        for i, c in enumerate(names)
    ]
    suspicious = None
    for c in names:
        hit = P.has_formula_prefix(col(c))
        suspicious = hit if suspicious is None else suspicious | hit
    # Keys are carried under their own names unless a cell field would clash.
    found = (
        df.filter(suspicious)
        .select(*[col(k) for k in keys], F.inline(F.array(*cells)))
        .filter(P.has_formula_prefix(F.col("value")))
    )
    if limit is not None:
        found = found.orderBy(*[col(k) for k in keys], "ordinal").limit(limit)
    return found.select(
        *[col(k) for k in keys],
        "column",
        F.substring("value", 1, 1).alias("prefix"),
        F.substring("value", 1, PREVIEW).alias("value_preview"),
        F.lit("low").alias("severity"),
    )
