"""Fingerprints of schema, size and content."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritable.functions.columns import col
from veritable.operators.checks import one_row

# ---- fixed values: the row text that is hashed ------------------------------
CELL_SEPARATOR, NULL_CELL = "\x1f", "\x00"
# ---- end of fixed values ----------------------------------------------------

#: Marks the fingerprint of a sample, which never equals one of the whole content.
SAMPLED = "sampled:"
_NESTED = (T.ArrayType, T.MapType, T.StructType, T.VariantType)
_LANE = 15  # hex digits per lane: 60 bits, so a lane fits a bigint


def signature(df: DataFrame) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in df.schema.fields]


def schema_hash(df: DataFrame) -> str:
    """SHA-256 of the ordered (name, type) list as JSON."""
    return hashlib.sha256(json.dumps(signature(df)).encode()).hexdigest()


def statistics_fingerprint(df: DataFrame, rows: int | None = None) -> str:
    """SHA-256 of schema hash and row count."""
    rows = df.count() if rows is None else rows
    return hashlib.sha256(f"{schema_hash(df)}|{rows}".encode()).hexdigest()


def _cell_text(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType.simpleString()
    c = col(name)
    if kind.startswith(("array", "map", "struct", "variant")):
        return F.to_json(F.struct(c))
    return F.base64(c) if kind == "binary" else c.cast("string")


def row_digest(df: DataFrame, cols: Sequence[str] | None = None, seed: object = None) -> Column:
    """MD5 of a row's cells as text; NULL differs from every text."""
    cells = [F.coalesce(_cell_text(df, c), F.lit(NULL_CELL)) for c in (cols or df.columns)]
    if seed is not None:
        cells = [F.lit(str(seed)), *cells]
    return F.md5(F.concat_ws(CELL_SEPARATOR, *cells))


def lane(digest: Column, start: int) -> Column:
    """60 bits of a hex digest as a bigint."""
    return F.conv(F.substring(digest, start, _LANE), 16, 10).cast("bigint")


def _hashed(df: DataFrame, name: str) -> list[Column]:
    """What is hashed of a cell: the hash alone would skip NULLs, also those inside of a cell, and run elements together."""
    kind, c = df.schema[name].dataType, col(name)
    parts = [c, c.isNull()]
    if isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, _NESTED):
        return parts + ([F.transform(c, lambda x: x.isNull())] if kind.containsNull else [])
    # Maps cannot be hashed at all.
    return [F.to_json(F.struct(c), {"ignoreNullFields": "false"}), c.isNull()] if isinstance(kind, _NESTED) else parts


def row_hash(df: DataFrame, cols: Sequence[str] | None = None, seed: object = None) -> Column:
    """64 bits of a row's cells; a NULL counts as a cell of its own."""
    parts = [F.lit(str(seed))]
    for name in df.columns if cols is None else cols:
        parts += _hashed(df, name)
    return F.xxhash64(*parts)


def row_lanes(df: DataFrame, cols: Sequence[str] | None = None) -> list[Column]:
    """128 bits of a row's cells, as ``lane_a`` and ``lane_b``."""
    return [row_hash(df, cols, seed).alias(f"lane_{seed}") for seed in ("a", "b")]


def content_sums(df: DataFrame, cols: Sequence[str] | None = None, text: bool = True) -> DataFrame:
    """One row: row count and the sums of two hash lanes over all rows.

    Addition makes it independent of row order and partitioning, needs no sort,
    and, unlike XOR, does not cancel repeated rows.  ``text`` hashes the cells as text, which
    other engines can repeat; without it the cells are hashed as they are, many times faster.
    """
    if text:
        rows = df.select(row_digest(df, cols).alias("digest"))
        lanes = [lane(F.col("digest"), at) for at in (1, 1 + _LANE)]
    else:
        rows = df.select(*row_lanes(df, cols))
        lanes = [F.col("lane_a"), F.col("lane_b")]
    return rows.agg(
        F.count(F.lit(1)).alias("rows"),
        *[
            F.coalesce(F.sum(x.cast("decimal(38,0)")), F.lit(0)).cast("string").alias(name)
            for name, x in zip(("lane_a", "lane_b"), lanes)
        ],
    )


def fingerprint_of(df: DataFrame, sums) -> str:
    """The fingerprint of a table of ``df``'s schema whose ``content_sums`` are known."""
    text = f"{schema_hash(df)}|{sums['rows']}|{sums['lane_a']}|{sums['lane_b']}"
    return hashlib.sha256(text.encode()).hexdigest()


def content_fingerprint(df: DataFrame, cols: Sequence[str] | None = None, text: bool = False) -> str:
    """Hash of all rows as a multiset, with schema hash and row count."""
    return fingerprint_of(df, one_row(content_sums(df, cols, text)))


def sampled_fingerprint(
    df: DataFrame, fraction: float = 0.01, cols: Sequence[str] | None = None, seed: int = 42, text: bool = False
) -> str:
    """Content fingerprint of the rows whose hash falls below a threshold.

    Which rows take part depends on their content only, so it is repeatable, and
    every row may take part.
    """
    if text:
        chosen = lane(row_digest(df, cols, seed), 1) < F.lit(int(fraction * 16**_LANE))
    else:
        chosen = F.pmod(row_hash(df, cols, seed), F.lit(1 << 40)) < F.lit(int(fraction * (1 << 40)))
    return SAMPLED + content_fingerprint(df.filter(chosen), cols, text)


def changed_since(
    df: DataFrame, previous: dict | None, rows: int | None = None, content: str | None = None
) -> dict:
    """Compare the cheap layer first; read the content only when it agrees.

    ``previous`` holds ``statistics_fingerprint`` and ``content_fingerprint``; ``rows`` and ``content`` are the table's
    own where they are known already.
    """
    statistics = statistics_fingerprint(df, rows)
    out = {"statistics_fingerprint": statistics, "content_fingerprint": None}
    if previous is None:
        return {**out, "changed": True, "layer": "none"}
    if statistics != previous["statistics_fingerprint"]:
        return {**out, "changed": True, "layer": "statistics"}
    stored = previous["content_fingerprint"] or ""
    # A run over a sample stored the fingerprint of a sample.
    content = sampled_fingerprint(df) if stored.startswith(SAMPLED) else content or content_fingerprint(df)
    changed = content != stored
    return {**out, "content_fingerprint": content, "changed": changed, "layer": "content"}
