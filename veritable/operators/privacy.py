"""Masking of personal data.

Finding overlapping hits and replacing their union is per-text work, done in
Arrow batches; texts that cannot contain a hit are recognised beforehand in
generated code and never leave the JVM.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence
from itertools import chain, zip_longest

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritable.functions.columns import col, string_columns

# ---- fixed values: what counts as personal data -----------------------------
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "cn_phone": r"(?<!\d)1[3-9]\d{9}(?!\d)",
    "cn_id": r"(?<!\d)\d{17}[\dXx](?!\d)|(?<!\d)\d{15}(?!\d)",
    "ipv4": r"(?<!\d)(?:\d{1,3}\.){3}\d{1,3}(?!\d)",
    "url": r"(?i:https?://[^\s\"'<>]+)",
}
MASK = "[REDACTED]"
TOKEN = r"\{\{REDACTED:(\w+):(\d+)\}\}"
PREVIEWS = 2
# ---- end of fixed values ----------------------------------------------------

# Every hit contains one of these.
_POSSIBLE = r"(?U)@|\d{11}|\d\.\d|(?i:https?://)"
_HITS = "array<struct<kind:string,value:string>>"


def spans(text: str, patterns: dict) -> list[tuple[int, int, str]]:
    """What the hits of all kinds cover, as separate stretches; each is of the kind that opens it.

    Ends and starts are swept in order, ends first, so stretches that only touch stay apart.
    """
    marks = []
    for kind, pattern in patterns.items():
        for m in pattern.finditer(text):
            marks += [(m.start(), 1, m.end(), kind), (m.end(), 0, 0, "")]
    covered, depth, opened = [], 0, (0, "")
    for at, opens, _, kind in sorted(marks):
        if opens and not depth:
            opened = (at, kind)
        depth += 1 if opens else -1
        if not depth:
            covered.append((opened[0], at, opened[1]))
    return covered


def token_number(value: str) -> int:
    """A number that depends only on the value: equal values get equal tokens everywhere."""
    return int(hashlib.md5(value.encode()).hexdigest()[:30], 16)


def token_digits(value: Column) -> Column:
    """``token_number`` as text, in the JVM: two halves of 60 bits."""
    high, low = (F.conv(F.substring(F.md5(value), at, 15), 16, 10).cast("decimal(19,0)") for at in (1, 16))
    return (high * F.lit(1 << 60).cast("decimal(19,0)") + low).cast("decimal(38,0)").cast("string")


def _compiled() -> dict:
    return {k: re.compile(p) for k, p in PATTERNS.items()}


def _rewrite(replace):
    """UDF replacing each hit by ``replace(kind, value)``."""
    patterns = _compiled()

    @F.pandas_udf("string")
    def rewrite(texts: pd.Series) -> pd.Series:
        def one(text):
            if text is None:
                return None
            found = spans(text, patterns)
            edges = [0, *chain.from_iterable(s[:2] for s in found), len(text)]
            plain = [text[a:b] for a, b in zip(edges[::2], edges[1::2])]
            new = [replace(kind, text[a:b]) for a, b, kind in found]
            return "".join(map("".join, zip_longest(plain, new, fillvalue="")))

        return texts.map(one)

    return rewrite


def _if_possible(c: Column, udf) -> Column:
    suspect = F.when(c.rlike(_POSSIBLE), c)
    return F.coalesce(udf(suspect), c)


def mask_text(c: Column) -> Column:
    """Every hit becomes ``[REDACTED]``."""
    return _if_possible(c, _rewrite(lambda kind, value: MASK))


def tokenise_text(c: Column) -> Column:
    """Every hit becomes ``{{REDACTED:kind:number}}``, equal values alike."""
    return _if_possible(
        c, _rewrite(lambda kind, value: "{{REDACTED:%s:%d}}" % (kind, token_number(value)))
    )


def hits(c: Column) -> Column:
    """The hits of a text, as an array of (kind, value)."""
    patterns = _compiled()

    @F.pandas_udf(_HITS)
    def find(texts: pd.Series) -> pd.Series:
        return texts.map(
            lambda t: None
            if t is None
            else [{"kind": k, "value": t[a:b]} for a, b, k in spans(t, patterns)]
        )

    return find(F.when(c.rlike(_POSSIBLE), c))


def mask(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    names = string_columns(df, cols)
    return df.withColumns({n: mask_text(col(n)) for n in names})


def mapping(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Distinct (kind, token, value) over all rows and columns, with how often each occurs.

    The hits are combined on the map side, so a value repeated in a third of the
    texts is shuffled once per task.
    """
    names = string_columns(df, cols)
    none = F.array().cast(_HITS)
    found = F.flatten(F.array(*[F.coalesce(hits(col(n)), none) for n in names]))
    grouped = (
        df.select(F.explode(found).alias("h"))
        .groupBy(F.col("h.kind").alias("kind"), F.col("h.value").alias("value"))
        .agg(F.count(F.lit(1)).alias("occurrences"))
    )
    token = F.concat(F.lit("{{REDACTED:"), "kind", F.lit(":"), token_digits(F.col("value")), F.lit("}}"))
    return grouped.select("kind", token.alias("token"), "value", "occurrences")


def tokenise(df: DataFrame, cols: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(table with tokens, mapping).  No row needs to see another one's values."""
    names = string_columns(df, cols)
    return df.withColumns({n: tokenise_text(col(n)) for n in names}), mapping(df, names)


def restore(df: DataFrame, tokens: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    """Put the originals back; unknown tokens stay as they are.

    Only the texts that hold tokens are exploded; they meet the mapping in a join on
    the token, which adaptive execution splits when one token is very frequent.
    """
    whole = F.regexp_extract_all(col(column), F.lit("(" + TOKEN + ")"), F.lit(1))
    held = df.select(*[col(k) for k in keys], F.explode(F.array_distinct(whole)).alias("token"))
    known = held.join(tokens.select("token", "value"), "token")
    # At most one entry per distinct token of the row.
    per_row = known.groupBy(*keys).agg(F.collect_list(F.struct("token", "value")).alias("__known"))
    restored = F.aggregate(
        "__known", col(column), lambda text, t: F.replace(text, t["token"], t["value"])
    )
    joined = df.join(per_row, list(keys), "left")
    return joined.withColumn(column, F.coalesce(restored, col(column))).select(*df.columns)


def pii_summary(tokens: DataFrame) -> DataFrame:
    """Distinct masked values and hits per kind, with up to two sample tokens."""
    return tokens.groupBy("kind").agg(
        F.count(F.lit(1)).alias("distinct_values"),
        F.sum("occurrences").alias("hits"),
        F.array_compact(
            F.array(
                F.min("token"), F.when(F.count(F.lit(1)) > 1, F.max("token"))
            )
        ).alias("samples"),
    )


def _of_kind(kind: str):
    return lambda h: h["kind"] == kind


def pii_by_column(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Hits and affected rows per (column, kind): the hits that masking replaces."""
    names = string_columns(df, cols)
    none = F.array().cast(_HITS)
    kinds = list(PATTERNS)
    aggs, cells = [], []
    for i, n in enumerate(names):
        for j, kind in enumerate(kinds):
            count = F.size(F.filter(F.col(f"h{i}"), _of_kind(kind)))
            aggs += [
                F.coalesce(F.sum(count), F.lit(0)).alias(f"h{i}_{j}"),
                F.count_if(count > 0).alias(f"r{i}_{j}"),
            ]
            cells.append(
                F.struct(
                    F.lit(n).alias("column"),
                    F.lit(kind).alias("kind"),
                    F.col(f"h{i}_{j}").alias("hits"),
                    F.col(f"r{i}_{j}").alias("rows"),
                )
            )
    found = df.select(*[F.coalesce(hits(col(n)), none).alias(f"h{i}") for i, n in enumerate(names)])
    return found.agg(*aggs).select(F.inline(F.array(*cells)))


def _keyed(df: DataFrame, key: str) -> DataFrame:
    """``df`` with the key as data: a literal would show in plans and event logs."""
    one = df.sparkSession.createDataFrame([(key,)], "__key string")
    return df.join(F.broadcast(one), F.lit(True))


def encrypt_mapping(tokens: DataFrame, key: str, created_at: Column | None = None) -> DataFrame:
    """The mapping with its originals encrypted (AES-GCM; ``key`` of 16, 24 or 32 bytes)."""
    at = created_at if created_at is not None else F.current_timestamp()
    return _keyed(tokens, key).select(
        "kind", "token", F.aes_encrypt("value", F.col("__key")).alias("secret"), at.alias("created_at")
    )


def decrypt_mapping(vault: DataFrame, key: str) -> DataFrame:
    return _keyed(vault, key).select(
        "kind", "token", F.aes_decrypt("secret", F.col("__key")).cast("string").alias("value"), "created_at"
    )


def rekey(vault: DataFrame, old_key: str, new_key: str) -> DataFrame:
    """The same mapping under a new key."""
    return encrypt_mapping(decrypt_mapping(vault, old_key), new_key, F.col("created_at"))


def purge(vault: DataFrame, days: int, as_of: Column | None = None) -> DataFrame:
    """Drop entries older than ``days``."""
    now = as_of if as_of is not None else F.current_timestamp()
    return vault.filter(F.col("created_at") >= now - F.make_dt_interval(F.lit(days)))
