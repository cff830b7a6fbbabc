"""Blocks ask, shards answer: counting the whole corpus and taking the counts back to the texts.

Texts are dealt into *blocks* of bounded size by a hash of the row; rows that are equal so often
that they alone would fill much of a block are dealt as one row with a count.  A block reduces its texts to
distinct 64-bit keys and asks about each key once; keys are dealt to *shards* by other bits of the
same hash.  A shard sees what all blocks say about its keys and answers every block.  The block's
texts meet the answers in a cogroup, where the block derives the same sorted keys again, so answers
are plain arrays in key order.  The texts are shuffled once: Spark reuses that exchange for each
later step.  A key in a third of all texts is one entry a block, and no step collects more than a
block or a shard; both are sized by the input.

Arrays travel as byte planes (all first bytes, then all second bytes, ...), which the shuffle's
compression shrinks well for sorted keys and small counts.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritable.llm import words
from veritable.llm.common import blocks, kept, shards

U64 = np.uint64
BLOCK_BYTES = 16 << 20
BLOCK_ROWS = 40_000
#: Copies of a row made at once.
REPEATED = 10_000
MOST_SHARDS = 1 << 15
ASK = "block int, shard int, kind int, keys binary, more binary"


def planes(values: np.ndarray, width: int = 8) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unplanes(data: bytes, width: int = 8) -> np.ndarray:
    n = len(data) // width
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, n).T
    return out.reshape(-1).view("<u8")


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def unbits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def distinct(ordered: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts."""
    fresh = np.ones(len(ordered), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=fresh[1:])
    return np.flatnonzero(fresh)


def holds(ordered: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values occur in a sorted array."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    at = np.searchsorted(ordered, values)
    at[at == len(ordered)] = 0
    return ordered[at] == values


def shard_of(keys: np.ndarray, n: int) -> np.ndarray:
    """A shard below ``n`` by the low 16 bits, which stand in no key that is sent shortened."""
    return ((keys & U64(0xFFFF)) * U64(n)) >> U64(16)


def cuts(shard: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(shard, np.arange(n + 1, dtype=U64))


def n_shards(df: DataFrame) -> int:
    return min(shards(df), MOST_SHARDS)


def in_blocks(rows: DataFrame, text_bytes: int, n_rows: int, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, bool]:
    """``rows`` (``doc_id``, ``text``, ...) with a ``block`` by a hash of id and text, and how many equal
    rows each stands for (``copies``); whether any stands for several."""
    n = max(blocks(rows, text_bytes, block_bytes), -(-n_rows // BLOCK_ROWS))
    tag = F.xxhash64("doc_id", "text")
    counted = rows.groupBy(tag.alias("tag")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    often = (F.col("n") > BLOCK_ROWS // 8) | (F.col("bytes") > block_bytes // 4)
    # At most eight a block by rows and four a block by bytes.
    many = kept(counted.filter((F.col("n") > 1) & often).select("tag"), "equal_rows")
    several = not many.isEmpty()
    if several:
        tagged = rows.withColumn("tag", tag)
        one = tagged.join(F.broadcast(many), "tag", "left_semi").groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("copies"))
        rest = tagged.join(F.broadcast(many), "tag", "left_anti").drop("tag").withColumn("copies", F.lit(1).cast("bigint"))
        rows = rest.unionByName(one)
    else:
        rows = rows.withColumn("copies", F.lit(1).cast("bigint"))
    return rows.withColumn("block", F.pmod(tag, F.lit(n)).cast("int")), several


def repeated(out: DataFrame, several: bool) -> DataFrame:
    """Each row ``copies`` times, made in two steps so that no list of copies is long."""
    if several:
        step = F.lit(REPEATED)
        out = out.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("copies") - 1) / step))))
        left = F.least(step.cast("bigint"), F.col("copies") - F.col("lot") * step)
        out = out.withColumn("lot", F.explode(F.sequence(F.lit(1).cast("bigint"), left))).drop("lot")
    return out.drop("copies")


def size_of(rows: DataFrame) -> tuple[int, int]:
    """Bytes of text and rows."""
    r = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b"), F.count(F.lit(1)).alias("n")).first()
    return r["b"], r["n"]


def ask_table(block: int, asks: list[tuple[int, int, bytes, bytes]]) -> pa.Table:
    """Rows of ``ASK`` for one block: shard, kind, keys, more."""
    cells = list(zip(*asks)) if asks else [(), (), (), ()]
    return pa.table(
        {
            "block": pa.array([block] * len(asks), pa.int32()),
            "shard": pa.array(cells[0], pa.int32()),
            "kind": pa.array(cells[1], pa.int32()),
            "keys": pa.array(cells[2], pa.binary()),
            "more": pa.array(cells[3], pa.binary()),
        }
    )


def said(table: pa.Table) -> dict[int, dict[int, tuple[bytes, bytes]]]:
    """The answers to a block as ``{kind: {shard: (keys, more)}}``."""
    out: dict[int, dict[int, tuple[bytes, bytes]]] = {}
    for shard, kind, keys, more in zip(*(table.column(c).to_pylist() for c in ("shard", "kind", "keys", "more"))):
        out.setdefault(kind, {})[shard] = (keys, more)
    return out


def answered(asks: DataFrame, answer: Callable[[pa.Table], pa.Table]) -> DataFrame:
    return asks.groupBy("shard").applyInArrow(answer, ASK)


def asked(rows: DataFrame, ask: Callable[[pa.Table], pa.Table]) -> DataFrame:
    return rows.groupBy("block").applyInArrow(ask, ASK)


def met(rows: DataFrame, answers: DataFrame, finish: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, schema)
