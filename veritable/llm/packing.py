"""Packing into optimal length buckets.

Texts are cut into pieces of at most ``longest`` tokens (words, and an end mark after each text's
last).  Over the global histogram of piece lengths, dynamic programming chooses the ``n_buckets``
bucket lengths with the least padding in all.  Inside each bucket, batches take pieces up to a token
budget, padding counted.

The histogram has at most ``longest`` entries whatever the corpus, so it is all the driver sees.
Batches form within groups of about ``GROUP_TOKENS`` tokens and at most about ``GROUP_ROWS`` pieces that a hash deals
out inside each bucket, so the most common length is spread over many tasks, and so is a row that is repeated
very often: its copies are told apart by their task and by how many came before them there.  Each group's last batch may
stay part full.

Defined cases: a NULL or empty text is one piece of one token, the end mark.  Very long texts become
many pieces, no token is lost.  Repeated rows are packed each.  An empty table gives no rows.  With
fewer distinct lengths than buckets there is a bucket for each.  Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritable.llm import words
from veritable.llm.common import documents

LONGEST = 2048
N_BUCKETS = 12
BUDGET = 32_768
GROUP_ROWS, GROUP_TOKENS = 20_000, 1 << 20
_PIECE = "doc_id bigint, piece int, first_token bigint, n_tokens int, text string, copy bigint"


def cut(docs: DataFrame, longest: int = LONGEST, with_text: bool = True) -> DataFrame:
    """Pieces of at most ``longest`` tokens.  A piece's text runs from its first word to its last.

    ``copy`` differs between equal rows.  It depends only on what a task holds, not on the order, so a task that runs again
    gives the same pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, met = TaskContext.get().partitionId() << 32, Counter()
        for part in words.pieces(batches):
            copies = []
            for key in part.column("row").to_pylist() if with_text else ():
                copies.append(task + met[key])
                met[key] += 1
            w = words.find_words(part.column("text"), hashed=False)
            tokens = w.counts + 1
            n = -(-tokens // longest)
            text = np.repeat(np.arange(len(n)), n)
            piece = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
            begin = piece * longest
            size = np.minimum(tokens[text] - begin, longest)
            cells = [
                part.column("doc_id").take(pa.array(text)),
                pa.array(piece, pa.int32()),
                pa.array(begin, pa.int64()),
                pa.array(size, pa.int32()),
            ]
            if with_text:
                a = w.first[text] + begin
                b = np.minimum(a + size, w.first[text + 1])
                some = b > a
                lo, hi = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
                lo[some], hi[some] = w.starts[a[some]], w.ends[b[some] - 1]
                raw = w.data.tobytes()
                cells.append(pa.array([raw[x:y].decode("utf-8", "replace") for x, y in zip(lo, hi)], pa.string()))
                cells.append(pa.array(np.array(copies, np.int64)[text]))
            else:
                cells += [pa.nulls(len(text), pa.string()), pa.nulls(len(text), pa.int64())]
            yield pa.RecordBatch.from_arrays(cells, ["doc_id", "piece", "first_token", "n_tokens", "text", "copy"])

    rows = documents(docs, "doc_id", "text")
    return rows.withColumn("row", F.xxhash64("doc_id", "text") if with_text else F.lit(0)).mapInArrow(run, _PIECE)


def choose(lengths: np.ndarray, counts: np.ndarray, n_buckets: int) -> list[int]:
    """The bucket lengths with the least padding: sorted distinct ``lengths`` occur ``counts`` times.

    ``best[j]`` is the least padding of the first j lengths in k buckets; the last bucket holds
    lengths i..j-1, all padded to lengths[j - 1].
    """
    m = len(lengths)
    if not m:
        return []
    size = np.concatenate([[0.0], np.cumsum(counts, dtype=float)])
    mass = np.concatenate([[0.0], np.cumsum(counts * lengths, dtype=float)])
    best = np.full(m + 1, np.inf)
    best[0] = 0.0
    back = []
    for _ in range(min(n_buckets, m)):
        after, came = np.full(m + 1, np.inf), np.zeros(m + 1, int)
        for j in range(1, m + 1):
            cost = best[:j] + lengths[j - 1] * (size[j] - size[:j]) - (mass[j] - mass[:j])
            came[j] = cost.argmin()
            after[j] = cost[came[j]]
        best = after
        back.append(came)
    out, j = [], m
    for came in reversed(back):
        out.append(int(lengths[j - 1]))
        j = came[j]
    return out[::-1]


def pack(docs: DataFrame, longest: int = LONGEST, n_buckets: int = N_BUCKETS, budget: int = BUDGET) -> DataFrame:
    """One row a piece: ``doc_id, piece, first_token, n_tokens, text``, its ``bucket``, the length it is
    padded to, its ``batch`` and its ``slot`` there."""
    histogram = cut(docs, longest, with_text=False).groupBy("n_tokens").count().collect()
    seen = sorted((r["n_tokens"], r["count"]) for r in histogram)
    lengths, counts = (np.array([x[i] for x in seen], np.int64) for i in (0, 1))
    tops = choose(lengths, counts, n_buckets) or [longest]
    inside = [int(counts[(lengths <= top) & (lengths > low)].sum()) for low, top in zip([0, *tops], tops)]
    groups = [max(1, math.ceil(n / GROUP_ROWS), math.ceil(n * top / GROUP_TOKENS)) for n, top in zip(inside, tops)]

    def of(values: list[int]):
        return F.element_at(F.array(*(F.lit(v) for v in values)), F.col("bucket") + 1)

    bucket = sum((F.when(F.col("n_tokens") > top, 1).otherwise(0) for top in tops[:-1]), F.lit(0))
    draw = F.xxhash64("doc_id", "piece", "text", "copy")
    rows = cut(docs, longest).withColumn("bucket", bucket.cast("int"))
    rows = rows.withColumn("padded", of(tops)).withColumn("draw", draw)
    rows = rows.withColumn("part", F.pmod(F.col("draw"), of(groups)).cast("int"))
    turn = F.row_number().over(Window.partitionBy("bucket", "part").orderBy("draw", "doc_id", "piece", "copy")) - 1
    room = F.greatest(F.floor(F.lit(budget) / F.col("padded")), F.lit(1)).cast("int")
    return rows.withColumn("turn", turn).select(
        "doc_id",
        "piece",
        "first_token",
        "n_tokens",
        "text",
        "bucket",
        "padded",
        F.concat_ws("-", "bucket", "part", F.floor(F.col("turn") / room).cast("string")).alias("batch"),
        (F.col("turn") % room).cast("int").alias("slot"),
    )


def op6(docs: DataFrame) -> DataFrame:
    return pack(docs)
