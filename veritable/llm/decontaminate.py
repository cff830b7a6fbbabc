"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items fall into size classes by powers of two.  For a class of up to ``s`` shingles a document
is seen as overlapping segments of ``2 s`` shingles, one every ``s``: wherever an item stands in a
long document, one segment holds it whole and is at most a few times its size, so that containment
in the document shows as a usable resemblance to that segment.  Signatures are one-permutation
MinHashes of at least ``4 s`` bins.  A segment that agrees with an item in any bin is a candidate; each
candidate is verified by exact containment of the item's shingles in the whole document.

A signature entry of an item can only be met where that very shingle occurs, so a document without
any of them needs no signature: a bit table over the items' entries skips it in one look-up a word.

Items are handled in blocks of bounded size, chosen by a hash: each block is sent to the tasks, and
documents are read once a block.  Nothing is shuffled.  Words are compared with A-Z lower-cased; a
shingle has five words, or all words of a shorter item.

Defined cases: an item without words is never found; a NULL or empty document holds nothing.
Repeated item rows count once; repeated documents are each reported or dropped.  Of two items of one
id and different texts, both are searched.  Extra columns are ignored by the search, kept by ``clean``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field as dc_field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritable.llm import exchange as X
from veritable.llm import words
from veritable.llm.common import by_place, documents, field

U64 = np.uint64
SHINGLE = 5
BLOCK_BYTES = 8 << 20
_TABLE_BITS = 22


@dataclass
class Index:
    """One block of items, for one shingle size."""

    size: int
    ids: list = dc_field(default_factory=list)
    #: Sorted distinct shingles of each item.
    shingles: list = dc_field(default_factory=list)
    #: Per size class (log2 of s): the signature entries in order, and the item of each.
    entries: dict = dc_field(default_factory=dict)
    table: np.ndarray | None = None


def bins_of(level: int) -> int:
    """Bins of a signature for items of up to ``2**level`` shingles, so that fewer than one in a million is missed.

    An entry is lost where a segment has a smaller shingle in its bin; small items have few entries to spare.
    """
    return 1 << max((20, 12, 10, 9, 8)[level] if level < 5 else 0, level + 2)


def bin_minima(h: np.ndarray, of: np.ndarray, bins: int) -> np.ndarray:
    """The one-permutation MinHash entries of several sets; ``of`` is the set of each hash."""
    bin_ = h & U64(bins - 1)
    order = np.lexsort((h, bin_, of))
    fresh = np.ones(len(h), bool)
    fresh[1:] = (bin_[order][1:] != bin_[order][:-1]) | (of[order][1:] != of[order][:-1])
    return h[order][fresh]


def build(items: list[tuple[int, str]]) -> list[Index]:
    """Indexes over ``(item_id, text)``, one for each shingle size in use."""
    out: dict[int, Index] = {}
    if not items:
        return []
    w = words.find_words(pa.array([t for _, t in items], pa.string()), lower=True)
    entries: dict[tuple[int, int], list] = {}
    for i, count in enumerate(w.counts):
        if not count:
            continue
        size = min(SHINGLE, int(count))
        index = out.setdefault(size, Index(size))
        at = np.arange(w.first[i], w.first[i + 1] - size + 1)
        every = words.spans_hash(w.hashes, at, at + size, 21)
        own = np.unique(every)
        level = math.ceil(math.log2(len(every)))
        minima = bin_minima(own, np.zeros(len(own), np.int64), bins_of(level))
        entries.setdefault((size, level), []).append((minima, len(index.ids)))
        index.ids.append(items[i][0])
        index.shingles.append(own)
    for (size, level), found in entries.items():
        value = np.concatenate([v for v, _ in found])
        item = np.concatenate([np.full(len(v), i) for v, i in found])
        order = np.argsort(value, kind="stable")
        out[size].entries[level] = (value[order], item[order])
    for index in out.values():
        index.table = np.zeros(1 << _TABLE_BITS, bool)
        for value, _ in index.entries.values():
            index.table[(value >> U64(64 - _TABLE_BITS)).astype(np.int64)] = True
    return list(out.values())


def contained(h: np.ndarray, index: Index, least: float) -> list[tuple[int, int, int]]:
    """Items in one document with shingles ``h``: place in the index, shared shingles, the item's shingles."""
    candidates: set[int] = set()
    for level, (value, item) in index.entries.items():
        seen = np.flatnonzero(X.holds(value, h))
        if not len(seen):
            continue
        half = np.arange(len(h)) >> level
        # Only halves next to a met entry can agree with an item.
        near = np.unique(np.concatenate([half[seen], half[seen] - 1, half[seen] + 1]))
        near = near[(near >= 0) & (near <= half[-1])]
        inside = np.isin(half, near)
        # A half is the first of one segment and the second of the one before.
        both = np.concatenate([half[inside], half[inside] - 1])
        met = np.unique(bin_minima(np.tile(h[inside], 2), both, bins_of(level)))
        met = met[X.holds(value, met)]
        lo, hi = np.searchsorted(value, met), np.searchsorted(value, met, side="right")
        for a, b in zip(lo, hi):
            candidates.update(item[a:b].tolist())
    if not candidates:
        return []
    own = np.sort(h)
    out = []
    for i in sorted(candidates):
        shared = int(X.holds(own, index.shingles[i]).sum())
        if shared >= least * len(index.shingles[i]):
            out.append((i, shared, len(index.shingles[i])))
    return out


def search_piece(column: pa.Array, indexes: list[Index], least: float) -> Iterator[tuple[int, int, int, int]]:
    """Hits in a piece of texts: text, item id, shared shingles, the item's shingles."""
    w = words.find_words(column, lower=True)
    for index in indexes:
        h, at = words.windows(w, index.size)
        hit = np.flatnonzero(index.table[(h >> U64(64 - _TABLE_BITS)).astype(np.int64)])
        if not len(hit):
            continue
        first = np.searchsorted(at, w.first)
        for i in np.unique(np.searchsorted(w.first, at[hit], side="right") - 1):
            for item, shared, size in contained(h[first[i] : first[i + 1]], index, least):
                yield int(i), index.ids[item], shared, size


def item_blocks(items: DataFrame) -> Iterator[list[Index]]:
    """The items' indexes, block by block; a block's texts are at most about ``BLOCK_BYTES``."""
    rows = items.select(
        field(items, "item_id").cast("bigint").alias("item_id"), field(items, "text").cast("string").alias("text")
    ).filter(F.col("text").isNotNull())
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    n = max(1, math.ceil(total / BLOCK_BYTES))
    for k in range(n):
        part = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).distinct()
        found = sorted(((r["item_id"], r["text"]) for r in part.collect()), key=lambda r: (r[0] is not None, r))
        if indexes := build(found):
            yield indexes


def find_items(docs: DataFrame, items: DataFrame, least: float = 0.8) -> DataFrame:
    """One row for each document and item it holds: ``doc_id, item_id, n_shared, n_item, containment``."""
    rows = documents(docs, "doc_id", "text")
    schema = "doc_id bigint, item_id bigint, n_shared bigint, n_item bigint, containment double"
    found = [rows.sparkSession.createDataFrame([], schema)]
    for indexes in item_blocks(items):
        # The fields, not the objects: workers need not have this package.
        shared = rows.sparkSession.sparkContext.broadcast([vars(i) for i in indexes])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known = [Index(**i) for i in shared.value]
            for piece in words.pieces(batches):
                hits = list(search_piece(piece.column("text"), known, least))
                if hits:
                    ids = piece.column("doc_id").take(pa.array([i for i, *_ in hits], pa.int64()))
                    item, n, size = (np.array(x) for x in zip(*(h[1:] for h in hits)))
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids,
                            pa.array([h[1] for h in hits], pa.int64()),
                            pa.array(n, pa.int64()),
                            pa.array(size, pa.int64()),
                            pa.array(n / size, pa.float64()),
                        ],
                        ["doc_id", "item_id", "n_shared", "n_item", "containment"],
                    )

        found.append(rows.mapInArrow(run, schema))
    return reduce(DataFrame.unionByName, found[1:] or found)


def clean(docs: DataFrame, items: DataFrame, least: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that hold no item."""
    text, names = f"c{docs.columns.index('text')}", docs.columns
    docs = by_place(docs)
    for indexes in item_blocks(items):
        shared = docs.sparkSession.sparkContext.broadcast([vars(i) for i in indexes])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known = [Index(**i) for i in shared.value]
            for piece in words.pieces(batches, column=text):
                bad = {i for i, *_ in search_piece(piece.column(text), known, least)}
                yield piece.filter(pa.array([i not in bad for i in range(piece.num_rows)])) if bad else piece

        docs = docs.mapInArrow(run, docs.schema)
    return docs.toDF(*names)


_W = r"'[^\x20\x09-\x0D]+'"
_LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = f"""
WITH item_words AS (SELECT DISTINCT item_id, text, regexp_extract_all({_LOW.format("text")}, {_W}) AS w FROM benchmark),
items AS (SELECT item_id, text, w, least(5, len(w)) AS k FROM item_words WHERE len(w) > 0),
item_shingles AS (
  SELECT DISTINCT item_id, text, k, unnest([array_to_string(w[i:i + k - 1], ' ') for i in range(1, len(w) - k + 2)]) AS s FROM items),
sizes AS (SELECT DISTINCT k FROM items),
doc_words AS (SELECT doc_id, regexp_extract_all({_LOW.format("text")}, {_W}) AS w FROM documents),
doc_shingles AS (
  SELECT DISTINCT doc_id, k, unnest([array_to_string(w[i:i + k - 1], ' ') for i in range(1, len(w) - k + 2)]) AS s
  FROM doc_words, sizes WHERE len(w) >= k),
totals AS (SELECT item_id, text, k, count(*) AS n_item FROM item_shingles GROUP BY ALL),
shared AS (SELECT doc_id, item_id, text, count(*) AS n_shared FROM doc_shingles JOIN item_shingles USING (k, s) GROUP BY ALL)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment
FROM shared JOIN totals USING (item_id, text) WHERE n_shared >= 0.8 * n_item
"""


def op8(docs: DataFrame, items: DataFrame) -> DataFrame:
    return find_items(docs, items)
