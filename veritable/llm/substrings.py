"""Substring dedup by fixed-block anchors.

Every text is cut into non-overlapping blocks of ``ANCHOR`` words; these are the index.  Every
rolling window of ``ANCHOR`` words of every text probes it.  Any run of at least ``2 * ANCHOR - 1``
words that two texts share holds a whole block of either text, so with blocks of 25 words no shared
run of 50 is missed.  Hits are extended to all 50-word windows around them; those are confirmed by
their full content, which finds the smallest document that has each, and confirmed windows that
follow one another merge into maximal repeats.  A word is removed if such a window of its text also
starts in a document with a smaller id.

Nothing is paired: a passage shared by thousands of texts is one key with its smallest document.
Probes travel as 32 bits each (chance hits are sorted out when windows are confirmed on 64 bits of
another hash, next to their shard); texts are shuffled once (see ``exchange``).

Defined cases: NULL and empty texts have no words, nothing removed, and the digest of the empty text.
Texts of fewer than 50 words lose nothing.  Rows with the same id do not remove each other's words; a
row with a NULL id neither loses words nor makes others lose them.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from veritable.llm import exchange as X
from veritable.llm import words
from veritable.llm.common import documents

U64 = np.uint64
WINDOW = 50
ANCHOR = 25
PROBES, WINDOWS, HOT = 0, 1, 2
NO_ID = (1 << 63) - 1
#: Text of a block; a task holds some thirty times as much in arrays.
BLOCK_BYTES = 6 << 20
#: Up to so many texts, a text's place in its block fits below its probes' keys.
PACKED_TEXTS = 1 << 16


def probe_keys(w: words.Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each rolling anchor-sized window: shard and 32 bits, its first word, whether it is an index block."""
    h, at = words.windows(w, ANCHOR, seed=31)
    owner = np.searchsorted(w.first, at, side="right") - 1
    return (X.shard_of(h, n) << U64(32)) | (h >> U64(32)), at, (at - w.first[owner]) % ANCHOR == 0


def probe_summary(w: words.Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple]:
    """The distinct probes of a block in order, which are index blocks, which occur in several of its texts."""
    key, at, aligned = probe_keys(w, n)
    owner = (np.searchsorted(w.first, at, side="right") - 1).astype(U64)
    # Each text counts once.
    if len(w.first) - 1 <= PACKED_TEXTS:
        # Shard (15 bits), 32 bits of the probe, 16 bits for the text.
        u = np.sort((key << U64(16)) | owner)
        u = u[X.distinct(u)] >> U64(16)
    else:
        order = np.lexsort((owner, key))
        u, of = key[order], owner[order]
        fresh = np.ones(len(u), bool)
        fresh[1:] = (u[1:] != u[:-1]) | (of[1:] != of[:-1])
        u = u[fresh]
    start = X.distinct(u)
    texts = np.diff(np.append(start, len(u)))
    keys = u[start]
    index = np.sort(key[aligned])
    return keys, X.holds(index, keys), texts > 1, (key, at)


def removals(docs: DataFrame) -> DataFrame:
    """One row a document: words, removed words, digest of the kept ones."""
    rows = documents(docs, "doc_id", "text")
    n = X.n_shards(docs)
    # Equal rows have the same id, so none removes another's words: one speaks for all.
    rows, several = X.in_blocks(rows, *X.size_of(rows), BLOCK_BYTES)

    def ask(table: pa.Table) -> pa.Table:
        w = words.find_words(table.column("text"))
        keys, index, several, _ = probe_summary(w, n)
        cut = X.cuts(keys >> U64(32), n)
        asks = []
        for s, (a, b) in enumerate(zip(cut[:-1], cut[1:])):
            if b > a:
                asks.append((s, PROBES, X.planes(keys[a:b], 4), X.bits(np.concatenate([index[a:b], several[a:b]]))))
        return X.ask_table(table.column("block")[0].as_py(), asks)

    def which_repeat(table: pa.Table) -> pa.Table:
        parts, index, several = [], [], []
        for keys, flags in zip(table.column("keys").to_pylist(), table.column("more").to_pylist()):
            k = X.unplanes(keys, 4)
            f = X.unbits(flags, 2 * len(k))
            parts.append(k)
            index.append(k[f[: len(k)]])
            several.append(k[f[len(k) :]])
        every = np.sort(np.concatenate(parts))
        twice = every[1:][every[1:] == every[:-1]]
        repeated = np.sort(np.concatenate([twice, *several]))
        repeated = repeated[X.distinct(repeated)]
        hot = repeated[X.holds(np.sort(np.concatenate(index)), repeated)]
        return pa.table(
            {
                "block": table.column("block"),
                "shard": table.column("shard"),
                "kind": table.column("kind"),
                "keys": pa.array([b""] * len(parts), pa.binary()),
                "more": pa.array([X.bits(X.holds(hot, k)) for k in parts], pa.binary()),
            }
        )

    def hot_flags(keys: np.ndarray, told: dict[int, tuple[bytes, bytes]]) -> np.ndarray:
        cut = X.cuts(keys >> U64(32), n)
        flags = np.zeros(len(keys), bool)
        for s, (_, more) in told.items():
            flags[cut[s] : cut[s + 1]] = X.unbits(more, int(cut[s + 1] - cut[s]))
        return flags

    def extended(w: words.Words, keys, hot, probes) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first word of each whole window that holds a hit."""
        key, at = probes
        hit = np.zeros(len(w.hashes) + 1, np.int64)
        hit[at[X.holds(keys[hot], key)]] = 1
        before = np.concatenate([[0], np.cumsum(hit)])
        h, start = words.windows(w, WINDOW, seed=41)
        near = before[start + WINDOW - ANCHOR + 1] > before[start]
        return h[near], start[near]

    def ids_of(table: pa.Table) -> np.ndarray:
        return table.column("doc_id").fill_null(NO_ID).to_numpy()

    def ask_windows(table: pa.Table, answers: pa.Table) -> pa.Table:
        w = words.find_words(table.column("text"))
        keys, _, _, probes = probe_summary(w, n)
        hot = hot_flags(keys, X.said(answers).get(PROBES, {}))
        h, start = extended(w, keys, hot, probes)
        ids = ids_of(table)[np.searchsorted(w.first, start, side="right") - 1]
        h, ids = h[ids != NO_ID], ids[ids != NO_ID]
        order = np.lexsort((ids, h, X.shard_of(h, n)))
        h, ids = h[order], ids[order]
        at = X.distinct(h)  # equal hashes have equal shards
        h, ids = h[at], ids[at]
        cut = X.cuts(X.shard_of(h, n), n)
        block = table.column("block")[0].as_py()
        asks = [
            (s, WINDOWS, X.planes(h[a:b]), X.planes(ids[a:b])) for s, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a
        ]
        # Which probes were hot is needed again where the windows' answers arrive.
        return X.ask_table(block, [*asks, (block % n, HOT, b"", X.bits(hot))])

    def smallest(table: pa.Table) -> pa.Table:
        kinds = np.asarray(table.column("kind").to_pylist())
        more = table.column("more").to_pylist()
        which = np.flatnonzero(kinds == WINDOWS)
        keep = [more[i] if kinds[i] == HOT else b"" for i in range(len(kinds))]
        if len(which):
            parts = [X.unplanes(table.column("keys")[int(i)].as_py()) for i in which]
            keys = np.concatenate(parts)
            ids = np.concatenate([X.unplanes(more[i]) for i in which]).astype(np.int64)
            order = np.argsort(keys, kind="stable")
            at = X.distinct(keys[order])
            least = np.empty(len(keys), np.int64)
            least[order] = np.repeat(np.minimum.reduceat(ids[order], at), np.diff(np.append(at, len(keys))))
            # A block whose own smallest document is the smallest of all needs only to know that.
            for i, part in zip(which, np.split(least < ids, np.cumsum([len(p) for p in parts])[:-1])):
                keep[i] = X.bits(part)
        return pa.table(
            {
                "block": table.column("block"),
                "shard": table.column("shard"),
                "kind": table.column("kind"),
                "keys": pa.array([b""] * len(kinds), pa.binary()),
                "more": pa.array(keep, pa.binary()),
            }
        )

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        w = words.find_words(table.column("text"))
        told = X.said(answers)
        size = len(w.hashes)
        removed = np.zeros(size, bool)
        if WINDOWS in told:
            keys, _, _, probes = probe_summary(w, n)
            (_, packed_hot), = told[HOT].values()
            h, start = extended(w, keys, X.unbits(packed_hot, len(keys)), probes)
            ids = ids_of(table)[np.searchsorted(w.first, start, side="right") - 1]
            h, start, ids = (x[ids != NO_ID] for x in (h, start, ids))
            order = np.lexsort((ids, h, X.shard_of(h, n)))
            at = X.distinct(h[order])
            cut = X.cuts(X.shard_of(h[order][at], n), n)
            elsewhere = np.zeros(len(at), bool)
            for s, (_, more) in told[WINDOWS].items():
                elsewhere[cut[s] : cut[s + 1]] = X.unbits(more, int(cut[s + 1] - cut[s]))
            runs = np.diff(np.append(at, len(order)))
            own = np.repeat(ids[order][at], runs) < ids[order]
            gone = start[order][np.repeat(elsewhere, runs) | own]
            cover = np.zeros(size + 1, np.int64)
            np.add.at(cover, gone, 1)
            np.add.at(cover, gone + WINDOW, -1)
            removed = np.cumsum(cover[:-1]) > 0
        return pa.table(
            {
                "doc_id": table.column("doc_id"),
                "n_words": pa.array(w.counts, pa.int64()),
                "n_removed": pa.array(np.diff(np.concatenate([[0], np.cumsum(removed)])[w.first]), pa.int64()),
                "kept_sha256": pa.array(digests(w, ~removed), pa.string()),
                "copies": table.column("copies"),
            }
        )

    hits = X.answered(X.asked(rows, ask), which_repeat)
    answers = X.answered(X.met(rows, hits, ask_windows, X.ASK), smallest)
    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, copies bigint"
    return X.repeated(X.met(rows, answers, finish, schema), several)


def digests(w: words.Words, keep: np.ndarray) -> list[str]:
    """SHA-256 of each text's kept words, joined by one space."""
    n = len(w.text_at) - 1
    # Each text with one blank more, so that a byte follows every word: it becomes the separator.
    data = np.full(len(w.data) + n, 32, np.uint8)
    data[np.arange(len(w.data)) + np.repeat(np.arange(n), np.diff(w.text_at))] = w.data
    owner = w.owner[keep]
    starts, ends = w.starts[keep] + owner, w.ends[keep] + owner
    edge = np.zeros(len(data) + 1, np.int8)
    edge[starts] = 1
    edge[ends] = -1
    take = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    take[ends] = True
    data[ends] = 32
    upto = np.concatenate([[0], np.cumsum(take)])[w.text_at + np.arange(n + 1)]
    flat = data[take].tobytes()
    return [hashlib.sha256(flat[a : max(a, b - 1)]).hexdigest() for a, b in zip(upto[:-1], upto[1:])]


def op9(docs: DataFrame) -> DataFrame:
    return removals(docs)
