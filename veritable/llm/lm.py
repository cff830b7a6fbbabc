"""Language-model scoring by a weighted backoff automaton.

A smoothed n-gram model is an automaton.  Its states are the root, one state for each word seen in training (the text so far
ends in it), and, from order 3 on, one for each two words that followed each other, and so on.  A state has an arc
for every word that followed it, with the smoothed conditional probability, and a failure arc with a backoff
weight to the state that forgets its first word, in the end to the root; the root has an arc for every word, and one for
unknown words.  A text is read once from left to right, carrying the state: take the arc of the next word, or
else failure arcs until a state has one, and add up log10 weights.

    P(w)     = (c(w) + 1) / (N + V + 1)
    P(w | s) = (c(s, w) + MU * P(w | s')) / (c(s) + MU)        failure weight of s: MU / (c(s) + MU), leading to s'

which sums to one over the V known words and one unknown.  A text begins in the state of the end
mark, and each text's last token is the end mark, so c(end) is also the number of training texts.
``order`` is the longest n-gram: 2 has words as states, 3 also pairs of words.

Counts cover the whole corpus and live in shards (see ``exchange``), those of each length in shards of their own; nothing
grows on the driver but N and V.  Each block of texts gets from the shards just the states and arcs that its texts can meet.

Defined cases: a NULL or empty text has the one token *end*.  NULL ids are scored and not learnt
from, their ``held_out`` is NULL.  Repeated rows count and are scored each.  With nothing to learn from, N = V = 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritable.llm import exchange as X
from veritable.llm import words
from veritable.llm.common import documents, remainder

U64 = np.uint64
MU = 50.0
#: Stands for the end mark; no word hashes to it but by chance of 2**-64.
END = U64(0x5EED0E4D)
#: Words of the longest n-gram.
ORDER = 3
#: Bits of a key that are sent, next to its shard.
SENT = 47
LOW = U64((1 << SENT) - 1)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each text's end mark included, and where each text starts."""
    w = words.find_words(column, lower=True)
    n = len(w.first) - 1
    first = w.first + np.arange(n + 1)
    out = np.full(len(w.hashes) + n, END, U64)
    out[np.arange(len(w.hashes)) + w.owner] = w.hashes
    return out, first


def grams(token: np.ndarray, first: np.ndarray, order: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length up to ``order``: keys of the n-grams that end at each token, and which tokens have one.

    The mark a text begins with counts as one word before it, so its first token has a pair and no longer n-gram.
    """
    place = np.arange(len(token)) - np.repeat(first[:-1], np.diff(first))
    keys = token
    yield 1, keys, place >= 0
    for n in range(2, order + 1):
        before = np.empty_like(keys)
        before[1:] = keys[:-1]
        before[first[:-1]] = END
        keys = words.mix(before * U64(0x9E3779B97F4A7C15) ^ words.mix(token + U64(0x1234567)))
        yield n, keys, place >= n - 2


def packed(keys: np.ndarray, n: int) -> np.ndarray:
    """Shard (16 bits), 47 bits of the key, and a free low bit."""
    return (X.shard_of(keys, n) << U64(48)) | ((keys >> U64(64 - SENT)) << U64(1))


def steps(ordered: np.ndarray) -> np.ndarray:
    """Sorted keys as the distances between them, whose upper bytes are mostly zero and shrink away."""
    return np.diff(ordered, prepend=U64(0))


def tallied(keys: np.ndarray, learn: np.ndarray, n: int, copies: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct packed keys in order, and how often each occurs in training texts (each ``copies`` times)."""
    v = packed(keys, n) | (~learn).astype(U64)
    if copies is None:
        v = np.sort(v)
        times = (v & U64(1)) == 0
    else:
        order = np.argsort(v)
        v = v[order]
        times = np.where((v & U64(1)) == 0, copies[order], 0)
    at = X.distinct(v >> U64(1))
    trained = np.concatenate([[0], np.cumsum(times)])
    return v[at] & ~U64(1), np.diff(trained[np.append(at, len(v))])


def totals(rows: DataFrame) -> dict:
    """N, V, bytes and rows of the corpus; ``rows`` has ``text`` and ``learn``."""
    n = X.n_shards(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = [np.zeros(0, U64)]
        count = size = texts = pending = 0

        def flush():
            v = np.sort(np.concatenate(have))
            v = v[X.distinct(v)]
            cut = X.cuts(v >> U64(48), n)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(n), pa.int32()),
                    pa.array([X.planes((v[a:b] & U64((1 << 48) - 1)), 6) for a, b in zip(cut[:-1], cut[1:])], pa.binary()),
                    pa.array([count] + [0] * (n - 1), pa.int64()),
                    pa.array([size] + [0] * (n - 1), pa.int64()),
                    pa.array([texts] + [0] * (n - 1), pa.int64()),
                ],
                ["shard", "keys", "tokens", "bytes", "texts"],
            )

        for piece in words.pieces(batches):
            token, first = tokens(piece.column("text"))
            learn = np.repeat(np.asarray(piece.column("learn").to_pylist(), bool), np.diff(first))
            v = np.sort(packed(token[learn], n))
            have.append(v[X.distinct(v)])
            count, size, texts = count + int(learn.sum()), size + len(words.text_buffers(piece.column("text"))[0]), texts + piece.num_rows
            pending += len(have[-1])
            if pending > 4_000_000:  # bounds a long task's memory
                yield flush()
                have, count, size, texts, pending = [np.zeros(0, U64)], 0, 0, 0, 0
        yield flush()

    def join(table: pa.Table) -> pa.Table:
        v = np.sort(np.concatenate([X.unplanes(k, 6) for k in table.column("keys").to_pylist()]))
        total = [sum(table.column(c).to_pylist()) for c in ("tokens", "bytes", "texts")]
        return pa.table({c: pa.array([x], pa.int64()) for c, x in zip(("v", "n", "b", "r"), (len(X.distinct(v)) if len(v) else 0, *total))})

    parts = rows.select("text", "learn").mapInArrow(run, "shard int, keys binary, tokens bigint, bytes bigint, texts bigint")
    whole = parts.groupBy("shard").applyInArrow(join, "v bigint, n bigint, b bigint, r bigint")
    return whole.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("v", "n", "b", "r"))).first().asDict()


def score(docs: DataFrame, learn, mu: float = MU, order: int = ORDER) -> DataFrame:
    """One row a document: token counts, the add-one unigram score, and the automaton's score.

    ``learn`` tells which rows to learn from; ``order`` is the longest n-gram, 2 or more.
    """
    if order < 2:
        raise ValueError("order must be 2 or more")
    rows = documents(docs, "doc_id", "text").withColumn("learn", F.coalesce(learn, F.lit(False)))
    t = totals(rows)
    big_n, big_v = int(t["n"]), int(t["v"])
    n = X.n_shards(docs)
    # What a block holds and is told grows with the order.
    rows, several = X.in_blocks(rows, t["b"], t["r"], X.BLOCK_BYTES // (order - 1))

    def keys_of(table: pa.Table):
        token, first = tokens(table.column("text"))
        learn_ = np.repeat(np.asarray(table.column("learn").to_pylist(), bool), np.diff(first))
        return token, first, learn_

    def ask(table: pa.Table) -> pa.Table:
        token, first, learn_ = keys_of(table)
        copies = np.repeat(table.column("copies").to_numpy(), np.diff(first)) if several else None
        asks = []
        for kind, keys, have in grams(token, first, order):
            v, c = tallied(keys[have], learn_[have], n, copies[have] if several else None)
            cut = X.cuts(v >> U64(48), n)
            asks += [
                (kind * n + s, kind, X.planes(steps(v[a:b] >> U64(1) & LOW), 6), X.planes(c[a:b]))
                for s, (a, b) in enumerate(zip(cut[:-1], cut[1:]))
                if b > a
            ]
        return X.ask_table(table.column("block")[0].as_py(), asks)

    def answer(table: pa.Table) -> pa.Table:
        kinds = np.asarray(table.column("kind").to_pylist())
        replies: list[bytes] = [b""] * len(kinds)
        for kind in np.unique(kinds):
            which = np.flatnonzero(kinds == kind)
            parts = [np.cumsum(X.unplanes(table.column("keys")[int(i)].as_py(), 6), dtype=U64) for i in which]
            counts = [X.unplanes(table.column("more")[int(i)].as_py()) for i in which]
            keys = np.concatenate(parts)
            order = np.argsort(keys, kind="stable")
            ordered = keys[order]
            at = X.distinct(ordered)
            total = np.add.reduceat(np.concatenate(counts)[order], at)
            full = np.empty(len(keys), U64)
            full[order] = np.repeat(total, np.diff(np.append(at, len(keys))))
            for i, part in zip(which, np.split(full, np.cumsum([len(p) for p in parts])[:-1])):
                replies[i] = X.planes(part)
        return pa.table(
            {
                "block": table.column("block"),
                "shard": table.column("shard"),
                "kind": table.column("kind"),
                "keys": pa.array([b""] * len(kinds), pa.binary()),
                "more": pa.array(replies, pa.binary()),
            }
        )

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        token, first, learn_ = keys_of(table)
        told = X.said(answers)
        for kind, keys, have in grams(token, first, order):
            v = packed(keys[have], n)
            u = np.sort(v)
            u = u[X.distinct(u)]
            by = told.pop(kind, {})
            c = np.concatenate([X.unplanes(by[s][1]) for s in sorted(by)]).astype(float) if by else np.zeros(0)
            arc = np.zeros(len(token))
            arc[have] = c[np.searchsorted(u, v)]
            if kind == 1:
                word = arc
                chance = (word + 1) / (big_n + big_v + 1)
                base = np.log10(chance)
                step = base
            else:
                # Each token is read in the state that the token before it left; a text begins in the end mark's.
                state = np.empty_like(arc)
                state[1:] = shorter[:-1]
                state[first[:-1]] = word[first[1:] - 1]
                mixed = (arc + mu * chance) / (state + mu)
                taken = np.where(arc > 0, np.log10(mixed), np.log10(mu / (state + mu)) + step)
                step, chance = np.where(have, taken, step), np.where(have, mixed, chance)
            shorter = arc
        size = np.diff(first)
        return pa.table(
            {
                "doc_id": table.column("doc_id"),
                "n_tokens": pa.array(size, pa.int64()),
                "n_known": pa.array(np.add.reduceat((word > 0).astype(np.int64), first[:-1]), pa.int64()),
                "train_tokens": pa.array(np.full(len(size), big_n), pa.int64()),
                "base_score": pa.array(np.add.reduceat(base, first[:-1])),
                "score": pa.array(np.add.reduceat(step, first[:-1])),
                "copies": table.column("copies"),
            }
        )

    answers = X.answered(X.asked(rows, ask), answer)
    out = X.met(
        rows,
        answers,
        finish,
        "doc_id bigint, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, copies bigint",
    )
    return X.repeated(out, several)


def op5(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """The digest of the registered query: learn where crc32 of the id is not 2 modulo 7."""
    left = remainder(F.col("doc_id"), 7)
    return score(docs, left != 2, order=order).select(
        "doc_id", (left == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )
