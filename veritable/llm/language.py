"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text's subwords are the byte n-grams of its words (2 to 4 bytes, with the blank before and after
a word as a boundary mark, letters A-Z lower-cased).  Each n-gram hashes to a row of an embedding
table; the text is the average of its rows; a linear softmax gives the language.  Table and softmax
are trained together by stochastic gradient descent in numpy.  A temperature fitted on rows kept
out of the descent calibrates the probabilities, and the same rows set the rejection threshold.

Fitting takes a bounded sample (``per_language`` labelled rows of each of ``most_languages``, ``in_all`` together, by a hash of
the row); each sampled text is hashed on the executors, whole, so the driver gets at most ``BUCKETS``
numbers a row.  Prediction is one pass over the texts without a shuffle: after training, table and
softmax fold into one ``BUCKETS x languages`` matrix that is summed over the n-grams.

Defined cases: a NULL, empty or letterless text is ``und`` with score 0 and rejected.  Repeated rows
and extra columns change nothing.  Without any labelled row everything is ``und`` with score 0.
Equal probabilities go to the language that sorts first.  NULL ids are never learnt from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritable.llm import words
from veritable.llm.common import by_place, documents, field, remainder

BUCKETS = 1 << 14
SIZES = (2, 3, 4)
UNKNOWN = "und"


@dataclass
class Settings:
    per_language: int = 1500
    #: Rows learnt from in all, and languages (the most frequent ones).
    in_all: int = 12_000
    most_languages: int = 200
    width: int = 16
    epochs: int = 12
    #: A small sample is passed over more often, up to this many steps.
    steps: int = 1500
    batch: int = 32
    rate: float = 0.5
    #: Share of correctly predicted calibration rows that rejection may cost.
    cost: float = 0.001
    #: Rejection never asks for more than this probability.
    most: float = 0.4
    seed: int = 7


@dataclass
class Model:
    languages: list[str]
    #: One row a bucket, one column a language: embedding times softmax weights.
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float


_NORMAL = np.arange(256, dtype=np.uint8)
_NORMAL[65:91] += 32
_NORMAL[:65] = 32  # digits and signs separate words as blanks do
_NORMAL[91:97] = 32
_NORMAL[123:128] = 32


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams, and the text of each."""
    raw, at = words.text_buffers(column)
    n = len(at) - 1
    # A blank before each text and one after the last, so that every word has both its marks.
    data = np.full(len(raw) + n + 1, 32, np.uint8)
    size = np.diff(at)
    to = np.arange(len(raw)) + np.repeat(np.arange(1, n + 1), size)
    data[to] = _NORMAL[raw]
    # The blank after a text is the next one's first, yet an n-gram starting there holds only that one's bytes.
    owner = np.concatenate([np.repeat(np.arange(n), size + 1), [max(n - 1, 0)]])
    blank = data == 32
    found, of = [], []
    wide = data.astype(np.uint32)
    for k in SIZES:
        m = len(data) - k + 1
        if m <= 0:
            continue
        inner = np.zeros(m, bool)  # a blank inside: the n-gram spans two words
        for j in range(1, k - 1):
            inner |= blank[j : j + m]
        if k == 2:
            inner = blank[:m] & blank[1 : 1 + m]
        code = np.full(m, k * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for j in range(k):
            code = (code ^ wide[j : j + m]) * np.uint32(0x01000193)
        code ^= code >> np.uint32(15)
        code *= np.uint32(0x85EBCA6B)
        at_ = np.flatnonzero(~inner)
        found.append(code[at_] >> np.uint32(32 - 14))
        of.append(owner[at_])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found).astype(np.int64), np.concatenate(of)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sampled texts as sparse counts: buckets and their shares."""
    for piece in words.pieces(batches, limit=1 << 18):
        bucket, of = grams(piece.column("text"))
        cells, n = np.unique(of * BUCKETS + bucket, return_counts=True)
        cut = np.searchsorted(cells, np.arange(piece.num_rows + 1) * BUCKETS)
        ids = cells % BUCKETS
        yield pa.RecordBatch.from_arrays(
            [
                piece.column("draw"),
                piece.column("lang"),
                pa.array([ids[a:b].astype("<u2").tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary()),
                pa.array([n[a:b].astype("<f4").tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary()),
            ],
            ["draw", "lang", "ids", "counts"],
        )


def sample(docs: DataFrame, settings: Settings) -> DataFrame:
    """About ``per_language`` rows of each of the ``most_languages`` most frequent languages, no more than about ``in_all``
    together, by a hash of the row; equal rows are learnt from once.

    The share to draw follows from one count per language, so no language is sorted or gathered.
    """
    draw = F.pmod(F.xxhash64(F.lit(settings.seed), F.col("doc_id"), F.col("text")), F.lit(1 << 30))
    rows = documents(docs, "doc_id", "text", "lang").filter(
        F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), 3) != 1)
    )
    rows = rows.withColumn("draw", draw)
    listed = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(settings.most_languages)
    counts = {r["lang"]: r["count"] for r in listed.collect()}
    if not counts:
        return rows.limit(0)
    chosen = F.lit(False)
    for lang, n in sorted(counts.items()):
        wanted = min(settings.per_language, settings.in_all / len(counts))
        limit = int(min(1.0, wanted / n) * (1 << 30))
        chosen = chosen | ((F.col("lang") == lang) & (F.col("draw") < limit))
    return rows.filter(chosen & F.col("text").rlike(r"\p{L}")).dropDuplicates(["doc_id", "text", "lang"])


def fit(docs: DataFrame, settings: Settings | None = None) -> Model:
    """Learn from text and language of the rows whose crc32 remainder by 3 is not 1."""
    s = settings or Settings()
    rows = (
        sample(docs, s)
        .select("draw", "lang", "text")
        .mapInArrow(_hashed, "draw bigint, lang string, ids binary, counts binary")
        .collect()
    )
    rows.sort(key=lambda r: (r["draw"], r["lang"], bytes(r["ids"])))
    return _descend(
        [r["lang"] for r in rows],
        [np.frombuffer(r["ids"], "<u2").astype(np.int64) for r in rows],
        [np.frombuffer(r["counts"], "<f4") for r in rows],
        s,
    )


def _descend(langs: list[str], ids: list[np.ndarray], counts: list[np.ndarray], s: Settings) -> Model:
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 1.0)
    y = np.array([names.index(x) for x in langs])
    rng = np.random.default_rng(s.seed)
    table = (rng.standard_normal((BUCKETS, s.width)) * 0.1).astype(np.float32)
    out = np.zeros((s.width, len(names)), np.float32)
    bias = np.zeros(len(names), np.float32)
    share = [c / c.sum() for c in counts]
    held = np.arange(len(y)) % 5 == 4 if len(y) >= 50 else np.zeros(len(y), bool)
    train = np.flatnonzero(~held)

    def average(which):
        return np.stack([share[i] @ table[ids[i]] for i in which])

    a_pass = -(-len(train) // s.batch)
    epochs = max(s.epochs, -(-s.steps // a_pass))
    steps, done = epochs * a_pass, 0
    for _ in range(epochs):
        rng.shuffle(train)
        for lo in range(0, len(train), s.batch):
            which = train[lo : lo + s.batch]
            h = average(which)
            z = h @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(which)), y[which]] -= 1
            step = s.rate * (1 - done / steps)
            back = p @ out.T
            out -= step * (h.T @ p) / len(which) * 4
            bias -= step * p.mean(0)
            for row, i in enumerate(which):
                table[ids[i]] -= (step * 20 / len(which)) * share[i][:, None] * back[row]
            done += 1
    check = np.flatnonzero(held) if held.any() else train
    z = average(check) @ out + bias
    truth = y[check]

    def loss(t):
        a = z / t
        a = a - a.max(1, keepdims=True)
        return -(a[np.arange(len(truth)), truth] - np.log(np.exp(a).sum(1))).mean()

    heat = min((0.25 * 1.15**k for k in range(30)), key=loss)
    a = z / heat
    p = np.exp(a - a.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    right = p.max(1)[p.argmax(1) == truth]
    threshold = min(s.most, float(np.quantile(right, s.cost))) if len(right) else 0.0
    return Model(names, (table @ out).astype(np.float32), bias.astype(np.float64), float(heat), threshold)


def scores(model: Model, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Index of the best language and its calibrated probability, for each text."""
    n = len(column)
    k = len(model.languages)
    if not k:
        return np.zeros(n, np.int64), np.zeros(n)
    bucket, of = grams(column)
    size = np.bincount(of, minlength=n)
    z = np.empty((n, k))
    for j in range(k):
        z[:, j] = np.bincount(of, weights=model.table[:, j][bucket], minlength=n)
    z = (z / np.maximum(size, 1)[:, None] + model.bias) / model.temperature
    z -= z.max(1, keepdims=True)
    p = np.exp(z)
    p /= p.sum(1, keepdims=True)
    best = p.argmax(1)
    return best, p[np.arange(n), best]


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``rejected``; other columns of those names are replaced."""
    rest = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    text = f"c{rest.index('text')}"
    rows = by_place(docs.select(*(field(docs, c) for c in rest)))
    schema = T.StructType(
        [
            *rows.schema.fields,
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("rejected", T.BooleanType()),
        ]
    )
    rows = rows.withColumn("lettered", F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    # The fields, not the object: workers need not have this package.
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(**shared.value)
        names = np.array([*m.languages, UNKNOWN], object)
        for piece in words.pieces(batches, column=text, limit=1 << 18):
            best, p = scores(m, piece.column(text))
            known = np.asarray(piece.column("lettered").to_pylist(), bool) & bool(m.languages)
            best = np.where(known, best, len(names) - 1)
            p = np.where(known, p, 0.0)
            yield pa.RecordBatch.from_arrays(
                [
                    *piece.columns[:-1],
                    pa.array(list(names[best]), pa.string()),
                    pa.array(p, pa.float64()),
                    pa.array(~known | (p < m.threshold)),
                ],
                schema.names,
            )

    return rows.mapInArrow(run, schema).toDF(*rest, "lang_pred", "score", "rejected")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose language is not rejected; their columns stay as they are."""
    text, names = f"c{docs.columns.index('text')}", docs.columns
    rows = by_place(docs)
    lettered = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(**shared.value)
        for piece in words.pieces(batches, column=text, limit=1 << 18):
            _, p = scores(m, piece.column(text))
            yield piece.filter(pa.array(p >= m.threshold))

    # Without a language learnt nothing is accepted.
    rows = rows.filter(lettered if model.languages else F.lit(False))
    return rows.mapInArrow(run, rows.schema).toDF(*names)


def op10(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """The digest of the registered query: one row a document."""
    model = fit(docs, settings)
    return predict(documents(docs, "doc_id", "text"), model).select(
        "doc_id",
        (remainder(F.col("doc_id"), 3) == 1).alias("held_out"),
        "lang_pred",
        "score",
        "rejected",
    )
