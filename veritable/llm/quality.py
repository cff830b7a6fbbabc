"""Quality classifier: a regularised quadratic discriminant over document statistics.

Thirteen statistics of a whole text (length, word lengths, repetition, kinds of characters, entropy)
are put on log scales, where they are roughly normal.  Each class gets its mean and a covariance that
is shrunk towards the pooled one and towards a multiple of the identity.  A text's score is the
difference of the two log densities: squared Mahalanobis distances through the Cholesky factors,
which are computed once and sent to the tasks, plus log determinants and priors.

All labelled rows are learnt from.  Their moments are integers (statistics in 1/1024 steps), so sums
do not depend on partitioning, and reach the driver as 105 numbers a class.  Statistics are written
once to the shared folder and serve both fit and scoring.

The score is 1 / (1 + exp(-difference / number of statistics)): the statistics overlap in what they
tell, and undamped differences would all round to 0 or 1.  It passes 0.5 where the difference changes sign.

Defined cases: NULL and empty texts have the statistics of a text without words and are scored like
any other.  Repeated document rows are each scored.  A document with contradicting labels, or with a
label other than 0 and 1, is not learnt from; NULL ids neither.  With one class only, every score is that class's
smoothed share; with no label at all, 0.5.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritable.llm import words
from veritable.llm.common import documents, field, kept, remainder

STATISTICS = (
    "log_words",
    "log_word_length",
    "log_word_length_spread",
    "distinct_words",
    "adjacent_repeats",
    "upper_share",
    "symbol_share",
    "digit_share",
    "stop_share",
    "wordless_share",
    "wide_share",
    "log_line_rate",
    "entropy",
)
D = len(STATISTICS)
UNIT = 1024


def _kind(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[[ord(c) for c in chars]] = True
    return table


_UPPER = _kind("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTER = _UPPER | _kind("abcdefghijklmnopqrstuvwxyz") | (np.arange(256) >= 128)
_DIGIT = _kind("0123456789")
_STOP = _kind(".,;:?!'\"()-")
_SYMBOL = _kind("#$%&*+/<=>@[\\]^_`{|}~")


def statistics(column: pa.Array) -> np.ndarray:
    """One row of ``STATISTICS`` for each text."""
    w = words.find_words(column)
    n = len(w.text_at) - 1
    count = w.counts.astype(float)
    some = np.maximum(count, 1)
    size = (w.ends - w.starts).astype(float)
    owner = w.owner
    mean = words.sums(size, owner, n) / some
    spread = np.sqrt(np.maximum(words.sums(size * size, owner, n) / some - mean**2, 0))
    order = np.lexsort((w.hashes, owner))
    h, o = w.hashes[order], owner[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    distinct = np.bincount(o[fresh], minlength=n)
    again = np.zeros(len(h), bool)
    again[1:] = (w.hashes[1:] == w.hashes[:-1]) & (owner[1:] == owner[:-1])
    data = w.data
    n_bytes = np.diff(w.text_at)
    of = np.repeat(np.arange(n), n_bytes)
    bytes_ = np.maximum(n_bytes, 1).astype(float)
    histogram = np.bincount(of * 256 + data, minlength=n * 256).reshape(n, 256)

    def share(kind):
        return histogram[:, kind].sum(1) / bytes_

    letters = np.concatenate([[0], np.cumsum(_LETTER[data] | _DIGIT[data])])
    wordless = letters[w.ends] == letters[w.starts]
    p = histogram / bytes_[:, None]
    entropy = -(p * np.log2(np.where(p > 0, p, 1))).sum(1)

    def log(x):
        return np.log(x + 0.002)

    return np.column_stack(
        [
            np.log1p(count),
            np.log1p(mean),
            np.log1p(spread),
            distinct / some,
            log(words.sums(again.astype(float), owner, n) / some),
            log(share(_UPPER)),
            log(share(_SYMBOL)),
            log(share(_DIGIT)),
            log(share(_STOP)),
            log(words.sums(wordless.astype(float), owner, n) / some),
            log(histogram[:, 128:].sum(1) / bytes_),
            log(histogram[:, 10] / some),
            entropy,
        ]
    )


def with_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the packed statistics of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in words.pieces(batches):
            x = statistics(piece.column("text")).astype("<f8")
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "x"]
            )

    return documents(docs, "doc_id", "text").mapInArrow(run, "doc_id bigint, x binary")


@dataclass
class Model:
    prior: np.ndarray
    mean: np.ndarray
    #: Inverses of the Cholesky factors, one a class.
    whiten: np.ndarray
    log_det: np.ndarray
    #: The score of every text when there are not two classes to tell apart.
    constant: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        density = []
        for k in (0, 1):
            z = (x - self.mean[k]) @ self.whiten[k].T
            density.append(np.log(self.prior[k]) - 0.5 * (z * z).sum(1) - 0.5 * self.log_det[k])
        return 1 / (1 + np.exp(np.clip((density[0] - density[1]) / D, -700, 700)))


def truth(labels: DataFrame) -> DataFrame:
    """One label for each document that has just one."""
    rows = labels.select(field(labels, "doc_id").cast("bigint").alias("doc_id"), field(labels, "quality").try_cast("double").alias("q"))
    return (
        rows.filter(F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("q").alias("quality"), F.max("q").alias("high"))
        .filter((F.col("quality") == F.col("high")) & F.col("quality").isin(0.0, 1.0))
        .select("doc_id", F.col("quality").cast("int").alias("quality"))
    )


def moments(rows: DataFrame) -> DataFrame:
    """Count, sums and sums of products of the statistics, by class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {}
        for b in batches:
            if not b.num_rows:
                continue
            x = np.frombuffer(b"".join(b.column("x").to_pylist()), "<f8").reshape(-1, D)
            whole = np.column_stack([np.full(len(x), UNIT), np.rint(x * UNIT)]).astype(np.int64)
            q = b.column("quality").to_numpy()
            for k in (0, 1):
                part = whole[q == k]
                for cell, value in enumerate((part.T @ part)[np.triu_indices(D + 1)]):
                    total[k, cell] = total.get((k, cell), 0) + int(value)
        keys = sorted(total)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k for k, _ in keys], pa.int32()),
                pa.array([c for _, c in keys], pa.int32()),
                pa.array([str(total[key]) for key in keys], pa.string()),
            ],
            ["quality", "cell", "value"],
        )

    parts = rows.select("quality", "x").mapInArrow(run, "quality int, cell int, value string")
    return parts.groupBy("quality", "cell").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))


def fit(rows: DataFrame, pooled: float = 0.05, round_: float = 0.01) -> Model:
    """The discriminant of labelled statistics: ``quality`` and ``x``."""
    total = np.zeros((2, D + 1, D + 1))
    upper = np.triu_indices(D + 1)
    for r in moments(rows).collect():
        total[r["quality"]][upper[0][r["cell"]], upper[1][r["cell"]]] = float(r["value"]) / UNIT**2
    n = total[:, 0, 0]
    if n.min() < 1:
        return Model(n, n, n, n, float((n[1] + 1) / (n.sum() + 2)))
    mean = total[:, 0, 1:] / n[:, None]
    own = []
    for k in (0, 1):
        s = total[k, 1:, 1:]
        s = s + np.triu(s, 1).T
        own.append(s / n[k] - np.outer(mean[k], mean[k]))
    both = (n[0] * own[0] + n[1] * own[1]) / n.sum() + 1e-6 * np.eye(D)
    whiten, log_det = [], []
    for k in (0, 1):
        # The fewer rows a class has, the more it leans on the pooled covariance.
        share = max(pooled, D / (D + n[k]))
        cov = (1 - share) * own[k] + share * both
        cov = (1 - round_) * cov + round_ * np.trace(cov) / D * np.eye(D)
        factor = np.linalg.cholesky(cov)
        whiten.append(np.linalg.inv(factor))
        log_det.append(2 * np.log(np.diag(factor)).sum())
    return Model(n / n.sum(), mean, np.array(whiten), np.array(log_det))


def predict(rows: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``score`` and ``predicted`` for packed statistics."""
    # The fields, not the object: workers need not have this package.
    shared = rows.sparkSession.sparkContext.broadcast(vars(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Model(**shared.value)
        for b in batches:
            x = np.frombuffer(b"".join(b.column("x").to_pylist()), "<f8").reshape(-1, D)
            score = known.score(x)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                ["doc_id", "score", "predicted"],
            )

    return rows.select("doc_id", "x").mapInArrow(run, "doc_id bigint, score double, predicted int")


def op1(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The digest of the registered query: learn where the remainder by 3 is not 1, score every document."""
    rows = kept(with_statistics(docs), "quality-statistics")
    known = truth(labels).filter(remainder(F.col("doc_id"), 3) != 1)
    # A repeated document is learnt from once.
    train = rows.join(known, "doc_id").dropDuplicates(["doc_id", "x"])
    model = fit(train)
    return predict(rows, model).select(
        "doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted"
    )
