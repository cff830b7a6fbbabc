"""Hard negatives by inner product, searched exactly with coordinate pruning in length buckets.

For each anchor the best rows of its own label are its positives, and for each positive the best rows of other labels
whose score lies in a band below the positive's are its hard negatives.  Both are searches for the top scores inside
intervals, answered by the same index: rows are dealt at random into groups; inside a group
they lie in buckets by label and length, and a bucket holds, for each coordinate, its unit vectors' values
sorted.  For an anchor and the score its k-th best has reached, a bucket whose longest row cannot reach that
score is skipped.  Otherwise the score over both lengths is a least cosine, and at an angle of its arc cosine around the
anchor each of the anchor's focus coordinates (its largest) can only take values in a range: binary search
in the sorted lists gives the ranges, the rows in all of them are the candidates, and only these are
verified.  Where even the narrowest range covers much of a bucket, all its rows are candidates and are
verified by one matrix product.

Scores are whole numbers and exact: in floating point where the lengths prove that nothing is rounded, else as
Python's integers.  Nothing is sampled and no candidate is dropped.

A task holds one group of about ``GROUP_VALUES`` components and meets all anchors batch by batch; what it returns
is its own best for each anchor.  Rows are shuffled once a search, anchors once for each group.

Defined cases: rows with a NULL label, a NULL vector, or a NULL or non-finite component take no part.  A shorter vector
counts as ending in zeros.  Rows of the anchor's own id are never its positives; NULL ids are no anchors, and as candidates come
after all others.  Each anchor row is answered, repeated ones too, and repeated rows are candidates each.  Equal
scores go to the smaller id.  A score beyond 64 bits counts as the nearest 64-bit number.
An empty table has no anchors.  Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritable.llm.common import field, kept, shards

SCALE = 256
#: Components in a group, and bytes of anchors met at once.
GROUP_VALUES, ANCHOR_BYTES = 1 << 21, 8 << 20
BUCKET_ROWS = 2048
#: Labels with fewer rows in a group share buckets.
FEW_ROWS = 256
#: Anchors multiplied at once, and coordinates looked at for each.
ANCHOR_STEP, FOCUS = 512, 4
#: A bucket of which the narrowest range covers more than this share is verified whole.
WIDE = 0.1
#: Room for rounding in lengths, cosines and angles; ranges are widened by it, so no row is lost.
SLACK = 1e-6
N_POSITIVES, N_NEGATIVES = 5, 3
#: A negative's score is at least LOW and at most HIGH hundredths of the positive's.
LOW, HIGH = 50, 95
LEAST, MOST = -(1 << 63), (1 << 63) - 1
FOUND = "anchor bigint, slot int, vec_id bigint, score bigint"


def quantised(flat: np.ndarray) -> np.ndarray:
    """``floor(SCALE * x)``, as floats, or as Python's integers where a product leaves the range of floats."""
    with np.errstate(over="ignore"):
        out = np.floor(flat.astype(np.float64) * SCALE)
    return out if np.isfinite(out).all() else np.array([math.floor(Fraction(float(x)) * SCALE) for x in flat], object)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Quantised vectors as rows of ``width``, filled up with zeros."""
    flat = quantised(column.flatten().to_numpy(zero_copy_only=False))
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), width), flat.dtype)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def measured(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths (infinite beyond the range of floats) and directions, without overflow on the way."""
    if vectors.dtype == object:
        most = np.array([max(map(abs, v), default=0) for v in vectors], object)
        x = np.array([[float(Fraction(int(c), int(m))) if m else 0.0 for c in v] for v, m in zip(vectors, most)]).reshape(vectors.shape)
        most = np.array([float(m) if m < 2**1023 else np.inf for m in most])
    else:
        most = np.abs(vectors).max(1, initial=0)
        x = np.divide(vectors, most[:, None], out=np.zeros_like(vectors), where=most[:, None] > 0)
    size = np.sqrt((x * x).sum(1))
    with np.errstate(over="ignore"):
        return most * size, np.divide(x, size[:, None], out=np.zeros_like(x), where=size[:, None] > 0)


def whole(vectors: np.ndarray) -> np.ndarray:
    """The same numbers as Python's integers."""
    return vectors if vectors.dtype == object else np.array([int(x) for x in vectors.ravel()], object).reshape(vectors.shape)


class Bucket:
    """Rows of one label (or of several rare ones) and similar length, with a sorted list for each coordinate."""

    def __init__(self, at: np.ndarray, length: np.ndarray, unit: np.ndarray, labels: np.ndarray):
        self.at = at
        self.longest, self.shortest = float(length[at].max()), float(length[at].min())
        self.label = labels[at[0]] if (labels[at] == labels[at[0]]).all() else None
        lists = unit[at].T
        self.order = np.argsort(lists, axis=1).astype(np.int32)
        self.values = np.take_along_axis(lists, self.order, axis=1)
        self.place = np.empty_like(self.order)
        np.put_along_axis(self.place, self.order, np.broadcast_to(np.arange(len(at), dtype=np.int32), self.order.shape), axis=1)


class Group:
    """The rows of one task."""

    def __init__(self, ids: np.ndarray, unnamed: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.unnamed, self.labels, self.vectors = ids, unnamed, labels, vectors
        self.length, unit = measured(vectors)
        n = len(ids)
        #: Rows by their part of a key: of equal scores the smaller id has the larger key.
        self.by_tie = np.lexsort((ids, unnamed))[::-1]
        self.tie = np.empty(n, np.int64)
        self.tie[self.by_tie] = np.arange(n)
        _, of, count = np.unique(labels, return_inverse=True, return_counts=True)
        pool = np.where(count[of] >= FEW_ROWS, of, -1)
        order = np.lexsort((-self.tie, -self.length, pool))
        starts = np.flatnonzero(np.diff(pool[order], prepend=-2))
        self.buckets = [
            Bucket(order[i : min(i + BUCKET_ROWS, hi)], self.length, unit, labels)
            for lo, hi in zip(starts, [*starts[1:], n])
            for i in range(lo, hi, BUCKET_ROWS)
        ]


class Search:
    """The best ``k`` rows of a group in each of an anchor's intervals of scores: rows of the anchor's label, or of others.

    A key is a score with the tie's part below it, so no two keys are equal, and "better" is one comparison.
    ``floor`` is the least key that still improves a slot.
    """

    def __init__(self, group: Group, ids, labels, vectors, intervals: list[list[tuple[int, int]]], k: int, same: bool):
        self.group, self.ids, self.labels, self.k, self.same = group, ids, labels, k, same
        self.length, self.unit = measured(vectors)
        self.focus = np.argsort(-np.abs(self.unit), axis=1)[:, :FOCUS]
        self.spread = len(group.ids) + 1
        most = float(self.length.max(initial=0)) * float(group.length.max(initial=0)) * (1 + SLACK) + 1
        self.plain = most < 2**53 and most * self.spread < 2**62 and vectors.dtype != object and group.vectors.dtype != object
        if self.plain:
            kind = np.float32 if most < 2**24 else np.float64
            self.mine, self.theirs = vectors.astype(kind), group.vectors.astype(kind)
        else:
            self.mine, self.theirs = whole(vectors), whole(group.vectors)
        bound = int(most) + 1 if self.plain else MOST
        slots = max((len(x) for x in intervals), default=0)
        number = np.int64 if self.plain else object
        self.none = -bound * self.spread - 1
        shape = (len(intervals), slots)
        self.floor, self.ceiling = np.full(shape, bound * self.spread, number), np.full(shape, self.none, number)
        for a, own in enumerate(intervals):
            for slot, (lo, hi) in enumerate(own):
                if lo <= hi and lo <= bound and hi >= -bound:
                    self.floor[a, slot] = max(lo, -bound) * self.spread
                    self.ceiling[a, slot] = (min(hi, bound) + 1) * self.spread - 1
        self.best = np.full((*shape, k), self.none, number)

    def scores(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        s = a @ b
        return s.astype(np.int64) if self.plain else np.minimum(np.maximum(s, LEAST), MOST)

    def run(self) -> None:
        for bucket in self.group.buckets:
            # An unused slot has a floor above its ceiling.
            live = (self.floor <= self.ceiling).any(1) if self.floor.shape[1] else np.zeros(len(self.ids), bool)
            if bucket.label is not None:
                live &= (self.labels == bucket.label) == self.same
            anchors = np.flatnonzero(live)
            anchors, cosine = self.reachable(anchors, bucket)
            for a, at, score in self.verified(anchors, cosine, bucket):
                self.take(a, bucket.at[at], score)

    def least(self, anchors: np.ndarray) -> np.ndarray:
        """The least key that improves any slot of an anchor."""
        return np.where(self.floor[anchors] <= self.ceiling[anchors], self.floor[anchors], self.floor.dtype.type(-self.none) if self.plain else -self.none).min(1)

    def reachable(self, anchors: np.ndarray, bucket: Bucket) -> tuple[np.ndarray, np.ndarray]:
        """Anchors that may find a score they need in a bucket, by lengths alone, with the least cosine it takes."""
        if not len(anchors):
            return anchors, np.zeros(0)
        least = (self.least(anchors) // self.spread).astype(np.float64)
        with np.errstate(all="ignore"):
            size = np.where(least > 0, bucket.longest, bucket.shortest) * self.length[anchors]
            cosine = least / size
        # Zero and infinite lengths decide nothing, but a zero vector never has a positive score.
        cosine = np.where(np.isfinite(cosine) & np.isfinite(size), cosine, np.where((size == 0) & (least > 0), 2.0, -1.0)) - SLACK
        fine = cosine <= 1
        return anchors[fine], np.clip(cosine[fine], -1.0, 1.0)

    def verified(self, anchors: np.ndarray, cosine: np.ndarray, bucket: Bucket) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs of anchors and places in a bucket that pass the ranges of all focus coordinates, with their scores."""
        if not len(anchors):
            return
        n, focus = len(bucket.at), self.focus[anchors]
        angle = np.arccos(np.clip(np.take_along_axis(self.unit[anchors], focus, axis=1), -1, 1))
        turn = np.arccos(cosine)[:, None]
        low, high = np.cos(np.minimum(angle + turn, np.pi)) - SLACK, np.cos(np.maximum(angle - turn, 0)) + SLACK
        lo, hi = np.zeros(focus.shape, np.int64), np.full(focus.shape, n)
        for d in np.unique(focus):
            lo[focus == d] = np.searchsorted(bucket.values[d], low[focus == d], side="left")
            hi[focus == d] = np.searchsorted(bucket.values[d], high[focus == d], side="right")
        width = hi - lo
        wide = width.min(1, initial=n) > WIDE * n
        for i in np.flatnonzero(~wide):
            first, *others = np.argsort(width[i])
            at = bucket.order[focus[i, first], lo[i, first] : hi[i, first]]
            for f in others:
                place = bucket.place[focus[i, f], at]
                at = at[(place >= lo[i, f]) & (place < hi[i, f])]
            if len(at):
                yield np.full(len(at), anchors[i]), at, self.scores(self.theirs[bucket.at[at]], self.mine[anchors[i]])
        whole_of = self.theirs[bucket.at].T if wide.any() else None
        for part in np.split(anchors[wide], range(ANCHOR_STEP, wide.sum(), ANCHOR_STEP)) if wide.any() else ():
            score = self.scores(self.mine[part], whole_of)
            least = self.least(part) // self.spread
            if self.same and self.plain and n > self.k + 1 and bucket.label is not None:
                # One of a label's own bucket: what is below the k-th best of it (or the next, if the anchor is there) is not among the best.
                own = (self.group.ids[bucket.at] == self.ids[part][:, None]).sum(1).max()
                if n > self.k + own:
                    least = np.maximum(least, np.partition(score, n - self.k - own, axis=1)[:, n - self.k - own])
            i, at = np.nonzero(score >= least[:, None])
            yield part[i], at, score[i, at]

    def take(self, a: np.ndarray, row: np.ndarray, score: np.ndarray) -> None:
        """Merge scored pairs into the best of every slot they fit."""
        g = self.group
        right = (g.labels[row] == self.labels[a]) == self.same
        if self.same:
            right &= g.unnamed[row] | (g.ids[row] != self.ids[a])
        a, key = a[right], score[right] * self.spread + g.tie[row[right]].astype(self.floor.dtype)
        for slot in range(self.floor.shape[1]):
            fits = (key >= self.floor[a, slot]) & (key <= self.ceiling[a, slot])
            if not fits.any():
                continue
            some = np.unique(a[fits])
            who = np.concatenate([a[fits], np.repeat(some, self.k)])
            keys = np.concatenate([key[fits], self.best[some, slot].ravel()])
            order = np.argsort(keys, kind="stable")[::-1]
            order = order[np.argsort(who[order], kind="stable")]
            who, keys = who[order], keys[order]
            place = np.arange(len(who)) - np.searchsorted(who, who)
            self.best[some, slot] = keys[place < self.k].reshape(len(some), self.k)
            last = self.best[some, slot, -1]
            self.floor[some, slot] = np.where(last > self.none, last + 1, self.floor[some, slot])

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Anchor, slot, row and score of everything found."""
        a, slot, k = np.nonzero(self.best > self.none)
        keys = self.best[a, slot, k]
        return a, slot, self.group.by_tie[(keys % self.spread).astype(np.int64)], (keys // self.spread).astype(np.int64)


def taking_part(embeddings: DataFrame, relabel: int | None = None) -> DataFrame:
    """``row, vec_id, label, vector`` of the rows that take part; ``row`` is a number of the row's own.

    Where ``relabel`` divides an id, the label counts as the next of ten.
    """
    kind = dict(embeddings.dtypes).get("embedding", "void")
    # Floats stay as they are: half the bytes.
    v = F.lit(None).cast("array<double>") if kind == "void" else field(embeddings, "embedding").cast("array<float>" if kind == "array<float>" else "array<double>")
    rows = embeddings.select(
        F.monotonically_increasing_id().alias("row"),
        field(embeddings, "vec_id").cast("bigint").alias("vec_id"),
        field(embeddings, "label").cast("bigint").alias("label"),
        v.alias("vector"),
    )
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("label").isNotNull() & F.col("vector").isNotNull() & fine)
    if relabel:
        rows = rows.withColumn("label", F.when(F.col("vec_id") % relabel == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return rows


def best_rows(rows: DataFrame, anchors: DataFrame, n_rows: int, width: int, k: int, same: bool) -> DataFrame:
    """``anchor, slot, rank, vec_id, score``: for each anchor, and each of its ``scores`` (each gives an interval; NULL: one
    interval of all scores), the best ``k`` rows."""
    n_groups = max(1, min(shards(rows), n_rows), -(-n_rows * max(width, 1) // GROUP_VALUES))
    group = F.pmod(F.xxhash64("row"), F.lit(n_groups)).cast("int")
    theirs = rows.withColumns({"group": group, "asks": F.lit(False), "scores": F.lit(None).cast("array<bigint>")})
    mine = anchors.withColumns({"group": F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))), "asks": F.lit(True)})
    met = theirs.unionByName(mine.select(theirs.columns)).repartitionById(n_groups, F.col("group"))
    step = max(1, ANCHOR_BYTES // (8 * max(width, 1)))

    def columns(batch: pa.RecordBatch):
        ids = batch.column("vec_id")
        unnamed = ids.is_null().to_numpy(zero_copy_only=False)
        return ids.fill_null(0).to_numpy(), unnamed, batch.column("label").to_numpy(), matrix(batch.column("vector"), width)

    def answer(group: Group, batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, _, labels, vectors = columns(batch)
        scores = batch.column("scores").to_pylist()
        intervals = [[(LEAST, MOST)] if s is None else [(-(-LOW * p // 100), HIGH * p // 100) for p in s] for s in scores]
        search = Search(group, ids, labels, vectors, intervals, k, same)
        search.run()
        a, slot, row, score = search.found()
        return pa.RecordBatch.from_arrays(
            [
                pa.array(batch.column("row").to_numpy()[a], pa.int64()),
                pa.array(slot, pa.int32()),
                pa.array(group.ids[row], pa.int64(), mask=group.unnamed[row]),
                pa.array(score, pa.int64()),
            ],
            ["anchor", "slot", "vec_id", "score"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        group = None
        for b in batches:
            split = b.num_rows - int(b.column("asks").to_numpy(zero_copy_only=False).sum())
            if split:
                held.append(columns(b.slice(0, split)))
            for at in range(split, b.num_rows, step):
                if group is None:
                    if not held:
                        return
                    group = Group(*(np.concatenate(c) for c in zip(*held)))
                yield answer(group, b.slice(at, min(step, b.num_rows - at)))

    found = met.sortWithinPartitions("asks").mapInArrow(run, FOUND)
    first = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, every: int) -> DataFrame:
    """Hard negatives of the rows of ``taking_part`` whose id is divisible by ``every``."""
    rows = kept(rows, "vectors")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("width")).first()
    anchors = rows.filter(F.col("vec_id") % every == 0)
    everything = anchors.withColumn("scores", F.lit(None).cast("array<bigint>"))
    positives = kept(best_rows(rows, everything, size["n"], size["width"], N_POSITIVES, True), "positives")
    listed = positives.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("found"))
    asking = anchors.join(listed.select(F.col("anchor").alias("row"), F.col("found.score").alias("scores")), "row")
    negatives = best_rows(rows, asking, size["n"], size["width"], N_NEGATIVES, False)
    named = positives.select(
        "anchor", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")
    ).join(anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    return named.join(
        negatives.select("anchor", "slot", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")), ["anchor", "slot"]
    ).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


EVERY, RELABEL = 50, 7


def op11(embeddings: DataFrame) -> DataFrame:
    return hard_negatives(taking_part(embeddings, RELABEL), EVERY)


ORACLE = f"""
WITH rows AS (
    SELECT vec_id, CASE WHEN vec_id % {RELABEL} = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
    SELECT a.vec_id AS anchor_id, r.vec_id AS other, a.label = r.label AS same, CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score
    FROM rows a JOIN rows r ON a.vec_id % {EVERY} = 0 AND a.vec_id <> r.vec_id),
positives AS (
    SELECT anchor_id, other AS positive_id, score AS positive_score FROM pairs WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= {N_POSITIVES})
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor_id)
WHERE NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)
QUALIFY row_number() OVER w <= {N_NEGATIVES}
"""
