"""Near-duplicate detection: BagMinHash signatures, banding, exact multiset overlap, components.

A text is the multiset of its five-word shingles.  BagMinHash draws, for every shingle, a Poisson
process of points over its weight axis and time; a register keeps the earliest point that falls to it
within the text's weight.  Two texts agree in a register with probability equal to their weighted
Jaccard similarity.  The weight axis is cut into blocks [0,1), [1,2), [2,4), [4,8), ...: each block
has its own process of a rate equal to its width, so a heavy shingle costs a few blocks, not one
process a copy; in the block where a text's weight ends, points beyond it are thinned out.  Points come in
order of time, and a text stops asking for more once its registers can only be full: about
``m log m`` points a text in all, whatever its length, next to the first point of each shingle.

1. Texts with the same words form one class; only one row a class goes on.
2. Classes that share a band (5 registers of 140, 28 bands) meet in buckets.  A bucket is compared by
   signatures inside a task, and says only which pairs to verify, in three rounds with the links found
   so far joined to components in between: a spanning forest of the best estimates inside each chunk
   of a bucket; a forest over the components that a bucket still holds, the largest meeting the
   others chunk by chunk; and every remaining pair
   between different components whose estimate is not hopeless, verified on the spot.  Chunks are
   drawn anew in each band, so a group of near copies, however large, is one component after the first
   round and says no more; large buckets repeat each other, and a seventh of the bands speaks for them there.
3. Verification is exact: sum of minima over sum of maxima of the shingle counts, at least 0.8.

What remains quadratic is a bucket of many *mutually dissimilar* texts with the same band, and there
only the signature comparison, spread over tasks.  A pair of similarity 0.8 shares a band with
probability 1 - 1.4e-5, more similar pairs more surely.

Defined cases: a text of fewer than five words is one shingle of all its words.  NULL, empty and
blank texts have no words and are each a class of their own, never a duplicate.  Repeated rows are
copies of each other.  Rows with a NULL id are compared like all others and count after them; a class of
NULL ids only has a NULL ``class_id``, and its rows of one text stay.  Extra columns are left alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritable.llm import exchange as X
from veritable.llm import words
from veritable.llm.common import by_place, documents, kept, shards
from veritable.llm.components import components

U64 = np.uint64
ROWS, BANDS = 5, 28
M = ROWS * BANDS
LEAST = 0.8
#: Pairs estimated below this are not verified: four standard deviations under 0.8.
HOPELESS = LEAST - 4 * math.sqrt(LEAST * (1 - LEAST) / M)
CHUNK = 400
#: Stands for a NULL id, after all others.
NO_ID = (1 << 63) - 1
#: Ids sent to every task instead of shuffling texts, up to this many.
BROADCAST_IDS = 500_000
SKETCH = "doc_id bigint, node bigint, size bigint, bands array<bigint>, signature binary"


def text_hash(w: words.Words) -> np.ndarray:
    """A hash of each text's whole word sequence."""
    return words.spans_hash(w.hashes, w.first[:-1], w.first[1:], 51)


def bags(w: words.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles, their counts, the text of each, and all shingles in order by text."""
    h, owner = words.shingles(w)
    h = h.copy()
    cut = np.searchsorted(owner, np.arange(len(w.first)))
    for a, b in zip(cut[:-1], cut[1:]):
        h[a:b].sort()
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(fresh)
    return h[at], np.diff(np.append(at, len(h))), owner[at], cut


def bag_min_hash(value: np.ndarray, count: np.ndarray, owner: np.ndarray, n: int, m: int = M) -> np.ndarray:
    """The registers of ``n`` bags, as times; a bag without elements keeps infinite ones."""
    out = np.full(n * m, np.inf)
    weight = np.bincount(owner, weights=count, minlength=n)
    # Blocks of the weight axis that each element reaches: 0, and j while 2**(j-1) < count.
    element, level = np.arange(len(value)), np.zeros(len(value), np.int64)
    heavy, j = np.flatnonzero(count > 1), 1
    while len(heavy):
        element, level = np.concatenate([element, heavy]), np.concatenate([level, np.full(len(heavy), j)])
        j += 1
        heavy = heavy[count[heavy] > 1 << (j - 1)]
    width = np.where(level == 0, 1, 1 << np.maximum(level - 1, 0)).astype(float)
    low = np.where(level == 0, 0, 1 << np.maximum(level - 1, 0))
    seed = words.mix(value[element] + words.seeded(64, 61)[level])
    own, most = owner[element], count[element]
    slack = math.log(m) + 3
    todo = weight > 0
    while todo.any():
        limit = np.zeros(n)
        limit[todo] = m / weight[todo] * slack
        at = np.flatnonzero(todo[own])
        time, k = np.zeros(len(at)), 0
        while len(at):
            k += 1
            u = words.mix(seed[at] + U64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            time = time - np.log(((u >> U64(11)).astype(float) + 0.5) * 2.0**-53) / width[at]
            alive = time < limit[own[at]]
            at, time, u = at[alive], time[alive], u[alive]
            v = words.mix(u ^ U64(0xA5A5A5A5A5A5A5A5))
            place = low[at] + ((v >> U64(32)).astype(float) * 2.0**-32 * width[at]).astype(np.int64)
            inside = place < most[at]
            register = ((v & U64(0xFFFFFFFF)) % U64(m)).astype(np.int64)
            np.minimum.at(out, own[at][inside] * m + register[inside], time[inside])
        # Rarely a register got no point in time: those texts look twice as far.
        todo &= np.isinf(out.reshape(n, m)).any(1)
        slack *= 2
    return out.reshape(n, m)


def sketches(docs: DataFrame) -> DataFrame:
    """One row a document: its class, bag size, band keys and signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = words.seeded(BANDS, 71)
        for piece in words.pieces(batches):
            w = words.find_words(piece.column("text"))
            n = piece.num_rows
            value, count, owner, cut = bags(w)
            times = bag_min_hash(value, count, owner, n)
            mark = words.mix(times.view(U64).reshape(n, M))
            band = words.mix(words.spans_hash(mark.reshape(-1), *_rows(n), 72).reshape(n, BANDS) + salt)
            some = w.counts > 0
            short = (mark >> U64(48)).astype("<u2")
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(np.where(some, BANDS, 0))]), pa.int32()),
                pa.array(band[some].reshape(-1).view(np.int64)),
            )
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("doc_id"),
                    pa.array(text_hash(w).view(np.int64), mask=~some),
                    pa.array(np.diff(cut), pa.int64()),
                    lists,
                    pa.array([s.tobytes() for s in short], pa.binary()),
                ],
                ["doc_id", "node", "size", "bands", "signature"],
            )

    return documents(docs, "doc_id", "text").mapInArrow(run, SKETCH)


def _rows(n: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(n * BANDS) * ROWS
    return at, at + ROWS


def bucket_pairs(members: DataFrame, bags: DataFrame | None = None, inside: bool = False) -> DataFrame:
    """Pairs ``a < b`` of a bucket's members (``key, band, node, comp, signature``).

    Without ``bags``, pairs to verify: a spanning forest of the best estimates among members of
    different components.  With ``bags``, links: every pair between different components whose estimate
    is not hopeless is verified right there, in the first band that the two share, so that what leaves a
    task is what joins two components, never the pairs that were looked at.  ``inside`` compares the chunks of a bucket of ``n``
    rows each in itself.  Otherwise members of a bucket's ``main`` component (``n_main`` rows) meet the
    ``n_rest`` others and these each other, chunk by chunk: what is in one component is not compared.
    """
    draw = F.xxhash64("node", "key")
    if inside:
        own = F.pmod(draw, F.ceil(F.col("n") / CHUNK)).cast("int")
        rows = members.withColumn("own", own).withColumn("other", F.col("own"))
    else:
        main, rest = (F.ceil(F.col(c) / CHUNK).cast("int") for c in ("n_main", "n_rest"))
        in_main = F.col("comp") == F.col("main")
        own = F.when(in_main, F.pmod(draw, main)).otherwise(main + F.pmod(draw, rest)).cast("int")
        others = F.sequence(F.when(in_main, main).otherwise(0), main + rest - 1)
        rows = members.withColumn("own", own).withColumn("other", F.explode(others))
    rows = rows.withColumn("cell", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")))
    tasks = shards(members) * 4
    rows = rows.select("cell", "band", "own", "node", "comp", "signature", F.pmod("cell", F.lit(tasks)).alias("task"))
    verify = bags is not None
    if verify:
        rows = rows.join(bags, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        last = None

        def flush(table: pa.Table) -> pa.RecordBatch:
            cells = table.column("cell").to_numpy()
            edges = np.append(np.flatnonzero(np.append(True, cells[1:] != cells[:-1])), len(cells))
            node, comp = table.column("node").to_numpy(), table.column("comp").to_numpy()
            own = table.column("own").to_numpy()
            flat = b"".join(table.column("signature").to_pylist())
            signature = np.frombuffer(flat, "<u2").reshape(-1, M)
            band = table.column("band").to_numpy()
            bag = table.column("bag") if verify else None
            out = []
            for lo, hi in zip(edges[:-1], edges[1:]):
                if hi - lo > 1:
                    held = None if bag is None else [np.frombuffer(x, "<u4") for x in bag.slice(lo, hi - lo).to_pylist()]
                    out.append(_compare(node[lo:hi], comp[lo:hi], own[lo:hi], signature[lo:hi], int(band[lo]), held))
            a, b = (np.concatenate([o[i] for o in out] or [np.zeros(0, np.int64)]) for i in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        # Rows come sorted by cell; a cell is never cut.
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = batch.column("cell").to_numpy()
            start = batch.num_rows - _run_length(cells)
            if last is not None and cells[0] != last and waiting:
                yield flush(pa.Table.from_batches(waiting))
                waiting = []
            if start:
                waiting.append(batch.slice(0, start))
                yield flush(pa.Table.from_batches(waiting))
                waiting = []
            waiting.append(batch.slice(start))
            last = cells[-1]
        if waiting:
            yield flush(pa.Table.from_batches(waiting))

    dealt = rows.repartition(shards(members), "task").sortWithinPartitions("cell", "node")
    return dealt.drop("task").mapInArrow(run, "a bigint, b bigint").distinct()


def _run_length(cells: np.ndarray) -> int:
    """How many rows at the end have the last row's cell."""
    other = np.flatnonzero(cells != cells[-1])
    return len(cells) - (int(other[-1]) + 1 if len(other) else 0)


def _compare(node, comp, own, signature, band: int, bags) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest over the components of one cell, best estimates first; with bags, of verified pairs."""
    n = len(node)
    across = own[0] != own[-1] or len(np.unique(own)) > 1
    found_a, found_b, found_s = [], [], []
    for i in range(n - 1):
        # Two chunks meet here; pairs inside one chunk are met where it meets itself.
        other = (comp[i + 1 :] != comp[i]) & (node[i + 1 :] != node[i])
        if across:
            other &= own[i + 1 :] != own[i]
        use = np.flatnonzero(other) + i + 1
        if not len(use):
            continue
        same = signature[use] == signature[i]
        share = same.sum(1)
        good = share >= HOPELESS * M
        if bags is not None:
            # A pair is looked at in the first band that it shares.
            good &= ~same[:, : band * ROWS].reshape(len(use), band, ROWS).all(2).any(1)
        use, share = use[good], share[good]
        found_a.append(np.full(len(use), i))
        found_b.append(use)
        found_s.append(share)
    if not found_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b, s = (np.concatenate(x) for x in (found_a, found_b, found_s))
    parent = {c: c for c in comp.tolist()}

    def root(c):
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    keep = []
    low, high = np.minimum(node[a], node[b]), np.maximum(node[a], node[b])
    for e in np.lexsort((high, low, -s)):
        x, y = root(int(comp[a[e]])), root(int(comp[b[e]]))
        if x != y and (bags is None or overlap(bags[a[e]], bags[b[e]]) >= LEAST):
            parent[x] = y
            keep.append(e)
    a, b = a[keep], b[keep]
    x, y = node[a], node[b]
    return np.minimum(x, y), np.maximum(x, y)


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted multisets."""
    at_a, at_b = X.distinct(a), X.distinct(b)
    n_a, n_b = np.diff(np.append(at_a, len(a))), np.diff(np.append(at_b, len(b)))
    u_a, u_b = a[at_a], b[at_b]
    both = X.holds(u_b, u_a)
    common = np.minimum(n_a[both], n_b[np.searchsorted(u_b, u_a[both])]).sum()
    return common / (len(a) + len(b) - common)


def material(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node`` and the sorted shingles of one text for each wanted class (``node``, ``doc_id``)."""
    rows = documents(docs, "doc_id", "text").filter(F.col("text").isNotNull())
    rows = rows.withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
    ids = wanted.select("doc_id").distinct()
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    rows = rows.join(ids, "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in words.pieces(batches):
            w = words.find_words(piece.column("text"))
            h, owner = words.shingles(w)
            cut = np.searchsorted(owner, np.arange(len(w.first)))
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("doc_id"),
                    pa.array(text_hash(w).view(np.int64)),
                    pa.array([np.sort(h[a:b] >> U64(32)).astype("<u4").tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary()),
                ],
                ["doc_id", "node", "bag"],
            )

    # Ids may be repeated with other texts: only the wanted class's text stays, once.
    found = rows.mapInArrow(run, "doc_id bigint, node bigint, bag binary")
    return found.join(wanted, ["doc_id", "node"], "left_semi").dropDuplicates(["node"]).select("node", "bag")


def verified(pairs: DataFrame, bags_: DataFrame) -> DataFrame:
    """The pairs whose exact similarity is at least 0.8, with it."""
    left = bags_.select(F.col("node").alias("a"), F.col("bag").alias("bag_a"))
    right = bags_.select(F.col("node").alias("b"), F.col("bag").alias("bag_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = [
                overlap(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4"))
                for x, y in zip(batch.column("bag_a").to_pylist(), batch.column("bag_b").to_pylist())
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(s, pa.float64())], ["a", "b", "similarity"]
            )

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "bag_a", "bag_b")
    return joined.mapInArrow(run, "a bigint, b bigint, similarity double").filter(F.col("similarity") >= LEAST)


def near_duplicates(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sketches' ``doc_id, node`` for every document, and ``node, comp`` for every linked class."""
    sketch = kept(sketches(docs), "sketches")
    marked = sketch.withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
    classes = marked.filter(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    # Copies have the same bands and signature: any one row of a class will do.
    one = marked.select("node", "doc_id", "bands").join(classes, ["node", "doc_id"], "left_semi").dropDuplicates(["node"])
    keyed = one.select("node", F.posexplode("bands").alias("band", "key"))
    shared_keys = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    members = kept(keyed.join(shared_keys, "key"), "buckets")
    wanted = kept(members.select("node").distinct().join(classes, "node"), "wanted")
    # Signatures and shingles only of classes that share a band with another.
    signed = marked.select("node", "doc_id", "signature").join(wanted, ["node", "doc_id"], "left_semi")
    signed = kept(signed.dropDuplicates(["node"]).select("node", "signature"), "signatures")
    bags_ = kept(material(docs, wanted), "bags")
    members = members.join(signed, "node")
    speak = members.filter((F.col("n") <= CHUNK) | (F.pmod("key", F.lit(7)) == 0))
    tried = kept(bucket_pairs(speak.withColumn("comp", F.col("node")), inside=True), "pairs")
    links = kept(verified(tried, bags_).select("a", "b"), "links")
    comps = components(links)
    for last in (False, True):
        known = members.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        # Buckets that lie within one component have nothing left to say.
        sizes = known.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("k"))
        mixed = (
            sizes.groupBy("key")
            .agg(F.max_by("comp", F.struct("k", "comp")).alias("main"), F.max("k").alias("n_main"), F.sum("k").alias("all"))
            .filter("n_main < all")
            .select("key", "main", "n_main", (F.col("all") - F.col("n_main")).alias("n_rest"))
        )
        apart = known.join(mixed, "key")
        if last:
            found = bucket_pairs(apart, bags_)
        else:
            found = verified(bucket_pairs(apart).join(tried, ["a", "b"], "left_anti"), bags_).select("a", "b")
        found = kept(found, "links")
        if not found.isEmpty():
            links = links.unionByName(found)
            comps = components(links)
    return sketch.select("doc_id", "node"), comps


def classes_of(docs: DataFrame) -> DataFrame:
    """One row a document: ``doc_id``, ``class_id`` (smallest id of its near-duplicates), ``exact_id``
    (smallest id of the same words) and whether it is the one of its class that stays."""
    rows, comps = near_duplicates(docs)
    exact = rows.filter(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("exact_id"))
    known = exact.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    groups = known.groupBy("comp").agg(F.min("exact_id").alias("class_id"), F.min("node").alias("first"))
    # Where no row has an id, one text's rows stay, the same that ``deduplicated`` keeps.
    speaks = F.col("class_id").isNotNull() | (F.col("node") == F.col("first"))
    known = known.join(groups, "comp").select("node", "exact_id", "class_id", speaks.alias("speaks"))
    own = rows.filter(F.col("node").isNull()).select(
        "doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("exact_id"), F.lit(True).alias("speaks")
    )
    out = rows.join(known, "node").select("doc_id", "class_id", "exact_id", "speaks").unionByName(own)
    stays = F.col("speaks") & F.col("doc_id").eqNullSafe(F.col("class_id"))
    return out.withColumn("stays", stays).drop("speaks")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each class, the one with the smallest id; texts without words all stay."""
    rows, comps = near_duplicates(docs)
    # Of each class of equal words the smallest id, then of each component; NULL ids last.
    last = F.coalesce("doc_id", F.lit(NO_ID))
    exact = rows.filter(F.col("node").isNotNull()).groupBy("node").agg(F.min(last).alias("id"))
    known = exact.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    stays = known.groupBy("comp").agg(F.min(F.struct("id", "node")).alias("first")).select("first.id", "first.node")
    text, key = (f"c{docs.columns.index(c)}" for c in ("text", "doc_id"))
    marked = by_place(docs).withColumn("id", F.coalesce(F.col(key).cast("bigint"), F.lit(NO_ID)))
    schema = T.StructType([*marked.schema.fields, T.StructField("node", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in words.pieces(batches, column=text):
            w = words.find_words(piece.column(text))
            node = pa.array(text_hash(w).view(np.int64), mask=w.counts == 0)
            yield pa.RecordBatch.from_arrays([*piece.columns, node], [*piece.schema.names, "node"])

    marked = marked.mapInArrow(run, schema)
    blank = marked.filter(F.col("node").isNull())
    one = marked.join(stays, ["id", "node"], "left_semi").dropDuplicates(["id", "node"])
    both = one.unionByName(blank).drop("id", "node")
    return both.toDF(*docs.columns)


def op2(docs: DataFrame) -> DataFrame:
    return classes_of(docs)
