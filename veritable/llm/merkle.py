"""A Merkle manifest of a dataset: one leaf a row, a subtree a source, a root over the subtrees, a proof for every leaf.

Rows are numbered within their group without gathering a group: the (small) leaf table is dealt out by
ranges of the order, each range is sorted, and what earlier ranges hold of a group is added to a row's
place in its own.  A level then looks at runs of ``FAN`` consecutive nodes with windows: ``lag`` and
``lead`` columns of each fixed offset, masked by the node's slot and by the length of its run, are its
siblings, and the first node of a run hashes itself and its siblings into the parent.  A window holds one
run, so no task depends on the size of a source.  Proofs are passed down level by level: each node takes its parent's path
by a join on (group, run), where a parent meets at most ``FAN`` children.

Everything is DataFrame functions.  Texts are read once, hashed where they lie, and never shuffled.

Defined cases: NULL values are hashed as ``-``, unlike empty ones; a NULL id comes before all others, and rows of one
id are ordered by their leaf; equal rows are leaves of their own with their own proofs.  A NULL source is a
source that comes first.  A missing column counts as NULL, other columns are ignored.  An empty table
has no rows in its manifest.  A group of one leaf is its own root; the proof of a sole leaf is the
digest of nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritable.llm.common import field, kept, remainder, shards

#: Children of a node.
FAN = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAF_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts, one after another."""
    return F.sha2(F.concat(*(p.cast("binary") for p in parts)), 256)


def framed(value: Column) -> Column:
    """A value with its length in front, ``-`` for NULL: no two rows share a concatenation."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(values: list[Column]) -> Column:
    return sha(*(framed(v) for v in values))


def grouped(source: Column) -> Column:
    """A group key that is never NULL and sorts as the sources do, NULL first."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def positioned(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``pos``, the place of each in its group ``grp`` by ``order``, and ``n``, the group's size.

    Rows that are equal in all of ``order`` are told apart by where they were read, so that many of them are still
    dealt to several tasks; any order among them is as good.
    """
    rows = kept(rows.withColumn("salt", F.xxhash64(F.monotonically_increasing_id())), "nodes")
    by = ("grp", *order, "salt")
    dealt = rows.repartitionByRange(shards(rows), *by).sortWithinPartitions(*by)
    dealt = kept(
        dealt.drop("salt").withColumns({"place": F.monotonically_increasing_id(), "part": F.spark_partition_id()}), "ordered"
    )
    spans = dealt.groupBy("grp", "part").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("here"))
    # At most one row a range and group meets in a window.
    before = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(
        "grp",
        "part",
        (F.coalesce(F.sum("here").over(before), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("here").over(Window.partitionBy("grp")).alias("n"),
    )
    placed = dealt.join(spans, ["grp", "part"]).withColumn("pos", F.col("place") + F.col("shift"))
    return kept(placed.drop("part", "place", "shift"), "placed")


def in_runs(nodes: DataFrame) -> DataFrame:
    """``nodes`` (``grp``, ``n``, ``pos``, ``h``, ...) with their ``run`` and the digests of the siblings ``before``
    and ``after`` them, as one text each."""
    nodes = nodes.withColumns(
        {"run": F.expr(f"pos DIV {FAN}"), "slot": (F.col("pos") % FAN).cast("int")}
    ).withColumn("length", F.least(F.lit(FAN), F.col("n") - F.col("run") * FAN))
    run = Window.partitionBy("grp", "run").orderBy("slot")
    none = F.lit("")
    offsets = range(1, FAN)
    nodes = nodes.select(
        "*",
        *(F.when(F.col("slot") >= k, F.lag("h", k).over(run)).otherwise(none).alias(f"lag{k}") for k in offsets),
        *(F.when(F.col("slot") + k < F.col("length"), F.lead("h", k).over(run)).otherwise(none).alias(f"lead{k}") for k in offsets),
    )
    nodes = nodes.withColumns(
        {"before": F.concat(*(f"lag{k}" for k in reversed(offsets))), "after": F.concat(*(f"lead{k}" for k in offsets))}
    )
    return nodes.drop("slot", "length", *(f"{side}{k}" for side in ("lag", "lead") for k in offsets))


def levels(leaves: DataFrame) -> list[DataFrame]:
    """Leaves, their parents, and so on, up to where every group has one node left."""
    found = [leaves]
    most = leaves.agg(F.max("n").alias("n")).first()["n"] or 0
    while most > 1:
        first = in_runs(found[-1].filter("n > 1")).filter(F.col("pos") % FAN == 0)
        parents = first.select(
            "grp", F.expr(f"(n + {FAN - 1}) DIV {FAN} AS n"), F.col("run").alias("pos"), sha(F.col("h"), F.col("after")).alias("h")
        )
        found.append(kept(parents, "parents"))
        most = -(-most // FAN)
    return found


def tops(found: list[DataFrame]) -> DataFrame:
    """``grp, h``: the root of each group."""
    out = found[0].filter("n = 1").select("grp", "h")
    for level in found[1:]:
        out = out.unionByName(level.filter("n = 1").select("grp", "h"))
    return out


PATH = "array<struct<before: string, after: string>>"


def with_paths(found: list[DataFrame], ends: DataFrame) -> DataFrame:
    """The leaves with their ``path``, the siblings level by level, and what ``ends`` says of their group.

    ``ends`` has a row a group: ``grp``, the ``path`` of its root beyond the group, and any further columns.
    """
    more = [c for c in ends.columns if c not in ("grp", "path")]
    down = None
    for depth in range(len(found) - 1, -1, -1):
        # A group whose root is at this level gets its path from outside, every other one from the level above.
        root = found[depth].filter("n = 1").select("grp", F.lit(0).cast("bigint").alias("run"))
        above = root.join(ends, "grp")
        if down is not None:
            above = above.unionByName(down.select("grp", F.col("pos").alias("run"), "path", *more))
        here = in_runs(found[depth]).join(above, ["grp", "run"])
        step = F.array(F.struct("before", "after"))
        path = F.when(F.col("n") > 1, F.concat(step, F.col("path"))).otherwise(F.col("path"))
        down = here.withColumn("path", path).drop("before", "after", "run")
        if depth:
            down = kept(down.select("grp", "pos", "path", *more), "paths")
    return down


def proof_of(path: Column) -> Column:
    """One digest of all siblings, from the leaf's up."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["before"], x["after"])), "").cast("binary"), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, leaf, lambda so_far, x: sha(x["before"], so_far, x["after"]))


def manifest(rows: DataFrame) -> DataFrame:
    """Every leaf of ``rows`` (``grp``, ``id``, ``h``, ...) with ``path``, ``subroot`` and ``root``."""
    leaves = levels(positioned(rows, "id", "h"))
    subroots = tops(leaves).select(F.lit("").alias("grp"), F.col("grp").alias("source_key"), "h")
    forest = levels(positioned(subroots, "source_key"))
    whole = tops(forest).select("grp", F.array().cast(PATH).alias("path"), F.col("h").alias("root"))
    ends = with_paths(forest, whole).select(F.col("source_key").alias("grp"), "path", F.col("h").alias("subroot"), "root")
    return with_paths(leaves, kept(ends, "subroots"))


def leaves_of(documents: DataFrame) -> DataFrame:
    """``grp, id, h`` and ``tampered``, the leaf of the lower-cased text where that is to be tried (else NULL)."""
    values = {c: field(documents, c) for c in LEAF_FIELDS}
    doc_id = values["doc_id"].cast("bigint")
    lowered = values | {"text": F.translate(values["text"].cast("string"), UPPER, LOWER)}
    return documents.select(
        grouped(values["source"]).alias("grp"),
        doc_id.alias("id"),
        leaf_of(list(values.values())).alias("h"),
        F.when(remainder(doc_id, 5) == 0, leaf_of(list(lowered.values()))).alias("tampered"),
    )


def verified(leaves: DataFrame) -> DataFrame:
    """Manifest rows with the root that the leaf, or its tampered version, folds to."""
    end = folded(F.coalesce("tampered", "h"), F.col("path"))
    out = leaves.select(
        F.col("id").alias("doc_id"), F.col("h").alias("leaf"), "subroot", "root", proof_of(F.col("path")).alias("proof_sha256"), end.alias("folded_root")
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13(documents: DataFrame) -> DataFrame:
    return verified(manifest(leaves_of(documents)))


def _levels_sql(name: str, depth: int) -> str:
    """Statements ``name``1 .. ``name``depth over ``name``0 (grp, n, pos, h): runs of a level, and the level above."""
    out = []
    for d in range(depth):
        out.append(
            f"{name}r{d} AS (SELECT grp, pos // {FAN} AS run, any_value(n) AS n, list(h ORDER BY pos) AS hs "
            f"FROM {name}{d} WHERE n > 1 GROUP BY grp, pos // {FAN})"
        )
        out.append(
            f"{name}{d + 1} AS (SELECT grp, CAST(ceil(n / {FAN}.0) AS BIGINT) AS n, run AS pos, "
            f"sha256(array_to_string(hs, '')) AS h FROM {name}r{d})"
        )
    return ",\n".join(out)


def _climb_sql(name: str, place: str, group: str, depth: int) -> tuple[str, list[str], list[str]]:
    """Joins of the runs above a node, and its siblings before and after it at each level."""
    joins, left, right = [], [], []
    for d in range(depth):
        alias = f"{name}x{d}"
        joins.append(f"LEFT JOIN {name}r{d} {alias} ON {alias}.grp = {group} AND {alias}.run = {place} // {FAN ** (d + 1)}")
        slot = f"({place} // {FAN ** d}) % {FAN}"
        left.append(f"coalesce(array_to_string(list_slice({alias}.hs, 1, {slot}), ''), '')")
        right.append(f"coalesce(array_to_string(list_slice({alias}.hs, {slot} + 2, {FAN}), ''), '')")
    return "\n".join(joins), left, right


def _oracle(depth: int = 7) -> str:
    """The same in DuckDB, for up to 16**7 leaves a source and as many sources."""
    def frame(v: str) -> str:
        return f"coalesce(CAST(strlen(CAST({v} AS VARCHAR)) AS VARCHAR) || ':' || CAST({v} AS VARCHAR), '-')"

    low = f"translate(text, '{UPPER}', '{LOWER}')"
    tops_ = " UNION ALL ".join(f"SELECT grp, h FROM s{d} WHERE n = 1" for d in range(depth + 1))
    roots = " UNION ALL ".join(f"SELECT h FROM t{d} WHERE n = 1" for d in range(depth + 1))
    up_s, left_s, right_s = _climb_sql("s", "l.pos", "l.grp", depth)
    up_t, left_t, right_t = _climb_sql("t", "q.pos", "q.grp", depth)
    applied = [f"(sx{d}.run IS NOT NULL)" for d in range(depth)] + [f"(tx{d}.run IS NOT NULL)" for d in range(depth)]
    left, right = left_s + left_t, right_s + right_t
    fold = "joined"
    for i in range(2 * depth):
        fold = f"(SELECT * REPLACE (CASE WHEN on{i} THEN sha256(b{i} || f || a{i}) ELSE f END AS f) FROM {fold})"
    columns = ", ".join(f"{b} AS b{i}, {a} AS a{i}, {on} AS on{i}" for i, (b, a, on) in enumerate(zip(left, right, applied)))
    proof = " || ".join(f"b{i} || a{i}" for i in range(2 * depth))
    crc = """CAST(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))),
        lambda r, b: CAST(list_reduce(list_prepend(xor(r, b), [CAST(0 AS BIGINT), 1, 2, 3, 4, 5, 6, 7]),
            lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, CAST(3988292384 AS BIGINT)) ELSE x // 2 END) AS BIGINT)) AS BIGINT)"""
    return f"""
    WITH leaves AS (
        SELECT doc_id, coalesce('=' || source, '') AS grp,
               sha256({' || '.join(frame(c) for c in LEAF_FIELDS)}) AS h,
               CASE WHEN xor({crc}, CAST(4294967295 AS BIGINT)) % 5 = 0 THEN
                   sha256({' || '.join(frame(low if c == 'text' else c) for c in LEAF_FIELDS)}) END AS tampered
        FROM documents),
    s0 AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY grp) AS n,
               row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, h) - 1 AS pos FROM leaves),
    {_levels_sql('s', depth)},
    subroots AS ({tops_}),
    t0 AS MATERIALIZED (SELECT '' AS grp, grp AS source_key, h, count(*) OVER () AS n, row_number() OVER (ORDER BY grp) - 1 AS pos FROM subroots),
    {_levels_sql('t', depth)},
    root AS ({roots}),
    joined AS (SELECT l.doc_id, l.h AS leaf, q.h AS subroot, (SELECT h FROM root) AS root, coalesce(l.tampered, l.h) AS f, {columns}
        FROM s0 l JOIN t0 q ON q.source_key = l.grp
        {up_s}
        {up_t})
    SELECT doc_id, leaf, subroot, root, sha256({proof}) AS proof_sha256, f AS folded_root, f = root AS verified FROM {fold}
    """


ORACLE = _oracle()
