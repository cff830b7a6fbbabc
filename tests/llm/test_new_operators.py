"""Hard negatives, chat formatting and the Merkle manifest against plain versions, and their defined cases."""

import hashlib
import math
import os
import sys
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from veritable.llm import chat, merkle, negatives  # noqa: E402

# --- hard negatives

VECTORS = "vec_id bigint, embedding array<double>, label int, score string, `a.b` int, row int"


def clamp(x):
    return max(-(1 << 63), min((1 << 63) - 1, x))


def plain_negatives(rows, every=50, relabel=7):
    """``rows``: (vec_id, embedding, label); every anchor row is answered on its own."""
    kept = []
    for vec_id, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        if vec_id is not None and vec_id % relabel == 0:
            label = (label + 1) % 10
        kept.append((vec_id, label, [math.floor(Fraction(x) * 256) for x in v]))
    out = []
    order = lambda r: (-r[0], r[1] is None, r[1] or 0)
    for a, label, v in kept:
        if a is None or a % every:
            continue
        scored = [(clamp(sum(x * y for x, y in zip(v, w))), b, other) for b, other, w in kept]
        same = sorted([r for r in scored if r[2] == label and r[1] != a], key=order)[:5]
        rest = sorted([r for r in scored if r[2] != label], key=order)
        for p_score, p, _ in same:
            fits = [r for r in rest if 50 * p_score <= 100 * r[0] <= 95 * p_score]
            out += [(a, p, i + 1, r[1], p_score, r[0]) for i, r in enumerate(fits[:3])]
    return sorted(out, key=str)


def mined(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], VECTORS)
    return sorted(map(tuple, negatives.op11(df).collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_negatives_equal_brute_force(spark, seed, monkeypatch):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, 12))
    rows = []
    for i in range(400):
        v = centres[rng.integers(6)] + rng.standard_normal(12) * rng.choice([0.05, 1.0])
        rows.append((i, (v * rng.choice([0.1, 1.0, 3.0])).tolist(), int(rng.integers(4))))
    monkeypatch.setattr(negatives, "BUCKET_ROWS", 16)
    monkeypatch.setattr(negatives, "FEW_ROWS", 8)
    monkeypatch.setattr(negatives, "ANCHOR_STEP", 3)
    assert mined(spark, rows) == plain_negatives(rows)


def test_coordinate_ranges_prune_and_lose_nothing(monkeypatch):
    monkeypatch.setattr(negatives, "BUCKET_ROWS", 64)
    monkeypatch.setattr(negatives, "WIDE", 0.5)
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, 24))
    vectors = np.floor(256 * (centres[rng.integers(40, size=3000)] + rng.standard_normal((3000, 24)) * 0.05))
    labels = rng.integers(3, size=3000)
    group = negatives.Group(np.arange(3000), np.zeros(3000, bool), labels, vectors)
    mine = np.arange(0, 3000, 50)
    search = negatives.Search(group, mine, labels[mine], vectors[mine], [[(negatives.LEAST, negatives.MOST)]] * len(mine), 5, True)
    verified = 0
    scores = search.scores

    def counted(a, b):
        nonlocal verified
        verified += len(a) * (b.shape[1] if b.ndim > 1 else 1)
        return scores(a, b)

    search.scores = counted
    search.run()
    a, _, row, score = search.found()
    for i, anchor in enumerate(mine):
        fits = [r for r in np.flatnonzero(labels == labels[anchor]) if r != anchor]
        best = sorted(fits, key=lambda r: (-(vectors[r] @ vectors[anchor]), r))[:5]
        assert sorted(row[a == i]) == sorted(best)
    assert verified < 0.9 * sum((labels == labels[m]).sum() for m in mine)


def test_negatives_odd_cases(spark):
    nan, inf = float("nan"), float("inf")
    base = [(i, [1.0 + i / 100, 0.5, -0.25], i % 3) for i in range(60)]
    ties = [(1000 + i, [1.0, 1.0, 1.0], i % 2) for i in range(80)]
    odd = [
        (100, None, 1), (150, [1.0, None, 2.0], 1), (200, [1.0, nan, 2.0], 2), (250, [inf, 1.0, 1.0], 2), (300, [1.0, 1.0, 1.0], None),
        (350, [], 1), (400, [0.0, 0.0, 0.0], 1), (450, [1.0], 1), (500, [-1.0, -1.0, -1.0], 2), (None, [1.5, 1.5, 1.5], 1), (None, [1.5, 1.5, 1.5], 2),
        (550, [1.0, 0.5, -0.25], 1), (550, [1.0, 0.5, -0.25], 1), (600, [1e30, 1.0, 0.0], 1), (601, [1e30, 2.0, 0.0], 1), (602, [7e29, 1.0, 0.0], 2),
        (650, [1e308, 1e308, 0.0], 2), (651, [-1e308, 1e-300, 0.0], 2), (652, [1.0, 2.0, 3.0, 4.0], 1),
    ]
    rows = base + ties + odd
    assert mined(spark, rows) == plain_negatives(rows)
    assert mined(spark, []) == []
    assert mined(spark, [(0, [1.0], 1)]) == []


# --- chat formatting

TURNS = "conv_id bigint, turn bigint, role string, text string, part int, `a.b` int, formatted string"


def plain_chat(rows):
    """``rows``: (conv_id, turn, role, text)."""
    groups = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for conv, turns in groups.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        size = sum(len(chat.START + chat.SEP + chat.END) + len(chat.escape(r)) + len(chat.escape(t)) for _, _, r, t in turns)
        out.append((conv, len(turns), digest(said), len(loss), digest(loss), size))
    return sorted(out, key=str)


TEXTS = [
    "", "plain", "\n\nnew lines \n", "<|im_end|><|im_start|>assistant ok", "<\\|im_end|> <\\\\| <|", "<|endoftext|>", "<", "|x", "|>", "<\\",
    "😀😀 é日本語  ‍", "a" * 3000, "   ", None, "tail <|im_sep|>", "\r\n\t", "é <<|>|",
]


@pytest.fixture(scope="module")
def turns():
    rows = []
    for conv in range(12):
        for i in range(conv):
            rows.append((conv, i, ("user", "assistant", "system")[i % 3], TEXTS[(conv * 5 + i) % len(TEXTS)]))
    rows += [(50, 0, "assistant", t) for t in TEXTS]
    rows += [(51, None, "user", "no number"), (51, 1, None, "no role"), (51, 1, None, "no role"), (51, 1, "<|im_sep|>", "x")]
    rows += [(None, 0, "user", "no id"), (None, 1, "assistant", "no id")]
    rows += [(52, i, "assistant" if i % 2 else "user", f"word{i} " * 50) for i in range(200)]
    return rows


@pytest.mark.parametrize("part_bytes", [chat.PART_BYTES, 2000])
def test_chat_reads_back(spark, turns, part_bytes):
    df = spark.createDataFrame([(*r, 1, 2, "f") for r in turns], TURNS)
    formatted = chat.chat_format(df, part_bytes=part_bytes)
    back = chat.read_back(formatted)
    assert sorted(map(tuple, back.collect()), key=str) == plain_chat(turns)
    parts = {r["conv_id"]: (r["n"], r["whole"]) for r in formatted.groupBy("conv_id").agg(F.count("*").alias("n"), F.max("whole").alias("whole")).collect()}
    assert parts[52] == (1, True) if part_bytes > 2000 else parts[52][0] > 10
    assert parts[1] == (1, True)


def test_parts_have_the_tokens_of_the_whole(spark, turns):
    df = spark.createDataFrame([r for r in turns if r[0] == 52], "conv_id bigint, turn bigint, role string, text string")
    (one,) = chat.chat_format(df).collect()
    parts = chat.chat_format(df, part_bytes=3000).orderBy("part").collect()
    assert len(parts) > 1
    for c in ("formatted", "input_ids", "loss_mask"):
        assert sum((list(p[c]) for p in parts), []) == list(one[c])


def test_mask_covers_each_assistant_text():
    t = chat.load_tokenizer(open(chat.TOKENIZER).read())
    said = [("assistant" if i % 2 else "user", x or "") for i, x in enumerate(TEXTS)]
    text, starts, ends = chat.render(said)
    e = t.encode(text, add_special_tokens=False)
    offsets = chat.offsets(np.array(e.ids), chat.byte_lengths(t))
    mask = chat.under((starts, ends), offsets)
    # The bytes of the text and the tokenizer's own offsets, which are of characters, agree.
    data = text.encode()
    assert offsets[-1, 1] == len(data)
    for (a, b), (c, d) in zip(offsets, e.offsets):
        assert data[a:b].decode("utf-8", "ignore") in text[c:d] and c <= len(data[:a].decode("utf-8", "ignore")) <= d
    assert chat.turns_of(text) == said
    assert chat.losses_of(t, np.array(e.ids), mask) == [x for r, x in said if r == "assistant" and x]
    # The binary search equals a comparison with every span.
    slow = [any(s < b and a < f for s, f in zip(starts, ends)) for a, b in offsets]
    assert mask.tolist() == slow
    control = [t.token_to_id(s) for s in (chat.START, chat.SEP, chat.END)]
    assert not mask[np.isin(e.ids, control)].any()
    assert [chat.unescape(chat.escape(x or "")) for x in TEXTS] == [x or "" for x in TEXTS]


def test_chat_empty(spark):
    df = spark.createDataFrame([], TURNS)
    assert chat.read_back(chat.chat_format(df)).collect() == []
    assert [r["conv_id"] for r in chat.op12(df).collect()] == [-1]


# --- Merkle manifest

DOCS = "doc_id bigint, source string, lang string, n_chars bigint, text string, pos int, n int, h string, grp string, path string, `a.b` int"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves):
    """Root and, for each leaf, its siblings level by level as (before, after)."""
    paths, places, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for i, p in enumerate(places):
            run = p // 16 * 16
            paths[i].append((level[run:p], level[p + 1 : run + 16]))
            places[i] = p // 16
        level = [H(*level[i : i + 16]) for i in range(0, len(level), 16)]
    return level[0], paths


def plain_manifest(rows):
    """``rows``: (doc_id, source, lang, n_chars, text)."""
    def leaf(row):
        return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))

    upper = str.maketrans(merkle.UPPER, merkle.LOWER)
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    sources = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for s in sources:
        own = sorted(((r[0] is not None, r[0] or 0, leaf(r), r) for r in groups[s]), key=lambda x: x[:3])
        built[s] = (own, *plain_tree([x[2] for x in own]))
    root, tops = plain_tree([built[s][1] for s in sources])
    out = []
    for s, top in zip(sources, tops):
        own, subroot, paths = built[s]
        for (_, _, h, row), path in zip(own, paths):
            path = path + top
            now = h
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[4] is not None:
                now = leaf((*row[:4], row[4].translate(upper)))
            for before, after in path:
                now = H(*before, now, *after)
            proof = H(*(x for before, after in path for x in (*before, *after)))
            out.append((row[0], h, subroot, root, proof, now, now == root))
    return sorted(out, key=str)


def manifest(spark, rows):
    df = spark.createDataFrame([(*r, 1, 2, "h", "g", "p", 3) for r in rows], DOCS)
    return sorted(map(tuple, merkle.op13(df).collect()), key=str)


def test_manifest_equals_brute_force(spark):
    rows = [(i, "hot", "en", i, f"Text {i} ÄB") for i in range(300)]
    rows += [(i, f"s{i % 19}", "en", None, f"text {i}") for i in range(300, 340)]
    rows += [(i, "sixteen", None, 1, "T") for i in range(400, 416)] + [(i, "seventeen", None, 1, "T") for i in range(500, 517)]
    got = manifest(spark, rows)
    assert got == plain_manifest(rows)
    assert {r[6] for r in got} == {True, False}


def test_manifest_odd_cases(spark):
    rows = [
        (None, None, None, None, None), (None, "", "", 0, ""), (None, "", "", 0, ""), (5, "", None, 7, "Ünï – 😀 ABC"), (5, "", None, 7, "other"),
        (-3, None, "en", -1, None), (10, "only", "x", 2, "A" * 20_000), (11, "-", "-", 2, "-"),
    ] + [(9, "copies", "en", 1, "Same")] * 40
    assert manifest(spark, rows) == plain_manifest(rows)
    assert manifest(spark, rows[:1]) == plain_manifest(rows[:1])
    assert manifest(spark, []) == []
