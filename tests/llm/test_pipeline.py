"""The pipeline's stages, each against a plain version on its own input."""

import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from veritable.llm import secrets  # noqa: E402
from veritable.llm.common import kept  # noqa: E402

SF = os.environ.get("TEST_LLM_SF_DIR", "/root/testdata/sf0.001")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(kept(stage(spark, out[-1], SF), name))
    return out


def rows(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages_keep_the_columns(steps):
    for df in steps[1:-1]:
        assert df.columns == COLUMNS


def test_language_keeps_lettered_documents(steps):
    assert set(rows(steps[1])) == {k for k, t in rows(steps[0]).items() if any(c.isalpha() for c in t or "")}


def test_one_of_each_group_stays(steps):
    before = rows(steps[1])
    assert set(rows(steps[2])) == set(brute.near_duplicate_classes(list(before.items())).values())


def test_no_benchmark_item_is_left(spark, steps):
    def grams(text):
        w = [x.translate(brute.LOWER) for x in brute.words(text)]
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    items = [grams(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before = rows(steps[2])
    dirty = {k for k, t in before.items() for g in [grams(t)] if any(len(i & g) >= 0.8 * len(i) for i in items)}
    assert dirty and set(rows(steps[3])) == set(before) - dirty


def test_secrets_are_masked(steps):
    before, after = rows(steps[3]), rows(steps[4])
    assert {k: secrets.redact(t) for k, t in before.items()} == after
    assert steps[4].filter(F.col("n_chars") != F.length("text")).count() == 0


def test_packing_is_whole(spark, steps):
    total = sum(len(brute.words(t)) + 1 for t in rows(steps[4]).values())
    assert steps[5].agg(F.sum("n_tokens")).first()[0] == total
    assert corpus_pipeline.run(spark, SF).count() == steps[5].count()
