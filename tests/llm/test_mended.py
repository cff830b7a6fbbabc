"""Workers without the package, repeated and extreme rows, odd tables in the pipeline, models against plain versions."""

import math
import os
import subprocess
import sys
import textwrap

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from veritable.llm import language, neighbours, packing, quality, secrets
from veritable.llm.common import remainder

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = os.environ.get("TEST_LLM_SF_DIR", "/root/testdata/sf0.001")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_workers_need_no_package(tmp_path):
    """A session started elsewhere: the driver alone can import the package."""
    script = tmp_path / "run.py"
    script.write_text(
        textwrap.dedent(
            f"""
            import sys
            from pyspark.sql import SparkSession
            spark = SparkSession.builder.master("local[4]").config("spark.checkpoint.dir", {str(tmp_path / "shared")!r}).config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
            spark.range(4).rdd.map(lambda x: x).count()  # workers start before the path is known
            sys.path.insert(0, {ROOT!r})
            import __spark_entry__ as e
            for name, query in sorted(e.queries().items()):
                if name.split("_")[0] in ("op1", "op3", "op8", "op10", "op11", "op12", "pipeline"):
                    assert query(spark, {SF!r}).count() > 0, name
                    print("ran", name, flush=True)
            """
        )
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-2000:]
    assert done.stdout.count("ran ") == 7


# --- packing


def test_a_repeated_row_is_dealt_to_many_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ROWS", 100)
    docs = spark.range(6000).selectExpr("IF(id % 3 = 0, NULL, id) AS doc_id", "IF(id % 3 = 0, '', concat('some text ', id)) AS text")
    rows = packing.pack(docs).groupBy("bucket", F.substring_index("batch", "-", 2).alias("part")).count().collect()
    assert sum(r["count"] for r in rows) == 6000
    assert max(r["count"] for r in rows) < 200


def test_groups_hold_a_bounded_number_of_tokens(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_TOKENS", 50_000)
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("x"), F.repeat(F.lit(" w"), 1999)).alias("text"))
    parts = packing.pack(docs, budget=4096).groupBy(F.substring_index("batch", "-", 2)).agg(F.sum("n_tokens").alias("n")).collect()
    assert sum(r["n"] for r in parts) == 300 * 2001 and max(r["n"] for r in parts) < 120_000


# --- nearest neighbours


def test_extreme_lengths_take_part(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((120, 16))
    scale = np.array([1e160, 1e-170, 1.0, 5e-300])
    rows = [(i, (v * scale[i % 4]).tolist()) for i, v in enumerate(base)]
    rows += [(1000, (base[0] * 1e-150).tolist()), (1001, (base[50] * 1e140).tolist())]
    got = neighbours.op7(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    unit = {i: np.array(v) / np.abs(v).max() for i, v in rows}
    unit = {i: v / np.linalg.norm(v) for i, v in unit.items()}
    for q in (0, 50, 100, 1000):
        want = sorted(((-float(unit[q] @ unit[i]), i) for i in unit if i != q))[:5]
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [i for _, i, _ in own] == [i for _, i in want]
        assert np.allclose([s for *_, s in own], [-s for s, _ in want], atol=1e-12)


# --- secrets


def texts_of(text):
    return [text[a:b] for a, b, _ in secrets.scan(text)[1]]


def test_joined_without_blanks():
    a, b = "q9XkT27bLmPzR4", "w8VnC31dHsYtK6"
    head = f'A="{a}"; B="{b}"; '
    for tail in ("db_pwd=A+B", "db_pwd = A + B", "db_pwd=A +B"):
        assert set(texts_of(head + tail)) >= {a, b}
    assert texts_of(f'A="{a}"; db_pwd=A+"{b}"') == [a, b]
    assert texts_of("db_pwd = PART_ONE_LONG1+PART_TWO_LONG2") == []
    # A literal may hold the sign itself.
    assert texts_of("db_pwd=wJalrXUt7nFEMI+K7MDENGbPx") == ["wJalrXUt7nFEMI+K7MDENGbPx"]


@pytest.mark.parametrize("head", ["db_pwd: str", "db_pwd : Optional[str]", "self.db_pwd: str | None", "db_pwd: dict[str, list[int]]"])
def test_typed_assignments(head):
    assert texts_of(f'{head} = "q9XkT27bLmPzR4"') == ["q9XkT27bLmPzR4"]


def test_plain_pairs_still_parse():
    assert texts_of("db_pwd: q9XkT27bLmPzR4") == ["q9XkT27bLmPzR4"]
    assert texts_of('{"db_pwd": "q9XkT27bLmPzR4", "x": 1}') == ["q9XkT27bLmPzR4"]
    assert texts_of("url: http://example.org/a=b") == []


# --- models against plain versions


def test_quality_scores_equal_a_plain_discriminant(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.with_statistics(docs).join(quality.truth(labels), "doc_id", "left").withColumn("r", remainder(F.col("doc_id"), 3)).collect()
    x = np.array([np.frombuffer(r["x"], "<f8") for r in rows])
    y = np.array([-1 if r["quality"] is None or r["r"] == 1 else r["quality"] for r in rows])
    pooled = sum((y == k).sum() * np.cov(x[y == k].T, bias=True) for k in (0, 1)) / (y >= 0).sum() + 1e-6 * np.eye(quality.D)
    density = []
    for k in (0, 1):
        own = x[y == k]
        share = max(0.05, quality.D / (quality.D + len(own)))
        cov = (1 - share) * np.cov(own.T, bias=True) + share * pooled
        cov = 0.99 * cov + 0.01 * np.trace(cov) / quality.D * np.eye(quality.D)
        d = x - own.mean(0)
        density.append(math.log(len(own) / (y >= 0).sum()) - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) - 0.5 * np.linalg.slogdet(cov)[1])
    want = dict(zip((r["doc_id"] for r in rows), 1 / (1 + np.exp((density[0] - density[1]) / quality.D))))
    got = {r["doc_id"]: r["score"] for r in quality.op1(docs, labels).collect()}
    assert got.keys() == want.keys()
    assert max(abs(got[k] - want[k]) for k in got) < 5e-3  # statistics are summed in fixed point


def test_labels_of_other_types_are_not_learnt_from(spark):
    docs = spark.createDataFrame([(i, f"word {i} text") for i in range(30)], "doc_id bigint, text string")
    for kind, values in (("double", [0.7, 0.2, 1.5]), ("string", ["good", "", None])):
        labels = spark.createDataFrame([(i, values[i % 3]) for i in range(30)], f"doc_id bigint, quality {kind}")
        assert quality.truth(labels).count() == 0
        assert quality.op1(docs, labels).count() == 30
    labels = spark.createDataFrame([(i, str(i % 2)) for i in range(30)], "doc_id bigint, quality string")
    assert quality.truth(labels).count() == 30


def plain_grams(text):
    """Hashes of the n-grams of a text's words, marked by blanks."""
    raw = bytes(32 if b < 65 or 91 <= b <= 96 or 123 <= b <= 127 else b + 32 if b <= 90 else b for b in text.encode())
    data, out = b" " + raw + b" ", []
    for k in language.SIZES:
        for i in range(len(data) - k + 1):
            gram = data[i : i + k]
            if 32 in gram[1:-1] or k == 2 and gram == b"  ":
                continue
            code = k * 0x9E3779B1 & 0xFFFFFFFF
            for b in gram:
                code = (code ^ b) * 0x01000193 & 0xFFFFFFFF
            code ^= code >> 15
            out.append((code * 0x85EBCA6B & 0xFFFFFFFF) >> 18)
    return out


def test_language_scores_equal_a_plain_softmax(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit(docs)
    texts = [r["text"] for r in docs.select("text").collect()][:60] + ["a", "Ünï – 😀", "x" * 400]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    for r in language.predict(rows, model).collect():
        if r["lang_pred"] == language.UNKNOWN:
            continue
        grams = plain_grams(r["text"])
        z = (np.sum([model.table[g].astype(float) for g in grams], axis=0) / len(grams) + model.bias) / model.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        assert r["lang_pred"] == model.languages[int(p.argmax())] and abs(r["score"] - p.max()) < 1e-6


def test_language_sample_is_bounded(spark):
    rows = spark.range(4000).selectExpr("IF(id % 2 = 0, 6, id) AS doc_id", "IF(id % 2 = 0, 'one text', concat('text ', id)) AS text", "concat('l', id % 50) AS lang")
    few = language.Settings(per_language=100, in_all=60, most_languages=5)
    got = language.sample(rows, few).collect()
    assert 0 < len(got) < 150 and len({r["lang"] for r in got}) <= 5
    assert len({(r["doc_id"], r["text"], r["lang"]) for r in got}) == len(got)


# --- the pipeline


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.read.parquet(f"{SF}/benchmark.parquet")


def test_stages_keep_columns_of_clashing_names(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    own = docs.withColumns({c: F.concat(F.lit("own "), "doc_id") for c in ("score", "lang_pred", "rejected", "copy", "a.b", "node")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, own, SF)
        assert out.columns == own.columns, name
        assert out.filter(" OR ".join(f"`{c}` <> concat('own ', doc_id)" for c in ("score", "lang_pred", "rejected", "copy", "a.b", "node"))).isEmpty(), name
        assert out.count() > 0


def test_stages_take_odd_tables(spark):
    learn = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    odd = spark.createDataFrame(
        [(None, "the text has no id and some words", None, None, None), (None, None, "en", None, None), (-1, None, None, "s", None), (-2, "", "en", "s", 0),
         (-3, "the same words again and again", "en", "s", 1), (-3, "the same words again and again", "en", "s", 1)], SCHEMA
    )
    for docs in (learn.unionByName(odd), learn.limit(0)):
        rows = docs
        for _, stage in corpus_pipeline.STAGES:
            rows = stage(spark, rows, SF)
        rows.collect()
