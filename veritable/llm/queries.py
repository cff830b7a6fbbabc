"""The registered queries of this package, with their oracle statements where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veritable.llm import chat, decontaminate, language, lm, merkle, neardup, negatives, neighbours, packing, quality, secrets, substrings, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return keep


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@register("op10_language_id")
def _(spark, sf_dir):
    return language.op10(read(spark, sf_dir, "documents"))


@register("op3_secret_scan")
def _(spark, sf_dir):
    return secrets.find_secrets(read(spark, sf_dir, "documents"))


@register("op1_quality")
def _(spark, sf_dir):
    return quality.op1(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@register("op4_url_filter", urls.ORACLE)
def _(spark, sf_dir):
    return urls.op4(read(spark, sf_dir, "pages"))


@register("op5_lm_score")
def _(spark, sf_dir):
    return lm.op5(read(spark, sf_dir, "documents"))


@register("op9_substring_dedup")
def _(spark, sf_dir):
    return substrings.op9(read(spark, sf_dir, "documents"))


@register("op8_decontaminate", decontaminate.ORACLE)
def _(spark, sf_dir):
    return decontaminate.op8(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@register("op6_packing")
def _(spark, sf_dir):
    return packing.op6(read(spark, sf_dir, "documents"))


@register("op2_near_duplicates")
def _(spark, sf_dir):
    return neardup.op2(read(spark, sf_dir, "documents"))


@register("op7_nearest", neighbours.ORACLE)
def _(spark, sf_dir):
    return neighbours.op7(read(spark, sf_dir, "embeddings"))


@register("op13_merkle_manifest", merkle.ORACLE)
def _(spark, sf_dir):
    return merkle.op13(read(spark, sf_dir, "documents"))


@register("op12_chat_format", chat.ORACLE)
def _(spark, sf_dir):
    return chat.op12(read(spark, sf_dir, "conversations"))


@register("op11_hard_negatives", negatives.ORACLE)
def _(spark, sf_dir):
    return negatives.op11(read(spark, sf_dir, "embeddings"))
