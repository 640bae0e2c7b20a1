"""The corpus operators over their whole tables, in the shape of their contracts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, classifier, html, merkle, mixing, packing, quality_rules, secrets, simhash, spelling, suffix, topk, toxicity
from .common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.query(table(spark, sf_dir, "documents"))


def op2_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.query(table(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.query(table(spark, sf_dir, "documents"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.query(table(spark, sf_dir, "pages"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.query(table(spark, sf_dir, "documents"))


def op6_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.query(table(spark, sf_dir, "embeddings"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.query(table(spark, sf_dir, "conversations"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.query(table(spark, sf_dir, "documents"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.query(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_suffix": op2_suffix,
    "op3_secrets": op3_secrets,
    "op4_html": op4_html,
    "op5_quality_rules": op5_quality_rules,
    "op6_classifier": op6_classifier,
    "op7_topk": op7_topk,
    "op8_chat": op8_chat,
    "op9_mixing": op9_mixing,
    "op10_packing": op10_packing,
    "op11_spelling": op11_spelling,
    "op12_toxicity": op12_toxicity,
    "op13_merkle": op13_merkle,
}

ORACLE_SQL: dict[str, str] = {
    "op5_quality_rules": quality_rules.ORACLE_SQL,
    "op7_topk": topk.ORACLE_SQL,
    "op8_chat": chat.ORACLE_SQL,
    "op11_spelling": spelling.ORACLE_SQL,
    "op13_merkle": merkle.ORACLE_SQL,
}
