"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lenscube.llm import chat, decontamination, licenses, packing, quality, repeats, secrets, simhash, sketch, warc
from lenscube.llm.common import load
from lenscube.llm.oracles import ORACLES as ORACLES


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(load(spark, sf_dir, "documents"), tokenizer_path()))


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.report(repeats.remove_repeats(load(spark, sf_dir, "documents")))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(load(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    postings = decontamination.index(load(spark, sf_dir, "documents"))
    return decontamination.report(decontamination.search(postings, load(spark, sf_dir, "benchmark")))


def op6_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.report(sketch.against_next(load(spark, sf_dir, "documents")))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(chat.format_conversations(chat.with_probe(load(spark, sf_dir, "conversations"))))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.report(warc.round_trip(load(spark, sf_dir, "pages")))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(secrets.scan(load(spark, sf_dir, "documents")))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(licenses.scan(load(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_repeats": op2_repeats,
    "op3_quality": op3_quality,
    "op4_simhash": op4_simhash,
    "op5_decontamination": op5_decontamination,
    "op6_sketch": op6_sketch,
    "op7_chat": op7_chat,
    "op8_warc": op8_warc,
    "op9_secrets": op9_secrets,
    "op10_licenses": op10_licenses,
}
