"""The registered queries of the training-data operators: thin, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.llm import audit, chat, decontaminate, html, licenses, line_dedup, near_dedup, packing, quality, rules, secrets, toxicity, vector_codes
from mnemospark.llm.common import read, text_of


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    marked = line_dedup.with_bitmaps(docs)
    text, bitmap = text_of(marked), F.col("dropped")
    return marked.select(
        "doc_id",
        F.size(F.split(text, "\n")).cast("long").alias("n_lines"),
        line_dedup.n_dropped(bitmap).alias("n_dropped"),
        F.sha2(line_dedup.kept_text(text, bitmap), 256).alias("kept_sha256"),
    )


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").select("doc_id", "toxic"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = secrets.scan(read(spark, sf_dir, "documents"))
    base = F.filter("found", lambda s: s["kind"] < 3)

    def count(kind: int, name: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(name)

    return spans.select("doc_id", count(0, "n_assign"), count(1, "n_access"), count(2, "n_hex"), F.sha2(secrets.as_text(base), 256).alias("base_sha256"), secrets.as_text(F.col("found")).alias("spans"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.find(read(spark, sf_dir, "documents"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    ranks = tokenizers.path("byte_bpe_50k.tiktoken")
    formatted = chat.format_conversations(rows.unionByName(extra), ranks, tokenizers.PATTERN)
    return chat.read_back(formatted, ranks, tokenizers.PATTERN)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(read(spark, sf_dir, "documents"))
    return judged.drop("failed_rule", "n_rules_run")  # which rule came first depends on measured costs


def op8_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read(spark, sf_dir, "pages"))


def op11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op12_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").select("doc_id", "quality"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pack": op1_pack,
    "op2_line_dedup": op2_line_dedup,
    "op3_licenses": op3_licenses,
    "op4_decontaminate": op4_decontaminate,
    "op5_toxicity": op5_toxicity,
    "op6_secrets": op6_secrets,
    "op7_near_dedup": op7_near_dedup,
    "op8_extract": op8_extract,
    "op9_chat": op9_chat,
    "op10_quality": op10_quality,
    "op11_audit": op11_audit,
    "op12_rules": op12_rules,
    "op13_vector_codes": op13_vector_codes,
}
