"""The registered query of each operator, with its production parameters, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codegrain.llm import chat, license_scan, mixing, quality_rules
from codegrain.llm.common import remainder, stored, table


def tokenizer_path(name: str) -> str:
    """Where the file of a public tokenizer is; they are installed beside Python, on every machine alike."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codegrain.llm.token_output import token_output

    return token_output(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codegrain.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codegrain.llm.embedding_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codegrain.llm.quality_classifier import score, train

    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = train(docs, labels.where(remainder(F.col("doc_id"), 4) != 2))
    scored = stored(score(docs, model))
    return scored.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codegrain.llm.mixing import mix_plan

    planned = mix_plan(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), weights=(5, 2, 1), share=1.5, most=2.0)
    return planned.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(license_scan.scan(table(spark, sf_dir, "documents"), threshold=0.8))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codegrain.llm.quality_rules import BASE, cascade, score

    scored = score(table(spark, sf_dir, "documents").select("doc_id", "text"))
    failed = cascade(list(BASE)).isNotNull()
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "kept")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codegrain.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4, most=4)


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codegrain.llm.chat import TRAP, digest, format_conversations

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRAP).alias("text"))
    return digest(format_conversations(rows.unionByName(trap)))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codegrain.llm.langid import predict, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(remainder(F.col("doc_id"), 3) != 1))
    predicted = stored(predict(docs, model))
    return predicted.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from codegrain.llm.byte_bpe import digest

    return digest(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op12_window_panes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codegrain.llm.panes import revised

    return revised(table(spark, sf_dir, "clicks"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codegrain.llm.hard_negatives import mined

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label")), "vec_id % 50 = 0")


QUERIES = {
    "op1_token_planes": op1_token_planes,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_mixing": op5_mixing,
    "op6_license_scan": op6_license_scan,
    "op7_quality_rules": op7_quality_rules,
    "op8_simhash": op8_simhash,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_language_id": op10_language_id,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_window_panes": op12_window_panes,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLES: dict[str, str] = {
    "op5_mixing": mixing.ORACLE,
    "op6_license_scan": license_scan.oracle(),
    "op7_quality_rules": quality_rules.ORACLE,
    "op9_chat_formatting": chat.ORACLE,
}
