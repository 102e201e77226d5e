"""From raw documents to packed training sequences.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written and
read again before the next one gets it. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codegrain.llm import langid, mixing, packing, quality_rules, shingle_sets
from codegrain.llm.common import stored, table
from codegrain.llm.queries import tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no known language go: those without a letter (null and empty texts too) and those for which no language
    that the corpus names stands out. Where no row has a lang, letters alone decide. Rows are judged one by one, repeated
    ones alike; no rows, no result."""
    return langid.keep_known(docs, langid.train(docs))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go; short texts are wanted, so only those without a word (null and empty ones)
    are too short. Rows are judged one by one, repeated ones alike; no rows, no result."""
    return quality_rules.keep_good(docs, quality_rules.SHORT_TOO)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest doc_id, nulls last: groups link texts
    whose sets of five-word shingles have a Jaccard similarity of 0.8 or more. Texts without words are one group. Rows that
    share a doc_id, or have none, go only if their texts are linked; of rows equal in every column one stays; no rows, no
    result."""
    return shingle_sets.keep_one(docs, shingle=5, least=(4, 5))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or dropped so that sources come near their targets. Null sources are one source, the last;
    texts without words (null and empty ones) are drawn like others; rows with the same doc_id and source share their draw;
    no rows, no result."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are placed into sequences of 2048 tokens; one row for each piece, repeated documents as often as they come.
    A null or empty text is its end id alone; a null doc_id is packed like any other; no rows, no pieces."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("quality_rules", rules),
    ("simhash_near_dedup", near_duplicates),
    ("source_mixing", mix),
    ("best_fit_packing", pack),
]

#: None: string kernels, SimHash and a tokenizer are beyond SQL; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
