"""From raw documents to packed training sequences; each stage calls one operator on all that the one before it kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next stage's documents. All but the last return the columns of `documents`, and any others that come along, as they are.

Nulls and ties: a null or empty text, or one without a letter, goes with the first stage. Of repeated rows one stays, and of near duplicates the
one with the smallest id; a document without an id stays if no other of its group has one. An empty table gives no rows. Texts of any length,
also long runs of one sign, pass every stage whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.llm import decontam, langid, neardup, packing, pii
from ledgerflow.llm.common import fresh_name, is_training, materialize, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; one that none was stated for gets the predicted one."""
    model = langid.fit(docs, key="doc_id", text="text", language="lang", training=is_training("doc_id"))
    language, certainty = fresh_name(docs, "predicted"), fresh_name(docs, "certainty")
    found = langid.predict(docs, model, into=(language, certainty)).where(F.col(language) != langid.UNKNOWN)
    return found.withColumn("lang", F.coalesce("lang", language)).drop(language, certainty)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return neardup.keep_first(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return pii.redacted(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 2048 tokens."""
    vocabulary, tokenizer = map(public_tokenizers.path, ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json"))
    return packing.pack_texts(docs, vocabulary, public_tokenizers.PATTERN, tokenizer=tokenizer)


STAGES = [
    ("language", known_language),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("personal_data", without_personal_data),
    ("packing", packed),
]

# Learned models, graph components and tokens have no SQL form; tests/llm/test_pipeline.py checks every stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of `documents`."""
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
    return docs
