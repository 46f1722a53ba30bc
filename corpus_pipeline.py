"""From raw documents to tokens: language, near copies, repeated passages, benchmark leaks, encoding.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor
kept; all but the last return the columns of ``documents``. Stages are total:
null texts and ids, repeated rows and empty tables pass through with the results
that the operators' docstrings define.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import bpe_automaton, decontaminate, language_ppm, minhash_forest, suffix_dedup
from tidemill.llm.common import staged

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters, and those that no learned language fits: told apart badly, or coded far longer than its own texts."""
    docs = docs.select(*COLUMNS)
    return language_ppm.accepted(docs, language_ppm.fit(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies, that of the smallest doc_id; rows without doc_id come last.

    Rows that have no doc_id, or share it, are told apart by numbers beyond all
    doc_ids, so different texts of one doc_id are different documents.
    """
    docs = docs.select(*COLUMNS)
    again = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", F.lit(True).alias("again"))
    top = docs.agg(F.greatest(F.max("doc_id"), F.lit(0))).first()[0] or 0
    number = F.when(F.col("doc_id").isNull() | F.col("again"), F.monotonically_increasing_id() + F.lit(top + 1)).otherwise(F.col("doc_id"))
    rows = staged(docs.join(again, "doc_id", "left").select(*COLUMNS, number.alias("row")), "rows")
    groups = minhash_forest.near_duplicates(rows.select(F.col("row").alias("doc_id"), "text"))
    members = groups.select(F.col("doc_id").alias("row"), "component_id").join(rows.select("row", "doc_id"), "row")
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))["row"]
    kept = members.groupBy("component_id").agg(best.alias("row")).select("row")
    return rows.join(kept, "row", "left_semi").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts strings of 200 bytes or more that occur twice out of the texts; what is left of cut characters goes too.

    A passage of more than 50 words is longer than that. Texts without repeats are unchanged.
    """
    out = suffix_dedup.repeated_substrings(docs.select(*COLUMNS), length=200, kept_as="string", carry=["lang", "source", "n_chars"])
    return out.select(
        "doc_id",
        F.when(F.col("was_null"), None).otherwise(F.col("kept")).alias("text"),
        "lang",
        "source",
        F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"),
    )


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, whole or with its parts in another order."""
    return decontaminate.uncontaminated(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and the digests of ids and decoded text of each document."""
    return bpe_automaton.tokenize(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", language),
    ("near_copies", near_copies),
    ("repeated_passages", repeated_passages),
    ("leaks", leaks),
    ("encoding", encoding),
]

#: SQL has no counterpart of the stages' models, signatures and tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, name)
    return docs
