"""From raw documents to token ids: each stage takes (spark, docs, sf_dir) and returns a DataFrame.

The stages only need the columns doc_id and text (language ID also learns from
lang) and pass every other column on. A stage's result may be written and read
again as the next one's input; ``run`` does so in the shared folder. An empty
table goes through all stages as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import bpe, chunk_dedup, langid, near_duplicates, winnow
from colloquy.llm.names import free_name
from colloquy.llm.written import written

VOCABULARY = "word_bpe_49k.json"

#: SQL cannot fit the classifier, hash the chunks or merge the pairs; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told: ``und`` (null text, no letter) and ambiguous ones go."""
    model = langid.fit(docs.where(~langid.held_out()))
    to = free_name(docs.columns, "_language")
    told = langid.predict(docs, model, to=to)
    return told.where((F.col(f"{to}.lang_pred") != langid.UNKNOWN) & ~F.col(f"{to}.ambiguous")).select(*docs.columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies (five-word shingles common by 0.8 or more) the document of the smallest id; rows that share an id count as one document."""
    groups = near_duplicates.near_duplicate_groups(docs)
    kept = free_name(docs.columns, "_keep")
    keep = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(kept)).distinct()
    return docs.join(keep, F.col("doc_id").eqNullSafe(F.col(kept)), "left_semi").select(*docs.columns)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document holds; ``n_chars`` follows where there is one."""
    cleaned = chunk_dedup.without_repeats(docs)
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.char_length("text").cast("long"))
    return cleaned.select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item contaminates."""
    judged = winnow.hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    named = free_name(docs.columns, "_gone")
    gone = judged.where("contaminated").select(F.col("doc_id").alias(named))
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col(named)), "left_anti").select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, their number, and a digest of the text they decode to."""
    coded = bpe.coded(docs.select("doc_id", "text"), VOCABULARY, decoded="decoded", drop_text=True)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", known_language),
    ("simhash_near_dedup", one_of_near_copies),
    ("substring_dedup", without_repeated_passages),
    ("benchmark_decontamination", without_benchmark),
    ("bpe_codec", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
