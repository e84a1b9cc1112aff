"""Corpus cleaning and packing: language ID, quality, near copies, repeated passages, sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as
Parquet to the cluster's shared folder and rereads it as the next stage's input. All
stages but the last return the columns of the documents they were given. Documents
that a filtering stage says nothing against stay. Columns other than doc_id, text,
lang and n_chars may have any name: operators don't see them.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shroud.llm import kneser, langid, packing, partenum, substring
from shroud.llm.storage import small_batches, stored
from shroud.sources.tables import table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: those without a letter and ambiguous ones go."""
    small_batches(spark)
    model = langid.fit(langid.train_rows(docs.select("doc_id", "text", "lang")))
    row = docs.select("text", F.struct(*(c for c in docs.columns if c != "text")).alias("row"))
    kept = langid.predict(row, model).where(f"lang_pred <> '{langid.UNDETERMINED}' AND NOT ambiguous")
    return kept.select(*(F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within their language's limit; rows that share a doc_id are judged one by one."""
    small_batches(spark)
    judged = kneser.judge(docs.select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"))
    bad = judged.where("NOT keep").select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"), F.col("text_hash").alias("_hash")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("lang").eqNullSafe(F.col("_lang")) & (F.xxhash64("text") == F.col("_hash"))
    return docs.join(bad, same, "left_anti").select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similar shingle sets the one with the smallest doc_id, and of rows with one doc_id and text any one."""
    small_batches(spark)
    groups = partenum.similar_components(docs.select("doc_id", "text"))
    dropped = stored(groups.where("component_id <> doc_id").select("doc_id").distinct(), "copies")
    left = docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
    rows = docs.groupBy("doc_id", F.sha2("text", 256)).count()   # no text is shuffled to find repeated rows
    again = stored(rows.where("count > 1").select(F.col("doc_id").alias("_id")).distinct(), "repeated-rows")
    if again.isEmpty():
        return left
    same = F.col("doc_id").eqNullSafe(F.col("_id"))
    return left.join(again, same, "left_anti").unionByName(left.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has; untouched texts stay as they are, emptied ones go."""
    small_batches(spark)
    out = substring.remove_repeats(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    new = {"doc_id": F.col("doc_id"), "text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.char_length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    out = out.where("n_removed = 0 OR n_removed < n_words")
    return out.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their place in a sequence."""
    small_batches(spark)
    return packing.pack(stored(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")), "pieces"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language), ("quality", quality), ("near_copies", near_copies), ("repeated_passages", repeated_passages), ("pack", pack),
]

#: SQL cannot express the language model's and the quality model's scores.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
