"""From documents to packed training sequences, in five stages.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; each result is written as Parquet and read again as the next one's ``docs``.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossgrain.llm import decontaminate, langid, neardup, packing, surrogates
from crossgrain.llm.common import as_row, read_table, unpacked, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: no letters, or no more than chance in common with any learned profile.

    Profiles are learned from the labelled rows themselves; a kept row without a label gets the predicted one.
    """
    keyed = docs.select(as_row(docs), "text")
    found = langid.identify(keyed, langid.learn(docs), id_col="row").withColumnRenamed("doc_id", "row")
    kept = found.where(langid.understood())
    return unpacked(kept, docs, lang=F.coalesce("row.lang", "lang_pred"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicates, that of the smallest id; rows are told apart by themselves, not by their ids.

    Near-duplicates are texts whose sets of five-word shingles have a Jaccard likeness of 0.8 or more. SimHash fingerprints in
    BK-trees propose the closest pairs, min-hash bands the others; exact counts decide.
    """
    return neardup.deduplicated(docs, width=5, share=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a ten-word passage, or the whole of a shorter text, of a benchmark item."""
    return decontaminate.decontaminated(docs, read_table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by surrogates."""
    hidden = surrogates.pseudonymized(docs, key=surrogates.secret_key(spark))
    return hidden.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of training sequences: doc_id, start, length, ids, doc_tokens, sequence_id, offset."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packed),
]

#: SQL cannot tokenize or draw surrogates; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
