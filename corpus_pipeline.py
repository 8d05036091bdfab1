"""Corpus preparation in five stages, each one operator over all that its predecessor kept.

All stages take empty tables (no rows come out), whole texts of any length, and extra
columns, which stay untouched whatever their names; only doc_id and text are read, n_chars
is kept true if it is there, and columns of an operator with a clashing name are not kept.
Rows with equal ids are rows of their own unless a stage says otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adweave.llm.common import read_table, stored
from adweave.llm.decontamination import contaminated
from adweave.llm.language_id import identify, train
from adweave.llm.line_dedup import dedup_lines
from adweave.llm.near_dedup import near_duplicates
from adweave.llm.packing import pack

#: Posterior below which no language is identified.
MIN_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: drops documents of no language or of an unsure one (a posterior below MIN_SCORE).

    Null and empty texts and texts without a letter have no language and go, whatever their
    id. Repeated rows get the same answer; of equal posteriors the first language in order
    counts. Without a labelled row, as in an empty table, all go.
    """
    marked = identify(docs, train(docs))
    return marked.filter((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE)).select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: takes cross-site boilerplate lines out of the texts, but for whole copies; n_chars follows.

    Every row stays. Null texts stay null and empty ones empty; rows with a null id keep
    their lines, and rows with equal ids each lose theirs. A null source counts for no site.
    A line on exactly the least number of sites is boilerplate.
    """
    cleaned = dedup_lines(docs, whole_copies=True)
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return cleaned.select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: keeps the document of the smallest doc_id of each group of near copies.

    Null, empty and blank texts are copies of nothing and stay, as do rows with a null id.
    Rows with equal ids stay or go together.
    """
    gone = near_duplicates(docs).filter(~F.col("kept")).select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: drops documents that hold an item of the benchmark table.

    Null and empty texts hold none; null and empty items are in no document. Rows with a
    null id aren't checked and stay; rows with equal ids go if one of them holds an item.
    """
    gone = contaminated(docs, read_table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: a row per document with its length bucket and batch.

    Null and empty texts have the end id alone. Equal lengths are in one bucket; rows with
    equal or null ids are documents of their own.
    """
    return pack(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("packing", packing),
]

#: SQL cannot express the fitted language model or the MinHash stage; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's rows stored and read by the next."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
