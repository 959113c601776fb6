"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages the
rows are written to the shared folder and read again. Documents and lines that a stage
rejects are gone for the next one. Edge cases are those of the operators: a null text
fails the quality rules, a document of which line dedup leaves no word goes, an empty table stays empty through all stages, and columns
beyond those of ``documents`` are carried along until the packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from macrotide.llm import decontaminate, line_dedup, minhash, packing, quality
from macrotide.llm.queries import table, tokenizer
from macrotide.llm.storage import discard, materialise


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; of the others, lines above the host's limit go."""
    return quality.apply_rules(docs)


def fuzzy_line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar lines the first stays; documents that this leaves without a word go."""
    return line_dedup.remove(docs).filter(F.length(F.translate("text", " \t\n\x0b\f\r", "")) > 0)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return minhash.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold too much of the benchmark go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents as pieces with their places in sequences."""
    return packing.pack(docs, tokenizer())


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", fuzzy_line_dedup),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Near duplicates are found by locality-sensitive hashing and packing by a search, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
