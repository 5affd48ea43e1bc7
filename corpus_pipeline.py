"""Corpus pipeline: quality rules, line dedup, near dedup, decontamination, best-fit packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last
return the columns of ``documents``.

1. quality_rules: documents that fail the base rules or are robust outliers of their language and
   source go.
2. line_dedup: lines of three-line windows that stand elsewhere before go; n_chars follows the text;
   a document all of whose lines stand elsewhere before goes.
3. near_dedup: of each class of equal and near-equal texts the document with the least id stays.
4. decontamination: documents that hold benchmark passages for a twentieth of their words go.
5. packing: what is left, as token pieces placed in sequences of 2048.

Empty tables pass through every stage; nulls are as the operators define them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, line_dedup, near_dedup, packing, quality_rules
from tessera.llm.queries import TOKENIZER
from tessera.llm.staging import stage


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.without_repeats(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_tests(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, TOKENIZER)


STAGES = [
    ("quality_rules", keep_good),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Token ids and signatures are beyond SQL; the tests compare with a brute-force version.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
SQL = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
