"""The corpus pipeline: quality rules, near-duplicates, decontamination, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's documents. All stages but the last return the columns of documents.

Defined cases: null and empty texts fail the quality stage's base rule and go there; of rows that
repeat a doc_id and belong to one near-duplicate class one row stays; rows with a null doc_id are
kept only if no other row of their class has an id; an empty table passes through as an empty table;
columns beyond those of documents are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm.bpe import stage_bpe
from loomgraph.llm.common import table, work_folder
from loomgraph.llm.decontaminate import stage_decontaminate
from loomgraph.llm.quality import stage_quality
from loomgraph.llm.secrets import stage_secrets
from loomgraph.llm.simhash import stage_near_duplicates

STAGES = [
    ("quality", stage_quality),
    ("near_duplicates", stage_near_duplicates),
    ("decontamination", stage_decontaminate),
    ("secrets", stage_secrets),
    ("tokens", stage_bpe),
]

#: The stages learn and hash in ways SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`; what each stage keeps is written and read again."""
    docs, folder = table(spark, sf_dir, "documents"), work_folder(spark)
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
