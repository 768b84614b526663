"""From raw documents to token shards: civil, near-unique, uncontaminated, mixed, encoded.

Every stage reads what the stage before has kept, from Parquet in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skriba.llm.decontam import clean_documents
from skriba.llm.mixing import mixed_documents
from skriba.llm.near_dup import drop_near_duplicates
from skriba.llm.queries import END_ID, vocabulary
from skriba.llm.shared import remove, store, work_dir
from skriba.llm.token_output import token_table
from skriba.llm.toxicity import keep_civil


def _civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the clause grammar does not reject; see `keep_civil`."""
    return keep_civil(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _near_unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of every near-duplicate component (five words, 0.8); see `drop_near_duplicates`."""
    return drop_near_duplicates(docs, 5, 80)


def _uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without enough benchmark words; see `clean_documents`."""
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; see `mixed_documents`."""
    return mixed_documents(docs)


def _encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards of the mix, read back: a row per document written; see `token_table`."""
    return token_table(docs, vocabulary(), END_ID)


STAGES = [("toxicity", _civil), ("near_duplicates", _near_unique), ("decontamination", _uncontaminated), ("mixing", _mixed), ("token_output", _encoded)]

#: SQL cannot express the learned grammar, the mix's seeded choice nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; rows of the last one.

    A stage's table is deleted when the next one's is written. An empty table gives an
    empty result; texts that are null or empty, rows that repeat an id or have none, and
    extra columns go through the stages as their own docstrings say."""
    folder = work_dir(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), folder, name)
        remove(spark, *before)
        before = [f"{folder}/{name}"]
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
