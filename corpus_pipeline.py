"""A corpus pipeline: documents in, token digests of what is kept out.

Each stage gets the rows that the one before kept, as a table, and all but the last return
the columns of documents.  Stages: documents in no known language go; lines that five
documents hold stay in the last of them; one document of each near-duplicate group stays;
passages of the benchmark are cut out; the rest is encoded and decoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pixelloom.llm import decontaminate, language_id, line_dedup, minhash_join, sentencepiece_chunks
from pixelloom.llm.shared import stored

STAGES = [
    ("language_id", language_id.stage),
    ("line_dedup", line_dedup.stage),
    ("near_dedup", minhash_join.stage),
    ("decontamination", decontaminate.stage),
    ("sentencepiece", sentencepiece_chunks.stage),
]

#: Mixtures, wavelet ranks and subword merges have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each written as Parquet and read again."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        rows = stored(step(spark, rows, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, rows, sf_dir)
