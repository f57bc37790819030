"""Documents to packed training sequences: clean, deduplicate, mix to target weights, pack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pathloom.llm import exact, mixing, packing, simhash, toxicity
from pathloom.llm.common import documents, staged

STAGES = [
    ("toxicity", toxicity.stage),
    ("exact_dedup", exact.stage),
    ("simhash_near_dedup", simhash.stage),
    ("mixing", mixing.stage),
    ("packing", packing.stage),
]

#: The toxicity, fingerprint and tokenizer stages have no SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each is written as Parquet in the shared folder and read again by the next."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
