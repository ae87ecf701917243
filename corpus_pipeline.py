"""Corpus pipeline: five stages over the documents, each one of the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
in the shared scratch folder and read again as the next stage's documents. Every stage works
on all that its predecessor kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidalframe.llm.bpe import tokenize_documents
from tidalframe.llm.common import read, stage
from tidalframe.llm.decontaminate import drop_contaminated
from tidalframe.llm.exact_dedup import keep_unique
from tidalframe.llm.minhash import keep_representatives
from tidalframe.llm.toxicity import drop_toxic

STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", keep_unique),
    ("near_dedup", keep_representatives),
    ("decontamination", drop_contaminated),
    ("bpe", tokenize_documents),
]

#: SQL cannot express the learned, hashed and merging stages; tests/llm/test_pipeline.py
#: compares each stage with a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
