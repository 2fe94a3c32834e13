"""Corpus pipeline: the stages in order, each over all that its predecessor kept.

1. language ID: documents in no learned language go, by a class of strange texts that the network learns, too;
2. near duplicates: one document of each group of near copies stays;
3. benchmark decontamination: documents that contain a benchmark window go;
4. mixing: the documents are put in the order of the target mix (none goes);
5. token store: the documents, in that order, become token-id shards; the
   result is read back from them.

Every stage is written as Parquet and read again.  The order of stage 4 is the
order of its files and their rows; stage 5 reads it from the file metadata
(and falls back to ascending ids for a table that is not read from files).
"""

from __future__ import annotations

from functools import partial

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.llm import decontaminate, langid, mixing, near_dup, token_store
from fleetpulse.llm.queries import MIX_WEIGHTS, id_part
from fleetpulse.session import settle

LEAST_LANGUAGE_SCORE = 0.3
LEAST_STRANGE_SCORE = 0.75      # of sf0.1 one document of 10,000 goes (nine where the class merely is the likeliest)
NEAR_PERCENT = 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is recognised (7); null texts and texts without letters have none."""
    model = langid.train(docs, id_part(3) != 1, strangers=True)
    return langid.keep_identified(docs, model, LEAST_LANGUAGE_SCORE, LEAST_STRANGE_SCORE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate component (9)."""
    return near_dup.keep_one(docs, NEAR_PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents without benchmark windows (1)."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the target mix (5)."""
    return mixing.mixed_order(docs, MIX_WEIGHTS)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-id shards in the order of the input, read back through their index (2)."""
    try:
        places = docs.select("doc_id", "text", F.col("_metadata.file_name").alias("_file"),
                             F.col("_metadata.row_index").alias("_row"))
        order = [F.length("_file"), F.col("_file"), F.col("_row")]      # part numbers may grow beyond five digits
    except AnalysisException:
        places, order = docs, None
    stored = token_store.store_tokens(places, public_tokenizers.path("byte_bpe_50k.json"), order=order)
    return stored.select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination),
          ("mixing", mix_sources), ("token_output", token_output)]
# Trained language ID and tokenization have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settle(spark, partial(stage, spark, docs, sf_dir), f"pipeline-{name}")
    return docs
