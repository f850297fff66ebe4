"""Training-corpus pipeline over the ``documents`` table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's docs.  All but the last return
the columns of ``documents``:

1. quality: documents that the rule ensemble scores below 0.7 go;
2. near_dup: of each group of near copies (five-word shingles, similarity of
   0.8 or more) the document with the smallest doc_id stays;
3. mix: documents are taken 0, 1 or 2 times so that sources reach their targets;
4. pack: what is left is packed into sequences of 4096 tokens, a row per piece.

No stage is SQL alone, so ``ORACLE_SQL`` is None; the tests hold every stage
against a brute-force version.  An empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dunegrid.llm import mixing, near_dup, packing, quality
from dunegrid.llm.queries import tokenizer_file
from dunegrid.session import scratch_table_path

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0
WINDOW, TOKENIZER, END_ID = 4096, "word_bpe_49k.json", 2


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.fit(docs, labels), 0.7)


def stage_near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.keep_one(docs, words=5, percent=80)


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, weights=WEIGHTS, share=SHARE, most=MOST)


def stage_pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_file(TOKENIZER), END_ID, WINDOW)


STAGES = [("quality", stage_quality), ("near_dup", stage_near_dup), ("mix", stage_mix), ("pack", stage_pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; returns the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = scratch_table_path(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
