"""Corpus pipeline: quality, near-dedup, repeated passages, packing.

Each stage works on all rows its predecessor kept, and returns the columns of ``documents`` but for
the last, which returns the packed pieces. ``n_chars`` follows the text where a stage changes it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from panelspark.llm import near_dedup, packing, quality_crf, suffix_dedup
from panelspark.storage import application_dir, children, remove, scratch_path

#: Some stages cannot be said in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


#: A repeated passage is removed from this many bytes on: of 51-word windows of sf0.1, 1 % are shorter than 246 bytes.
PASSAGE, ANCHOR = 240, 64


def fresh(docs: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column has."""
    while name in docs.columns:
        name += "_"
    return name


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose lines a conditional random field finds good; the others go."""
    chain, out = quality_crf.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), fresh(docs, "_quality")
    scored = quality_crf.score(docs, chain, out=out)
    rejected = F.lit(False) if chain is None else F.col(out) < quality_crf.CUT
    return scored.filter(~rejected).drop(out)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id."""
    return near_dedup.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without bytes of ``PASSAGE``-byte strings that start more than once; cut characters go whole."""
    kept, removed, runs = names = tuple(fresh(docs, n) for n in ("_kept", "_removed", "_runs"))
    done = suffix_dedup.without_repeats(docs, as_text=True, length=PASSAGE, gram=ANCHOR, names=names)
    size = F.when(F.col(removed) == 0, F.col("n_chars")).otherwise(F.char_length(kept).cast("long"))
    return done.withColumn("text", F.col(kept)).withColumn("n_chars", size).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing of what is left into sequences of at most 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("near_dedup", near_duplicates), ("suffix_dedup", repeated_passages), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again.

    A stage's own tables and the result before it are removed once its result is written.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path, there = scratch_path(spark, f"pipeline-{name}"), children(spark, application_dir(spark))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        for made in children(spark, application_dir(spark)):
            if made not in there and not made.endswith(path.rsplit("/", 1)[1]):
                remove(spark, made)
        if before:
            remove(spark, before)
        before = path
    return docs
