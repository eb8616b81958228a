"""A corpus through five operators of :mod:`lexigram.llm`, each on all its predecessor kept.

Every stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as
the next one's ``docs``.  All but the last return the columns of ``documents``.

An empty table passes through.  Null texts count as empty: they are never toxic, contaminated
or secret, and are near duplicates of each other.  A row with a null id stays in the near-duplicate stage
only where no row of its group has an id; of rows that repeat id and text one stays.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigram.llm import cgk_decontam, credential_links, lattice_sampling, simhash_tiles, toxic_crf
from lexigram.llm.common import folder_till_exit, remove, shared_dir, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose toxicity score reaches 0.7; the model never sees labels that op2 holds out."""
    labels = table(spark, sf_dir, "labels")
    out = toxic_crf.held_out(F.col("doc_id"), 3, 1)
    model = toxic_crf.train(docs, labels.where(~F.coalesce(out, F.lit(False))))
    return toxic_crf.reject(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the least id in each near-duplicate group."""
    return simhash_tiles.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, up to a fifth of its words edited."""
    return cgk_decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a mask in place of every secret; ``n_chars`` follows."""
    clean = credential_links.redact(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType))
    return clean


def segmentation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled ids of every text that is left: ``doc_id, n_tokens, ids, lossless``."""
    import public_tokenizers

    made = lattice_sampling.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return made.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "lossless")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("segmentation", segmentation),
]

#: SQL can't express the fitted field, the component search or the sampled lattice.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again.

    A result is deleted once the next one is committed; the last stays till the driver ends, as the
    frame reads it.
    """
    docs = table(spark, sf_dir, "documents")
    folder = folder_till_exit(spark, f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}")
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if before:
            remove(spark, before)
        before = f"{folder}/{name}"
        docs = spark.read.parquet(before)
    return docs
