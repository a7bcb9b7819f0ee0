"""A training-data pipeline over ``documents``: five stages, each written as Parquet and reread by the next.

All stages but the last return the columns of ``documents``. Rows of null id and empty texts pass through
every stage (an empty text isn't toxic, has nothing to cut, and is a near copy of other empty ones).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import bpe, minhash, mixing, passages, simhash, toxicity
from lexmill.llm.common import ensure_checkpoint_dir, materialize, remove, table
from lexmill.llm.queries import TARGETS, labelled_domains, tokenizer_path


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from all labels of the stage's own documents."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return toxicity.drop_toxic(docs, model)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, Jaccard 0.8 or more) stays: the smallest doc_id."""
    return simhash.keep_one(docs, groups=minhash.near_groups)


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut from the later one; every document stays."""
    cut = passages.cut_passages(docs, passages.repeated_passages(docs))
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeat so that the languages' expected tokens meet the target weights; every document stays."""
    model = mixing.fit(labelled_domains(docs, table(spark, sf_dir, "labels")), domains=sorted(TARGETS))
    _, fitted = mixing.rates(docs, model, TARGETS, total="grow")
    return mixing.apply_rates(docs, fitted, at_least=1)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every row, and digests of them and of the text they decode to.

    The ids are written before they are decoded: else each task runs two Python workers at once, the join's
    and the decoder's, and executors keep them all.
    """
    path = tokenizer_path()
    got = bpe.bpe_decode(materialize(bpe.bpe_encode(docs, path)), path)
    return got.select("doc_id", "ids", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("substring_dedup", substring_dedup_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

#: Trained models and token ids are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each stage returns is written in the shared checkpoint folder.

    A stage's rows are deleted when the next one's are written; those of the last stage are what the result reads, and stay.
    """
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
