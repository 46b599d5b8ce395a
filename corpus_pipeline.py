"""The corpus pipeline: toxic documents and quality outliers go, one document of each group of copies stays, sources are mixed to target weights, and
what remains is packed.

Each stage is a function of (spark, docs, sf_dir). ``run`` writes the rows of each stage as Parquet in the shared folder and reads them again for the
next. All stages but the last return the columns of ``documents``; the last returns a row for each packed piece. A document that the mixture takes
several times is packed several times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioflow.llm import common, jaccard, mixing, packing, quality, tokens, toxicity

#: The classifier and the robust estimates are not SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, toxicity.learnable(common.table(spark, sf_dir, "labels")))
    return toxicity.keep_clean(docs, model)


def drop_outliers(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.resample(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokens.public_path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("quality rules", drop_outliers), ("n-gram Jaccard join", drop_copies), ("mixing sources to target weights", mix_sources), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), "stage")
    return docs
