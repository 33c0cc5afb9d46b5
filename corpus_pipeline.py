"""A corpus pipeline of five stages over ``documents``: toxic documents go, near-repeated lines go,
one document of each near-duplicate group stays, sources are mixed to their target weights (a
document stands once per copy), and what is left is packed into sequences. A document that line dedup
leaves without a word keeps its row until the mix, which takes no document of size 0; one of which some
lines are left goes on with those."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from symloom.llm import jaccard, lines, mixing, packing, toxicity
from symloom.llm.common import materialize, table


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def remove_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(docs, exact=1)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeat_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", remove_toxic),
    ("line_dedup", remove_lines),
    ("jaccard_join", one_of_each_group),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack),
]

#: Learned scores, similarity joins and tokenizers have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{k}-{name}")
    return docs
