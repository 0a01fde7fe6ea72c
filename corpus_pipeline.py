"""Corpus pipeline over ``documents``: toxicity, line dedup, n-gram Jaccard join, benchmark decontamination, BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's docs.  All but the last return the
columns of ``documents``; where a stage changes a text, its n_chars follows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streakline.llm import _common as c
from streakline.llm.bpe import encode_documents
from streakline.llm.decontamination import decontaminate
from streakline.llm.jaccard_join import jaccard_components
from streakline.llm.line_dedup import drop_common_lines
from streakline.llm.toxicity import score_documents, train_model

#: Ids of documents to drop (8 bytes each) up to this number are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def _measured(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of ``docs`` with n_chars taken from the text anew."""
    kinds = dict(docs.dtypes)
    return docs.select(*[F.length("text").cast(kinds[x]).alias(x) if x == "n_chars" else F.col(f"`{x}`") for x in columns])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, fitted on this input's labelled rows that are not held out, rejects go."""
    model = train_model(docs, c.table(spark, sf_dir, "labels"))
    return score_documents(docs, model).filter("predicted = 0").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand in ten documents or more go; the documents stay, if with an empty text."""
    return _measured(drop_common_lines(docs), docs.columns)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents that with the smallest id stays; a null id is linked with nothing."""
    groups = jaccard_components(docs).filter("component_id < doc_id").select("doc_id").distinct()
    gone = c.checkpoint(groups)
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents of which they are more than half go."""
    return _measured(decontaminate(docs, c.table(spark, sf_dir, "benchmark")), docs.columns)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, their number, and the digests of ids and of the text decoded from them."""
    return encode_documents(docs)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("jaccard_join", jaccard_join), ("decontamination", decontamination), ("bpe", bpe)]
#: The toxicity model has no SQL; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = c.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
