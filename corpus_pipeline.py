"""Corpus pipeline: quality filter, near duplicates, decontamination, mixing to source targets, token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. It works on all that the stage before it kept; all stages
but the last return the columns of `documents`, whatever they are called, in their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwave.llm import decontam, dedup, mixing, quality, tokens
from rillwave.llm.shared import table, unused, written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality classifier rejects (score under 0.5).

    A null or empty text is scored as empty and a very long one whole; equal texts stay or go together, a score of exactly
    0.5 stays; rows with a null doc_id are scored like others; an empty table stays empty; labels of absent rows are unused.
    """
    name = unused(docs, "score")
    model = quality.fit(docs, quality.train_labels(table(spark, sf_dir, "labels")))
    return quality.score(docs, model, score_col=name).where(F.col(name) >= 0.5).drop(name)


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the least doc_id of each class of near duplicates.

    Null, empty and wordless texts are each alone and stay; very long texts are compared whole; of rows with one doc_id one
    stays; rows with a null doc_id stay; an empty table stays empty.
    """
    return dedup.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item.

    Null and empty texts hold none and stay; very long texts are read whole; repeated rows stay or go together; an empty
    table or an empty benchmark drops nothing.
    """
    prefix = unused(docs, *decontam.RESULT.fieldNames())
    checked = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"), result_prefix=prefix)
    return checked.where(~F.col(f"{prefix}contaminated")).select(*[F.col(f"`{c}`") for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; a document taken twice is two rows.

    Null and empty texts have no words and are taken as their source is; a null source is the last source; a very long text
    is one document; repeated rows are taken equally often; an empty table stays empty.
    """
    return mixing.mix(docs)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the corpus in the shared folder, and one row a document read back from them.

    Null and empty texts are the end id alone; very long texts are encoded whole; a null doc_id comes first; repeated rows
    are written each; an empty table gives no rows; columns other than doc_id and text are not read.
    """
    return tokens.token_table(docs)


STAGES = [
    ("quality_classifier", keep_good),
    ("minhash_near_dedup", keep_one_copy),
    ("benchmark_decontamination", drop_leaks),
    ("cube_mixing", mix_sources),
    ("token_files", write_token_files),
]

#: A fitted classifier, sampled similarity and a tokenizer are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents of sf_dir; each stage's rows are written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
