"""From raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a frame; `run` writes every
stage's result as Parquet in the shared folder and reads it again for the next.
All stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from denpyo.llm import byte_bpe, line_dedup, minhash_dedup, mixing, quality
from denpyo.llm.tables import Workspace, fresh, read


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier scores below its threshold; empty texts are scored like others."""
    model = quality.fitted(docs, read(spark, sf_dir, "labels"))
    name = fresh(docs.columns, "score")
    return quality.score(docs, model, name=name).where(F.col(name) >= quality.REJECT_BELOW).select(*(F.col(f"`{c}`") for c in docs.columns))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that are similar to earlier ones; a document may end up empty and stays. n_chars follows the text."""
    out = line_dedup.dedup_lines(docs, shortest=line_dedup.SHORTEST)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def minhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near-duplicates, and of rows of one doc_id and text the first by all their columns.

    Documents without words are in no group and stay, as do rows without doc_id.
    """
    ws = Workspace(spark, "minhash-stage")
    node, keeps, n = (fresh(docs.columns, x) for x in ("node", "keeps", "n"))
    found = ws.keep(minhash_dedup.near_duplicates(docs).select(F.col("doc_id").alias(node), F.col("kept").alias(keeps)), "found")
    gone = found.where(F.col(node).isNotNull()).groupBy(node).agg(F.bool_or(keeps).alias(keeps), F.count("*").alias(n))
    gone = ws.keep(gone.where(~F.col(keeps) | (F.col(n) > 1)), "gone")
    id_ = F.col("doc_id").cast("long")
    once = docs.join(gone, id_ == F.col(node), "left_anti")
    again = docs.join(gone.where(keeps), id_ == F.col(node), "left_semi")
    whole = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)))
    first = again.groupBy("doc_id", "text").agg(F.min(whole).alias(node))
    return once.union(first.select(*(F.col(node)[f"c{i}"].alias(c) for i, c in enumerate(docs.columns))))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that the expected tokens by domain meet the targets."""
    return mixing.sample(docs, mixing.labelled_domains(read(spark, sf_dir, "labels")))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and the ids (little-endian unsigned 32-bit integers)."""
    ids = byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=["doc_id", "lang", "source"])
    return ids.select("doc_id", "lang", "source", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("minhash_dedup", minhash_stage),
    ("mixing", mixing_stage),
    ("byte_bpe", encode_stage),
]

#: Not expressible: a trained classifier decides, and rates come from an iteration.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        kept = ws.keep(stage(spark, docs, sf_dir), name)
        if k:
            ws.drop(docs)
        ws.release()
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
