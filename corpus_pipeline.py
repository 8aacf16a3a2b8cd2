"""A training corpus from raw documents: quality, exact copies, near copies, mixture, tokens.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns
a DataFrame; all but the last return the columns of documents. ``run`` writes each stage's
result as Parquet to the shared folder and rereads it as the next one's docs.

Defined cases: a null text counts as empty, scores like one, is a copy of other empty texts,
has no near copies, and takes no part in the words of the mixture; rows with a null id are
kept by the near-copy stage; rows that repeat an id stay or go together there, and one by one
elsewhere; empty tables give empty results; further columns of the documents pass through,
whatever their names, unless they start with two underscores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.llm import bpe, exact, mixing, quality, simhash
from notelake.llm.common import drop_written, located, table, written
from notelake.llm.queries import ranks_path


def _rows(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """``docs`` joined with ``chosen`` by locator, without the locator."""
    at = chosen.withColumnsRenamed({"__file": "__c_file", "__row": "__c_row"})
    # decisions grow with the documents, so they are never broadcast
    rows = located(docs).join(at.hint("merge"), (F.col("__file") == F.col("__c_file")) & (F.col("__row") == F.col("__c_row")))
    return rows.drop("__file", "__row", "__c_file", "__c_row")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier scores below its threshold."""
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    scored = quality.score_documents(docs, model, out="__score")
    return scored.where(F.col("__score") >= model.cut).select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id stays."""
    kept = exact.exact_duplicates(docs).where("kept").select("__file", "__row")
    return _rows(docs, kept).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) the one with the smallest id stays."""
    copies = simhash.near_copies(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("__c_id"))
    return docs.join(copies.hint("merge"), docs["doc_id"] == copies["__c_id"], "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that sources have their target weights."""
    mixed = written(mixing.mix(docs).where("copies > 0").select("__file", "__row", F.col("copies").alias("__copies")), "mixed")
    copies = F.explode(F.sequence(F.lit(1), F.col("__copies")))
    return _rows(docs, mixed).withColumn("__copy", copies).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and the ids (little-endian unsigned 32-bit) of every row."""
    coded = bpe.encode_texts(docs.select("doc_id", "source", "text"), ranks_path()).drop("text")
    return coded.select("doc_id", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_exact_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing to target weights", mix_sources),
    ("byte-level BPE", encode),
]

#: The classifier, the fingerprints, the draws and the tokens have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.lower().replace(" ", "-"))
        if before is not None:
            drop_written(before)
        before = docs
    return docs
