"""Training corpus from raw documents: five stages, each one an operator of millrace.llm.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it
kept; run() writes every stage's rows as Parquet and reads them again.

All stages take null and empty texts, null ids, languages and sources, very long
texts, repeated rows, an empty table (the result is empty) and further columns
of any name (all but the last give back the five columns of documents).  What
each stage makes of them stands at the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import mixing, packing, quality, secrets, shingles, simhash
from millrace.llm.common import new_path, stored, tables

DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null and empty texts are judged like any others, by features of zero; rows
    with a null id are judged and never learnt from; repeated rows go together.
    """
    return quality.keep_good(docs, tables(spark, sf_dir, "labels")).select(*DOCUMENT)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, by fingerprints or by five-word shingles, the document with the smallest id stays.

    Null and empty texts are copies of one another; a null id comes last; of
    rows equal in id and text one stays.
    """
    return simhash.one_of_each(docs, least=shingles.SIMILAR).select(*DOCUMENT)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; the document stays, with its new length.

    A null text stays null, with a null length.
    """
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*DOCUMENT)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn so that sources, languages and topics come near their target weights and KEPT_SHARE of the tokens stays.

    Null languages and sources are values of their own; null and empty texts
    count one token; rows with equal ids in one cell go together.
    """
    return mixing.sample(docs, share=mixing.KEPT_SHARE).select(*DOCUMENT)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document, with its sequence and place.

    A null or empty text is one piece of the end id alone; repeated rows are
    packed once each.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("secret scans", secret_stage),
    ("mixing sources to target weights", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: A learnt classifier and 64-bit fingerprints are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents table; its nulls, repeats and an empty table are treated as the stages say."""
    docs = tables(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "stage", new_path(spark, "stage-" + name.replace(" ", "-")))
    return docs
