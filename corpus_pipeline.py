"""A corpus pipeline over `documents`: each stage applies one operator of spanloom.llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each result
to the shared folder and hands it, read again, to the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm import dedup, langid, packing, pii, quality
from spanloom.llm.common import small_batches, table
from spanloom.sources.shared import discard, kept_alone


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no or no clear language go.

    Null and empty texts, and texts without a letter, have no language and go.  Rows are
    judged one by one, so repeated rows fare alike; of equally likely languages the first
    by name counts, which decides nothing here.  A long text is read whole, window by
    window.  All columns come back unchanged; an
    empty table, or one without labelled texts to learn from, gives an empty table.
    """
    small_batches(spark)
    return langid.identified(docs, langid.fit(docs))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule of the current policy go.

    Null and empty texts fail.  Rows are judged one by one by exact integer rules, so
    there are no ties and repeated rows fare alike.  A long text is measured whole.  All
    columns come back unchanged; an empty table stays empty.
    """
    small_batches(spark)
    return quality.passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of documents with a similarity of 0.8 or more the one with the smallest id stays.

    Null and empty texts are like nothing and stay, as do rows without an id.  Rows that
    repeat an id are one document and stay or go together; of equal texts the smallest id
    stays, and which of several links joins a group changes nothing.  A long text is
    hashed whole.  All columns come back unchanged; an empty table stays empty.
    """
    return dedup.representatives(docs, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked in the texts; every document stays.

    Null and empty texts stay as they are, repeated rows are masked alike, overlapping
    finds become one mask, which settles ties.  A long text is searched whole, in time
    that grows with its length.  Other columns come back unchanged; an empty table stays empty.
    """
    small_batches(spark)
    return pii.mask_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document is packed into training sequences of token ids; one row a sequence.

    A null or empty text is its end token alone; repeated rows are packed as often as
    they come.  Of windows with equal room the one opened first is filled.  A long text is
    cut into pieces, none of its ids is lost.  Columns besides id and text are not read;
    an empty table gives no sequence.
    """
    return packing.sequences(docs)


STAGES = [
    ("language id", language_id),
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("personal data", personal_data),
    ("packing", packed),
]

#: Model training, hashing and token packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages; the tables that a stage wrote on its way are deleted when it ends."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        done = kept_alone(lambda: stage(spark, docs, sf_dir), name.replace(" ", "-"))  # noqa: B023
        discard(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
