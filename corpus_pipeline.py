"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's docs. All but the last return the columns of documents, of whatever
type, and need doc_id and text alone. A null text counts as an empty one, a row without an id is
a document of its own, and a table without rows gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm import contamination, jaccard, lines, packing, toxicity
from tallymark.llm.queries import SEQUENCE_TOKENS, WORD_VOCABULARY, table
from tallymark.llm.tokens import tokenizer_path
from tallymark.session import materialise


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels, doesn't reject. Repeated rows score
    alike."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that one with a smaller id holds; n_chars follows the text. All
    rows stay, emptied ones too; rows without an id neither lose lines nor take them."""
    cleaned = lines.dedup_lines(docs, counts=False)
    return cleaned.withColumns(
        {"n_chars": F.length("text").cast("long")} if "n_chars" in docs.columns else {})


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones, that with the smallest id. Of repeated rows and
    of texts without words that are the same, one stays."""
    return jaccard.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage; null and empty texts hold none."""
    return contamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their place in the training sequences. An empty text is its
    end id alone; repeated rows are packed each."""
    return packing.pack(docs, tokenizer_path(WORD_VOCABULARY), end_id=1,
                        capacity=SEQUENCE_TOKENS)


STAGES = [("toxicity", drop_toxic), ("line dedup", dedup_lines),
          ("n-gram Jaccard join", keep_one_of_each),
          ("benchmark decontamination", drop_contaminated), ("best-fit packing", pack)]

# A trained classifier and a tokenizer are no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
