"""From documents to training sequences: five stages, each written as Parquet and read again as the input of the next.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return
the columns of documents, and each works on all rows that the one before it kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vialect.llm import langid, line_dedup, ngram_join, packing, quality
from vialect.llm.common import table, written
from vialect.llm.queries import tokenizer


def _judged(docs: DataFrame, judge: Callable[[DataFrame, str], DataFrame], condition: str) -> DataFrame:
    """The rows of ``docs`` that ``judge`` gives columns for which the condition holds; no column of ``docs`` can clash with them."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    kept = judge(plain, f"c{docs.columns.index('text')}").filter(condition)
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the classifier, fitted on the labelled ones among them, predicts to be good.

    A null text counts as empty, equal texts are judged alike, and without any label all stay.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"), ~quality.held_out(F.col("doc_id")))
    return _judged(docs, lambda rows, text: quality.score(rows, model, text), "predicted = 1")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document with a letter, whatever its language: the nearest one learned is always named. Others are dropped.

    Null and empty texts have no letter. Where no language could be learned the letter alone decides.
    """
    model = langid.fit(docs.filter(~langid.held_out(F.col("doc_id"))))
    if not model.langs:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    return _judged(docs, lambda rows, text: langid.predict(rows, model, text), "lang_pred <> 'und'")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document, without the lines that a document of smaller id holds; n_chars follows the text.

    A null text stays null; rows of one id count as one document; rows without id come after all others.
    """
    kept = line_dedup.dedup_lines(docs).withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long"))
    return kept.select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each group of near duplicates.

    Of repeated rows one stays, and one of all texts without words; a row without id stays only if no row of its group has one.
    """
    return ngram_join.one_of_each(docs).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and the sequences that they are packed into; a null or empty text is its end id."""
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("language ID", language_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("packing", packing_stage),
]

#: The classifiers can't be expressed in SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; an empty table gives no rows, and columns beside the known ones are carried along."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
