"""From raw documents to token ids: quality, near-duplicates, benchmark passages, personal data, encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the
columns of docs. Stages read what else they need (labels, benchmark) from sf_dir.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumagrid.llm.bpe import encode_documents
from lumagrid.llm.decontamination import decontaminate
from lumagrid.llm.disclosure import sanitise
from lumagrid.llm.ngram_join import first_of_each
from lumagrid.llm.quality import keep_good
from lumagrid.llm.queries import tokenizer_path
from lumagrid.llm.shared import scratch, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents stays: the one with the least id."""
    return first_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Values and disclosing terms become placeholders."""
    return sanitise(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the text that the ids decode to."""
    return encode_documents(docs, tokenizer_path(), decode=True)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("personal_data", personal_data), ("encoding", encoding)]

#: Perplexities and token ids are beyond SQL: tests/llm holds each stage against a plain version of its operator.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written before the next one reads it; what a stage wrote for itself is deleted then."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            docs = keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
