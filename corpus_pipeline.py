"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm import decontaminate, language, lines, packing
from tempora.llm.common import fresh, quoted, table, written
from tempora.llm.jaccard import linked_documents

#: Documents of which less is like their language go. Noise in other letters scores about 0; on
#: the test tables no document in a learned language, however short or mixed, is below 0.35.
LEAST_SCORE = 0.1


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any letter, and those that are like no language that is learned, go."""
    model = language.profiles(language.training_rows(docs))
    lang, score = fresh(docs.columns, "lang_pred"), fresh(docs.columns, "score")
    found = language.predict(docs, model, docs.columns, (lang, score))
    return found.where((F.col(lang) != "und") & (F.col(score) >= LEAST_SCORE)).select(*quoted(docs.columns))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of lines that are copies or near copies of each other the first stays.

    A document of which no text is left, as all of its lines stand in others, goes; one that
    was empty before stays.
    """
    before = fresh(docs.columns, "before")
    kept = lines.without_repeats(spark, docs.withColumn(before, F.coalesce(F.length(F.trim("text")), F.lit(0))))
    return kept.where((F.col(before) == 0) | (F.length(F.trim("text")) > 0)).select(*quoted(docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least doc_id stays.

    Rows that repeat its doc_id and its text go as well. Rows without a doc_id can't be told
    apart by it: of those with equal texts one stays, whatever they are linked with.
    """
    first = linked_documents(spark, docs).where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    kept = docs.join(first, "doc_id", "left_semi").select(*quoted(docs.columns)).unionByName(docs.where("doc_id is null"))
    others, row, digest = [c for c in docs.columns if c != "doc_id"], fresh(docs.columns, "row"), fresh(docs.columns, "digest")
    once = kept.groupBy("doc_id", F.sha2("text", 256).alias(digest)).agg(F.first(F.struct(*quoted(others))).alias(row))
    return once.select("doc_id", f"{row}.*").select(*quoted(docs.columns))


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with windows of two or more benchmark items go; of one item, the words that were hit."""
    return decontaminate.decontaminated(spark, docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, packing.vocabulary_path())


STAGES = [
    ("language ID", identify_language),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", decontaminate_benchmark),
    ("packing", pack_sequences),
]

#: Profiles and vocabularies can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(spark, stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
