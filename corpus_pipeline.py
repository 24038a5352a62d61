"""The corpus pipeline: language ID, toxicity, near-duplicates and packing over `documents`.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs. All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm import jaccard, langid, packing, toxicity
from loomline.llm.common import bounded, documents, materialise, unused

#: The stages train and pack; SQL can't express them. The tests hold them against brute force.
ORACLE_SQL = None

TOXIC_FROM = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language; those that no model explains, or without letters, go, and so do null texts. Rows are judged one by one, so repeated ones fare alike; other columns stay, and an empty table stays empty."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    return langid.keep_identified(docs, langid.train(docs, fold != 0))


def toxic_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't take for toxic. Null and empty texts are scored like any other and repeated rows fare alike; other columns stay, and an empty table stays empty."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_below(docs, toxicity.train(docs, labels, toxicity.fold(F.col("doc_id"), 4) != 2), TOXIC_FROM)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least doc_id.

    Texts that are null or without words are linked with nothing and stay. Rows without
    an id can't be told apart by one and stay; of rows that share an id, those of equal
    text stay once, and only the linked ones go. An empty table stays empty. Other
    columns are kept as they are, whatever their names.
    """
    row_id, own, gone_set = unused(docs, "_id", "_set", "_gone")
    linked = materialise(jaccard.link_components(docs, "set"))
    goes = "n_shingles > 0 AND doc_id IS NOT NULL AND NOT component_id <=> doc_id"
    gone_sets = materialise(linked.filter(goes).select(F.col("doc_id").alias(row_id), F.col("set").alias(gone_set)).distinct())
    twice = materialise(linked.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias(row_id)))
    among = lambda df, ids, how: df.join(bounded(ids), df["doc_id"] == ids[row_id], how)
    if twice.isEmpty():
        return among(docs, gone_sets, "left_anti")
    # ids of several rows: an id and a set name the rows to drop; here alone the sets are computed again
    shared = jaccard.with_sets(among(docs, twice, "left_semi"), own)
    gone = bounded(gone_sets)
    shared = shared.join(gone, (shared["doc_id"] == gone[row_id]) & (shared[own] == gone[gone_set]), "left_anti").drop(own).dropDuplicates(["doc_id", "text"])
    return among(among(docs, twice, "left_anti"), gone_sets, "left_anti").unionByName(shared)


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packing of what is left: each row's pieces, also of null texts (one of length 0) and of rows without an id or a source; other columns are not carried, and an empty table gives none."""
    return packing.pack_documents(docs)


STAGES = [("language_id", language_id), ("toxicity", toxic_text), ("ngram_jaccard", near_duplicates), ("best_fit_packing", best_fit)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
