"""From raw documents to packed training sequences: five stages, each over all rows its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. What
a stage returns is written as Parquet in the shared folder and read again as the next one's docs.

Defined results: documents without words (null, empty, blank texts) are rejected by the first stage; a row with a null
id passes the later ones; rows of one doc_id share what their stage decides; an empty
table gives no sequences; other columns are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemspark.llm import decontaminate, near, packing, rules, substrings
from stemspark.llm.queries import END_ID, tokenizer_path
from stemspark.llm.store import free_name, kept, table


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without the rows of some doc_ids; rows with a null id stay."""
    return docs.join(ids.select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without the lines that too many documents of their host share."""
    return rules.clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the least doc_id."""
    return _without(docs, near.near_duplicates(docs).where(~F.col("kept")))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier document holds; documents of which no word stays go."""
    found = substrings.dedup(docs, as_text=True).where("n_removed > 0")
    id_, left = free_name(docs, "id"), free_name(docs, "left")
    changed = found.groupBy(F.col("doc_id").alias(id_)).agg(F.min_by("out", "n_removed").alias(left))
    joined = docs.join(changed, docs["doc_id"] == F.col(id_), "left").where(F.col(id_).isNull() | (F.col(left) != ""))
    text = F.when(F.col(id_).isNull(), F.col("text")).otherwise(F.col(left))
    n_chars = F.when(F.col(id_).isNull(), F.col("n_chars")).otherwise(F.length(left))
    return joined.withColumns({"text": text, "n_chars": n_chars.cast("long")}).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by benchmark items."""
    judged = decontaminate.judge(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, judged.where("contaminated"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of every document's pieces in sequences of tokens."""
    return packing.pack_documents(docs, tokenizer_path(), END_ID)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can't encode texts; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = kept(docs, name)
    return docs
