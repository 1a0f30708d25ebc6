"""Corpus cleaning as a chain of stages over documents.

Each stage gets what its predecessor kept, written as Parquet and read again. Documents that are predicted toxic go; of
each group of near copies (five-word shingles, similarity 0.8 or more) one stays; documents that hold a benchmark item go;
secrets are replaced by a mark; what is left is encoded and decoded. All stages but the last return the columns of
documents, with n_chars following the text.

Defined cases: rows with a null or empty text are kept by every stage (they hold nothing to reject) and have no tokens;
rows without doc_id, and rows that share one, are judged each by its own text; further columns are kept, whatever their
names; an empty table passes through.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm import common
from panelforge.llm.bpe import bpe_digests
from panelforge.llm.decontamination import contaminated
from panelforge.llm.ngram_jaccard import jaccard_components
from panelforge.llm.secret_scan import redacted
from panelforge.llm.toxicity import without_toxic

#: Words of a shingle, and the least similarity in percent, of near copies.
SHINGLE, PERCENT = 5, 80


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that are predicted toxic; the score learns from the labels of the table beside documents."""
    return without_toxic(docs, common.table(spark, sf_dir, "labels"))


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a column that tells rows apart, and its name.

    It is doc_id where a row has its own. Rows without an id, and rows that share one, are numbered above all ids in a
    stored copy, so that each is judged by its own text.
    """
    row = "row"
    while row in {c.lower() for c in docs.columns}:
        row = "_" + row
    id_ = F.col("doc_id").cast("long")
    rows, ids, top = docs.agg(F.count(F.lit(1)), F.count_distinct("doc_id"), F.max(id_)).first()
    if rows == ids:
        return docs.withColumn(row, id_), row
    shared = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias(f"{row}s")).filter(F.col(f"{row}s") > 1)
    above = F.lit(max(top or 0, 0) + 1) + F.monotonically_increasing_id()
    told = docs.join(shared, "doc_id", "left").withColumn(row, F.when(F.col("doc_id").isNull() | F.col(f"{row}s").isNotNull(), above).otherwise(id_))
    return common.stored(told.select(*docs.columns, row), "numbered-rows"), row


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id (rows without an id, or with a shared one, come after those)."""
    rows, row = numbered(docs)
    groups = jaccard_components(rows.select(F.col(row).alias("doc_id"), "text"), SHINGLE, PERCENT)
    gone = common.small_side(groups.filter("doc_id <> component_id").select(F.col("doc_id").alias(row)), "near-copies")
    return rows.join(gone, row, "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a benchmark item, edited or not."""
    rows, row = numbered(docs)
    held = contaminated(rows.select(F.col(row).alias("doc_id"), "text"), common.table(spark, sf_dir, "benchmark"))
    return rows.join(common.small_side(held.select(F.col("doc_id").alias(row)).distinct(), "contaminated"), row, "left_anti").select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets replaced by a mark."""
    cleaned = redacted(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        cleaned = cleaned.withColumn("n_chars", F.when(F.col("text").contains("[secret]"), F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return cleaned.select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document the number and digest of its token ids, and the digest of the text they decode to."""
    return bpe_digests(docs, common.tokenizer_file("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("ngram_jaccard", near_copies),
    ("decontamination", decontamination),
    ("secret_scan", secrets),
    ("bpe", encoding),
]

#: The first stage learns a model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    path = f"{common.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
