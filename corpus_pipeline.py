"""The corpus pipeline: stages that each work on all that the one before kept.

Toxicity drops the documents that it rejects; SimHash leaves one document of each group of
near copies (five-word shingles, exact similarity of 0.8 or more); substring dedup cuts passages that an earlier document has; PII masks
personal data; packing lays the documents' tokens into sequences. The learned first stage
and the tokenizer have no form in SQL, so there is no oracle; tests hold each stage
against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm import alike, lz_dedup, packing, pii, toxicity
from memlake.llm.common import shared_folder, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ORACLE_SQL = None


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_civil(docs, table(spark, sf_dir, "labels"))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return alike.keep_one(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = lz_dedup.lz_dedup(docs)
    text = F.when(F.col("row.__null_text"), F.lit(None)).otherwise(F.col("kept"))
    rest = {c: F.col(f"row.`{c}`") for c in docs.columns if c not in ("doc_id", "text")}
    changed = F.col("n_removed") > 0
    cols = {"doc_id": F.col("id"), "text": text} | rest | ({"n_chars": F.when(changed, F.length("kept").cast("long")).otherwise(rest["n_chars"])} if "n_chars" in rest else {})
    return out.select(*[cols[c].alias(c) for c in docs.columns])


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pii.mask(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash_near_dedup", simhash_stage),
    ("substring_dedup", substring_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`; each stage's result is written and read again."""
    import uuid

    docs = table(spark, sf_dir, "documents")
    folder = shared_folder(spark)
    run_id = uuid.uuid4().hex
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = f"{folder}/pipeline-{run_id}/{i}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
