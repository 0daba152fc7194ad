"""The corpus pipeline: quality rules, near-duplicates, decontamination, mixing and token files over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kinfold.llm import decontam, mixing, neardup, quality, shared, tokenids

#: Shares of the corpus that mixing keeps here.
KEEP = 0.8


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base or a learned rule rejects go; null and empty texts fail the base. Rows are judged one by one."""
    return quality.kept(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the smallest doc_id; groups are those of five-word shingles with a similarity of 0.8.

    Texts without words and rows without doc_id stay. Rows that agree in doc_id and text are one document and stay or go together; of
    rows that agree in doc_id alone each is judged by its text.
    """
    found = neardup.near_duplicates(docs, neardup.Params(words=5)).where("not kept").select("doc_id", "text_hash").distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"))
    return rows.join(found, (F.col("id") == F.col("doc_id")) & (F.col("hash") == F.col("text_hash")), "left_anti").select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a stretch of a benchmark item go."""
    return decontam.clean(docs, _table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample by probabilities that bring sources, languages and topics nearer to each other."""
    return mixing.sample(docs, keep=KEEP)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the documents' token ids, read back from the files."""
    import public_tokenizers

    return tokenids.write_and_read(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixture),
    ("token files", token_files),
]

#: Learned rules, sketches and tokenizers aren't SQL; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, one after the other; what a stage returns is written as Parquet and read again by the next."""
    tables = shared.Tables(spark)
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = tables.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
