"""The corpus pipeline: stages over the documents table, each stored before the next one reads it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.llm.decontaminate import LEAST, clean
from creditloom.llm.files import run_folder
from creditloom.llm.language import identify
from creditloom.llm.mixing import mix
from creditloom.llm.queries import token_file_digests
from creditloom.llm.simhash import similar_groups
from creditloom.operators.sizing import settle

DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]
WORST_RATE = 8.0


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID. Rejected are texts without a letter, and texts that the closest language codes
    worse than plain bytes would be (more than 8 bits per symbol). Rows are judged one by one."""
    judged = identify(docs, keep_row=True)
    return judged.where((F.col("lang_pred") != "und") & (F.col("rate") <= WORST_RATE)).select("row.*").select(*DOCUMENTS)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-duplicates by SimHash of five-word shingles at a similarity of 0.8 or more; the smallest
    id of a group stays, of rows that share it the text with the smallest hash, of rows that share the
    text too the least by all columns. Rows of one id whose texts are in different groups all stay, as
    do rows without an id."""
    key = ["doc_id", "text_hash"]
    firsts = similar_groups(docs).where("doc_id = component_id and text_hash = component_hash").select(*key).distinct()
    hashed = docs.select(*DOCUMENTS, F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    kept = hashed.join(firsts, key, "left_semi").groupBy(*key).agg(F.min(F.struct(*DOCUMENTS)).alias("row")).select("row.*")
    return kept.union(docs.where("doc_id is null").select(*DOCUMENTS)).select(*DOCUMENTS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat 13 words or more of a benchmark item, up to a fifth of them changed, go. Items
    of fewer than 13 words take no document; items without an id do."""
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), shortest=LEAST).select(*DOCUMENTS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as its source's target asks for: not at all, once or twice. Rows
    without an id and rows that share one are documents of their own, told apart by hashes of all
    their columns; rows equal in all columns are as good as each other and get the sum of their copies."""
    nulls = [F.col(c).isNull() for c in DOCUMENTS]
    keyed = docs.select(*DOCUMENTS, F.xxhash64(*DOCUMENTS, *nulls).alias("_k"), F.xxhash64(F.lit(1), *DOCUMENTS, *nulls).alias("_l"))
    key = ["_k", "_l"]
    copies = settle(mix(keyed, keep=key).groupBy(*key).agg(F.sum("copies").alias("copies"), F.count("*").alias("_rows")).where("copies > 0"))
    once = keyed.join(copies.where("_rows = 1"), key)
    again = keyed.join(copies.where("_rows > 1"), key).dropDuplicates(key)
    return once.unionByName(again).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*DOCUMENTS)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in seekable shards; the rows tell what reading them back gives."""
    return token_file_digests(docs, run_folder(spark, "pipeline-tokens"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", keep_known_languages),
    ("simhash_near_dedup", keep_one_of_each_group),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mixing", mix_sources),
    ("token_files", write_token_files),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result is written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
