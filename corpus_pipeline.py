"""A training corpus in stages; each takes documents and returns those that the next one works on.

Defined results, beside those that each operator states: null or empty texts are documents without
words, which the classifiers judge like others and near-dedup keeps; rows without an id stay through
near-dedup.  Equal rows are one document after near-dedup; rows of the same id with unlike texts stay
apart, and of rows with equal id and text the least one in the order of all columns stays.  Texts of any
length are judged whole.  An empty table passes all stages.  Other columns, whatever their names,
are handed on until the last stage, whose rows are pieces of packed sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeops.llm import cotraining, mixing, neardup, packing, toxicity
from lakeops.operators import ordered
from lakeops.session import scratch_path, settle, tune

TOKENIZER = "word_bpe_49k.json"
LABELS = "{}/labels.parquet"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(LABELS.format(sf_dir))
    return toxicity.clean(docs, toxicity.fit(docs, labels))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(LABELS.format(sf_dir))
    return cotraining.good(docs, cotraining.fit(docs, labels))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document per group: the one of the smallest id; rows without an id stay.

    Rows of one id with unlike texts are documents of their own, in the order of a hash of their
    texts; equal rows are one document.
    """
    named = docs.where("doc_id IS NOT NULL")
    mark = F.xxhash64(F.coalesce("text", F.lit("")))
    repeated = named.groupBy("doc_id").agg(F.min(mark).alias("a"), F.max(mark).alias("b")).where("a <> b")
    if not repeated.isEmpty():
        places = ordered.row_numbers(named.select("doc_id", mark.alias("mark")).distinct(), [], ["doc_id", "mark"], "place")
        keyed = named.select(F.struct(*docs.columns).alias("row"), "doc_id", mark.alias("mark"), "text")
        rows = settle(keyed.join(places, ["doc_id", "mark"]).select("row", F.col("place").alias("doc_id"), "text"), "pipeline-rows")
    else:
        rows = named.select(F.struct(*docs.columns).alias("row"), "doc_id", "text")
    kept = neardup.group(rows, width=5).where("kept").select("doc_id").distinct()
    first = rows.join(kept, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("row").alias("row")).select("row.*")
    return first.unionByName(docs.where("doc_id IS NULL")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_classifier", drop_low_quality),
    ("minhash_near_dedup", drop_near_copies),
    ("weighted_mix", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: The stages hold trained models and a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written as Parquet and read again."""
    tune(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
