"""A training corpus from raw documents: five stages, each written and read again as the next one's input.

Edge cases, stage by stage: null texts count as empty and pass the first four stages like other clean documents (as do
empty texts, which link with nothing); null ids are documents of their own, told apart by their text; of rows that
repeat an id and its text one stays in the MinHash stage; extra columns, whatever their names, pass all but the last stage, which
returns its own; very long texts are read whole; of ties the smallest id is kept; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slidespark.llm import bpe, minhash_dedup, mixing, suffix_dedup, toxicity
from slidespark.llm.common import Scratch, ready, table
from slidespark.llm.queries import vocabulary


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go; neighbours are found among labelled documents of the input."""
    ready(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), F.col("text").alias("body"))
    kept = toxicity.score(rows, model, "id", "body", extra=("row",)).filter("score < 0.5")
    return kept.select("row.*")


def minhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: 5-word shingles, similarity 0.8 or more.

    Of rows that repeat an id and its text one stays, the least; rows without an id are told apart by their text."""
    ready(spark)
    no_id = F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND(2**62 - 1).bitwiseOR(2**62)  # above ids, so that a row with an id is kept rather
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), no_id).alias("key"), F.col("text"), F.struct(*docs.columns).alias("row"))
    gone = minhash_dedup.near_duplicates(rows, k=5, percent=80, id_col="key").filter("not kept").select(F.col("doc_id").alias("key")).distinct()
    left = rows.join(gone, "key", "left_anti")
    # rows of a group have the same id and text; maps have no order and count as their text
    rest = [f for f in docs.schema.fields if f.name not in ("doc_id", "text")]
    place = F.struct(F.lit(0), *(F.to_json(F.struct(f"row.{f.name}")) if any(k in f.dataType.simpleString() for k in ("map<", "variant")) else F.col(f"row.{f.name}") for f in rest))
    return left.groupBy("key", F.sha2("text", 256).alias("sha")).agg(F.min_by("row", place).alias("row")).select("row.*")


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes or more that repeat are cut out of the texts."""
    ready(spark)
    x = suffix_dedup.dedup_texts(docs, 200)
    return x.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its fitted rate says."""
    ready(spark)
    return mixing.sample(docs, table(spark, sf_dir, "labels"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of every text."""
    ready(spark)
    x = bpe.encode_decode(docs, vocabulary())
    return x.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [("toxicity", toxicity_stage), ("minhash_dedup", minhash_stage), ("suffix_dedup", suffix_stage), ("mixing", mixing_stage), ("bpe", bpe_stage)]

#: No SQL: nearest neighbours, similarity joins and BPE are beyond it; tests/llm/test_pipeline_stages.py holds every stage against plain Python on a small corpus.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
