"""The registered queries of this subpackage, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embedding_dedup, html_text, lm, merkle, minhash_dedup, mixing, quality_rules, ranked_search, site_quality, suffix_dedup, toxicity, url_filter
from .common import Scratch, held_out, ready, table


def vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    x = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), vocabulary()), vocabulary())
    n = (F.octet_length("ids") / 4).cast("long")
    return x.select("doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return lm.score(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return site_quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return suffix_dedup.dedup_digest(table(spark, sf_dir, "documents"), 200)


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    docs = table(spark, sf_dir, "documents")
    x = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return x.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "neighbours")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return html_text.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    x = quality_rules.apply(table(spark, sf_dir, "documents"))
    return x.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2")


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), 0.98)


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    scratch = Scratch(spark, "merkle")
    docs = table(spark, sf_dir, "documents")
    digest = lambda n: merkle.leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text"))
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    n = F.col("n_chars").cast("long")
    leaves = docs.select(merkle.group_key(F.col("lang")).alias("grp"), F.col("doc_id").cast("long").alias("doc_id"), digest(n).alias("digest"), F.when(tampered, digest(n + 1)).alias("altered"))
    trees = merkle.Manifest(scratch)
    trees.append(merkle.positions(scratch.keep(leaves), ["doc_id", "digest"], scratch))
    x = merkle.check(merkle.manifest(trees).withColumn("shown", F.coalesce("altered", "digest")))
    return x.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", F.col("proof").alias("proof_sha256"), F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    scratch = Scratch(spark, "search")
    index = ranked_search.build(table(spark, sf_dir, "documents"), scratch)
    return ranked_search.search(index, table(spark, sf_dir, "benchmark"), 20, scratch)


#: The rules of the query, as a verdict, a host and a path.
RULES = [url_filter.Rule("block", "net", "/"), url_filter.Rule("allow", "example.net", "/en/"), url_filter.Rule("block", "example.com", "/de/"), url_filter.Rule("allow", "org", "/fr/")]


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    x = url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), RULES, Scratch(spark, "urls"))
    return x.select("page_id", "host", "path", "rule", "verdict", F.round("p_block", 9).alias("p_block"))


QUERIES = {f.__name__: f for f in (op1_bpe, op2_lm_scoring, op3_mixing, op4_quality_classifier, op5_suffix_dedup, op6_minhash_dedup, op7_toxicity, op8_html_extraction, op9_quality_rules, op10_embedding_dedup, op11_merkle, op12_ranked_search, op13_url_filter)}

ORACLE_SQL: dict[str, str] = {"op11_merkle": merkle.SQL, "op12_ranked_search": ranked_search.SQL}
