"""Gene annotations: records, aliases and descriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach_summaries(records: DataFrame, summaries: DataFrame) -> DataFrame:
    """Records (gene_id, ..) with the non-empty summaries of their gene in file order; summaries (line, gene_id, summary)."""
    s = summaries.filter(F.trim("summary") != "").groupBy("gene_id").agg(F.array_sort(F.collect_list(F.struct("line", "summary"))).alias("s"))
    x = records.join(s, "gene_id", "left")
    return x.withColumn("summaries", F.coalesce(F.transform("s", lambda r: r["summary"]), F.array().cast("array<string>"))).drop("s")


def resolve_aliases(genes: DataFrame) -> DataFrame:
    """Alias -> symbol; genes (ord, symbol, synonyms array). A symbol's first record wins; an alias that is a symbol is ignored."""
    first = genes.groupBy("symbol").agg(F.min_by("synonyms", "ord").alias("synonyms"), F.min("ord").alias("ord"))
    a = first.select(F.explode("synonyms").alias("alias"), "symbol", "ord")
    a = a.join(first.select(F.col("symbol").alias("alias")), "alias", "left_anti")
    return a.groupBy("alias").agg(F.min_by("symbol", F.struct("ord", "symbol")).alias("symbol"))


def gene_text(genes: DataFrame) -> DataFrame:
    """(gene_id, text): symbol, name, sorted aliases but the own symbol (64 at most), other names (512 characters), summaries.

    genes (gene_id, symbol, name, synonyms, designations, summaries)."""
    alias = F.slice(F.array_sort(F.array_distinct(F.filter("synonyms", lambda a: a != F.upper("symbol")))), 1, 64)
    part = lambda head, body: F.when(body != "", F.concat(F.lit(head), body, F.lit(".")))
    return genes.select(
        "gene_id",
        F.concat_ws(
            " ",
            part("Gene symbol: ", F.col("symbol")),
            part("Name: ", F.coalesce("name", F.lit(""))),
            part("Aliases: ", F.concat_ws(", ", alias)),
            part("Other designations: ", F.substring(F.coalesce("designations", F.lit("")), 1, 512)),
            F.when(F.size("summaries") > 0, F.concat(F.lit("Summary: "), F.concat_ws(" ", "summaries"))),
        ).alias("text"),
    )

