"""Quality by hierarchical empirical Bayes. SQL expressions only.

Method: a classifier over text statistics, fitted on the labelled train rows, gives each document its evidence (a
log likelihood ratio). Hosts and paths gather the posteriors of their documents (the label itself for train rows)
as soft counts. A host's share of good documents is shrunk towards the corpus, a path's towards its host, by
pseudo-counts that the spread between sites determines (method of moments). A document's posterior joins its
evidence with its path's share, its own count left out.

Sites are grouped sums with map-side combining; their figures are joined back by the site's key.

Edge cases: null hosts and paths are sites of their own; a site of one document has its parent's share; without
labels the evidence is 0 and all scores are 0.5; null and empty texts are scored from their statistics; repeated
rows are documents of their own; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import naive_bayes as NB
from . import quality_rules as R
from .common import Scratch, held_out

BINS = {"b_words": 16, "b_length": 32, "b_symbols": 16, "b_lines": 16, "b_repeat": 16}
MIN_PSEUDO, MAX_PSEUDO = 2.0, 1000.0


def _shrink(sites: DataFrame, keys: list[str], parent: str, name: str) -> DataFrame:
    """sites (keys, n, k, parent share) with name, the shrunk share, and pseudo, the pseudo-counts used.

    The spread between sites beyond that of counts gives the pseudo-counts: one row over all sites."""
    m, n = F.col("k") / F.col("n"), F.col("n")
    spread = sites.agg(
        (F.sum(n * (m - F.col(parent)) ** 2) / F.sum(n)).alias("_v"), (F.sum(F.col(parent) * (1 - F.col(parent))) / F.sum(n)).alias("_w"), F.avg(F.col(parent) * (1 - F.col(parent))).alias("_p")
    )
    between = F.greatest(F.col("_v") - F.col("_w"), F.lit(1e-6))
    pseudo = F.least(F.greatest(F.col("_p") / between - 1, F.lit(MIN_PSEUDO)), F.lit(MAX_PSEUDO))
    x = sites.crossJoin(F.broadcast(spread)).withColumn("pseudo", pseudo)  # spread is one row
    return x.withColumn(name, (F.col("k") + F.col("pseudo") * F.col(parent)) / (n + F.col("pseudo"))).drop("_v", "_w", "_p")


def score(docs: DataFrame, labels: DataFrame, host_col: str = "source", path_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, evidence, host_share, path_share, score, kept) of every document."""
    scratch = Scratch(docs.sparkSession, "site-quality")
    stats = R.statistics(docs, id_col, text_col, path_col, host_col)
    n = F.greatest("n_words", F.lit(1))
    rows = stats.select(
        "doc_id",
        F.col("source").alias("host"),
        F.col("lang").alias("path"),
        NB.binned(F.log2(n), 16).alias("b_words"),
        NB.binned(F.col("word_chars") / n * 2, 32).alias("b_length"),
        NB.binned(F.sqrt(F.col("n_symbols") / F.greatest("word_chars", F.lit(1))) * 20, 16).alias("b_symbols"),
        NB.binned(F.sqrt(F.col("n_dup_lines") / n) * 20, 16).alias("b_lines"),
        NB.binned(F.sqrt(F.col("n_repeat_words") / n) * 15, 16).alias("b_repeat"),
    )
    rows = scratch.keep(rows)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("q")).dropna().filter(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.min("q") > 0).cast("double").alias("q"))
    logs, shares = NB.fit(rows.join(known, "doc_id").withColumn("cls", F.when(F.col("q") > 0, "good").otherwise("bad")), BINS, ["good", "bad"])
    prior = math.log(shares["good"] / shares["bad"])
    evidence = (NB.log_likelihood(logs, "good") - NB.log_likelihood(logs, "bad")).alias("evidence")
    x = rows.join(known, "doc_id", "left").select("doc_id", "host", "path", "q", evidence)
    x = scratch.keep(x.select("doc_id", "host", "path", "evidence", F.coalesce("q", 1 / (1 + F.exp(-(F.col("evidence") + prior)))).alias("p")))
    paths = x.groupBy("host", "path").agg(F.count("*").cast("double").alias("n"), F.sum("p").alias("k"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    corpus = hosts.agg((F.sum("k") / F.sum("n")).alias("corpus"))
    hosts = _shrink(hosts.crossJoin(F.broadcast(corpus)), ["host"], "corpus", "host_share").select("host", "host_share")
    paths = scratch.keep(_shrink(paths.join(hosts, "host"), ["host", "path"], "host_share", "path_share"))
    y = x.join(paths, ["host", "path"])
    own = (F.col("k") - F.col("p") + F.col("pseudo") * F.col("host_share")) / (F.col("n") - 1 + F.col("pseudo"))
    own = F.least(F.greatest(own, F.lit(1e-6)), F.lit(1 - 1e-6))
    y = y.withColumn("score", 1 / (1 + F.exp(-(F.col("evidence") + F.log(own / (1 - own))))))
    return y.select("doc_id", "evidence", "host_share", "path_share", "score", (F.col("score") >= 0.5).alias("kept"))
