"""Mixing to target weights: soft domain membership and document rates. SQL expressions only.

Method: the labelled rows define domains (toxic; else low or high by their quality). A classifier over text
statistics and words that tell the classes apart gives every document its posterior of each domain. Document rates
w >= 0 then minimise the least squares

    1/2 |r|^2 + RIDGE/2 sum_i t_i (w_i - 1)^2 / n,  r_k = sum_i w_i t_i p_ik / n - T_k

(t tokens, n all of them, p posteriors, T targets as shares). The second term is the least change from rate 1 among
rates that meet the targets, and the trade of both where targets are out of reach. The minimum is one projected gradient
step from w = 1, w_i = max(0, 1 - p_i l) with l = r / RIDGE, so the fit looks for the few numbers l: Newton steps on
the dual, each halved until the dual falls, from domain totals and the Gram matrix of documents with a rate. A pass is
one grouped sum over all documents; passes do not grow with their number.

Edge cases: null and empty texts have no tokens and rate 1; without labels all posteriors are the class shares 1/3;
targets are scaled to sum 1, those of domains that hold no token are ignored; an empty table gives no rows;
repeated rows are documents of their own with equal rates and copies, told apart from others of the same id or without
one by their text; very long texts are one row like others; other columns pass through ``sample`` only, whatever their
names.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import naive_bayes as NB
from . import textstats as S
from .common import Scratch, least_hashes

DOMAINS = ["high", "low", "toxic"]
TARGETS = {"high": 0.85, "low": 0.15, "toxic": 0.0}
#: Labelled rows that the choice of words reads (documented bound), and the least chi-square of a chosen word.
MAX_SAMPLE, CHANCE = 4000, 25.0
#: Weight of the change from rate 1; size of the dual's gradient, in shares of all tokens, that ends the fit; passes at most.
RIDGE, CLOSE, PASSES = 1e-4, 1e-6, 60
BINS = {"b_words": 16, "b_length": 32, "b_symbols": 16, "b_distinct": 16, "b_terms": 8}


def labelled(labels: DataFrame) -> DataFrame:
    """(doc_id, cls): one row a labelled document; any toxic label makes it toxic."""
    x = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("q"), F.col("toxic").cast("int").alias("t")).dropna()
    x = x.groupBy("doc_id").agg(F.max("t").alias("t"), F.min("q").alias("q"))
    return x.select("doc_id", F.when(F.col("t") > 0, "toxic").when(F.col("q") > 0, "high").otherwise("low").alias("cls"))


def terms(texts: DataFrame, classes: DataFrame) -> list[str]:
    """Words that set the toxic rows of a bounded, class-balanced hash sample apart, by chi-square of the classes' rows."""
    pick = least_hashes(classes.filter("cls = 'toxic'"), MAX_SAMPLE // 2, "terms", "doc_id").union(least_hashes(classes.filter("cls <> 'toxic'"), MAX_SAMPLE // 2, "terms", "doc_id"))
    rows = texts.join(F.broadcast(pick), "doc_id").select((F.col("cls") == "toxic").cast("double").alias("y"), "text")
    n1, n = (float(x or 0) for x in rows.agg(F.sum("y"), F.count("*")).first())
    n0 = n - n1
    if not n0 or not n1:
        return []
    words = rows.select("y", F.explode(F.array_distinct(S.words(F.lower("text")))).alias("word"))
    c = words.groupBy("word").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    a, b = F.col("a"), F.col("b")
    off = F.greatest(F.abs(a * (n0 - b) - b * (n1 - a)) - n / 2, F.lit(0.0))
    chi = n * off * off / F.greatest((a + b) * (n - a - b) * n0 * n1, F.lit(1.0))
    return sorted(r.word for r in c.filter((a / n1 > b / n0) & (chi >= CHANCE)).select("word").collect())


def posteriors(docs: DataFrame, labels: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, tokens, p_high, p_low, p_toxic) of every row."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = texts.withColumn("text_hash", F.xxhash64("text"))
    classes = scratch.keep(labelled(labels))
    chosen = terms(texts, classes)
    lex = F.array(*map(F.lit, chosen)) if chosen else F.array().cast("array<string>")
    t = F.col("text")
    of_words = S.let(S.words(F.lower(t)), lambda w: S.let(F.array_distinct(w), lambda s: F.struct(F.size(w).alias("n"), F.size(s).alias("d"), F.size(F.array_intersect(s, lex)).alias("x"))))
    rows = texts.select("doc_id", "text_hash", of_words.alias("w"), S.word_chars(t).alias("chars"), S.n_symbols(t).alias("symbols"))
    n = F.greatest(F.col("w.n"), F.lit(1))
    rows = rows.select(
        "doc_id",
        "text_hash",
        F.col("w.n").cast("long").alias("tokens"),
        NB.binned(F.log2(n), 16).alias("b_words"),
        NB.binned(F.col("chars") / n * 2, 32).alias("b_length"),
        NB.binned(F.sqrt(F.col("symbols") / F.greatest("chars", F.lit(1))) * 20, 16).alias("b_symbols"),
        NB.binned(F.col("w.d") / n * 15, 16).alias("b_distinct"),
        NB.binned(F.col("w.x"), 8).alias("b_terms"),
    )
    rows = scratch.keep(rows)
    logs, shares = NB.fit(rows.join(classes, "doc_id"), BINS, DOMAINS)
    ll = [(NB.log_likelihood(logs, d) + math.log(shares[d])).alias(f"l_{d}") for d in DOMAINS]
    x = rows.select("doc_id", "text_hash", "tokens", *ll)
    top = F.greatest(*(f"l_{d}" for d in DOMAINS))
    x = x.select("doc_id", "text_hash", "tokens", *(F.exp(F.col(f"l_{d}") - top).alias(f"e_{d}") for d in DOMAINS))
    total = sum((F.col(f"e_{d}") for d in DOMAINS[1:]), F.col(f"e_{DOMAINS[0]}"))
    return scratch.keep(x.select("doc_id", "text_hash", "tokens", *((F.col(f"e_{d}") / total).alias(f"p_{d}") for d in DOMAINS)))


def rate(dual: np.ndarray) -> Column:
    """Rate of a row under the dual numbers: a step from 1 down the posteriors, projected to 0 or more."""
    slope = sum((F.col(f"p_{d}") * float(v) for d, v in zip(DOMAINS[1:], dual[1:], strict=True)), F.col(f"p_{DOMAINS[0]}") * float(dual[0]))
    return F.when(F.col("tokens") > 0, F.greatest(F.lit(0.0), 1 - slope)).otherwise(1.0)


def sums(rows: DataFrame, dual: np.ndarray) -> tuple[float, np.ndarray, float, np.ndarray]:
    """One pass: all tokens, domain totals and the sum of squared rates, and the Gram matrix of rows with a rate."""
    k = len(DOMAINS)
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    x = rows.select("tokens", *(f"p_{d}" for d in DOMAINS), rate(dual).alias("w"))
    t, w, p = F.col("tokens"), F.col("w"), [F.col(f"p_{d}") for d in DOMAINS]
    got = x.agg(F.sum(t), F.sum(t * w * w), *(F.sum(w * t * v) for v in p), *(F.sum(F.when(w > 0, t * p[i] * p[j]).otherwise(0.0)) for i, j in pairs)).first()
    n, square, *rest = (float(v or 0) for v in got)
    gram = np.zeros((k, k))
    for (i, j), v in zip(pairs, rest[k:], strict=True):
        gram[i, j] = gram[j, i] = v
    return n, np.array(rest[:k]), square, gram


def fit_rates(rows: DataFrame, targets: dict[str, float]) -> DataFrame:
    """rows of posteriors with rate; expected domain totals match the targets as closely as rates of 0 or more can."""
    dual = np.zeros(len(DOMAINS))
    n, have, square, gram = sums(rows, dual)
    if n:
        want = np.array([max(targets.get(d, 0.0), 0.0) if h > 1e-9 * n else 0.0 for d, h in zip(DOMAINS, have, strict=True)])
        want /= want.sum() or 1.0
        value = lambda square, dual: square / n / 2 + want @ dual + RIDGE / 2 * dual @ dual
        slope = want + RIDGE * dual - have / n
        passes = 1
        while np.abs(slope).max() > CLOSE and passes < PASSES:
            step = -np.linalg.solve(gram / n + RIDGE * np.eye(len(dual)), slope)
            size, now = 1.0, None
            while passes < PASSES:
                _, have, new_square, gram_there = sums(rows, dual + size * step)
                passes += 1
                if value(new_square, dual + size * step) <= value(square, dual) + 1e-4 * size * slope @ step:
                    now = dual + size * step
                    break
                size /= 2
            if now is None:
                break
            dual, square, gram = now, new_square, gram_there
            slope = want + RIDGE * dual - have / n
    return rows.withColumn("rate", rate(dual))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, **cols: str) -> DataFrame:
    """(doc_id, text_hash, tokens, p_high, p_low, p_toxic, rate, copies): copies is the rate rounded by a hash of id and text."""
    rows = fit_rates(posteriors(docs, labels, Scratch(docs.sparkSession, "mixing"), **cols), targets or TARGETS)
    u = F.pmod(F.xxhash64("doc_id", "text_hash", F.lit("mix")), F.lit(2**24)) / 2**24
    return rows.select("*", F.floor(F.col("rate") + u).cast("long").alias("copies"))


def sample(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """docs, each row as often as its copies say; columns as in docs. Rows are matched by id and text, which decide their copies."""
    got = mix(docs, labels, targets).groupBy(F.col("doc_id").alias("id"), "text_hash").agg(F.max("copies").alias("n")).filter("n > 0")
    x = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("of"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("of_text"))
    x = x.join(got, F.col("of").eqNullSafe(F.col("id")) & (F.col("of_text") == F.col("text_hash")))
    return x.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).select("row.*")
