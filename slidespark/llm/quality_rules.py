"""Quality rules: base rules, then robust multivariate outliers. SQL expressions only.

Method: for every language and source, the minimum covariance determinant of a vector of transformed statistics
is approached by concentration steps from several starts, the medians and rows by least hash: means and covariances
of the half of rows that lie nearest are taken again and again; after two steps the start of the least determinant
goes on until no group's determinant falls any more. Rows that tie at the half's edge count by an equal part, so
copies cannot fill it beyond its size. Rows whose Mahalanobis distance passes a fixed
chi-square quantile are rejected. Sparse groups are shrunk towards all rows of the corpus.

Scale: rows are read once for their statistics, which are written; every step is then one pass over seven small
numbers a row with grouped sums (map-side combined). Quantiles come from counts of fixed bins, so no group is
collected; a group's figures are joined back by the group's key: those of the largest groups are broadcast, at most
HOT of them, and the others are shuffled.

Edge cases: null texts count as empty (base_failed); null language or source is a group of its own; groups of one
row use the corpus figures; an empty table gives no rows; repeated rows count as rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textstats as S
from .common import Scratch, hot_join

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Share of rows in the concentrated subset, its consistency factor for 5 dimensions, and the chi-square cut-off (5 dimensions, 1 - 1e-6).
SUBSET, CONSISTENCY, CUTOFF = 0.5, 1.91, 35.9
#: Starts of every group, concentration steps of all of them, and the fall of a log determinant that asks for another step.
STARTS, STEPS, FALL = 5, 2, 0.01
#: Rows' worth of corpus figures that a group is shrunk by, and the least variance of each statistic.
SHRINK = 25.0
FEATURES = ("f_words", "f_length", "f_symbols", "f_lines", "f_repeat")
FLOOR = {"f_words": 0.5, "f_length": 0.03, "f_symbols": 0.04, "f_lines": 0.05, "f_repeat": 0.1}
KEYS = ["lang", "source"]


def site(name: str) -> Column:
    """The name of a group: null is a group of its own, apart from the empty name."""
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit(""))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        site(lang_col).alias("lang"),
        site(source_col).alias("source"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    t = F.col("text")
    of_words = S.let(S.words(t), lambda w: F.struct(F.size(w).cast("long").alias("n"), S.n_repeat_words(w).alias("r")))
    rows = rows.select("doc_id", *KEYS, of_words.alias("w"), S.word_chars(t).alias("word_chars"), S.n_symbols(t).alias("n_symbols"), S.n_dup_lines(t).alias("n_dup_lines"))
    n, r = F.col("w.n"), F.col("w.r")
    failed = (n < MIN_WORDS) | (100 * r > MAX_REPEAT_PERCENT * n)
    return rows.select("doc_id", *KEYS, n.alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", r.alias("n_repeat_words"), failed.alias("base_failed"))


def transformed() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [
        F.log1p(F.col("n_words").cast("double")).alias("f_words"),
        F.log1p(F.col("word_chars") / n).alias("f_length"),
        F.sqrt(F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))).alias("f_symbols"),
        F.sqrt(F.col("n_dup_lines") / n).alias("f_lines"),
        F.sqrt(F.col("n_repeat_words") / n).alias("f_repeat"),
    ]


def quantile(rows: DataFrame, keys: list[str], value: Column, share: float, name: str) -> DataFrame:
    """(keys, name): upper edge of the bin in which the share of rows is reached; counts only, whatever the group's size."""
    bins = rows.select(*keys, value.alias("_b")).groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    w = W.partitionBy(*keys)
    run = bins.withColumn("_c", F.sum("_n").over(w.orderBy("_b"))).withColumn("_t", F.sum("_n").over(w))
    return run.filter(F.col("_c") >= share * F.col("_t")).groupBy(*keys).agg(F.min("_b").alias(name))


def nearest(rows: DataFrame, keys: list[str], value: Column, share: float, scratch: Scratch) -> DataFrame:
    """The share of rows of least value with their weight: 1, but at the cut an equal part for each of the rows that tie."""
    bins = rows.select(*keys, value.alias("_b")).groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    w = W.partitionBy(*keys)
    run = bins.withColumn("_c", F.sum("_n").over(w.orderBy("_b"))).withColumn("_t", F.sum("_n").over(w))
    cut = run.filter(F.col("_c") >= share * F.col("_t")).groupBy(*keys).agg(F.min(F.struct("_b", "_n", "_c", "_t")).alias("_x"))
    cut = cut.select(*keys, F.col("_x._t").alias("_t"), F.col("_x._b").alias("_cut"), ((share * F.col("_x._t") - F.col("_x._c") + F.col("_x._n")) / F.col("_x._n")).alias("_part"))
    x = hot_join(rows, scratch.keep(cut), keys, "_t").filter(value <= F.col("_cut"))
    return x.select(*rows.columns, F.when(value < F.col("_cut"), 1.0).otherwise(F.col("_part")).alias("weight"))


def moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Weights, weighted sums and sums of products by group."""
    pairs = [(i, j) for i in range(len(FEATURES)) for j in range(i + 1)]
    w = F.col("weight")
    return rows.groupBy(*keys).agg(
        F.sum(w).alias("n"),
        *(F.sum(w * F.col(f)).alias(f"s{i}") for i, f in enumerate(FEATURES)),
        *(F.sum(w * F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"q{i}{j}") for i, j in pairs),
    )


def factors(groups: DataFrame, corpus: DataFrame) -> DataFrame:
    """Means m0.., Cholesky factors l00.. and log determinant of every group and start, shrunk towards the corpus row."""
    d = range(len(FEATURES))
    pairs = [(i, j) for i in d for j in range(i + 1)]
    x = groups.crossJoin(F.broadcast(corpus))  # the corpus is one row
    share = F.col("n") / (F.col("n") + SHRINK)
    mean = lambda p, i: F.col(f"{p}s{i}") / F.col(f"{p}n")
    cov = lambda p, i, j: F.col(f"{p}q{i}{j}") / F.col(f"{p}n") - mean(p, i) * mean(p, j)
    x = x.select(
        *KEYS,
        "start",
        F.ceil(F.col("n") / SUBSET).alias("rows"),
        *((share * mean("", i) + (1 - share) * mean("c_", i)).alias(f"m{i}") for i in d),
        *(((share * cov("", i, j) + (1 - share) * cov("c_", i, j)) * CONSISTENCY + (FLOOR[FEATURES[i]] ** 2 if i == j else 0.0)).alias(f"a{i}{j}") for i, j in pairs),
    )
    for i, j in pairs:
        rest = F.col(f"a{i}{j}")
        for k in range(j):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        x = x.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l{j}{j}"))
    det = sum((2 * F.log(f"l{i}{i}") for i in d), F.lit(0.0))
    return x.select(*KEYS, "start", "rows", *(f"m{i}" for i in d), *(f"l{i}{j}" for i, j in pairs), det.alias("det"))


def distance(rows: DataFrame, fitted: DataFrame) -> DataFrame:
    """rows with start and d2, the squared Mahalanobis distance from their group, once for every start that is fitted."""
    x = hot_join(rows, fitted, KEYS, "rows")
    for i, f in enumerate(FEATURES):
        rest = F.col(f) - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"z{k}")
        x = x.withColumn(f"z{i}", rest / F.col(f"l{i}{i}"))
    d2 = sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, len(FEATURES))), F.col("z0") * F.col("z0"))
    return x.select(*rows.columns, "start", d2.alias("d2"))


def start(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """rows with start and d2 from the start's centre, each statistic by its least deviation.

    Start 0 is the group's medians, the others are values by least hash: copies are drawn as one."""
    pairs = F.explode(F.array(*(F.struct(F.lit(i).alias("k"), F.floor(F.col(f) * 128).alias("v")) for i, f in enumerate(FEATURES))))
    long = rows.select(*KEYS, pairs.alias("x")).select(*KEYS, "x.k", "x.v")
    mid = quantile(long, [*KEYS, "k"], F.col("v"), 0.5, "v").groupBy(*KEYS).agg(*(F.max(F.when(F.col("k") == i, F.col("v"))).alias(f"m{i}") for i in range(len(FEATURES))))
    mid = mid.select(*KEYS, F.lit(0).alias("start"), *((F.col(f"m{i}") / 128).alias(f"m{i}") for i in range(len(FEATURES))))
    drawn = [F.min(F.struct(F.xxhash64(F.lit(k), *FEATURES).alias("h"), *FEATURES)) for k in range(1, STARTS)]
    sizes = rows.groupBy(*KEYS).agg(F.count("*").alias("rows"))
    drawn = rows.groupBy(*KEYS).agg(F.array(*(F.struct(F.lit(k).alias("start"), x.alias("at")) for k, x in enumerate(drawn, 1))).alias("x"))
    drawn = drawn.select(*KEYS, F.explode("x").alias("x")).select(*KEYS, "x.start", *(F.col(f"x.at.{f}").alias(f"m{i}") for i, f in enumerate(FEATURES)))
    d2 = sum((((F.col(f) - F.col(f"m{i}")) / FLOOR[f]) ** 2 for i, f in enumerate(FEATURES)), F.lit(0.0))
    starts = scratch.keep(mid.unionByName(drawn).join(sizes, KEYS))
    return hot_join(rows, starts, KEYS, "rows").select(*rows.columns, "start", d2.alias("d2"))


def concentrate(far: DataFrame, scratch: Scratch) -> DataFrame:
    """One step: figures of the nearest rows of every group and start; the corpus is that of start 0."""
    near = nearest(far, [*KEYS, "start"], F.floor(F.log(F.col("d2") + 1e-6) * 32), SUBSET, scratch)
    groups = scratch.keep(moments(near, [*KEYS, "start"]))
    sums = [c for c in groups.columns if c not in (*KEYS, "start")]
    corpus = groups.filter("start = 0").agg(*(F.sum(c).alias(f"c_{c}") for c in sums)).filter("c_n > 0")
    return scratch.keep(factors(groups, corpus))


def fit(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Figures of every group from the start, and then the step, of the least determinant."""
    far = start(rows, scratch)
    for _ in range(STEPS):
        fitted = concentrate(far, scratch)
        far = distance(rows, fitted)
    figures = [c for c in fitted.columns if c not in (*KEYS, "start")]
    least = fitted.groupBy(*KEYS).agg(F.min_by(F.struct(*figures), F.struct("det", "start")).alias("x"))
    best = scratch.keep(least.select(*KEYS, F.lit(0).alias("start"), "x.*"))
    while True:
        new = concentrate(distance(rows, best), scratch).select(*KEYS, F.struct(*figures).alias("x"))
        both = best.join(new, KEYS).withColumn("fell", F.col("x.det") < F.col("det") - FALL)
        both = scratch.keep(both.select(*KEYS, "start", *(F.when(F.col("fell"), F.col(f"x.{c}")).otherwise(F.col(c)).alias(c) for c in figures), "fell"))
        best = both.drop("fell")
        # determinants are bounded by FLOOR from below, so this ends
        if not both.filter("fell").limit(1).count():
            return best


def apply(docs: DataFrame, **cols: str) -> DataFrame:
    """The statistics of every document, base_failed, d2 (null if base_failed) and kept."""
    scratch = Scratch(docs.sparkSession, "quality-rules")
    stats = scratch.keep(statistics(docs, **cols))
    rows = stats.filter(~F.col("base_failed")).select(*KEYS, *transformed())
    fitted = fit(rows, scratch)
    seen = distance(stats.select("*", *transformed()).filter(~F.col("base_failed")), fitted)
    out = seen.select(*stats.columns, "d2", (F.col("d2") <= CUTOFF).alias("kept"))
    failed = stats.filter("base_failed").select("*", F.lit(None).cast("double").alias("d2"), F.lit(False).alias("kept"))
    name = lambda k: F.when(F.col(k) != "", F.substring(k, 2, 2**31 - 1)).alias(k)
    return out.unionByName(failed).select("doc_id", *map(name, KEYS), *(c for c in out.columns if c not in ("doc_id", *KEYS)))
