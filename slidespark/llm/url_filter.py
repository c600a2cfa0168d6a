"""URL filters: rules on hosts and paths, and gradient-boosted trees on lexical features for what no rule judges. SQL only.

Method: a URL's features are lengths, depth, digit ratios, the entropy of its host's characters, parameter counts, and
for its host's last label and last two labels the share of blocked URLs among the labelled ones, shrunk to the overall
share by PRIOR rows. A labelled URL's own label is left out of its shares. Features are cut into BINS by quantiles. Trees
of depth DEPTH are grown one after another on the logistic loss: each level takes one grouped sum of gradients and
curvatures by node, feature and bin, from which the best cut of every node follows; its size does not depend on the
data. Labels come with the URLs given; in the query they are those that a rule judges.

Fitting reads at most MAX_LABELLED labelled rows, those of least hash (documented bound); shares of suffixes count all.

Edge cases: null URLs, empty ones and those without ``://`` have an empty host and path, fit no rule and are scored by
the other features; without labels nothing is blocked but by rules, and where all labels agree so do all scores; ties
of two rules in length go to the longer host; repeated rows and equal URLs get equal verdicts; very long URLs are read
whole; an empty table gives no rows; other columns, whatever their names, are passed by ``judge`` as they are as long as
they are not called like a result.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, least_hashes

#: Labelled rows that the trees are fitted on; rows of the overall share in a suffix's share.
MAX_LABELLED, PRIOR = 50_000, 20.0
#: Trees, their depth, bins a feature, shrinkage of a tree, weight of the leaf penalty, least curvature of a leaf, least gain of a cut.
TREES, DEPTH, BINS, RATE, PENALTY, LEAST, GAIN = 10, 3, 16, 0.4, 1.0, 1.0, 1e-3
#: Rules at most: they are tried one by one in an expression.
MAX_RULES = 1000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ["length", "host_length", "path_length", "host_depth", "path_depth", "digits", "host_digits", "entropy", "hyphens", "params", "param_length", "ending", "share_1", "share_2"]


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path of a URL; empty without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """(rule, verdict) of the longest rule that fits; null without one."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), len(r.host))):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def _digits(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, "0123456789", ""))


def _entropy(text: Column) -> Column:
    """Bits a character of the text's own distribution of characters."""
    n = F.length(text)

    def bits(c: Column) -> Column:
        share = (n - F.length(F.replace(text, c, F.lit("")))) / n
        return -share * F.log2(share)

    return F.aggregate(F.transform(F.array_remove(F.array_distinct(F.split(text, "")), ""), bits), F.lit(0.0), lambda a, x: a + x)


def features(rows: DataFrame) -> DataFrame:
    """rows (url, host, path, ..) with the features that need no labels, and the suffixes s_1 and s_2 of the host."""
    url, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    labels = F.split(host, r"\.")
    out = {
        "length": F.length(url),
        "host_length": F.length(host),
        "path_length": F.length(path),
        "host_depth": F.size(labels),
        "path_depth": F.size(F.filter(F.split(path, "/"), lambda s: s != "")),
        "digits": _digits(url) / F.greatest(F.length(url), F.lit(1)),
        "host_digits": _digits(host) / F.greatest(F.length(host), F.lit(1)),
        "entropy": F.when(host == "", 0.0).otherwise(_entropy(host)),
        "hyphens": F.length(host) - F.length(F.translate(host, "-", "")),
        "params": F.size(F.filter(F.split(query, "&"), lambda s: s != "")),
        "param_length": F.length(query),
        "ending": F.length(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)),
    }
    return rows.withColumns({k: v.cast("double") for k, v in out.items()} | {"s_1": F.element_at(labels, -1), "s_2": F.substring_index(host, ".", -2)})


class Model(NamedTuple):
    """Shares of suffixes (s, n, bad) by their labels, the overall share, cuts of the features, and trees in heap order."""

    suffixes: dict[str, DataFrame]
    share: float
    cuts: dict[str, list[float]]
    start: float
    trees: list[tuple[list[tuple[str, int] | None], list[float]]]


def with_shares(rows: DataFrame, suffixes: dict[str, DataFrame], share: float, own: Column | None = None) -> DataFrame:
    """rows with share_1 and share_2; own (0 or 1) is a labelled row's label, which is left out.

    A suffix may hold most rows: small tables are broadcast by the optimizer, and skewed keys of others are split."""
    for k, of in suffixes.items():
        rows = rows.join(of.select(F.col("s").alias(f"s_{k}"), F.col("n").alias("_n"), F.col("bad").alias("_bad")), f"s_{k}", "left")
        n, bad = F.coalesce("_n", F.lit(0)), F.coalesce("_bad", F.lit(0))
        n, bad = (n, bad) if own is None else (n - 1, bad - own)
        rows = rows.withColumn(f"share_{k}", (bad + PRIOR * share) / (n + PRIOR)).drop("_n", "_bad")
    return rows


def binned(rows: DataFrame, cuts: dict[str, list[float]]) -> DataFrame:
    """rows with b_f, the number of cuts below feature f."""
    below = lambda f, c: F.size(F.filter(F.array(*map(F.lit, c)), lambda x: x < F.col(f)))
    return rows.withColumns({f"b_{f}": below(f, c) for f, c in cuts.items()})


def _node(tree: list[tuple[str, int] | None], at: int, depth: int, leaf) -> Column:
    """leaf(i) of the i-th node of the depth that a row falls to, from node at on."""
    if at >= 2**depth:
        return F.lit(leaf(at))
    cut = tree[at] if at < len(tree) else None
    low = _node(tree, 2 * at, depth, leaf)
    return low if cut is None else F.when(F.col(f"b_{cut[0]}") > cut[1], _node(tree, 2 * at + 1, depth, leaf)).otherwise(low)


def raw_score(start: float, trees: list) -> Column:
    """Sum of the trees' leaves: log odds of a block."""
    out = F.lit(start)
    for tree, leaves in trees:
        out = out + _node(tree, 1, DEPTH, lambda i, leaves=leaves: leaves[i - 2**DEPTH])
    return out


def _grow(rows: DataFrame) -> tuple[list, list[float]]:
    """One tree on rows (b_.., g, h): cuts by node in heap order, and leaves."""
    tree: list[tuple[str, int] | None] = [None] * 2**DEPTH
    leaves = [0.0] * 2**DEPTH
    value = lambda g, h: -RATE * g / (h + PENALTY)
    gain = lambda g, h: g * g / (h + PENALTY)
    for depth in range(DEPTH):
        node = _node(tree, 1, depth, lambda i: i)
        each = F.explode(F.array(*(F.struct(F.lit(i).alias("f"), F.col(f"b_{f}").alias("b")) for i, f in enumerate(FEATURES)))).alias("x")
        got = rows.select(node.alias("node"), "g", "h", each).groupBy("node", "x.f", "x.b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
        sums: dict[int, list[list[tuple[float, float]]]] = {}
        for r in got:
            per = sums.setdefault(r.node, [[(0.0, 0.0)] * BINS for _ in FEATURES])
            per[r.f][r.b] = (r.g, r.h)
        for at, per in sums.items():
            g, h = (math.fsum(x[i] for x in per[0]) for i in (0, 1))
            best = (GAIN, None, 0, g, h)
            for f, bins in zip(FEATURES, per, strict=True):
                a = b = 0.0
                for i, (x, y) in enumerate(bins[:-1]):
                    a, b = a + x, b + y
                    if min(b, h - b) >= LEAST:
                        won = gain(a, b) + gain(g - a, h - b) - gain(g, h)
                        if won > best[0] * (1 + 1e-9):
                            best = (won, f, i, a, b)
            _, f, cut, a, b = best
            if f is not None:
                tree[at] = (f, cut)
            if depth == DEPTH - 1:
                leaves[2 * at - 2**DEPTH] = value(a, b) if f else value(g, h)
                leaves[2 * at + 1 - 2**DEPTH] = value(g - a, h - b) if f else 0.0
    return tree, leaves


def fit(labelled: DataFrame, scratch: Scratch) -> Model | None:
    """A model of labelled (url, host, path, bad), bad 0 or 1; None without labels."""
    rows = scratch.keep(features(labelled.select("url", "host", "path", "bad")))
    n, bad = rows.agg(F.count("*"), F.sum("bad")).first()
    if not n:
        return None
    suffixes = {k: scratch.keep(rows.groupBy(F.col(f"s_{k}").alias("s")).agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))) for k in ("1", "2")}
    share = bad / n
    few = scratch.keep(with_shares(least_hashes(rows, MAX_LABELLED, "trees", "url"), suffixes, share, own=F.col("bad")))
    at = F.array(*(F.lit(i / BINS) for i in range(1, BINS)))
    found = few.agg(*(F.percentile_approx(f, at, 10_000).alias(f) for f in FEATURES)).first()
    cuts = {f: sorted(set(found[f])) for f in FEATURES}
    bins = [f"b_{f}" for f in FEATURES]
    few = scratch.keep(binned(few, cuts).groupBy(*bins).agg(F.count("*").cast("double").alias("n"), F.sum("bad").cast("double").alias("bad")))
    smooth = (bad + share) / (n + 1)
    start = math.log(max(smooth, 1e-6) / max(1 - smooth, 1e-6))
    trees: list = []
    while 0 < bad < n and len(trees) < TREES:
        p = 1 / (1 + F.exp(-raw_score(start, trees)))
        rows = few.select(*bins, "n", "bad", p.alias("p")).select(*bins, (F.col("n") * F.col("p") - F.col("bad")).alias("g"), (F.col("n") * F.col("p") * (1 - F.col("p"))).alias("h"))
        tree, leaves = _grow(rows)
        if tree[1] is None:
            break
        trees.append((tree, leaves))
    return Model(suffixes, share, cuts, start, trees)


def score(rows: DataFrame, model: Model | None) -> DataFrame:
    """rows (url, host, path, ..) with p_block, the probability of a block."""
    if model is None:
        return rows.withColumn("p_block", F.lit(0.0))
    x = binned(with_shares(features(rows), model.suffixes, model.share), model.cuts)
    return x.select(*rows.columns, (1 / (1 + F.exp(-raw_score(model.start, model.trees)))).alias("p_block"))


def judge(pages: DataFrame, rules: list[Rule], scratch: Scratch, url_col: str = "url") -> DataFrame:
    """pages with url, host, path, rule, verdict and p_block: the rule's verdict, else that of trees fitted on the URLs that rules judge."""
    host, path = host_and_path(F.col(url_col))
    x = pages.withColumn("url", F.col(url_col)).withColumns({"host": host, "path": path})
    x = x.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules)).withColumns({"rule": F.col("_rule.rule"), "verdict": F.col("_rule.verdict")}).drop("_rule")
    labelled = x.filter("rule is not null").select("url", "host", "path", (F.col("verdict") == "block").cast("int").alias("bad"))
    return score(x, fit(labelled, scratch)).withColumn("verdict", F.coalesce("verdict", F.when(F.col("p_block") >= 0.5, "block").otherwise("allow")))
