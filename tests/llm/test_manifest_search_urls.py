"""Merkle manifest, ranked search and URL filter against plain Python."""

import math
import random
from collections import Counter, defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from slidespark.llm import merkle, ranked_search, url_filter
from slidespark.llm.common import Scratch, ready
from slidespark.llm.url_filter import Rule


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def siblings(tree, i):
    out = []
    for level in tree[:-1]:
        out += level[i ^ 1 : (i ^ 1) + 1]
        i //= 2
    return out


@pytest.mark.parametrize("n", [*range(1, 20), 31, 32, 33, 64, 100])
def test_witnesses_of_a_block(n):
    nodes = [H(str(i)) for i in range(n)]
    tree = levels(nodes)
    wits, root = merkle.grow(nodes)
    assert root == tree[-1][0]
    for i, w in enumerate(wits):
        assert merkle.fold(nodes[i], w) == root and merkle.proof(w) == H(*siblings(tree, i))
    assert merkle.grow(nodes, 8)[1] == merkle.fold(nodes[0], wits[0] + bytes(merkle.STEP) * max(0, 8 - len(tree) + 1))


@pytest.mark.parametrize("k, batches", [(1, 1), (2, 1), (2, 3), (3, 2)])
def test_manifest_under_append_equals_the_whole_tree(spark, k, batches):
    """Groups of one row, of exact powers, with open blocks on several levels; null group; repeated rows."""
    ready(spark)
    sizes = {None: 1, "": 5, "a": 64, "b": 37, "c": 8, "é": 2, "z": 17}
    rows = [(g, i, f"text {i % 5}") for g, n in sizes.items() for i in range(n)] + [("b", None, None), ("b", 36, "text 1")]
    scratch = Scratch(spark, "merkle")
    trees, counts = merkle.Manifest(scratch, k), None
    for b in range(batches):
        part = [r for r in rows if (r[1] or 0) * batches // 64 == b]
        d = spark.createDataFrame(part, "g string, i long, t string")
        d = d.select(merkle.group_key(F.col("g")).alias("grp"), "i", merkle.leaf_digest(F.col("i"), F.col("t")).alias("digest"))
        placed = merkle.positions(d.repartition(4), ["i", "digest"], scratch, counts)
        trees.append(placed)
        seen = placed.groupBy("grp").agg(F.max("pos").alias("p")).select("grp", (F.col("p") + 1).alias("n"))
        counts = seen if counts is None else counts.unionByName(seen).groupBy("grp").agg(F.max("n").alias("n"))
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = defaultdict(list)
    for g, i, t in rows:
        groups[g].append((i is not None, i or 0, H(field(i), field(t))))
    order = [None, *sorted((g for g in groups if g is not None), key=str.encode)]
    tree = {g: levels([x[2] for x in sorted(groups[g])]) for g in order}
    top = levels([tree[g][-1][0] for g in order])
    want = Counter()
    for at, g in enumerate(order):
        for i, x in enumerate(sorted(groups[g])):
            want[x[2], tree[g][-1][0], top[-1][0], H(*siblings(tree[g], i), *siblings(top, at)), top[-1][0]] += 1
    got = merkle.check(merkle.manifest(trees).withColumn("shown", F.col("digest"))).select("digest", "subroot", "root", "proof", "folded")
    assert Counter(map(tuple, got.collect())) == want
    altered = merkle.check(merkle.manifest(trees).withColumn("shown", F.sha2(F.lit("x"), 256)))
    assert altered.filter("folded = root").isEmpty()


def test_empty_manifest(spark):
    ready(spark)
    scratch = Scratch(spark, "merkle")
    trees = merkle.Manifest(scratch)
    trees.append(merkle.positions(spark.createDataFrame([], "grp string, i long, digest string"), ["i", "digest"], scratch))
    assert merkle.manifest(trees).isEmpty()


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return "".join(c if ord(c) > 127 or c.isalnum() else " " for c in low).replace("\x00", " ").split(" ")


def ranked(docs, items, k):
    """The contract's ranking in plain Python: (item, rank, doc, score)."""
    bags = [(i, Counter(w for w in words_of(t) if w)) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    N, L, df = len(bags), sum(n for *_, n in bags), Counter(w for _, b, _ in bags for w in b)
    out = []
    for item, text in items:
        scores = []
        for i, b, n in bags:
            m = 100 - 25 + (25 * n * N) // L
            s = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[w] + 1))) * (10**9 * b[w] // (1000 * b[w] + 12 * m)) for w in words_of(text) if w and b[w])
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return Counter(out)


def test_ranked_search_equals_brute_force(spark, monkeypatch):
    """Several blocks and passes, ties, hot terms, null and empty texts, repeated ids, long texts, clashing names."""
    ready(spark)
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(60)] + ["é", "Ünï", "日本", "x y"]
    text = lambda n: rnd.choice([" ", "-", "\n"]).join(rnd.choice(vocab[: rnd.choice([5, 20, 64])]).upper() for _ in range(n))
    docs = [(i, text(rnd.randrange(1, 60))) for i in range(700)]
    docs += [(i, docs[7][1]) for i in range(700, 730)] + [(5, docs[9][1]), (5, docs[9][1]), (None, docs[7][1]), (None, "w1 w2"), (800, None), (801, ""), (802, "., !"), (803, text(5000))]
    items = [(i, text(rnd.randrange(1, 40))) for i in range(25)] + [(30, None), (31, "unheard of"), (32, docs[7][1]), (33, docs[7][1]), (33, "w3 w3 w3"), (None, "w4")]
    d = spark.createDataFrame([(i, t, "a", 1) for i, t in docs], "doc_id long, text string, term string, block int").repartition(5)
    q = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, query int").repartition(3)
    scratch = Scratch(spark, "search")
    index = ranked_search.build(d, scratch)
    want = ranked(docs, items, 20)
    got = ranked_search.search(index, q, 20, scratch)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, got.collect())) == want
    monkeypatch.setattr(ranked_search, "PASS_TERMS", 150)
    assert Counter(map(tuple, ranked_search.search(index, q, 20, scratch).collect())) == want
    assert ranked_search.search(index, q.limit(0), 20, scratch).isEmpty()
    assert ranked_search.search(ranked_search.build(d.limit(0), scratch), q, 20, scratch).isEmpty()


def test_range_maxima_and_interval_search_in_small_blocks():
    import numpy as np

    rnd = np.random.default_rng(3)
    for _ in range(40):
        n = int(rnd.integers(1, 40))
        lists = [np.sort(rnd.choice(n, int(rnd.integers(1, n + 1)), replace=False)) for _ in range(int(rnd.integers(1, 6)))]
        starts = np.cumsum([0, *map(len, lists)])
        docs, impacts = np.concatenate(lists), rnd.integers(0, 6, starts[-1])
        r = ranked_search.Ranges(starts, docs, impacts, n)
        for i in range(len(lists)):
            for a in range(starts[i], starts[i + 1] + 1):
                for b in range(a, starts[i + 1] + 1):
                    assert r.maxima(np.array([a]), np.array([b]))[0] == max(impacts[a:b], default=0)
        times = rnd.integers(1, 4, len(lists))
        score = np.zeros(n, int)
        for i, docs_i in enumerate(lists):
            score[docs_i] += times[i] * impacts[starts[i] : starts[i + 1]]
        ids = list(range(n))
        for k, floor in ((1, 0), (3, 0), (20, 0), (3, 4)):
            want = sorted(((int(s), d) for d, s in enumerate(score) if s >= max(floor, 1)), key=lambda x: (-x[0], x[1]))[:k]
            got = sorted(r.search(np.arange(len(lists)), times, ids, k, floor), key=lambda x: (-x[0], x[1]))
            assert got == want


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    tail = rest[end:]
    return host, tail[: min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]


RULES = [Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"), Rule("block", "a.org", "/fr/")]


def test_hosts_paths_and_rules(spark):
    urls = [None, "", "no scheme.net/", "http://Www.Example.NET/en/1?x=://y#z", "http://example.net/de/", "ftp://net/", "http://net", "http://xnet/", "http://example.com/de", "http://sub.example.com/de/q", "http://É.ORG/fr/", "http://b.a.org/fr/2", "http://x.org?p=/fr/", "://h/p", "http://a\nb.org/fr/\nx", "x" * 50_000 + "://y.net/" + "p" * 50_000]
    d = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    host, path = url_filter.host_and_path(F.col("url"))
    for r in d.select("url", host.alias("h"), path.alias("p"), url_filter.rule_of(host, path, RULES).alias("r")).collect():
        h, p = parts(r.url)
        fit = [x for x in RULES if (h == x.host or h.endswith("." + x.host)) and p.startswith(x.path)]
        best = max(fit, key=lambda x: (len(x.text), len(x.host)), default=None)
        assert (r.h, r.p, r.r and (r.r.rule, r.r.verdict)) == (h, p, best and (best.text, best.verdict)), r.url


def test_trees_learn_lexical_features(spark):
    """Labelled URLs whose blocked ones have many digits or parameters, or a bad suffix: the rest are told apart; held out."""
    ready(spark)
    rnd = random.Random(4)
    word = lambda n: "".join(rnd.choice("abcdefghij") for _ in range(n))
    rows = []
    for i in range(3000):
        bad = rnd.random() < 0.4
        host = word(rnd.randrange(5, 12)) + "." + ("bad" if bad and i % 3 == 0 else rnd.choice(["com", "org"]))
        path = f"/{word(4)}/" + (str(rnd.randrange(10**8, 10**9)) if bad and i % 3 == 1 else word(9))
        rows.append((i, f"http://{host}{path}" + ("?a=1&b=2&c=3" if bad and i % 3 == 2 else ""), int(bad)))
    d = spark.createDataFrame(rows, "i long, url string, bad int")
    host, path = url_filter.host_and_path(F.col("url"))
    d = d.withColumns({"host": host, "path": path})
    model = url_filter.fit(d.filter("i % 5 <> 0"), Scratch(spark, "urls"))
    got = url_filter.score(d.filter("i % 5 = 0"), model).selectExpr("avg(double((p_block >= 0.5) = (bad = 1))) AS right").first().right
    assert got >= 0.97
    # the score of a row is the sum of its leaves, walked in plain Python
    x = url_filter.binned(url_filter.with_shares(url_filter.features(d.limit(50)), model.suffixes, model.share), model.cuts)
    for r in x.withColumn("raw", url_filter.raw_score(model.start, model.trees)).collect():
        want = model.start
        for f, cuts in model.cuts.items():
            assert r[f"b_{f}"] == sum(c < r[f] for c in cuts)
        for tree, leaves in model.trees:
            at = 1
            while at < 2**url_filter.DEPTH:
                at = 2 * at + bool(tree[at] and r[f"b_{tree[at][0]}"] > tree[at][1])
            want += leaves[at - 2**url_filter.DEPTH]
        assert r.raw == pytest.approx(want)


def test_first_tree_equals_exhaustive_search(spark):
    """The root cut of the first tree is the one of greatest gain over all features and cuts."""
    rnd = random.Random(9)
    rows = [tuple(rnd.randrange(4) for _ in url_filter.FEATURES) + (float(rnd.randrange(2)),) for _ in range(300)]
    rows = [(*r[:-1], float(r[2] > 1) if rnd.random() < 0.9 else r[-1]) for r in rows]
    d = spark.createDataFrame([(*r[:-1], 0.5 - r[-1], 0.25) for r in rows], [*(f"b_{f}" for f in url_filter.FEATURES), "g", "h"])
    tree, _ = url_filter._grow(d)
    gain = lambda s: sum(0.5 - r[-1] for r in s) ** 2 / (0.25 * len(s) + url_filter.PENALTY)
    cut = lambda f, c: gain([r for r in rows if r[f] <= c]) + gain([r for r in rows if r[f] > c])
    f, c = max(((f, c) for f in range(len(url_filter.FEATURES)) for c in range(3)), key=lambda x: cut(*x))
    assert tree[1] == (url_filter.FEATURES[f], c)


def test_judge_edges(spark):
    """Null and repeated rows, empty tables, no labels, other columns."""
    ready(spark)
    scratch = Scratch(spark, "urls")
    d = spark.createDataFrame([(1, None, 7), (1, "http://x.com/a", 8), (2, "http://x.com/a", 8)], "page_id long, url string, n int")
    got = url_filter.judge(d, RULES, scratch)
    assert {r.verdict for r in got.collect()} == {"allow"} and got.filter("n = 8").count() == 2
    assert url_filter.judge(d.limit(0), RULES, scratch).isEmpty()
    all_bad = url_filter.judge(d.union(spark.createDataFrame([(3, "http://x.net/", 0)], d.schema)), RULES, scratch)
    assert {r.verdict for r in all_bad.collect()} == {"block"}
    with pytest.raises(ValueError):
        url_filter.rule_of(F.lit(""), F.lit(""), RULES * 1000)
