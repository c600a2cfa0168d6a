"""The operators whose results are SQL expressions against plain Python over the same rows."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from slidespark.llm import quality_rules, site_quality
from slidespark.llm.common import Scratch, ready

WORD = re.compile("[^\x20\x09-\x0d]+").findall


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(31)
    out = []
    for i in range(400):
        kind = i % 4
        w = ["".join(rnd.choice("abcdefg") for _ in range(rnd.randrange(2, 9))) for _ in range(rnd.randrange(55, 120) if kind else rnd.randrange(1, 40))]
        if kind == 1:
            w = [x + rnd.choice("#$%") for x in w]
        text = " ".join(w) + ("\n" + " ".join(w[:9])) * (i % 3)
        out.append((i, text, ("en", "de", None, "")[i // 7 % 4], ("a", "b", "c", None, "")[i % 5], 1))
    out += [(400, None, "en", "a", 1), (401, "", "en", "a", 1), out[9], (None, "some words here", "xx", "alone", None), (402, "long " * 4000, "en", "b", 1)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    ready(spark)
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score int").repartition(4)


def figures(t):
    w = WORD(t)
    c = Counter(zip(w, w[1:], w[2:], strict=False))
    twice = {j for i in range(len(w) - 2) if c[w[i], w[i + 1], w[i + 2]] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if WORD(x)]
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(twice)


def test_site_quality_equals_plain_python(spark, docs, rows):
    labels = [(i, int(i % 4 > 1), 0) for i in range(300)] + [(3, None, 0), (None, 1, 0)]
    got = site_quality.score(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    known = {i: q for i, q, _ in labels if i is not None and q is not None and zlib.crc32(str(i).encode()) % 5}
    bins = site_quality.BINS

    def binned(t):
        n, chars, sym, dup, rep = figures(t or "")
        n = max(n, 1)
        v = (math.log2(n), chars / n * 2, math.sqrt(sym / max(chars, 1)) * 20, math.sqrt(dup / n) * 20, math.sqrt(rep / n) * 15)
        return [min(max(math.floor(x), 0), k - 1) for x, k in zip(v, bins.values(), strict=True)]

    have = [(i, (source,), (source, lang), binned(t)) for i, t, lang, source, _ in rows]
    counts = {(f, c): [0.5] * k for f, k in enumerate(bins.values()) for c in (0, 1)}
    for i, *_, b in have:
        if i in known:
            for f, x in enumerate(b):
                counts[f, known[i]][x] += 1
    first = [sum(counts[0, c]) - 0.5 * bins["b_words"] + 1 for c in (0, 1)]
    prior = math.log(first[1] / first[0])
    ratio = lambda f, x: math.log(counts[f, 1][x] / sum(counts[f, 1])) - math.log(counts[f, 0][x] / sum(counts[f, 0]))
    evidence = [sum(ratio(f, x) for f, x in enumerate(b)) for *_, b in have]
    p = [float(known[i]) if i in known else 1 / (1 + math.exp(-(e + prior))) for (i, *_), e in zip(have, evidence, strict=True)]
    sites = [defaultdict(lambda: [0, 0.0]) for _ in range(2)]
    for (_, host, path, _), v in zip(have, p, strict=True):
        for s, k in zip(sites, (host, path), strict=True):
            s[k][0] += 1
            s[k][1] += v
    corpus = sum(p) / len(p)

    def shrink(site, parent):
        n = sum(a for a, _ in site.values())
        v = sum(a * (b / a - parent(k)) ** 2 for k, (a, b) in site.items()) / n
        w = sum(parent(k) * (1 - parent(k)) for k in site) / n
        mean = sum(parent(k) * (1 - parent(k)) for k in site) / len(site)
        pseudo = min(max(mean / max(v - w, 1e-6) - 1, site_quality.MIN_PSEUDO), site_quality.MAX_PSEUDO)
        return {k: (b + pseudo * parent(k)) / (a + pseudo) for k, (a, b) in site.items()}, pseudo

    host_share, _ = shrink(sites[0], lambda k: corpus)
    path_share, pseudo = shrink(sites[1], lambda k: host_share[k[:1]])
    want = []
    for (i, host, path, _), e, v in zip(have, evidence, p, strict=True):
        n, k = sites[1][path]
        own = min(max((k - v + pseudo * host_share[host]) / (n - 1 + pseudo), 1e-6), 1 - 1e-6)
        want.append((-1 if i is None else i, host_share[host], path_share[path], 1 / (1 + math.exp(-(e + math.log(own / (1 - own)))))))
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.host_share, r.path_share, r.score) for r in got)
    assert np.allclose(got, sorted(want), atol=1e-9)


def test_quality_verdict_equals_plain_python(spark, docs, rows):
    """Distances under the fitted figures, the verdict, and that another step lowers no group's determinant."""
    scratch = Scratch(spark, "twin")
    stats = scratch.keep(quality_rules.statistics(docs))
    kept = stats.filter(~stats.base_failed).select(*quality_rules.KEYS, *quality_rules.transformed())
    fitted = scratch.keep(quality_rules.fit(kept, scratch))
    fits = {(r.lang, r.source): r for r in fitted.collect()}
    again = quality_rules.concentrate(quality_rules.distance(kept, fitted), scratch).collect()
    assert all(r.det >= fits[r.lang, r.source].det - quality_rules.FALL - 1e-9 for r in again)
    site = lambda v: "" if v is None else "=" + v
    want = Counter()
    for i, t, lang, source, _ in rows:
        n, chars, sym, dup, rep = figures(t or "")
        failed = n < 50 or 100 * rep > 50 * n
        d2 = None
        if not failed:
            f = np.array([math.log1p(n), math.log1p(chars / n), math.sqrt(sym / max(chars, 1)), math.sqrt(dup / n), math.sqrt(rep / n)])
            r = fits[site(lang), site(source)]
            low = np.array([[r[f"l{a}{b}"] if b <= a else 0.0 for b in range(5)] for a in range(5)])
            z = np.linalg.solve(low, f - np.array([r[f"m{a}"] for a in range(5)]))
            d2 = round(float(z @ z), 6)
        want[i, lang, source, n, failed, d2, not failed and d2 <= quality_rules.CUTOFF] += 1
    got = Counter((r.doc_id, r.lang, r.source, r.n_words, r.base_failed, None if r.d2 is None else round(r.d2, 6), r.kept) for r in quality_rules.apply(docs).collect())
    assert sorted(map(str, got.elements())) == sorted(map(str, want.elements()))
