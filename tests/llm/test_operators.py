"""Each operator against brute force on a small fixture with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from slidespark.llm import bpe, embedding_dedup, html_text, lm, minhash_dedup, mixing, quality_rules, site_quality, suffix_dedup, toxicity
from slidespark.llm.common import ready

tokenizers = pytest.importorskip("tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, k1 string, rank int"


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(4)
    vocab = ["".join(rnd.choice("abcdefgéüßñ") for _ in range(rnd.randrange(2, 9))) for _ in range(900)]
    words = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    passage = words(60)
    texts = [words(rnd.randrange(1, 160)) for _ in range(60)]
    texts += [texts[0], texts[0], texts[3] + " x", words(30) + "\n" + passage + "\n" + words(40), passage + " " + words(9), passage]
    base = words(150).split()
    for _ in range(6):
        c = list(base)
        c[rnd.randrange(150)] = "changed"
        texts.append(" ".join(c))
    common = words(70)
    texts += [words(rnd.randrange(1, 20)) + " " + common[rnd.randrange(60) :] + " " + words(rnd.randrange(1, 20)) for _ in range(12)]
    texts += [None, "", "  \n\t ", "one", "two words", "aaaa " * 200, "x" * 900, words(6000), "Same Same", "same same", "line\nline\nline a b c a b c"]
    return [(i, t, "en", f"src{i % 3}", 0, "k", 1) for i, t in enumerate(texts)] + [(0, texts[0], "en", "src0", 0, "k", 1), (None, texts[1], None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    ready(spark)
    return spark.createDataFrame(corpus, DOCS).repartition(5)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 4 > 0), int(i % 9 == 0)) for i in range(60)] + [(3, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")


def test_bpe_equals_the_library(docs, nothing, corpus):
    from slidespark.llm.queries import vocabulary

    t = tokenizers.Tokenizer.from_file(vocabulary())
    got = Counter((r.doc_id, bytes(r.ids), r.decoded) for r in bpe.decode(bpe.encode(docs, vocabulary()), vocabulary()).collect())
    want = Counter()
    for i, text, *_ in corpus:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want[i, np.array(ids, "<u4").tobytes(), t.decode(ids, skip_special_tokens=False)] += 1
    assert got == want
    assert bpe.encode(nothing, vocabulary()).count() == 0


@pytest.mark.parametrize("text", ["a<|endoftext|>B <|startoftext|>", "ΑΣ İst ﬀ é", "don't I'LL", "\x00\x1c!\x1c!\x85", "!" * 300, "😀٣½"])
def test_bpe_odd_texts(text):
    from slidespark.llm.queries import vocabulary

    with open(vocabulary(), encoding="utf-8") as f:
        m = bpe.Model(f.read())
    assert m.encode(text) == np.array(tokenizers.Tokenizer.from_file(vocabulary()).encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("in_task", [suffix_dedup.IN_TASK, 1])
def test_suffix_dedup_equals_brute_force(docs, nothing, corpus, in_task, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "IN_TASK", in_task)  # 1: every rank goes by cells
    n, seen = 200, Counter()
    raws = [(i, (t or "").encode()) for i, t, *_ in corpus]
    for _, b in raws:
        seen.update(b[i : i + n] for i in range(len(b) - n + 1))
    want = Counter()
    for i, b in raws:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - n + 1):
            if seen[b[k : k + n]] > 1:
                gone[k : k + n] = True
        runs = int((np.diff(np.r_[False, gone].astype(int)) == 1).sum())
        want[i, len(b), int(gone.sum()), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()] += 1
    got = suffix_dedup.dedup_digest(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert Counter(map(tuple, got.collect())) == want
    assert suffix_dedup.dedup_digest(nothing).count() == 0
    cut = suffix_dedup.dedup_texts(docs)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    odd = suffix_dedup.dedup_texts(docs.withColumnsRenamed({"k1": "_a", "rank": "_kept"}))
    assert {(r["_a"], r["_kept"]) for r in odd.collect()} == {("k", 1), (None, None)}


def test_minhash_equals_brute_force(docs, nothing, corpus):
    def components(k, percent):
        sets = [(i, minhash_dedup.shingles(t or "", k)) for i, t, *_ in corpus]
        near = defaultdict(set)
        for i, a in sets:
            for j, b in sets:
                if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                    near[i].add(j)
        comp = {}
        for i in sorted(near):
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in comp:
                    comp[x] = i
                    todo += near[x]
        return Counter((i, len(a), (comp[i] if a else i) if i is not None else None) for i, a in sets)

    for k, percent in ((3, 85), (5, 80)):
        got = minhash_dedup.near_duplicates(docs, k, percent)
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == components(k, percent)
    assert minhash_dedup.near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("percent", [80, 85])
def test_minhash_trees_reach_the_recall(spark, percent, monkeypatch):
    """Pairs just at the threshold share a path of all levels in some tree, with the trees near_duplicates takes."""
    rnd, rows = random.Random(9), []
    for i in range(1500):
        w = [f"{rnd.randrange(10**9)}" for _ in range(200)]
        common = w[: 2 * percent]
        side = (200 - 2 * percent) // 2
        rows += [(2 * i, " ".join(common + w[2 * percent : 2 * percent + side])), (2 * i + 1, " ".join(common + w[200 - side :]))]
    ready(spark)
    used = []
    signatures = minhash_dedup.signatures
    monkeypatch.setattr(minhash_dedup, "signatures", lambda *a, **b: used.append(signatures(*a, **b)) or used[0])
    minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 1, percent)
    paths = {r.doc_id: np.array(r.chosen).reshape(-1, minhash_dedup.LEVELS) for r in used[0].collect()}
    met = sum((paths[2 * i] == paths[2 * i + 1]).all(1).any() for i in range(1500))
    assert met >= 0.995 * 1500


@pytest.mark.parametrize("chunk", [minhash_dedup.CHUNK, 40])
def test_minhash_large_nodes(spark, chunk, monkeypatch):
    """Families of near-copies too large for a small node: dense ones, and one whose members lie around the threshold."""
    monkeypatch.setattr(minhash_dedup, "CHUNK", chunk)
    rnd = random.Random(2)
    rows, sets = [], []
    for f, edits in enumerate((1, 3, 7)):
        base = [f"w{f}-{i}" for i in range(300)]
        for i in range(150):
            c = list(base)
            for _ in range(rnd.randrange(edits + 1)):
                c[rnd.randrange(300)] = f"n{i}"
            rows.append((1000 * f + i, " ".join(c)))
    ready(spark)
    sets = {i: minhash_dedup.shingles(t, 3) for i, t in rows}
    comp = {i: i for i in sets}

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and i // 1000 == j // 1000 and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                x, y = sorted((find(i), find(j)))
                comp[y] = x
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85)
    assert {r.doc_id: r.component_id for r in got.collect()} == {i: find(i) for i in sets}


def test_minhash_blocks_across_chunks():
    """Links between components of two sides are found, and no others; they form no star."""
    pd = pytest.importorskip("pandas")
    tokens = {i: np.arange(100) + (0 if i < 20 else 1000) for i in range(40)}
    f = pd.DataFrame([{"side": i % 2, "sid": i, "n": 100, "sketch": 0, "comp": i, "tokens": tokens[i]} for i in range(40)])
    got = minhash_dedup._blocks(85)(f)
    ends = Counter(got["a"].tolist() + got["b"].tolist())
    assert max(ends.values()) <= 6 and len(got) == 38
    assert all((a < 20) == (b < 20) for a, b in zip(got["a"], got["b"], strict=True))


def test_minhash_sketch_loses_no_more_than_stated():
    rnd = np.random.default_rng(3)
    for percent in (80, 85):
        differ = rnd.binomial(minhash_dedup.BITS, (1 - percent / 100) / 2, 200_000)
        assert (differ > minhash_dedup.bits_for(percent)).sum() <= 2


def test_toxicity_held_out(spark):
    rnd = random.Random(3)
    bad, vocab = ["vile", "scum", "foul"], [f"word{i}" for i in range(400)]
    rows, lab = [], []
    for i in range(900):
        w = [rnd.choice(vocab) for _ in range(60)]
        y = int(i % 6 == 0)
        for _ in range(2 * y):
            w[rnd.randrange(60)] = rnd.choice(bad)
        rows.append((i, " ".join(w)))
        lab.append((i, 1, y))
    rows += [(1000, None), (1001, "")]
    ready(spark)
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(lab, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and got[1000] == got[1001] < 0.5
    assert sum((got[i] >= 0.5) != bool(y) for i, _, y in lab) <= 9
    assert toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).filter("score <> 0").count() == 0


def test_block_max_is_exact():
    """The index against all cosines, with ties: those at the k-th place share what is left of it."""
    rnd = np.random.default_rng(1)
    bags = [(np.sort(rnd.choice(40, 5, False)), rnd.integers(1, 4, 5)) for _ in range(500)] + [(np.array([3, 7]), np.array([1, 1]))] * 100
    weight = rnd.random(40) + 0.2
    idx = toxicity.Index(bags, list(range(600)), [int(i % 3 == 0) for i in range(600)], weight)
    dense = np.zeros((600, 40))
    for i, (t, n) in enumerate(bags):
        w = (1 + np.log(n)) * weight[t]
        dense[i, t] = w / np.sqrt((w * w).sum())
    for q in [*range(50), 599]:
        every = dense @ dense[q]
        kth = np.sort(every)[-toxicity.NEAREST]
        slots, sims, share = idx.nearest(bags[q])
        want = sorted(np.flatnonzero(every >= kth - 1e-6))
        assert sorted(idx.ids[slots].tolist()) == want
        assert np.allclose(np.sort(sims), np.sort(every[want]), atol=1e-5) and abs(share.sum() - toxicity.NEAREST) < 1e-6


def test_toxicity_ties_are_shared(spark):
    """A hundred toxic and 3,000 clean examples of one word: the word says nothing of the class."""
    rows = [(i, "same") for i in range(4200)]
    lab = [(i, 1, int(i % 31 == 0)) for i in range(4000)]
    ready(spark)
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(lab, "doc_id long, quality int, toxic int")
    got = {round(r.score, 6) for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert len(got) == 1 and got.pop() < 0.1


def test_toxicity_equals_brute_force(spark):
    """The whole operator against plain Python: every cosine, shared ties, votes; extra columns, repeated rows and nulls."""
    rnd = random.Random(8)
    vocab = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    rows = []
    for i in range(400):
        w = [rnd.choice(vocab) for _ in range(rnd.randrange(1, 30))]
        if i % 5 == 0:
            w += rnd.choices(["vile", "scum"], k=2)
        rows.append((i, " ".join(w), i, "x", 0.5))
    rows += [rows[7], (900, None, 0, "x", 0.0), (901, "", 0, "x", 0.0), (None, rows[5][1], 0, None, None)]
    lab = [(i, 1, int(i % 5 == 0)) for i in range(300)] + [(2, None, None), (5000, 1, 1)]
    ready(spark)
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int, v string, score double")
    model = toxicity.fit(docs, spark.createDataFrame(lab, "doc_id long, quality int, toxic int"))
    got = Counter((r.doc_id, round(r.score, 6)) for r in toxicity.score(docs, model).collect())
    import zlib

    train = {i: y for i, _, y in lab if y is not None and zlib.crc32(str(i).encode()) % 5}
    ex = [(i, Counter(rows[i][1].split()), train[i]) for i in sorted(train) if i < 400]
    prior = sum(train.values()) / len(train)
    words = sorted({w for _, c, _ in ex for w in c})
    of = [sum(y == k for *_, y in ex) for k in (0, 1)]
    df = Counter(w for r in rows for w in set((r[1] or "").split()))
    n = [Counter(w for _, c, y in ex if y == k for w in c) for k in (0, 1)]
    rel = toxicity.relevance(np.array([n[0][w] for w in words], float), np.array([n[1][w] for w in words], float), *of)
    weight = {w: (math.log((len(rows) + 1) / (df[w] + 1)) + 0.1) * r for w, r in zip(words, rel, strict=True)}

    def vector(c):
        v = {w: (1 + math.log(k)) * weight[w] for w, k in c.items() if weight.get(w, 0) > 0}
        length = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / length for w, x in v.items()}

    vecs = [(vector(c), y) for _, c, y in ex]

    def vote(text):
        q = vector(Counter(text.split()))
        s = sorted(((sum(x * v.get(w, 0) for w, x in q.items()), y) for v, y in vecs), reverse=True)
        s = [(a, y) for a, y in s if a > 0]
        if not s:
            return prior
        k = toxicity.NEAREST
        if len(s) > k:
            kth = s[k - 1][0]
            above = [x for x in s if x[0] > kth + 1e-6]
            tied = [x for x in s if abs(x[0] - kth) <= 1e-6]
            s = [(a, y, 1.0) for a, y in above] + [(a, y, (k - len(above)) / len(tied)) for a, y in tied]
        else:
            s = [(a, y, 1.0) for a, y in s]
        w0, w1 = (1 - prior) / of[0], prior / of[1]
        pos, neg = w1 * sum(a * a * f for a, y, f in s if y), w0 * sum(a * a * f for a, y, f in s if not y)
        mass = 0.25 * min(w0, w1)
        return (pos + mass * prior) / (pos + neg + mass)

    want = [(r[0], float(toxicity.curve(np.array([vote(r[1] or "")]), *model.curve)[0])) for r in rows]
    have = sorted(((a is None, a or 0), s) for (a, s), k in got.items() for _ in range(k))
    for (a, s), (b, t) in zip(have, sorted(((i is None, i or 0), t) for i, t in want), strict=True):
        assert a == b and abs(s - t) < 1e-4


PAGE = """<html><head><title>t</title><script>var a="<p>no</p>";</script></head><body class="has-sidebar"><nav><a href=/>Home</a></nav>
<div class="cookie-notice">We use cookies, and more, and more, and more.</div><article><h1>Title &amp; more</h1><p>First, a paragraph&nbsp;with <b>bold
text</b>, commas, and length enough to count.<p>Second<br>line, never closed<ul><li>item one</li><li>item two</li></ul><div class="ad">Buy</div></article>
<section id="comments"><p>A reader says, well, many, many, many things about all of this and more.</p></section><aside>Side</aside><footer>Foot</footer></body></html>"""


def test_html(spark):
    ready(spark)
    assert html_text.main_text(PAGE) == "Title & more\nFirst, a paragraph with bold text, commas, and length enough to count.\nSecond line, never closed\nitem one\nitem two"
    assert html_text.main_text("") == "" and html_text.main_text("only text &lt;3") == "only text <3"
    assert html_text.main_text("<div>" * 5000 + "deep text") == "deep text"
    df = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (2, None, None)], "page_id long, url string, html string")
    assert sorted(len(r.text) for r in html_text.extract(df).collect())[0] == 0


def test_quality_rules(docs, nothing, corpus):
    word = re.compile("[^\x20\x09-\x0d]+").findall

    def figures(t):
        w = word(t)
        c = Counter(zip(w, w[1:], w[2:], strict=False))
        twice = {j for i in range(len(w) - 2) if c[w[i], w[i + 1], w[i + 2]] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if word(x)]
        return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(twice)

    want = Counter()
    for i, t, *_ in corpus:
        f = figures(t or "")
        want[i, *f, f[0] < 50 or 100 * f[4] > 50 * f[0]] += 1
    got = quality_rules.apply(docs)
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert Counter(map(tuple, got.select(*cols).collect())) == want
    assert got.filter("base_failed and kept").count() == 0 and got.filter("kept").count() > 20
    assert quality_rules.apply(nothing).count() == 0


@pytest.mark.parametrize("copies", [True, False])
def test_quality_rules_reject_a_third_of_junk(spark, copies):
    """A third of a group is extreme, as equal rows or as distinct ones: all of it goes, nearly all else stays."""
    rnd = random.Random(6)
    rows = []
    for i in range(600):
        w = ["".join(rnd.choice("abcdefg") for _ in range(rnd.randrange(3, 9))) for _ in range(rnd.randrange(80, 140))]
        if i % 3 == 0:
            w = ["#" * (5 if copies else rnd.randrange(4, 7)) + f"a{k}" for k in range(70 if copies else rnd.randrange(60, 80))]
        rows.append((i, " ".join(w), "en", "s"))
    ready(spark)
    got = {r.doc_id: r.kept for r in quality_rules.apply(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(got[i] for i in range(0, 600, 3))
    assert sum(got[i] for i in range(600) if i % 3) >= 390


def test_embeddings_equal_brute_force(spark):
    rnd = np.random.default_rng(5)
    base = rnd.normal(size=(150, 16))
    vecs = [*base, *(base[i % 20] + rnd.normal(size=16) * 0.02 for i in range(220)), base[0], base[0]]
    rows = [(i, [float(x) for x in np.float32(v)], i % 2) for i, v in enumerate(vecs)]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, rows[0][1], None), (904, [None] * 16, 0), (905, [1.0, 2.0], 0)]
    ready(spark)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    n = len(vecs)
    x = np.array([r[1] for r in rows[:n]])
    x /= np.linalg.norm(x, axis=1)[:, None]
    link = (x @ x.T >= 0.98) & (np.arange(n)[:, None] % 2 == np.arange(n)[None] % 2)
    np.fill_diagonal(link, False)
    found = sum(got[i][0] for i in range(n)) / max(int(link.sum()), 1)
    assert 0.9 <= found <= 1 and all(got[i][0] <= link[i].sum() for i in range(n))
    assert all(got[i] == (0, i) for i in range(900, 906))


def planted_domains():
    """Documents whose words tell toxic, and whose length tells high from low; the larger part labelled."""
    rnd = random.Random(12)
    rows, lab = [], []
    for i in range(1200):
        kind = ("high", "high", "low", "toxic")[i % 4]
        w = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(3, 9))) for _ in range({"high": 120, "low": 12, "toxic": 120}[kind] + rnd.randrange(20))]
        if kind == "toxic":
            w[3:3] = ["vile", "scum", "vile", "scum"]
        rows.append((i, " ".join(w), "en", "s", 0, "k", 1))
        if i % 3:
            lab.append((i, int(kind == "high"), int(kind == "toxic")))
    return rows, lab


def test_mixing_meets_every_target(spark):
    """Each domain's expected tokens within 1 % of all tokens."""
    rows, lab = planted_domains()
    ready(spark)
    docs, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame(lab, "doc_id long, quality int, toxic int")
    for targets in ({"high": 0.85, "low": 0.15, "toxic": 0.0}, {"high": 0.3, "low": 0.1, "toxic": 0.6}):
        p = mixing.mix(docs, labels, targets).toPandas()
        n = p.tokens.sum()
        for d, want in targets.items():
            assert abs((p.rate * p.tokens * p[f"p_{d}"]).sum() / n - want) < 0.01, (d, targets)
        assert (p.rate >= 0).all()


@pytest.mark.parametrize("targets", [(0.85, 0.15, 0.0), (0.2, 0.2, 0.6), (0.0, 1.0, 0.0)])
def test_mixing_rates_equal_projected_gradient(spark, targets):
    """Overlapping posteriors, targets in and out of reach: rates equal those of 20,000 projected gradient steps on the least squares itself."""
    rnd = np.random.default_rng(6)
    q = rnd.dirichlet((2, 1, 0.7), 300) * 0.97 + 0.01
    t = rnd.integers(0, 400, 300)
    d = spark.createDataFrame([(i, int(n), *map(float, v)) for i, (n, v) in enumerate(zip(t, q, strict=True))], "doc_id long, tokens long, p_high double, p_low double, p_toxic double")
    got = mixing.fit_rates(d, dict(zip(mixing.DOMAINS, targets, strict=True))).orderBy("doc_id").toPandas()
    share, w, at, speed = t / t.sum(), np.ones(300), np.ones(300), 1.0
    for _ in range(20_000):
        new = np.maximum(0, at - 0.9 * (q @ ((at * share) @ q - targets) + mixing.RIDGE * (at - 1)))
        faster = (1 + (1 + 4 * speed * speed) ** 0.5) / 2
        at, w, speed = new + (speed - 1) / faster * (new - w), new, faster
    some = t > 0
    miss = lambda w: 0.5 * (((w * share) @ q - targets) ** 2).sum() + mixing.RIDGE / 2 * (share * (w - 1) ** 2).sum()
    assert miss(got.rate.to_numpy()) <= miss(w) + 1e-9
    assert np.allclose(got.rate[some], w[some], atol=0.02) and (got.rate[~some] == 1).all()


def test_mixing_gives_rows_their_own_copies(spark):
    """Rows without id and rows of one id are told apart by their text."""
    rows, lab = planted_domains()
    rows = [(None if i % 4 == 0 else i // 2, *r[1:]) for i, r in enumerate(rows)]
    ready(spark)
    docs, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame(lab, "doc_id long, quality int, toxic int")
    copies = mixing.mix(docs, labels).toPandas()
    assert mixing.sample(docs, labels).count() == copies.copies.sum()


def test_mixing_keeps_columns_of_any_name(spark):
    rows, lab = planted_domains()
    docs = spark.createDataFrame([(*r[:4], 7, 8, 9) for r in rows], "doc_id long, text string, lang string, source string, _i int, _n int, row int")
    got = mixing.sample(docs, spark.createDataFrame(lab, "doc_id long, quality int, toxic int"))
    assert got.columns == docs.columns and {tuple(r)[4:] for r in got.collect()} == {(7, 8, 9)}


def test_mixing_meets_targets(docs, nothing, labels):
    p = mixing.mix(docs, labels, {"high": 0.7, "low": 0.2, "toxic": 0.1}).toPandas()
    t = p.tokens.sum()
    assert (p.rate >= 0).all() and abs((p.rate * p.tokens).sum() / t - 1) < 0.2
    assert mixing.mix(nothing, labels).count() == 0
    assert (mixing.mix(docs, labels.limit(0)).toPandas()[["p_high", "p_low", "p_toxic"]].sub(1 / 3).abs() < 1e-6).all().all()
    assert mixing.sample(docs, labels).columns == docs.columns


def test_site_quality(docs, nothing, labels):
    p = site_quality.score(docs, labels).toPandas()
    assert len(p) == docs.count() and p.score.between(0, 1).all() and p.path_share.between(0, 1).all()
    assert site_quality.score(nothing, labels).count() == 0


def test_lm(docs, nothing):
    p = {r.doc_id: r for r in lm.score(docs).collect()}
    assert all(math.isfinite(r.log_prob) and r.log_prob <= 0 for r in p.values())
    assert lm.score(nothing).count() == 0


def test_lm_learns_both_sides():
    c = lm.CLASSES
    keys = np.array([(1 * c + 5) * c + 2, (3 * c + 6) * c + 4])
    logs = lm.train(keys, np.array([100, 100]))
    assert logs[1, 2].argmax() == 5 and logs[3, 4].argmax() == 6


@pytest.mark.parametrize("head", [lm.HEAD, 0])
def test_lm_scores_every_word_by_its_counts(spark, docs, corpus, head, monkeypatch):
    """Within its class every word weighs by its corpus count, also beyond the broadcast head."""
    monkeypatch.setattr(lm, "HEAD", head)
    monkeypatch.setattr(lm, "train", lambda keys, n: np.zeros((lm.CLASSES,) * 3, np.float32))
    texts = [(i, lm.words(t or "")) for i, t, *_ in corpus]
    n = Counter(w for _, ws in texts for w in ws)
    own = set(sorted(n, key=lambda w: (-n[w], w.encode()))[: lm.OWN])
    total = Counter()
    for w in n:
        total[lm.ending(w)] += n[w] * (w not in own)
    log = {w: 0.0 if w in own else math.log(n[w] / total[lm.ending(w)]) for w in n}
    want = Counter((i, len(ws), round(sum(log[w] for w in ws), 3)) for i, ws in texts)
    assert Counter((r.doc_id, r.n_tokens, round(r.log_prob, 3) + 0.0) for r in lm.score(docs).collect()) == want


TALE = "The river rose again, and the town, which had seen it before, moved its boats and waited for the night to pass."


@pytest.mark.parametrize("name", ["comment-body", "reader-comments", "user-comments", "fb-comments", "CommentThread", "related-articles", "share-tools", "gdpr-message"])
def test_html_leaves_out_furniture_within_an_article(name):
    page = "<article><h1>T</h1><p>{0}</p><p>{0}</p>{1}</article>".format
    assert html_text.main_text(page(TALE, f'<div class="{name}"><p>Nice words, dear writer, thanks.</p></div>')) == f"T\n{TALE}\n{TALE}"


@pytest.mark.parametrize(
    "part,text",
    [
        ('<section class="discussion"><h2>Discussion</h2><p>Water falls.</p></section>', "Discussion\nWater falls."),
        ('<aside class="pullquote">moved its boats</aside>', "moved its boats"),
        ("<p>Press <button>Save</button> to store it.</p>", "Press Save to store it."),
        ('<div class="has-comments"><p>The end.</p></div>', "The end."),
        ('<div class="commentary"><p>The end.</p></div>', "The end."),
    ],
)
def test_html_keeps_the_article_whole(part, text):
    assert html_text.main_text(f"<article><h1>T</h1><p>{TALE}</p>{part}</article>") == f"T\n{TALE}\n{text}"


def test_html_of_an_empty_table_and_extra_columns(spark):
    df = spark.createDataFrame([(1, "u", f"<p>{TALE}</p>", "x")], "page_id long, url string, html string, text string")
    assert [r.text for r in html_text.extract(df).collect()] == [TALE] and html_text.extract(df.limit(0)).count() == 0
