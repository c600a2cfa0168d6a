"""The pipeline's stages and the chain of them against plain Python on a small folder."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline as P
from slidespark.llm import minhash_dedup, mixing
from slidespark.llm.common import table

tokenizers = pytest.importorskip("tokenizers")
COLS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(21)
    vocab = ["".join(rnd.choice("abcdefgéñ") for _ in range(rnd.randrange(3, 9))) for _ in range(1500)]
    words = lambda n: [rnd.choice(vocab) for _ in range(n)]
    rows, lab = [], []
    for i in range(240):
        w = words(rnd.randrange(20, 120))
        if i % 6 == 0:
            w[2:2] = ["vile", "scum"]
        rows.append([i, " ".join(w)])
        if i % 4:
            lab.append((i, int(i % 5 > 0), int(i % 6 == 0)))
    passage = " ".join(words(60))
    rows += [[300, rows[1][1]], [301, rows[1][1] + " more"], [302, passage + " " + " ".join(words(30))], [303, " ".join(words(40)) + "\n" + passage]]
    rows += [[304, rows[5][1]], [304, rows[5][1]], [None, " ".join(w := words(50))], [None, " ".join(w)], [305, None], [306, ""]]
    return [(i, t, "en", "s", len(t or "")) for i, t in rows], lab


@pytest.fixture(scope="module")
def folder(spark, corpus, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(corpus[0], COLS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(corpus[1], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_toxicity_stage(spark, folder, corpus):
    docs = table(spark, folder, "documents")
    got = P.toxicity_stage(spark, docs, folder)
    assert got.columns == docs.columns
    ids = {r.doc_id for r in got.collect()}
    toxic = {i for i, t, *_ in corpus[0] if t and "vile" in t}
    assert not ids & toxic and ids == {i for i, *_ in corpus[0]} - toxic


def kept_by_minhash(rows):
    sets = [minhash_dedup.shingles(t or "", 5) for _, t, *_ in rows]
    key = [(i is None, t or "") if i is None else (False, i) for i, t, *_ in rows]
    group = {k: k for k in key}

    def find(k):
        while group[k] != k:
            k = group[k]
        return k

    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if i < j and a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((find(key[i]), find(key[j])), key=lambda k: (k[0], str(k[1]).zfill(9)))
                group[y] = x
    return Counter((r[0], r[1]) for r in {(r[0], r[1]): r for k, r in zip(key, rows, strict=True) if find(k) == k}.values())


def test_minhash_stage(spark, folder, corpus):
    docs = table(spark, folder, "documents")
    got = P.minhash_stage(spark, docs, folder)
    assert got.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in got.collect()) == kept_by_minhash(corpus[0])


def cut(texts, n=200):
    raws, seen = [(t or "").encode() for t in texts], Counter()
    for b in raws:
        seen.update(b[i : i + n] for i in range(len(b) - n + 1))
    out = []
    for b, t in zip(raws, texts, strict=True):
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - n + 1):
            if seen[b[k : k + n]] > 1:
                gone[k : k + n] = True
        out.append(t if not gone.any() else bytes(x for x, g in zip(b, gone, strict=True) if not g).decode(errors="ignore"))
    return out


def test_suffix_stage(spark, folder, corpus):
    docs = table(spark, folder, "documents")
    got = P.suffix_stage(spark, docs, folder)
    assert got.columns == docs.columns
    want = cut([t for _, t, *_ in corpus[0]])
    assert Counter((r.doc_id, r.text, r.n_chars) for r in got.collect()) == Counter((r[0], t, None if t is None else len(t)) for r, t in zip(corpus[0], want, strict=True))


def test_mixing_stage(spark, folder, corpus):
    docs = table(spark, folder, "documents").filter("doc_id is not null").dropDuplicates(["doc_id"])
    copies = {r.doc_id: r.copies for r in mixing.mix(docs, table(spark, folder, "labels")).collect()}
    got = Counter(r.doc_id for r in P.mixing_stage(spark, docs, folder).collect())
    assert got == Counter({i: n for i, n in copies.items() if n})


def test_bpe_stage(spark, folder, corpus):
    from slidespark.llm.queries import vocabulary

    t = tokenizers.Tokenizer.from_file(vocabulary())
    got = Counter((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in P.bpe_stage(spark, table(spark, folder, "documents"), folder).collect())
    want = Counter()
    for i, text, *_ in corpus[0]:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want[i, len(ids), np.array(ids, "<u4").tobytes(), t.decode(ids, skip_special_tokens=False)] += 1
    assert got == want


def test_chain(spark, folder, corpus, tmp_path):
    """The first three stages one after the other equal plain Python; run() encodes what they and the mixing leave."""
    docs = table(spark, folder, "documents")
    for k, (name, stage) in enumerate(P.STAGES[:3]):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    rows = [r for r in corpus[0] if not (r[1] and "vile" in r[1])]
    rows = list(kept_by_minhash(rows).elements())
    want = defaultdict(set)
    for (i, _), t in zip(rows, cut([t for _, t in rows]), strict=True):
        want[i].add(t)
    assert {r.doc_id for r in docs.collect()} == set(want)
    assert all(r.text in want[r.doc_id] for r in docs.collect())
    ids = {r.doc_id for r in P.run(spark, folder).collect()}
    assert ids <= set(want) and len(ids) > 100


def test_empty_folder(spark, tmp_path):
    spark.createDataFrame([], COLS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = table(spark, str(tmp_path), "documents")
    for _, stage in P.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0


def test_minhash_stage_passes_map_columns(spark, folder):
    docs = table(spark, folder, "documents").selectExpr("*", "map(source, n_chars) AS extra")
    got = P.minhash_stage(spark, docs, folder)
    assert got.columns == docs.columns and got.count() == P.minhash_stage(spark, docs.drop("extra"), folder).count()
