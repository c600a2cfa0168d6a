"""Language-model scores by masked pseudo-likelihood.

Method: a network predicts every token from the tokens on both of its sides, with a factored output: the network gives
the class, which is the word itself for the most frequent and the word's ending for all others, and a word's probability within
its class comes from the corpus counts, whatever its rank. So context tells rarer words apart by their ending only. The network (two class embeddings, tanh, softmax) is
trained in numpy on the counts of (left, token, right) classes of the whole corpus, which are its sufficient
statistics and of a fixed size. A document's score is the sum of its tokens' conditional log probabilities.

What is gathered: counts of all words, a table that grows with the corpus, and at most CLASSES ** 3 class counts.
The HEAD most frequent words are broadcast, which only saves a shuffle: every other word of a document is joined
to the table of counts, so scores do not depend on HEAD.

Edge cases: words of equal count rank by their bytes; null and word-free texts have no tokens and score 0; single words are predicted from the text's ends;
very long texts are scored in slices with their neighbours; repeated rows count and are scored as rows; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import DBL, INT, LONG, STR, Scratch, schema, whole_texts

#: Words that are broadcast (OWN at least), classes (own words, endings), width of the network, training steps.
HEAD, OWN, ENDINGS = 20_000, 63, 24
EDGE = OWN + ENDINGS  # the class before the first and after the last token
CLASSES = EDGE + 1
WIDTH, STEPS, LEARN = 32, 200, 0.05
#: Log probabilities of joined words are summed as whole numbers of this part, so sums do not depend on the order of rows.
UNIT = 1e-9


def words(text: str) -> list[str]:
    return text.lower().split()


def word_counts(docs: DataFrame) -> DataFrame:
    def run(batches):
        have: Counter[str] = Counter()

        def out():
            keys = list(have)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([have[k] for k in keys], pa.int64())], ["word", "n"])
            have.clear()

        for b in batches:
            for t in b.column(0).to_pylist():
                have.update(words(t))
            if len(have) > 200_000:
                yield from out()
        yield from out()

    return docs.select("text").mapInArrow(run, schema(word=STR, n=LONG)).groupBy("word").agg(F.sum("n").alias("n"))


def ending(word: str) -> int:
    return OWN + zlib.crc32(word[-2:].encode()) % ENDINGS


def ending_of(word: Column) -> Column:
    """The same in SQL."""
    return F.lit(OWN) + F.crc32(F.encode(F.right(word, F.lit(2)), "UTF-8")) % ENDINGS


def class_totals(counts: DataFrame, own: list[tuple[str, int]]) -> dict[int, int]:
    """Tokens of every ending's class over all words of the corpus, the own words' left out."""
    total = Counter({r.cls: r.n for r in counts.groupBy(ending_of(F.col("word")).alias("cls")).agg(F.sum("n").alias("n")).collect()})
    for w, n in own:
        total[ending(w)] -= n
    return dict(total)


def most_frequent(counts: DataFrame, k: int) -> list[tuple[str, int]]:
    """The k words of the highest counts, ties by word. Counts by powers of two (64 rows at most) say where to cut, so that
    only words about as frequent as the k-th are sorted, whatever the number of partitions."""
    power = F.floor(F.log2("n")).cast("int")
    sizes = dict(counts.groupBy(power.alias("p")).agg(F.count("*").alias("c")).collect())
    have, cut = 0, 0
    for p in sorted(sizes, reverse=True):
        have, cut = have + sizes[p], p
        if have >= k:
            break
    return [tuple(r) for r in counts.filter(F.col("n") >= 2**cut).orderBy(F.desc("n"), "word").limit(k).collect()]


class Lexicon:
    """Class of every word, and log probability within the class of the most frequent."""

    def __init__(self, head: list[tuple[str, int]], total: dict[int, int]):
        self.known = {w: (i, 0.0) if i < OWN else (ending(w), math.log(n / total[ending(w)])) for i, (w, n) in enumerate(head)}

    def __call__(self, ws: list[str]) -> tuple[np.ndarray, float, Counter[str]]:
        """Classes with the edges, the sum over words of the head, and counts of the other words."""
        get = self.known.get
        c, s, other = np.empty(len(ws) + 2, np.int64), 0.0, Counter()
        c[0] = c[-1] = EDGE
        for i, w in enumerate(ws, 1):
            k = get(w)
            if k is None:
                c[i] = ending(w)
                other[w] += 1
            else:
                c[i] = k[0]
                s += k[1]
        return c, s, other


def context_counts(docs: DataFrame, lexicon) -> DataFrame:
    """(key, n): key packs the classes left, token, right."""

    def run(batches):
        lex, have = lexicon.value, np.zeros(CLASSES**3, np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                c, *_ = lex(words(t))
                if len(c) > 2:
                    key = (c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:]
                    if len(key) > 20_000:
                        have += np.bincount(key, minlength=len(have))
                    else:
                        np.add.at(have, key, 1)
        at = np.flatnonzero(have)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(have[at])], ["key", "n"])

    return docs.select("text").mapInArrow(run, schema(key=LONG, n=LONG)).groupBy("key").agg(F.sum("n").alias("n"))


def train(keys: np.ndarray, n: np.ndarray, seed: int = 1) -> np.ndarray:
    """Log probabilities [left, right, token] of the trained network; full-batch Adam on the class counts."""
    rng = np.random.default_rng(seed)
    left, token, right = keys // CLASSES**2, keys // CLASSES % CLASSES, keys % CLASSES
    seen, at = np.unique(left * CLASSES + right, return_inverse=True)
    sl, sr = seen // CLASSES, seen % CLASSES
    y = np.zeros((len(seen), CLASSES), np.float32)
    np.add.at(y, (at, token), n.astype(np.float32))
    y /= max(float(y.sum()), 1.0)
    mass = y.sum(1, keepdims=True)
    share = np.bincount(token, n, CLASSES) + 1
    p = {"l": rng.normal(0, 0.3, (CLASSES, WIDTH)), "r": rng.normal(0, 0.3, (CLASSES, WIDTH)), "u": rng.normal(0, 0.1, (WIDTH, CLASSES)), "c": np.log(share / share.sum())}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))

    def forward(a, b):
        h = np.tanh(p["l"][a] + p["r"][b])
        z = h @ p["u"] + p["c"]
        z -= z.max(1, keepdims=True)
        return h, z - np.log(np.exp(z).sum(1, keepdims=True))

    for step in range(1, STEPS + 1):
        h, logs = forward(sl, sr)
        d = np.exp(logs) * mass - y
        g = {"u": h.T @ d, "c": d.sum(0), "l": np.zeros_like(p["l"]), "r": np.zeros_like(p["r"])}
        dh = (d @ p["u"].T) * (1 - h * h)
        np.add.at(g["l"], sl, dh)
        np.add.at(g["r"], sr, dh)
        for k in p:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
            p[k] -= LEARN * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    a, b = np.divmod(np.arange(CLASSES**2), CLASSES)
    return forward(a, b)[1].reshape(CLASSES, CLASSES, CLASSES).astype(np.float32)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, log_prob, per_token) of every document; per_token is null for texts without tokens."""
    scratch = Scratch(docs.sparkSession, "lm")
    rows = whole_texts(docs, id_col, text_col)
    sc = docs.sparkSession.sparkContext
    corpus = scratch.keep(word_counts(rows))
    head = most_frequent(corpus, max(HEAD, OWN))
    totals = class_totals(corpus, head[:OWN])
    lexicon = sc.broadcast(Lexicon(head, totals))
    counts = np.array([tuple(r) for r in context_counts(rows, lexicon).collect()], np.int64).reshape(-1, 2)
    counts = counts[np.argsort(counts[:, 0])]
    table = sc.broadcast(train(counts[:, 0], counts[:, 1]))

    def run(batches):
        lex, logs = lexicon.value, table.value
        for b in batches:
            n, total, other, times = [], [], [], []
            for t in b.column(1).to_pylist():
                c, s, o = lex(words(t))
                n.append(len(c) - 2)
                total.append(s + float(logs[c[:-2], c[2:], c[1:-1]].sum(dtype=np.float64)) if len(c) > 2 else 0.0)
                other.append(list(o))
                times.append(list(o.values()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(total, pa.float64()), pa.array(other, pa.list_(pa.string())), pa.array(times, pa.list_(pa.int32()))],
                ["doc_id", "n_tokens", "log_prob", "other", "times"],
            )

    fields = schema(doc_id=LONG, n_tokens=LONG, log_prob=DBL, other=T.ArrayType(STR), times=T.ArrayType(INT))
    # ids may repeat or be null: rows are numbered, and the numbers are written before anything is joined by them
    part = scratch.keep(rows.mapInArrow(run, fields).withColumn("row", F.monotonically_increasing_id()))
    pairs = part.select("row", F.explode(F.arrays_zip("other", "times")).alias("w")).select("row", F.col("w.other").alias("word"), F.col("w.times").alias("times"))
    total_of = F.element_at(F.create_map(*(F.lit(x) for k in sorted(totals) for x in (k, totals[k]))), ending_of(F.col("word"))) if totals else F.lit(1)
    unit = F.round(F.log(F.col("n") / total_of) / UNIT).cast("long")
    sums = pairs.join(corpus, "word").groupBy("row").agg(F.sum(F.col("times") * unit).alias("units"))
    out = part.select("row", "doc_id", "n_tokens", "log_prob").join(sums, "row", "left")
    out = out.select("doc_id", "n_tokens", (F.col("log_prob") + F.coalesce("units", F.lit(0)) * UNIT).alias("log_prob"))
    return out.withColumn("per_token", F.col("log_prob") / F.nullif(F.col("n_tokens"), F.lit(0)))
