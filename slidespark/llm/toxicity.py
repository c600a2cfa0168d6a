"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Method: a bounded, class-stratified sample of labelled documents is the set of examples. Every word of an example is
a term; a document's vector weighs a term by (1 + log tf) * idf * r, with document frequencies over all documents
and r = (c / (c + CHANCE)) ** 2 for the term's chi-square c between the classes of the examples, so words that say nothing
of the class weigh little, and no term is left out. Words that no example has say nothing of it and weigh 0.
The examples form an inverted index: every term's posting list is cut into blocks of example slots with the
block's largest weight. A document visits blocks in the order of their upper bounds and stops once the bound of the
next cannot reach its k-th neighbour, so the neighbours are exact. Examples that tie at the k-th place share what is
left of the k places, whatever their label. Votes weigh by squared similarity, corrected for the sample's class
shares and shrunk towards the labelled share; a logistic curve fitted on the examples, each scored without itself and its
equals, turns them into calibrated scores. The nearest examples are the evidence.

Bounds: MAX_EXAMPLES examples of MAX_CHARS characters together; the broadcast index is bounded by these.

Edge cases: null and empty texts, and texts without a term of any example, get the calibrated labelled share; labels
that are null are ignored, several labels of a document count as toxic if one is; labels of documents that are not
there are ignored; with labels of one class or none every score is the toxic share of the labels (0 without any);
repeated documents are scored row by row; very long texts are scored whole; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import DBL, INT, LONG, STR, Scratch, held_out, least_hashes, schema, whole_texts

#: Documented bounds of the fitted classifier.
MAX_EXAMPLES, MAX_CHARS = 4000, 32_000_000
#: Chi-square that chance alone may reach: with a million candidates about 24.
CHANCE = 25.0
BLOCK, FIRST, NEAREST, EVIDENCE = 128, 4, 24, 8
#: Similarities closer than this tie.
TIE = 1e-6
WORDS = re.compile(r"[^\W\d_]+").findall


class Bag:
    """Terms of a text and their counts."""

    def __init__(self, terms: dict[str, int]):
        self.terms = terms

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        c = Counter(WORDS(text.lower()))
        t = np.fromiter(map(self.terms.get, c, repeat(-1)), np.int64, len(c))
        known = t >= 0
        return t[known], np.fromiter(c.values(), np.int64, len(c))[known]


def _gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of all ranges starts[i] .. starts[i] + sizes[i], one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes - starts, sizes)


class Index:
    """Block-max inverted index. A term's postings lie by slot; its blocks are those that hold any of them."""

    def __init__(self, bags: list[tuple[np.ndarray, np.ndarray]], ids: list[int], labels: list[int], weight: np.ndarray):
        self.weight = weight
        vecs = [self.vector(b) for b in bags]
        # alike examples share blocks: by strongest term
        order = sorted(range(len(bags)), key=lambda i: (int(vecs[i][0][np.argmax(vecs[i][1])]) if len(vecs[i][0]) else -1, ids[i]))
        self.slots = -(-max(len(bags), 1) // BLOCK) * BLOCK
        self.ids = np.array([ids[i] for i in order] + [-1] * (self.slots - len(order)), np.int64)
        self.labels = np.array([labels[i] for i in order] + [0] * (self.slots - len(order)), np.int8)
        term = np.concatenate([vecs[i][0] for i in order] or [np.empty(0, np.int64)])
        slot = np.repeat(np.arange(len(order)), [len(vecs[i][0]) for i in order])
        w = np.concatenate([vecs[i][1] for i in order] or [np.empty(0)])
        by = np.lexsort((slot, term))
        term, self.slot, self.w = term[by], slot[by].astype(np.int32), w[by].astype(np.float32)
        at = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (self.slot[1:] // BLOCK != self.slot[:-1] // BLOCK)]) if len(term) else np.empty(0, np.int64)
        self.post = np.r_[at, len(term)]  # postings of a block of a list
        self.block = self.slot[at] // BLOCK
        self.most = np.maximum.reduceat(self.w, at) if len(at) else np.empty(0, np.float32)
        self.first = np.searchsorted(term[at] if len(at) else term, np.arange(len(weight) + 1))  # blocks of a term

    def vector(self, bag: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Terms that weigh anything and their unit-length weights."""
        t, n = bag
        w = (1 + np.log(n)) * self.weight[t]
        t, w = t[w > 0], w[w > 0]
        length = math.sqrt(float(w @ w))
        return t, w / length if length else w

    def nearest(self, bag: tuple[np.ndarray, np.ndarray], k: int = NEAREST, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(slots, similarities, shares) of the k most similar examples, by similarity and slot; ties at the k-th place share it."""
        t, q = self.vector(bag)
        lo, size = self.first[t], self.first[t + 1] - self.first[t]
        at = _gather(lo, size)
        block, times = self.block[at], np.repeat(q, size)
        bounds = np.bincount(block, times * self.most[at], self.slots // BLOCK)
        order = np.argsort(-bounds, kind="stable")
        order = order[bounds[order] > 0]
        slots, sims, floor = [np.empty(0, np.int64)], [np.empty(0)], 0.0
        # the most promising blocks give a floor; of the others only those that may reach it are visited
        for visit in (order[:FIRST], order[FIRST:]):
            now = np.zeros(len(bounds), bool)
            now[visit[bounds[visit] >= floor - TIE]] = True
            on = np.flatnonzero(now[block])
            if not len(on):
                continue
            part = at[on]
            sizes = self.post[part + 1] - self.post[part]
            p = _gather(self.post[part], sizes)
            s = np.bincount(self.slot[p], self.w[p] * np.repeat(times[on], sizes), self.slots)
            if skip is not None:
                s[skip] = 0
            hit = np.flatnonzero(s > max(floor - TIE, 0))
            slots.append(hit)
            sims.append(s[hit])
            every = np.concatenate(sims)
            if len(every) >= k:
                floor = float(np.partition(every, len(every) - k)[len(every) - k])
        slots, sims = np.concatenate(slots), np.concatenate(sims)
        keep = np.flatnonzero(sims >= floor - TIE)
        keep = keep[np.lexsort((slots[keep], -sims[keep]))]
        slots, sims = slots[keep], sims[keep]
        share = np.ones(len(sims))
        if len(sims) > k:
            last = np.abs(sims - floor) <= TIE
            share[last] = (k - int((~last).sum())) / int(last.sum())
        return slots, sims, share


def sample_labels(labels: DataFrame, n: int) -> DataFrame:
    """(doc_id, toxic) of at most n train rows, half of them toxic if there are as many, in hash order."""
    rows = train_labels(labels)
    take = lambda y, k: least_hashes(rows.filter(F.col("toxic") == y), k, "examples", "doc_id")
    return take(1, n // 2).union(take(0, n - n // 2)).select("doc_id", "toxic")


def train_labels(labels: DataFrame) -> DataFrame:
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    return rows.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))


class Classifier:
    """Fitted scorer: ``score(bag) -> (score, neighbour ids)``."""

    def __init__(self, terms: dict[str, int], index: Index | None, weight: tuple[float, float], prior: float):
        self.terms, self.index, self.weight, self.prior, self.curve = terms, index, weight, prior, (0.0, 1.0)

    def vote(self, bag, skip: np.ndarray | None = None) -> tuple[float, list[int]]:
        slots, sims, share = self.index.nearest(bag, skip=skip) if self.index else (np.empty(0, np.int64),) * 3
        if not len(slots):
            return self.prior, []
        # the nearer, the heavier: squared similarity
        s = sims**2 * share
        y = self.index.labels[slots]
        pos, neg = self.weight[1] * float(s[y == 1].sum()), self.weight[0] * float(s[y == 0].sum())
        mass = 0.25 * min(self.weight)
        return (pos + mass * self.prior) / (pos + neg + mass), self.index.ids[slots[:EVIDENCE]].tolist()

    def score(self, bag) -> tuple[float, list[int]]:
        v, near = self.vote(bag)
        return (curve(np.array([v]), *self.curve)[0] if self.index else self.prior), near


def _logit(v: np.ndarray) -> np.ndarray:
    v = np.clip(v, 1e-4, 1 - 1e-4)
    return np.log(v / (1 - v))


def curve(v: np.ndarray, a: float, b: float) -> np.ndarray:
    return 1 / (1 + np.exp(-(a + b * _logit(v))))


def calibrate(v: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Logistic curve of the vote's logit by Newton steps, with a weak pull towards the vote itself."""
    x, a, b = _logit(v), 0.0, 1.0
    w = w / w.sum() * len(w)
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a + b * x)))
        g = np.array([(w * (y - p)).sum() - a, (w * (y - p) * x).sum() - (b - 1)])
        h = w * p * (1 - p)
        m = np.array([[h.sum() + 1, (h * x).sum()], [(h * x).sum(), (h * x * x).sum() + 1]])
        step = np.linalg.solve(m, g)
        a, b = a + step[0], max(b + step[1], 0.05)
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def relevance(n0: np.ndarray, n1: np.ndarray, of0: int, of1: int) -> np.ndarray:
    """(c / (c + CHANCE)) ** 2 for the chi-square c, with continuity correction, of terms that n0 and n1 of the classes' examples hold."""
    n = of0 + of1
    off = np.maximum(np.abs(n1 * (of0 - n0) - n0 * (of1 - n1)) - n / 2, 0.0)
    chi = n * off**2 / np.maximum((n0 + n1) * (n - n0 - n1) * of0 * of1, 1.0)
    return (chi / (chi + CHANCE)) ** 2


def word_counts(sample: DataFrame) -> pa.Table:
    """(word, n0, n1): documents of either class that hold each word of the examples; bounded as they are."""

    def run(batches):
        have: dict[str, list[int]] = {}
        for b in batches:
            for y, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for w in set(WORDS(text.lower())):
                    have.setdefault(w, [0, 0])[y] += 1
        keys = list(have)
        for i in range(0, len(keys), 50_000):
            part = keys[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *(pa.array([have[x][y] for x in part], pa.int64()) for y in (0, 1))], ["word", "n0", "n1"])

    counts = sample.select("toxic", "text").mapInArrow(run, schema(word=STR, n0=LONG, n1=LONG))
    return counts.groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()


def bags_of(sample: DataFrame, names: dict[str, int]) -> pa.Table:
    """(doc_id, toxic, t, n) of the examples by id: the numbers of their terms and how often each occurs."""
    held = sample.sparkSession.sparkContext.broadcast(names)

    def run(batches):
        bag = Bag(held.value)
        for b in batches:
            t, n = zip(*(bag(x) for x in b.column(2).to_pylist()), strict=True) if b.num_rows else ((), ())
            lists = (pa.array([x.astype(np.int32) for x in c], pa.list_(pa.int32())) for c in (t, n))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *lists], ["doc_id", "toxic", "t", "n"])

    ints = T.ArrayType(INT)
    return sample.select("doc_id", "toxic", "text").mapInArrow(run, schema(doc_id=LONG, toxic=INT, t=ints, n=ints)).toArrow().sort_by("doc_id")


def small_table(spark: SparkSession, rows: list[tuple], **kinds: pa.DataType) -> DataFrame:
    """rows as a table. Made of Arrow arrays, as a list of rows would start Python workers of another kind on every executor."""
    return spark.createDataFrame(pa.table({k: pa.array(c, t) for (k, t), c in zip(kinds.items(), zip(*rows, strict=True), strict=True)}))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", examples: int = MAX_EXAMPLES) -> Classifier:
    """Fit on train labels. What reaches the driver: the words of at most ``examples`` documents with their counts, and the documents as numbers of words."""
    texts = whole_texts(docs, id_col, text_col)
    shares = dict(train_labels(labels).groupBy("toxic").count().collect())
    prior = shares.get(1, 0) / max(sum(shares.values()), 1)
    picked = [tuple(r) for r in sample_labels(labels, examples).collect()]
    none = Classifier({}, None, (1.0, 1.0), prior)
    if not picked:
        return none
    spark = docs.sparkSession
    chosen = F.broadcast(small_table(spark, picked, doc_id=pa.int64(), toxic=pa.int32()))
    # one text of an id that repeats, the least; whole texts, in hash order, as far as MAX_CHARS goes
    there = texts.join(chosen, "doc_id")
    sizes = there.groupBy("doc_id").agg(F.min(F.struct(F.length("text").alias("n"), F.xxhash64("text").alias("h"))).alias("x")).select("doc_id", "x.n", "x.h").collect()
    order = {d: i for i, (d, _) in enumerate(picked)}
    left, keep = MAX_CHARS, []
    for r in sorted(sizes, key=lambda r: order[r.doc_id] % max(examples // 2, 1)):
        if r.n <= left:
            left -= r.n
            keep.append((r.doc_id, r.h))
    if not keep:
        return none
    which = F.broadcast(small_table(spark, keep, doc_id=pa.int64(), h=pa.int64()))
    sample = there.withColumn("h", F.xxhash64("text")).join(which, ["doc_id", "h"])
    sample = Scratch(spark, "toxicity").keep(sample.dropDuplicates(["doc_id"]).select("doc_id", "toxic", "text"))
    of = dict(sample.groupBy("toxic").count().collect())
    of = [of.get(0, 0), of.get(1, 0)]
    if not all(of):
        return none
    found = word_counts(sample)
    rel = relevance(*(found.column(c).to_numpy().astype(np.float64) for c in ("n0", "n1")), *of)
    # words that weigh nothing need no place in the index
    words = [w for w, r in zip(found.column("word").to_pylist(), rel, strict=True) if r > 0]
    names = {w: i for i, w in enumerate(words)}
    df, total = frequencies(texts, names)
    weight = (np.log((total + 1) / (df + 1)) + 0.1) * rel[rel > 0]
    got = bags_of(sample, names)
    ids, labels = got.column("doc_id").to_pylist(), got.column("toxic").to_pylist()
    bags = list(zip(*([np.asarray(x.values, np.int64) for x in got.column(c)] for c in ("t", "n")), strict=True))
    index = Index(bags, ids, labels, weight)
    model = Classifier(names, index, ((1 - prior) / of[0], prior / of[1]), prior)
    # calibration: every example without itself and those with its words
    same: dict[tuple, list[int]] = {}
    slot_of = {int(d): i for i, d in enumerate(index.ids) if d >= 0}
    key = [hash((b[0].tobytes(), b[1].tobytes())) for b in bags]
    for d, k in zip(ids, key, strict=True):
        same.setdefault(k, []).append(slot_of[d])
    held = spark.sparkContext.broadcast((model, bags, [np.array(same[k]) for k in key]))
    spans = spark.range(0, len(ids), 1, max(1, min(32, len(ids) // 100)))

    def votes(batches):
        m, b, skip = held.value
        for x in batches:
            at = x.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array([m.vote(b[i], skip[i])[0] for i in at], pa.float64())], ["i", "v"])

    v = spans.mapInArrow(votes, schema(i=LONG, v=DBL)).toArrow().sort_by("i").column("v").to_numpy()
    y = np.array(labels, np.float64)
    model.curve = calibrate(v, y, np.where(y > 0, model.weight[1], model.weight[0]))
    return model


def frequencies(texts: DataFrame, names: dict[str, int]) -> tuple[np.ndarray, int]:
    """Document frequency of the terms and number of documents, over all rows."""
    held = texts.sparkSession.sparkContext.broadcast(names)

    def count(batches):
        terms, have, n = held.value, np.zeros(len(held.value) + 1, np.int64), 0
        for b in batches:
            for x in b.column(0).to_pylist():
                have[[terms[w] for w in set(WORDS(x.lower())) if w in terms]] += 1
                n += 1
        have[-1] = n
        at = np.flatnonzero(have)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(have[at], pa.int64())], ["t", "n"])

    got = texts.select("text").mapInArrow(count, schema(t=LONG, n=LONG)).groupBy("t").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(names) + 1)
    out[got.column("t").to_numpy()] = got.column("n").to_numpy()
    return out[:-1], int(out[-1])


def score(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, score, neighbours[, extra columns of the input]) of every document; neighbours: the nearest example ids."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    fields = T.StructType([T.StructField("doc_id", LONG), T.StructField("score", DBL), T.StructField("neighbours", T.ArrayType(LONG)), *(docs.schema[c] for c in extra)])

    def run(batches):
        m = held.value
        bag = Bag(m.terms)
        for b in batches:
            got = [m.score(bag(x)) for x in b.column(1).to_pylist()]
            s, near = zip(*got, strict=True) if got else ((), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array(near, pa.list_(pa.int64())), *b.columns[2:]], fields.names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *(F.col(c) for c in extra))
    if extra and len({*fields.names}) < len(fields.names):
        raise ValueError(f"extra columns clash with the result's: {extra}")
    return rows.mapInArrow(run, fields)
