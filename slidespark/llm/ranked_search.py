"""Ranked lexical search: the k best documents of every query under an integer BM25, by range maxima over posting lists.

Method: ``build`` writes an index of all terms: documents are gathered into blocks where they are read, shortest first,
and a block has for each of its terms a posting list (document, occurrences). ``search`` takes the lists of the
queries' terms block by block. Over the impacts of each list lies a sparse table of range maxima, so that the greatest impact within
any interval of documents is read from two entries. A query starts with the whole block as one interval, bounded by the
sum of its terms' maxima. Of the open intervals those of greatest bound, AT_ONCE in a step, are split each at the
document of its greatest single impact; that document is scored, and the two intervals beside it are bounded anew. A
query ends when no bound reaches its k-th score.
The first wave takes one of WAVE blocks, by a hash; its k-th scores are where the second wave, the other blocks, starts
from, so few intervals of those need a split. The result is exact.

Impact of a term in a document: w * ((10^9 tf) div (1000 tf + 12 m)), m = 75 + (25 n N) div L, w = floor(1000 ln((2N + 2)
/ (2 df + 1))), over the counts of all documents.

Queries are gathered in passes of at most PASS_TERMS (query, term) pairs on average, each in its own run over the index; the pairs
of a pass are what is sent to tasks.

Edge cases: null and empty texts have no terms, count in no figure and are never found; a query without terms, or only
such that no document has, finds nothing; rows that repeat an id are documents, or queries, of their own, each query row with ranks of
its own; documents of equal score come by ascending id, those without id last; very long texts are counted whole; empty
tables give no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from heapq import heappop, heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BIN, INT, LONG, Scratch, schema

#: Documents and terms, with repeats, of a block at most (one document may have more); one of WAVE blocks is searched first.
BLOCK_DOCS, BLOCK_TERMS, WAVE = 4096, 1_000_000, 16
#: Intervals of greatest bound that are split in one step.
AT_ONCE = 8
#: (query, term) pairs of a pass.
PASS_TERMS = 200_000

# fixed values: ASCII letters, lower-cased, digits and every byte above make terms; all else separates them
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))

POSTINGS = schema(block=LONG, term=BIN, docs=T.ArrayType(INT, False), tfs=T.ArrayType(INT, False))
DOCS = schema(block=LONG, ids=T.ArrayType(LONG, True), lens=T.ArrayType(LONG, False))


def terms(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text."""
    return text.translate(_TABLE).split()


def _texts(col: pa.Array) -> list[bytes]:
    return [v or b"" for v in col.cast(pa.binary()).to_pylist()]


def lists_of(docs: list[pa.Array]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Posting lists of tokenized documents: terms, where each list begins (and the end), documents and occurrences."""
    codes = pa.concat_arrays(docs).dictionary_encode()
    doc = np.repeat(np.arange(len(docs), dtype=np.int64), [len(d) for d in docs])
    keys, tfs = np.unique(codes.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(docs) + doc, return_counts=True)
    starts = np.searchsorted(keys, np.arange(len(codes.dictionary) + 1) * len(docs))
    return codes.dictionary, starts, (keys % max(len(docs), 1)).astype(np.int32), tfs.astype(np.int32)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list[pa.Array]]]:
    """(block, ids, tokenized documents) of a task's rows, shortest documents first; documents without terms are left out."""
    number, ids, docs, size = TaskContext.get().partitionId() << 32, [], [], 0

    def closed() -> tuple[int, list, list]:
        order = sorted(range(len(docs)), key=lambda i: len(docs[i]))
        return number, [ids[i] for i in order], [docs[i] for i in order]

    for b in batches:
        for i, text in zip(b.column(0).to_pylist(), _texts(b.column(1)), strict=True):
            if found := terms(text):
                if docs and (len(docs) == BLOCK_DOCS or size + len(found) > BLOCK_TERMS):
                    yield closed()
                    number, ids, docs, size = number + 1, [], [], 0
                ids.append(i)
                docs.append(pa.array(found, pa.binary()))
                size += len(found)
    if docs:
        yield closed()


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of both kinds: a block's posting lists, and one row without term for its ids and lengths."""
    for number, ids, docs in _blocks(batches):
        words, starts, doc, tfs = lists_of(docs)
        n = len(words)
        lens = pa.array([[len(d) for d in docs]], pa.list_(pa.int64()))
        at = pa.array(starts, pa.int32())
        none = lambda k, kind: pa.nulls(k, pa.list_(kind))
        cols = [
            pa.array([number] * (n + 1), pa.int64()),
            pa.concat_arrays([words.cast(pa.binary()), pa.nulls(1, pa.binary())]),
            pa.concat_arrays([pa.ListArray.from_arrays(at, pa.array(doc)), none(1, pa.int32())]),
            pa.concat_arrays([pa.ListArray.from_arrays(at, pa.array(tfs)), none(1, pa.int32())]),
            pa.concat_arrays([none(n, pa.int64()), pa.array([ids], pa.list_(pa.int64()))]),
            pa.concat_arrays([none(n, pa.int64()), lens]),
        ]
        names = ["block", "term", "docs", "tfs", "ids", "lens"]
        whole = pa.RecordBatch.from_arrays(cols, names)
        for start in range(0, n + 1, 10_000):
            yield whole.slice(start, 10_000)


def build(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index, written: (block, term, docs, tfs, ids, lens), ids and lens in the rows without term."""
    ints, longs = T.ArrayType(INT), T.ArrayType(LONG)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return scratch.keep(rows.mapInArrow(_index, schema(block=LONG, term=BIN, docs=ints, tfs=ints, ids=longs, lens=longs)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        query, words, n = [], [], []
        for i, text in zip(b.column(0).to_pylist(), _texts(b.column(1)), strict=True):
            counts: dict[bytes, int] = {}
            for w in terms(text):
                counts[w] = counts.get(w, 0) + 1
            query += [i] * len(counts)
            words += counts
            n += counts.values()
        yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(words, pa.binary()), pa.array(n, pa.int64())], ["query", "term", "n"])


class Ranges:
    """Posting lists of one block with a sparse table of range maxima over their impacts."""

    def __init__(self, starts: np.ndarray, docs: np.ndarray, impacts: np.ndarray, n_docs: int):
        n, sizes = len(impacts), np.diff(starts)
        self.starts, self.docs, self.n_docs = starts, docs, n_docs
        self.impacts = np.append(impacts, 0)
        self.keys = np.append(docs + np.repeat(np.arange(len(sizes)), sizes) * n_docs, -1)
        longest = int(sizes.max(initial=1))
        # best[j, i]: the greatest impact of i .. i + 2^j - 1, and where[j, i] its place; entries that cross the end of a list are never read
        best, where = np.tile(self.impacts, (longest.bit_length(), 1)), np.tile(np.arange(n + 1, dtype=np.int32), (longest.bit_length(), 1))
        for j in range(1, len(best)):
            a, b = slice(None, -(2 ** (j - 1))), slice(2 ** (j - 1), None)
            later = best[j - 1, b] > best[j - 1, a]
            best[j, a] = np.where(later, best[j - 1, b], best[j - 1, a])
            where[j, a] = np.where(later, where[j - 1, b], where[j - 1, a])
        self.best, self.where = best.ravel(), where.ravel()
        # by size of a range: its row in the tables, and the width of the two entries that cover it
        log = np.frexp(np.maximum(np.arange(longest + 1), 1))[1].astype(np.int64) - 1
        self.row, self.width = log * (n + 1), 2**log

    def maxima(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The greatest impact of each range low .. high - 1; 0 for an empty one."""
        size = high - low
        row = self.row[size]
        return np.maximum(self.best[row + low], self.best[row + high - self.width[size]]) * (size > 0)

    def peaks(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Where the greatest impact of each range low .. high - 1 is; none is empty."""
        row, width = self.row[high - low], self.width[high - low]
        a, b = self.where[row + low], self.where[row + high - width]
        return np.where(self.impacts[b] > self.impacts[a], b, a)

    def search(self, lists: np.ndarray, times: np.ndarray, ids: list, k: int, floor: int) -> list[tuple[int, int]]:
        """(score, document) of the k best by score and id that have floor or more; lists are the query's, times its occurrences of them."""
        heap: list = []
        top: list[tuple] = []  # (score, negative id, document), least first
        floor, made = max(floor, 1), 0
        base = lists * self.n_docs
        low, high = self.starts[lists][None], self.starts[lists + 1][None]
        while True:
            values = self.maxima(low, high) * times
            for i, bound in enumerate(values.sum(1).tolist()):
                if bound >= floor:
                    heappush(heap, (-bound, made, values[i], low[i], high[i]))
                    made += 1
            split = []
            while heap and len(split) < AT_ONCE and -heap[0][0] >= floor:
                split.append(heappop(heap)[2:])
            if not split:
                break
            value, lo, hi = map(np.stack, zip(*split, strict=True))
            each, term = np.arange(len(split)), value.argmax(1)
            doc = self.docs[self.peaks(lo[each, term], hi[each, term])]
            want = base + doc[:, None]
            pos = np.searchsorted(self.keys[:-1], want)
            hit = self.keys[pos] == want
            for d, score in zip(doc.tolist(), (self.impacts[pos] * hit * times).sum(1).tolist(), strict=True):
                if score >= floor:
                    entry = (score, -math.inf if ids[d] is None else -ids[d], d)
                    if len(top) < k:
                        heappush(top, entry)
                    elif entry > top[0]:
                        heapreplace(top, entry)
                    if len(top) == k:
                        floor = max(floor, top[0][0])
            low, high = np.concatenate([lo, pos + hit]), np.concatenate([pos, hi])
        self.made = made
        return [(s, d) for s, _, d in top]


def _searcher(queries: list[tuple[int, list[bytes], np.ndarray]], weights: dict[bytes, int], n: int, total: int, floors: dict[int, int], k: int) -> Callable[[tuple, pa.Table], pa.Table]:
    def run(_key: tuple, t: pa.Table) -> pa.Table:
        head = t.filter(pa.compute.is_null(t["term"]))
        ids, lens = head["ids"][0].as_py(), np.array(head["lens"][0].values, dtype=np.int64)
        t = t.filter(pa.compute.is_valid(t["term"]))
        out: tuple[list, list, list] = [], [], []
        words = t["term"].to_pylist()
        if words:
            docs, tfs = t["docs"].combine_chunks(), t["tfs"].combine_chunks()
            starts = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(docs).to_numpy(zero_copy_only=False))]).astype(np.int64)
            doc, tf = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (docs, tfs))
            w = np.repeat(np.array([weights[x] for x in words], dtype=np.int64), np.diff(starts))
            m = 75 + (25 * lens * n) // total
            ranges = Ranges(starts, doc, w * ((10**9 * tf) // (1000 * tf + 12 * m[doc])), len(lens))
            place = {x: i for i, x in enumerate(words)}
            for query, names, times in queries:
                have = [(place[x], c) for x, c in zip(names, times, strict=True) if x in place]
                if have:
                    got = ranges.search(*np.array(have, dtype=np.int64).T, ids, k, floors.get(query, 0))
                    out[0].extend([query] * len(got))
                    out[1].extend(ids[d] for _, d in got)
                    out[2].extend(s for s, _ in got)
        return pa.table({"query": pa.array(out[0], pa.int64()), "doc_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.int64())})

    return run


def _pass(index: DataFrame, pairs: DataFrame, n: int, total: int, k: int, scratch: Scratch) -> DataFrame:
    """(query, doc_id, score) of the k best of the queries of one pass."""
    words = pairs.select("term").distinct()
    counts = index.filter("term is not null").join(F.broadcast(words), "term", "left_semi").groupBy("term").agg(F.sum(F.size("docs")).alias("df"))
    weights = {bytes(r.term): math.floor(1000 * math.log((2 * n + 2) / (2 * r.df + 1))) for r in counts.collect()}
    queries: dict[int, tuple[int, list, list]] = {}
    for r in pairs.collect():
        if bytes(r.term) in weights:
            q = queries.setdefault(r.query, (r.query, [], []))
            q[1].append(bytes(r.term))
            q[2].append(r.n)
    each = list(queries.values())
    use = index.filter("term is null").unionByName(index.filter("term is not null").join(F.broadcast(words), "term", "left_semi"))
    first = F.pmod(F.xxhash64("block"), F.lit(WAVE)) == 0
    best = W.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    kept, floors = [], {}
    for wave in (first, ~first):
        got = use.filter(wave).groupBy("block").applyInArrow(_searcher(each, weights, n, total, floors, k), schema(query=LONG, doc_id=LONG, score=LONG))
        got = scratch.keep(got.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k))
        kept.append(got)
        floors = {r.query: r.score for r in got.filter(F.col("rank") == k).collect()}
    both = kept[0].unionByName(kept[1])
    return both.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def search(index: DataFrame, queries: DataFrame, k: int, scratch: Scratch, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every query, those of score 0 left out."""
    rows = scratch.keep(queries.select(F.monotonically_increasing_id().alias("query"), F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("text")))
    pairs = scratch.keep(rows.select("query", "text").mapInArrow(_count, schema(query=LONG, term=BIN, n=LONG)))
    lens = index.filter("term is null").select(F.size("lens").alias("n"), F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))
    n, total = lens.agg(F.sum("n"), F.sum("total")).first()
    passes = math.ceil(pairs.count() / PASS_TERMS) if n else 0
    found = None
    for p in range(passes):
        mine = pairs.filter(F.pmod(F.xxhash64("query"), F.lit(passes)) == p) if passes > 1 else pairs
        got = scratch.keep(_pass(index, mine, n, total, k, scratch))
        found = got if found is None else found.unionByName(got)
    if found is None:
        found = pairs.sparkSession.createDataFrame([], schema(query=LONG, doc_id=LONG, score=LONG, rank=INT))
    return found.join(rows.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")


#: The contract's query in DuckDB's SQL.
SQL = r"""
WITH t AS (SELECT doc_id, row_number() OVER () AS r, unnest(regexp_extract_all(translate(text,'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'),'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
c AS (SELECT doc_id, r, term, count(*) AS tf FROM t GROUP BY ALL),
n AS (SELECT r, sum(tf)::BIGINT AS n FROM c GROUP BY r),
g AS (SELECT count(*) AS nn, sum(n)::BIGINT AS l FROM n),
df AS (SELECT term, count(*) AS df FROM c GROUP BY term),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(text,'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'),'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT item_id, c.r, any_value(c.doc_id) AS doc_id,
  sum(CAST(floor(1000*ln((2*nn+2)/(2*df+1))) AS BIGINT)*((1000000000*tf)//(1000*tf+12*(100-25+(25*n.n*nn)//l))))::BIGINT AS score
  FROM q JOIN df USING (term) JOIN c ON c.term = q.term JOIN n ON n.r = c.r CROSS JOIN g GROUP BY item_id, c.r),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 20
"""
