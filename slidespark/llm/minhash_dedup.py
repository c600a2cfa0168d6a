"""Near-duplicate documents by a chosen-path set similarity join.

Method: every document is the set of its word shingles. A tree sends a document down one path: at each level it
chooses the token of its set with the least hash under that tree and level, and documents that choose alike stay
together. Nodes of few documents are compared exhaustively, first with one of them, which makes copies one
component, then those that are left apart; larger nodes are branched again, LEVELS times. As many
independent trees are taken as bring the recall of a pair at the wanted similarity to RECALL, however deep its nodes go.
Nodes that are still large at the last level are compared exhaustively too, in chunks: first every chunk with
itself and the node's pivots, which makes a dense group one component; then what is outside of the node's largest
component with all chunks. Pairs that are known to be connected are left out, no others.

Pairs are confirmed on the full sets of 64-bit shingle hashes; components come from the confirmed links. Before
that, a pair's sketches of 64 bits must not differ in more bits than a pair at the similarity does but for one case in 10**7.

Equal sets are one node, known by a 64-bit hash, so exact copies are never expanded into pairs.

Edge cases: null or word-free texts have an empty set and link with nothing; texts with fewer words than a shingle
are one shingle; A-Z is lower-cased, other letters are not; repeated rows are equal sets; rows of one id are one
document; a null id is kept but never linked; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import INT, LONG, Scratch, connected, hot_join, schema, whole_texts

#: Levels, and the least chance that a pair just at the wanted similarity shares a path of all levels in some tree.
LEVELS, RECALL = 6, 0.998
#: Documents of a small node.
SMALL = 12
#: Bits of a sketch, and the chance that a pair just at the wanted similarity differs in more bits than are allowed.
BITS, LOST = 64, 1e-7
#: Documents and shingles of a large node's chunk, and pivots of a node.
CHUNK, CHUNK_TOKENS, PIVOTS = 512, 4_000_000, 4
MASK = 2**64 - 1


def trees_for(percent: int) -> int:
    """Trees that RECALL takes: 14 at 85 percent, 21 at 80."""
    path = (percent / 100) ** LEVELS
    return 1 if path >= 1 else math.ceil(math.log(1 - RECALL) / math.log1p(-path))


def bits_for(percent: int) -> int:
    """Least number of bits that all but LOST of the pairs at the similarity stay within: a bit differs with chance (1 - J) / 2."""
    p = (1 - percent / 100) / 2
    left = 1.0
    for k in range(BITS + 1):
        left -= math.comb(BITS, k) * p**k * (1 - p) ** (BITS - k)
        if left <= LOST:
            return k
    return BITS


def shingles(text: str, k: int) -> set[bytes]:
    """The exact set: shingles of k words, or the whole sequence if it is shorter."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if len(w) < k:
        return {b" ".join(w)} if w else set()
    return set(map(b" ".join, zip(*(w[i:] for i in range(k)), strict=False)))


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Hasher:
    """64-bit shingle hashes of a text, sorted; words seen before are looked up."""

    def __init__(self, k: int):
        self.k, self.seen = k, {}
        self.odd = [np.uint64((0xD6E8FEB86659FD93 * (2 * i + 3)) & MASK | 1) for i in range(k)]

    def word(self, w: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(w)
        if len(w) < 40:
            if len(self.seen) > 300_000:
                self.seen.clear()
            self.seen[w] = h
        return h

    def __call__(self, text: str) -> np.ndarray:
        w = text.encode("utf-8", "surrogatepass").lower().split()
        if not w:
            return np.empty(0, np.uint64)
        if len(w) < self.k:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(w), seed=7)], np.uint64)
        get, new = self.seen.get, self.word
        h = np.array([get(x) or new(x) for x in w], np.uint64)
        n = len(w) - self.k + 1
        s = np.zeros(n, np.uint64)
        for i, odd in enumerate(self.odd):
            s = _mix(s ^ (h[i : i + n] * odd))
        return np.unique(s)


def set_name(s: np.ndarray) -> int:
    """The 64 bits that name a set."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63


def signatures(docs: DataFrame, k: int, trees: int, levels: int = LEVELS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, sid, chosen, sketch): sid names the set; chosen holds a 32-bit token for every tree and level, sketch BITS of them."""
    odds = _mix(np.arange(1, max(trees * levels, BITS) + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) | np.uint64(1)
    weights = np.uint64(1) << np.arange(BITS, dtype=np.uint64)

    def run(batches):
        hashes = Hasher(k)
        for b in batches:
            n, sid, chosen, sketch = [], [], [], []
            for text in b.column(1).to_pylist():
                s = hashes(text)
                n.append(len(s))
                sid.append(set_name(s))
                if len(s):
                    least = np.full(len(odds), np.uint64(MASK))
                    for at in range(0, len(s), 512):  # a slice of the set under every hash at once
                        x = s[None, at : at + 512] * odds[:, None]
                        x ^= x >> np.uint64(32)
                        np.minimum(least, x.min(1), out=least)
                    least = _mix(least)
                    chosen.append((least[: trees * levels] >> np.uint64(32)).astype(np.uint32).view(np.int32))
                    sketch.append(int(((least[:BITS] & np.uint64(1)) * weights).sum()) - 2**63)
                else:
                    chosen.append(np.empty(0, np.int32))
                    sketch.append(0)
            kinds = pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int64()
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, t) for x, t in zip((n, sid, chosen, sketch), kinds, strict=True))], ["doc_id", "n_shingles", "sid", "chosen", "sketch"])

    return whole_texts(docs, id_col, text_col).mapInArrow(run, schema(doc_id=LONG, n_shingles=LONG, sid=LONG, chosen=T.ArrayType(INT), sketch=LONG))


def full_sets(docs: DataFrame, k: int, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(sid, tokens): the shingle hashes of wanted sets (sid, rep), one row a set."""

    def run(batches):
        hashes = Hasher(k)
        for b in batches:
            sets = [hashes(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([set_name(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["sid", "tokens"])

    texts = whole_texts(docs, id_col, text_col).join(wanted.select(F.col("rep").alias("doc_id")).distinct(), "doc_id").select("text")
    found = texts.mapInArrow(run, schema(sid=LONG, tokens=T.ArrayType(LONG)))
    return found.groupBy("sid").agg(F.first("tokens").alias("tokens"))


def nodes_of(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """rows (node, ..) split into those of small and of large nodes; nodes of one document are left out."""
    sizes = scratch.keep(rows.groupBy("node").agg(F.count("*").alias("size")).filter("size > 1"))
    sized = scratch.keep(hot_join(rows, sizes, ["node"], "size"))
    return sized.filter(F.col("size") <= SMALL), sized.filter(F.col("size") > SMALL)


def small_pairs(rows: DataFrame, percent: int, connect: bool) -> DataFrame:
    """Pairs (a < b) of small nodes whose set sizes and sketches allow the similarity. A node's list is at most SMALL long.

    connect: those with the node's first document; else all that are in different components (rows have comp)."""
    extra = [] if connect else ["comp"]
    lists = rows.groupBy("node").agg(F.array_sort(F.collect_set(F.struct("sid", "n", "sketch", *extra))).alias("m"))

    def allowed(p):
        x, y = p["x"], p["y"]
        ok = F.least(x["n"], y["n"]) * 100 >= F.greatest(x["n"], y["n"]) * percent
        ok = ok & (F.bit_count(x["sketch"].bitwiseXOR(y["sketch"])) <= bits_for(percent))
        return ok if connect else ok & (x["comp"] != y["comp"])

    first = F.slice("m", 1, 1) if connect else F.col("m")
    each = F.flatten(F.transform(first, lambda x, i: F.transform(F.slice("m", i + 2, SMALL), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    pairs = lists.select(F.explode(F.filter(each, allowed)).alias("p"))
    return pairs.select(F.col("p.x.sid").alias("a"), F.col("p.y.sid").alias("b")).distinct()


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link."""
    side = lambda s: sets.select(F.col("sid").alias(s), F.col("tokens").alias(f"t{s}"))
    x = pairs.join(side("a"), "a").join(side("b"), "b")
    x = x.select("a", "b", F.size(F.array_intersect("ta", "tb")).alias("inter"), (F.size("ta") + F.size("tb")).alias("sum"))
    return x.filter(F.col("inter") * 100 >= (F.col("sum") - F.col("inter")) * percent).select("a", "b")


def _blocks(percent: int):
    """Pairs of one component that join a block's documents as far as links do: side 0 with side 1, or side 0 with itself where there is no side 1."""
    most = bits_for(percent)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["side", "sid"]).drop_duplicates(["side", "sid"])
        side, sid, n, sketch = f["side"].to_numpy(), f["sid"].to_numpy(), f["n"].to_numpy(), f["sketch"].to_numpy()
        comp = np.unique(f["comp"].to_numpy(), return_inverse=True)[1]
        ids = np.unique(np.concatenate(f["tokens"].to_list()), return_inverse=True)[1]
        starts = np.r_[0, np.cumsum(n)]
        two = bool(side.max())
        mark = np.zeros(ids.max() + 1, np.int32)
        links = []
        for x in np.flatnonzero(side == 0):
            ok = (comp != comp[x]) & ((side == 1) if two else (np.arange(len(f)) > x))
            ok &= np.minimum(n, n[x]) * 100 >= np.maximum(n, n[x]) * percent
            ok &= np.bitwise_count((sketch ^ sketch[x]).view(np.uint64)) <= most
            near = np.flatnonzero(ok)
            if not len(near):
                continue
            own = ids[starts[x] : starts[x + 1]]
            mark[own] = 1
            if len(near) > len(f) // 8:
                inter = np.add.reduceat(mark[ids], starts[:-1])[near]
            else:
                inter = np.array([mark[ids[starts[y] : starts[y + 1]]].sum() for y in near])
            mark[own] = 0
            new = [x]  # one document of every component that x joins
            hits = near[inter * 100 >= (n[near] + n[x] - inter) * percent]
            for y in np.roll(hits, -int(x)).tolist():  # from another document on for every x
                if comp[y] != comp[x]:
                    new.append(y)
                    comp[comp == comp[y]] = comp[x]
            # as a binary tree rather than a star, so that no document is a hub
            links += [(sid[new[(i - 1) // 2]], sid[new[i]]) for i in range(1, len(new))]
        return pd.DataFrame(links, columns=["a", "b"], dtype=np.int64)

    return run


def with_sets(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of the blocks (node, lo, hi) of rows (sid, n, sketch, comp, side)."""
    x = rows.join(sets, "sid").select("node", "lo", "hi", "side", "sid", "n", "sketch", "comp", "tokens")
    return x.groupBy("node", "lo", "hi").applyInPandas(_blocks(percent), schema(a=LONG, b=LONG)).distinct()


def chunked(large: DataFrame) -> DataFrame:
    """rows of large nodes with their chunk and the number of chunks."""
    sizes = large.groupBy("node").agg(F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum("n") / CHUNK_TOKENS)).cast("int").alias("chunks"))
    return large.join(sizes, "node").withColumn("lo", F.pmod(F.xxhash64("sid", F.lit("chunk")), F.col("chunks")).cast("int"))


def links_within(large: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links within the chunks of large nodes and with the node's pivots."""
    drawn = [F.min(F.struct(F.xxhash64("sid", F.lit(i)).alias("h"), "sid", "n", "sketch")) for i in range(PIVOTS)]
    pivots = large.filter("chunks > 1").groupBy("node", "chunks").agg(F.array_distinct(F.array(*drawn)).alias("p"))
    pivots = pivots.select("node", "chunks", F.explode("p").alias("p"))
    pivots = pivots.select("node", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("lo"), "p.sid", "p.n", "p.sketch")
    rows = large.select("node", "lo", "sid", "n", "sketch").unionByName(pivots)
    return with_sets(rows.select("*", F.lit(0).alias("hi"), F.lit(0).alias("side"), F.col("sid").alias("comp")), sets, percent)


def links_across(large: DataFrame, comps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between the chunks of large nodes that are still in several components: all rows with those outside of the largest."""
    rows = large.filter("chunks > 1").join(comps, "sid")
    most = rows.groupBy("node", "comp").agg(F.count("*").alias("c")).groupBy("node").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.count("*").alias("parts"), (F.sum("c") - F.max("c")).alias("rest"))
    most = most.filter("parts > 1").select("node", "main", F.ceil(F.col("rest") / CHUNK).cast("int").alias("lots"))
    rows = rows.join(most, "node").drop("hi")
    every = F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("hi")
    right = rows.select("node", "lo", every, F.lit(1).alias("side"), "sid", "n", "sketch", "comp")
    rest = rows.filter("comp <> main").withColumn("hi", F.pmod(F.xxhash64("sid", F.lit("lot")), F.col("lots")).cast("int"))
    left = rest.select("node", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("lo"), "hi", F.lit(0).alias("side"), "sid", "n", "sketch", "comp")
    return with_sets(left.unionByName(right), sets, percent)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document.

    Documents link if 100 * |intersection| >= percent * |union| of their sets of k-word shingles.
    """
    scratch = Scratch(docs.sparkSession, "minhash-dedup")
    n_trees = trees_for(percent)
    sig = scratch.keep(signatures(docs, k, n_trees, id_col=id_col, text_col=text_col))
    named = sig.filter("n_shingles > 0 and doc_id is not null")
    sets = named.groupBy("sid").agg(
        F.count("*").alias("copies"), F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"), F.first("chosen").alias("chosen")
    )
    sets = scratch.keep(sets)
    path = F.transform(F.sequence(F.lit(0), F.lit(n_trees - 1)), lambda t: F.slice("chosen", t * LEVELS + 1, LEVELS))
    rows = sets.select("sid", "n", "sketch", F.posexplode(path).alias("tree", "path"))
    rows = rows.select(F.xxhash64("tree", F.get("path", 0)).alias("node"), "sid", "n", "sketch", "path")
    small, large = None, None
    for level in range(LEVELS):
        few, many = nodes_of(rows if level + 1 < LEVELS else rows.drop("path"), scratch)
        few = few.select("node", "sid", "n", "sketch")
        small = few if small is None else small.union(few)
        large = many.drop("size")
        if level + 1 < LEVELS:
            rows = large.withColumn("node", F.xxhash64("node", F.get("path", level + 1)))
    large = scratch.keep(chunked(large))
    pair = scratch.keep(small_pairs(small, percent, connect=True))
    same_doc = named.groupBy("doc_id").agg(F.min("sid").alias("a"), F.max("sid").alias("b"), F.collect_set("sid").alias("all")).filter("a <> b").select("a", F.explode("all").alias("b")).filter("a <> b")

    def with_tokens(pairs, nodes):
        """Full sets of the documents that are to be compared."""
        wanted = pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).union(nodes.select("sid")).distinct()
        return scratch.keep(full_sets(docs, k, sets.select("sid", "rep").join(wanted, "sid"), id_col, text_col))

    nodes = sets.select(F.col("sid").alias("id"))
    full = with_tokens(pair, large)
    links = scratch.keep(confirm(pair, full, percent).union(links_within(large, full, percent)).union(same_doc))
    comp = connected(nodes, links, scratch)
    # what the first comparisons left apart
    apart = scratch.keep(comp.withColumnRenamed("id", "sid").withColumnRenamed("component", "comp"))
    pair = scratch.keep(small_pairs(small.join(apart, "sid"), percent, connect=False))
    open_ = large.filter("chunks > 1")
    if not (pair.isEmpty() and open_.isEmpty()):
        full = with_tokens(pair, open_)
        more = scratch.keep(confirm(pair, full, percent).union(links_across(large, apart, full, percent)))
        if not more.isEmpty():
            comp = connected(nodes, links.union(more), scratch)
    comp = comp.select(F.col("id").alias("sid"), F.col("component").alias("comp"))
    of_set = sets.select("sid", "rep", "copies").join(comp, "sid")
    least = of_set.groupBy("comp").agg(F.min("rep").alias("component"))
    of_set = scratch.keep(of_set.join(least, "comp").select("sid", "copies", "component"))
    out = hot_join(named.select("doc_id", "n_shingles", "sid"), of_set, ["sid"], "copies").select("doc_id", "n_shingles", F.col("component").alias("component_id"), (F.col("doc_id") == F.col("component")).alias("kept"))
    alone = sig.filter("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return out.unionByName(alone)
