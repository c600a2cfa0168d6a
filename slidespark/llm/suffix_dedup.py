"""Exact removal of long repeated passages by distributed prefix doubling.

Method: positions of all texts are ranked by growing prefixes, and a position stays in the race only while its
rank is shared, until its prefix passes the threshold.

1. First rank: 40-byte prefixes. A 200-byte string holds a position whose hash is the least of its 161 prefixes,
   the same one wherever the string starts; only these positions are ranked. Those whose rank is unique end here.
2. Second rank: each surviving position with all the threshold-long strings around it that chose it, as one
   block. Equal blocks are repeats as a whole and go on as one.
3. Last rank: within a first rank that still holds different blocks, every string of threshold length. Small
   ranks are compared in sorted runs inside tasks. Large ones are cut into cells of neighbouring offsets, whose
   strings share a prefix that grows as cells are halved twice a round, and shuffled by its rank: cells alone
   with it leave, equal cells are settled as runs, so a hot rank meets no single task.

Positions that no string chooses are left out because a pair of position and rank for every byte would alone be
16 times the input. Ranks are fingerprints (64 bits a rank, combined over ranks) that are built by doubling and compared without
the bytes; Spark groups them, counting is map-side combined, and ranks that many positions share are joined by broadcast. Whole texts that equal another are known by their text key; they are repeats as a whole.

Edge cases: null texts are empty; texts shorter than the threshold are kept whole; overlapping occurrences and
occurrences within one document count; rows of one text, null ids and repeated ids included, get equal results;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BIN, BOOL, INT, LONG, STR, Scratch, hot_join, schema, whole_texts

SEED_LEN = 40
#: Blocks of a first rank that are compared within a task.
IN_TASK = 512
#: Bytes of texts that are ranked together, few enough for a processor's cache.
CHUNK = 1 << 16
#: Windows that are searched for their least rank at once.
SEARCHED = 4096
#: Offsets of a cell, round by round, where a first rank has more blocks.
WIDTHS = (64, 16, 4, 1)
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * _M1
    return x ^ (x >> np.uint64(29))


def prefix_ranks(b: bytes, length: int) -> np.ndarray:
    """Fingerprints of all substrings of one length, by doubling: a rank of 2h bytes from the ranks at i and i + h."""
    cur, h, acc, done = _BYTE[np.frombuffer(b, np.uint8)], 1, None, 0
    rest = length
    while True:
        if rest & 1:
            if acc is None:
                acc, done = cur, h
            else:
                n = len(b) - done - h + 1
                acc, done = _mix(acc[:n] * _M2 + cur[done : done + n]), done + h
        rest >>= 1
        if not rest:
            return acc
        n = len(b) - 2 * h + 1
        cur, h = _mix(cur[:n] * _M1 + cur[h : h + n]), 2 * h


def _sliding(a: np.ndarray, w: int) -> np.ndarray:
    """Minima of all windows of w."""
    cur, h = a, 1
    while 2 * h <= w:
        cur, h = np.minimum(cur[:-h], cur[h:]), 2 * h
    return np.minimum(cur[: len(cur) - (w - h)], cur[w - h :]) if h < w else cur


def chosen(raw: bytes, start: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, position, rank, first, last) of the positions that some string of threshold length chooses, rightmost least
    rank, and the first and last start of the strings that do.

    raw holds texts of threshold bytes at least, one after the other, which begin at start; strings across two are left
    out. Places are those in raw."""
    ranks = prefix_ranks(raw, SEED_LEN)
    w = threshold - SEED_LEN + 1
    least = _sliding(ranks, w)
    stop = np.r_[start[1:], len(raw)] - threshold + 1  # where the strings that begin in a text end
    # the choice moves only where a rank as small enters on the right or the chosen one leaves on the left
    enters = ranks[w - 1 :] == least
    moves = enters.copy()
    moves[1:] |= least[1:] != least[:-1]
    moves[start] = True
    moves[stop[:-1]] = True
    cut = np.flatnonzero(moves)
    end = np.r_[cut[1:], len(least)] - 1
    text = np.searchsorted(start, cut, side="right") - 1
    inside = cut < stop[text]
    text, cut, end = text[inside], cut[inside], end[inside]
    where = cut + w - 1
    left = np.flatnonzero(~enters[cut])
    windows = np.lib.stride_tricks.sliding_window_view(ranks, w)
    for at in range(0, len(left), SEARCHED):
        i = left[at : at + SEARCHED]
        where[i] -= np.argmax(windows[cut[i], ::-1] == least[cut[i], None], axis=1)
    return text, where, ranks[where], cut, end


def _chunks(texts: list[str]) -> Iterator[tuple[slice, bytes, np.ndarray]]:
    """(rows, their bytes, where each begins) of neighbouring texts of about CHUNK bytes together, or of one."""
    at, held, size = 0, [], 0
    for i, text in enumerate(texts, 1):
        held.append(text.encode())
        size += len(held[-1])
        if size >= CHUNK or i == len(texts):
            yield slice(at, i), b"".join(held), np.cumsum([0, *map(len, held[:-1])])
            at, held, size = i, [], 0


def _i64(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def text_keys(docs: DataFrame) -> DataFrame:
    """(doc_id, text, k1, k2, n_bytes): 96 bits that name a text."""
    t = F.col("text")
    return docs.select("doc_id", "text", F.xxhash64(t).alias("k1"), F.hash(t).alias("k2"), F.octet_length(t).cast("long").alias("n_bytes"))


def seeds(rows: DataFrame, threshold: int) -> DataFrame:
    """(rank, k1, at): chosen positions of every text; at holds k2 and the position."""

    def run(batches):
        for b in batches:
            out = [[], [], []]
            k1, k2 = (b.column(i).to_numpy().astype(np.int64) for i in (1, 2))
            for rows, raw, start in _chunks(b.column(0).to_pylist()):
                i, p, r, _, _ = chosen(raw, start, threshold)
                out[0].append(_i64(r))
                out[1].append(k1[rows][i])
                out[2].append((k2[rows][i] << 32) | (p - start[i]))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["rank", "k1", "at"])

    return rows.filter(F.col("n_bytes") >= threshold).select("text", "k1", "k2").mapInArrow(run, schema(rank=LONG, k1=LONG, at=LONG))


def _place(c) -> list:
    return [F.shiftright(c, 32).cast("int").alias("k2"), c.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("p")]


def blocks(texts: DataFrame, threshold: int) -> DataFrame:
    """(rank, block, k1, at, low, high, twice) for surviving positions whose strings hold survivors only.

    A string that starts d before its position is at offset d; low..high are the position's offsets."""

    def run(batches):
        for b in batches:
            out = [[] for _ in range(7)]
            k1, k2 = (b.column(i).to_numpy().astype(np.int64) for i in (0, 1))
            seen, twice = b.column(3).to_pylist(), b.column(4).to_numpy(zero_copy_only=False)
            for rows, raw, start in _chunks(b.column(2).to_pylist()):
                i, p, r, first, last = chosen(raw, start, threshold)
                keep = np.isin(p, np.concatenate([np.array(x, np.int64) + at for x, at in zip(seen[rows], start, strict=True)]))
                i, p, r, first, last = i[keep], p[keep], r[keep], first[keep], last[keep]
                # a block is named by hashes of its first and last strings and of a sum over all of them
                strings = prefix_ranks(raw, threshold)
                run_sum = np.r_[np.uint64(0), np.cumsum(_mix(strings), dtype=np.uint64)]
                total = run_sum[last + 1] - run_sum[first]
                low, high = p - last, p - first
                name = _mix(_mix(_mix(strings[first] * _M2 + strings[last]) * _M1 + total) * _M2 + (low * 1024 + high).astype(np.uint64))
                out[0].append(_i64(r))
                out[1].append(_i64(name))
                out[2].append(k1[rows][i])
                out[3].append((k2[rows][i] << 32) | (p - start[i]))
                out[4].append(low.astype(np.int32))
                out[5].append(high.astype(np.int32))
                out[6].append(twice[rows][i])
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["rank", "block", "k1", "at", "low", "high", "twice"])

    cols = texts.select("k1", "k2", "text", "seen", "twice")
    return cols.mapInArrow(run, schema(rank=LONG, block=LONG, k1=LONG, at=LONG, low=INT, high=INT, twice=BOOL))


def cells_of(need: DataFrame, texts: DataFrame, threshold: int, width: int) -> DataFrame:
    """(rank, block, k1, k2, p, low, high, again, cell, core, name): the offsets of each block cut into cells of ``width``.

    core is the rank of the bytes that all strings of a cell hold, a prefix that grows as cells get narrower; name
    stands for all strings low..high that the block has in the cell."""
    fields = ["rank", "block", "k1", "k2", "p", "low", "high", "again", "cell", "core", "name"]
    per_text = need.groupBy("k1", "k2").agg(F.collect_list(F.struct("rank", "block", "p", "low", "high", "again")).alias("need"))

    def run(batches):
        for b in batches:
            out = [[] for _ in fields]
            for k1, k2, text, need in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                raw = text.encode()
                strings, cores = prefix_ranks(raw, threshold), prefix_ranks(raw, threshold - width + 1)
                run_sum = np.r_[np.uint64(0), np.cumsum(_mix(strings), dtype=np.uint64)]
                cut = [np.arange(x["low"] // width, x["high"] // width + 1) for x in need]
                times = [len(c) for c in cut]
                rank, block, p, low, high = (np.repeat(np.array([x[f] for x in need], np.int64), times) for f in ("rank", "block", "p", "low", "high"))
                again = np.repeat(np.array([x["again"] for x in need], bool), times)
                cell = np.concatenate(cut)
                low, high = np.maximum(low, cell * width), np.minimum(high, cell * width + width - 1)
                total = run_sum[p - low + 1] - run_sum[p - high]
                name = _mix(_mix(_mix(strings[p - high] * _M2 + strings[p - low]) * _M1 + total) * _M2 + (low * 1024 + high).astype(np.uint64))
                n, i32 = len(cell), np.int32
                row = [rank, block, np.full(n, k1, np.int64), np.full(n, k2, i32), p.astype(i32), low.astype(i32), high.astype(i32), again, cell.astype(i32), _i64(cores[p - cell * width]), _i64(name)]
                for o, c in zip(out, row, strict=True):
                    o.append(c)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], fields)

    joined = texts.select("k1", "k2", "text").join(per_text, ["k1", "k2"]).select("k1", "k2", "text", "need")
    kinds = schema(rank=LONG, block=LONG, k1=LONG, k2=INT, p=INT, low=INT, high=INT, again=BOOL, cell=INT, core=LONG, name=LONG)
    return joined.mapInArrow(run, kinds)


def shared_by_cells(need: DataFrame, texts: DataFrame, threshold: int, scratch: Scratch) -> DataFrame:
    """(rank, block, a, b): runs of offsets whose strings another block of the rank holds, for ranks of any size.

    Cells are ranked by growing prefixes. Those with a rank of their own leave; equal cells are repeats as a whole
    and go on as one; the others are cut into narrower cells, at last single strings."""
    found = []
    for width in (w for w in WIDTHS if w == 1 or w < threshold - SEED_LEN):
        cells = scratch.keep(cells_of(need, texts, threshold, width))
        by = ["rank", "cell", "core"]
        kinds = cells.groupBy(*by, "name").agg(F.count("*").alias("n"), F.max("again").alias("again"), F.min(F.struct("block", "k1", "k2", "p", "low", "high")).alias("x"))
        kinds = scratch.keep(kinds.select(*by, "name", "n", (F.col("again") | (F.col("n") > 1)).alias("again"), "x.*"))
        # blocks that are repeats as a whole lend their strings and need no verdict
        equal = scratch.keep(kinds.filter("n > 1").select(*by, "name", "n"))
        found.append(scratch.keep(hot_join(cells.filter("not again"), equal, [*by, "name"], "n").select("rank", "block", F.col("low").alias("a"), F.col("high").alias("b"))))
        open_ = scratch.keep(kinds.groupBy(*by).agg(F.count("*").alias("names"), F.min("again").alias("settled")).filter("names > 1 and not settled"))
        need = scratch.keep(hot_join(kinds, open_, by, "names").select("rank", "block", "k1", "k2", "p", "low", "high", "again"))
        scratch.drop(cells, kinds)
        if need.isEmpty():
            break
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return out


def packed_strings(need: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """(rank, block, low, high, bytes): the bytes that hold a block's strings."""
    per_text = need.groupBy("k1", "k2").agg(F.collect_list(F.struct("rank", "block", "p", "low", "high")).alias("need"))

    def run(batches):
        for b in batches:
            rows = []
            for text, need in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = text.encode()
                rows += [(x["rank"], x["block"], x["low"], x["high"], raw[x["p"] - x["high"] : x["p"] - x["low"] + threshold]) for x in need]
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["rank", "block", "low", "high", "bytes"])

    joined = texts.select("k1", "k2", "text").join(per_text, ["k1", "k2"]).select("text", "need")
    return joined.mapInArrow(run, schema(rank=LONG, block=LONG, low=INT, high=INT, bytes=BIN))


def shared_in_task(packed: DataFrame, threshold: int) -> DataFrame:
    """(rank, block, a, b): runs of offsets a..b whose strings another block of the rank holds. A rank is whole in a task."""

    def settle(rows):
        # all blocks' bytes in a row: their strings are ranked together, those across two blocks are left out
        low, high = (np.array([r[i] for r in rows], np.int64) for i in (2, 3))
        n = high - low + 1
        every = prefix_ranks(b"".join(r[4] for r in rows), threshold)
        begin = np.cumsum(n + threshold - 1) - (n + threshold - 1)
        owner = np.repeat(np.arange(len(rows)), n)
        d = np.arange(n.sum()) - (np.cumsum(n) - n - low)[owner]  # by growing offset
        strings = every[(begin + high)[owner] - d]
        ranks = np.array([r[0] for r in rows], np.int64)[owner]
        key = _mix(_mix(strings + ranks.view(np.uint64) * _M2) * _M1 + d.astype(np.uint64))
        order = np.argsort(key, kind="stable")
        k = key[order]
        same = np.r_[False, k[1:] == k[:-1]]
        same[:-1] |= same[1:]
        hit = np.zeros(len(key), bool)
        hit[order] = same
        owner, d = owner[hit], d[hit]
        if not len(d):
            return None
        start = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (d[1:] != d[:-1] + 1)])
        stop = np.r_[start[1:], len(d)] - 1
        who = owner[start]
        cols = [pa.array([rows[i][0] for i in who], pa.int64()), pa.array([rows[i][1] for i in who], pa.int64()), pa.array(d[start].astype(np.int32)), pa.array(d[stop].astype(np.int32))]
        return pa.RecordBatch.from_arrays(cols, ["rank", "block", "a", "b"])

    def run(batches):
        held = []
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            held += rows
            last = held[-1][0] if held else None
            full = [r for r in held if r[0] != last]  # the last rank may go on in the next batch
            if len(full) >= 2000:
                held = [r for r in held if r[0] == last]
                if (out := settle(full)) is not None:
                    yield out
        if held and (out := settle(held)) is not None:
            yield out

    return packed.repartition("rank").sortWithinPartitions("rank").mapInArrow(run, schema(rank=LONG, block=LONG, a=INT, b=INT))


def removed(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """(k1, k2, n_removed, n_spans, kept, kept_text, spans) of texts with repeats that are not repeats as a whole."""

    def run(batches):
        for b in batches:
            rows = []
            for k1, k2, text, spans in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                raw = text.encode()
                gone = np.zeros(len(raw) + 1, np.int64)
                for x in spans:
                    gone[x["from"]] += 1
                    gone[x["to"]] -= 1
                gone = np.cumsum(gone[:-1]) > 0
                edge = np.flatnonzero(np.diff(np.r_[0, gone.view(np.int8), 0]))
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                rows.append((k1, k2, int(gone.sum()), len(edge) // 2, kept, kept.decode(errors="ignore"), edge.tolist()))
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["k1", "k2", "n_removed", "n_spans", "kept", "kept_text", "spans"])

    joined = texts.select("k1", "k2", "text").join(spans, ["k1", "k2"]).select("k1", "k2", "text", "found")
    return joined.mapInArrow(run, schema(k1=LONG, k2=INT, n_removed=LONG, n_spans=LONG, kept=BIN, kept_text=STR, spans=T.ArrayType(LONG)))


def find_repeats(docs: DataFrame, threshold: int = 200, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(base, found): base (doc_id, k1, k2, n_bytes, copies) of every row; found (k1, k2, n_removed, n_spans, kept
    bytes, spans as from, to, from, to ..) of texts with repeated parts that are not copies as a whole."""
    scratch = Scratch(docs.sparkSession, "suffix-dedup")
    rows = text_keys(whole_texts(docs, id_col, text_col))
    first = scratch.keep(seeds(rows, threshold))
    # rank 1: unique prefixes leave
    shared = scratch.keep(first.groupBy("rank").agg(F.count("*").alias("c")).filter("c > 1"))
    seen = hot_join(first, shared, ["rank"], "c").select("k1", *_place(F.col("at"))).groupBy("k1", "k2").agg(F.collect_set("p").alias("seen"))
    seen = scratch.keep(seen)
    base = scratch.keep(rows.select("doc_id", "k1", "k2", "n_bytes"))
    copies = base.groupBy("k1", "k2").agg(F.count("*").alias("copies"))
    one = rows.select("k1", "k2", "text").groupBy("k1", "k2").agg(F.first("text").alias("text"), (F.count("*") > 1).alias("twice"))
    texts = scratch.keep(one.join(seen, ["k1", "k2"]))
    scratch.drop(first)
    # rank 2: blocks
    found = scratch.keep(blocks(texts, threshold))
    kinds = found.groupBy("rank", "block").agg(F.min(F.struct("k1", "at", "low", "high")).alias("x"), F.max(F.struct("k1", "at")).alias("y"), F.max("twice").alias("twice"), F.count("*").alias("times"))
    again = F.col("twice") | (F.col("x.k1") != F.col("y.k1")) | (F.col("x.at") != F.col("y.at"))
    kinds = scratch.keep(kinds.select("rank", "block", "x.k1", *_place(F.col("x.at")), "x.low", "x.high", "times", again.alias("again")))
    sizes = kinds.groupBy("rank").agg(F.count("*").alias("size"), F.min("again").alias("all_again")).filter("size > 1 and not all_again")
    need = scratch.keep(hot_join(kinds.drop("times"), scratch.keep(sizes), ["rank"], "size").drop("all_again"))
    # rank 3: strings
    few = shared_in_task(packed_strings(need.filter(F.col("size") <= IN_TASK), texts, threshold), threshold)
    many = shared_by_cells(need.filter(F.col("size") > IN_TASK), texts, threshold, scratch)
    verdict = few.union(many).union(kinds.filter("again").select("rank", "block", F.col("low").alias("a"), F.col("high").alias("b")))
    # a block's runs in one row, one for each of its offsets at most
    verdict = verdict.groupBy("rank", "block").agg(F.collect_list(F.struct("a", "b")).alias("runs"))
    verdict = scratch.keep(verdict.join(kinds.select("rank", "block", "times"), ["rank", "block"]))
    at = found.filter("not twice").select("rank", "block", "k1", *_place(F.col("at")))
    run = lambda x: F.struct((F.col("p") - x["b"]).alias("from"), (F.col("p") - x["a"] + threshold).alias("to"))
    spans = hot_join(at, verdict, ["rank", "block"], "times").select("k1", "k2", F.transform("runs", run).alias("s"))
    spans = spans.groupBy("k1", "k2").agg(F.flatten(F.collect_list("s")).alias("found"))
    out = scratch.keep(removed(texts, spans))
    scratch.drop(texts, found, kinds, need, verdict, seen)
    return hot_join(base, scratch.keep(copies), ["k1", "k2"], "copies"), out


def dedup_digest(docs: DataFrame, threshold: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, k1, k2) of every document."""
    base, out = find_repeats(docs, threshold, id_col, text_col)
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= threshold)
    short = out.select("k1", "k2", "n_removed", "n_spans", F.sha2("kept", 256).alias("sha"))
    sha = text_keys(whole_texts(docs, id_col, text_col)).select("k1", "k2", F.sha2("text", 256).alias("all_sha")).dropDuplicates(["k1", "k2"])
    of_text = base.groupBy("k1", "k2").agg(F.max("copies").alias("of")).join(sha, ["k1", "k2"]).join(short, ["k1", "k2"], "left")
    x = hot_join(base, Scratch(docs.sparkSession, "suffix-dedup").keep(of_text), ["k1", "k2"], "of")
    return x.select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("sha", "all_sha")).alias("kept_sha256"),
    )


def dedup_texts(docs: DataFrame, threshold: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every repeated passage cut from text_col; where a cut splits a character, its rest goes too.

    The other columns and the number of rows are unchanged; a text that is repeated as a whole becomes empty."""
    base, out = find_repeats(docs, threshold, id_col, text_col)
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= threshold)
    of_text = base.groupBy("k1", "k2").agg(F.max("copies").alias("copies"), F.max("n_bytes").alias("n_bytes")).join(out.select("k1", "k2", "kept_text"), ["k1", "k2"], "left")
    of_text = Scratch(docs.sparkSession, "suffix-dedup").keep(of_text.select("k1", "k2", "copies", F.when(whole, "").otherwise(F.col("kept_text")).alias("kept")))
    t = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64(t).alias("k1"), F.hash(t).alias("k2"))
    x = hot_join(rows, of_text, ["k1", "k2"], "copies")
    return x.select(*(F.coalesce("kept", F.col("row")[c]).alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns))
