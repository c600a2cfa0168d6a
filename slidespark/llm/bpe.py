"""BPE encoding and decoding with a public vocabulary file.

Method: every pre-token is a doubly linked list of symbols; a priority queue holds (merge rank, position) of
neighbouring pairs. The lowest rank is merged first, leftmost on ties; entries whose symbols have changed since
they were pushed are stale and skipped. Decoding concatenates the vocabulary strings of the ids.

Edge cases: a null or empty text has no ids and decodes to the empty string; repeated rows are encoded row by
row; text in any script, control characters and very long words are encoded whole (a word of n symbols costs
n log n); strings of special tokens in a text become the special ids, as the library does by default. Other
columns of the input are not read.
"""

from __future__ import annotations

import json
import struct
import unicodedata
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BIN, LONG, STR, schema, whole_texts

#: Words kept in a worker's cache, and the longest word kept.
CACHE_WORDS, CACHE_LEN = 250_000, 32
#: White_Space, which str.split() exceeds by four control characters.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
OTHER_SPACE, SPACE = regex.compile("[\x1c-\x1f]").search, regex.compile(f"[^{WHITE}]+").findall


def byte_chars() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte: printable Latin-1 bytes stand for
    themselves, the rest follow from U+0100 in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b if b in own else extra))
        extra += b not in own
    return out


class Model:
    """Vocabulary, merges and pattern of one tokenizer file; ``ids`` maps a word to its packed ids and is a cache."""

    def __init__(self, spec: str):
        d = json.loads(spec)
        m = d["model"]
        self.vocab: dict[str, int] = m["vocab"]
        end = self.end = m.get("end_of_word_suffix") or ""
        pairs = (tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in m["merges"])
        v = self.vocab
        self.merges = {(v[a], v[b]): (rank, v[a + b]) for rank, (a, b) in enumerate(pairs)}
        chars = byte_chars()
        self.first = [v.get(c) for c in chars]
        self.last = [v.get(c + end) for c in chars]
        self.strings = {i: s for s, i in v.items()} | {t["id"]: t["content"] for t in d["added_tokens"]}
        self.special = {t["content"]: np.uint32(t["id"]).tobytes() for t in d["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        split = next(x for x in d["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        # the file's engine takes only White_Space for \\s
        self.words = regex.compile(split["pattern"]["Regex"].replace(r"[^\s", f"[^{WHITE}")).findall
        self.ids: dict[str, bytes] = {}  # by chunk
        self.known: dict[str, bytes] = {}  # by word

    def word(self, w: str) -> bytes:
        """Ids of one pre-token as little-endian uint32."""
        known = self.known.get(w)
        if known is not None:
            return known
        raw = w.encode("utf-8", "surrogatepass")
        first = self.first
        sym = [first[b] for b in raw]
        sym[-1] = self.last[raw[-1]]
        if None in sym:
            sym = [s for s in sym if s is not None]
        n, get = len(sym), self.merges.get
        heap = []
        for i, pair in enumerate(zip(sym, sym[1:])):  # noqa: B905
            if m := get(pair):
                heap.append((m[0], i, pair, m[1]))
        if heap:
            heapify(heap)
            after, before = list(range(1, n + 1)), list(range(-1, n - 1))
            while heap:
                _, i, (a, b), new = heappop(heap)
                if sym[i] != a or (j := after[i]) >= n or sym[j] != b:
                    continue  # stale
                sym[i], sym[j] = new, -1
                after[i] = k = after[j]
                if k < n:
                    before[k] = i
                    if m := get(pair := (new, sym[k])):
                        heappush(heap, (m[0], i, pair, m[1]))
                if (h := before[i]) >= 0 and (m := get(pair := (sym[h], new))):
                    heappush(heap, (m[0], h, pair, m[1]))
            sym = [s for s in sym if s >= 0]
        out = struct.pack(f"<{len(sym)}I", *sym)
        if n <= CACHE_LEN:
            if len(self.known) >= CACHE_WORDS:
                self.known.clear()
            self.known[w] = out
        return out

    def chunk(self, s: str) -> bytes:
        """Ids of text without white space: the pattern's words one after the other."""
        out = b"".join(map(self.word, self.words(s)))
        if len(s) <= CACHE_LEN:
            if len(self.ids) >= CACHE_WORDS:
                self.ids.clear()
            self.ids[s] = out
        return out

    def piece(self, text: str) -> bytes:
        """Ids of text without special tokens: NFC, lower case by character. No word of the pattern holds white
        space, so the text is cut there first and what stands between is looked up whole."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        get, chunk = self.ids.get, self.chunk
        cut = text.lower()
        parts = SPACE(cut) if OTHER_SPACE(cut) else cut.split()
        return b"".join([get(w) or chunk(w) for w in parts])

    def encode(self, text: str) -> bytes:
        if self.cut is None or "<" not in text:
            return self.piece(text)
        return b"".join(self.special.get(x) or self.piece(x) for x in self.cut.split(text) if x)

    def decode(self, packed: bytes) -> str:
        return " ".join(map(self.strings.__getitem__, np.frombuffer(packed, "<u4").tolist()))


_MODELS: dict[int, Model] = {}


def _model(spec) -> Model:
    """One model a worker process and broadcast."""
    if spec.id not in _MODELS:
        _MODELS.clear()
        _MODELS[spec.id] = Model(spec.value)
    return _MODELS[spec.id]


class _Spec:
    """A broadcast tokenizer file with a key for the workers' cache."""

    def __init__(self, spark, path: str):
        with open(path, encoding="utf-8") as f:
            text = f.read()
        self.id, self.held = hash(text), spark.sparkContext.broadcast(text)

    @property
    def value(self) -> str:
        return self.held.value


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every whole text; ids packed as little-endian unsigned 32-bit integers.

    tokenizer: path of the vocabulary file on the driver; a file of fixed size, which is broadcast.
    """
    spec = _Spec(docs.sparkSession, tokenizer)

    def run(batches):
        m = _model(spec)
        for b in batches:
            ids = [m.encode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return whole_texts(docs, id_col, text_col).mapInArrow(run, schema(doc_id=LONG, ids=BIN))


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """decode(encode(docs)) in one pass: a task has one worker and one model instead of two at once."""
    spec = _Spec(docs.sparkSession, tokenizer)

    def run(batches):
        m = _model(spec)
        for b in batches:
            ids = [m.encode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), pa.array(map(m.decode, ids), pa.string())], ["doc_id", "ids", "decoded"])

    return whole_texts(docs, id_col, text_col).mapInArrow(run, schema(doc_id=LONG, ids=BIN, decoded=STR))


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids, decoded) for packed ids; special tokens are not skipped, null ids decode to the empty string."""
    spec = _Spec(encoded.sparkSession, tokenizer)

    def run(batches):
        m = _model(spec)
        for b in batches:
            text = [m.decode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", F.coalesce("ids", F.lit(b"")).alias("ids")).mapInArrow(run, schema(doc_id=LONG, ids=BIN, decoded=STR))
