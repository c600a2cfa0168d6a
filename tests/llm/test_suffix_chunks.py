"""Texts that are ranked together give the choices each of them gives alone."""

import random

import numpy as np

from slidespark.llm import suffix_dedup as S

THRESHOLD = 60


def plainly(text: bytes) -> list[tuple]:
    """(position, rank, first, last) from every string of the text, one after the other."""
    ranks = S.prefix_ranks(text, S.SEED_LEN).tolist()
    w, out = THRESHOLD - S.SEED_LEN + 1, []
    for i in range(len(text) - THRESHOLD + 1):
        least = min(ranks[i : i + w])
        at = max(p for p in range(i, i + w) if ranks[p] == least)
        if out and out[-1][0] == at:
            out[-1][3] = i
        else:
            out.append([at, ranks[at], i, i])
    return [tuple(x) for x in out]


def test_choices_of_texts_together(monkeypatch):
    r = random.Random(3)
    texts = ["a" * 60, "a" * 400, "abc" * 90, "é" * 60, "ab" * 40 + "x" * 61, *("".join(r.choice("ab") for _ in range(n)) for n in (60, 61, 300)), *("".join(r.choice("abcdefgh ") for _ in range(n)) for n in (75, 900, 64))]
    for chunk, searched in ((1, 4096), (500, 3), (1 << 16, 4096)):
        monkeypatch.setattr(S, "CHUNK", chunk)
        monkeypatch.setattr(S, "SEARCHED", searched)
        got = {}
        for rows, raw, start in S._chunks(texts):
            assert raw == "".join(texts[rows]).encode()
            i, p, rank, first, last = S.chosen(raw, start, THRESHOLD)
            for k, at in enumerate(start.tolist()):
                m = i == k
                got[rows.start + k] = list(zip((p[m] - at).tolist(), rank[m].tolist(), (first[m] - at).tolist(), (last[m] - at).tolist(), strict=True))
        assert got == {k: plainly(t.encode()) for k, t in enumerate(texts)}


def test_blocks_settled_together(spark):
    """Strings that lie across two blocks' bytes are in none of them."""
    r = np.random.default_rng(5)
    shared = bytes(r.integers(97, 123, 70, np.uint8))
    rows = [(1, k, 0, 10, bytes(v) + shared[:60]) for k, v in enumerate(r.integers(97, 123, (3, 10), np.uint8))]
    rows += [(2, 9, 5, 5, shared[:60]), (3, 7, 0, 1, shared[:61]), (3, 8, 1, 2, shared[:61])]
    packed = spark.createDataFrame(rows, "rank long, block long, low int, high int, bytes binary")
    got = sorted(map(tuple, S.shared_in_task(packed, 60).collect()))
    assert got == [(1, 0, 0, 0), (1, 1, 0, 0), (1, 2, 0, 0)]
