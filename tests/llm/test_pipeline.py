"""Stages of the corpus pipeline in sequence."""

import random
from collections import Counter

import corpus_pipeline
from slidespark.llm.common import ready


def test_repeated_rows_keep_one_text(spark):
    """Rows that occur twice, and equal texts without ids, are left once and whole by MinHash and suffix removal."""
    rnd = random.Random(8)
    words = lambda n: " ".join("".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    once, twice, bare, both, empty = words(80), words(80), words(80), words(80), ""
    rows = [(1, once, "a"), (2, twice, "b"), (2, twice, "b"), (None, bare, "c"), (None, bare, "d"), (3, both, "e"), (None, both, "f"), (4, empty, "g"), (None, None, "h")]
    ready(spark)
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    left = corpus_pipeline.minhash_stage(spark, docs, "")
    assert left.columns == docs.columns
    got = corpus_pipeline.suffix_stage(spark, left, "")
    want = Counter([(1, once), (2, twice), (None, bare), (3, both), (4, empty), (None, "")])
    assert Counter((r.doc_id, r.text or "") for r in got.collect()) == want
