"""Trigrams seen once are part of the language model."""

import math
from collections import Counter

from pyspark.sql import functions as F

from plotweave.llm import ngram_lm


def test_trigrams_seen_once_are_stored(spark):
    rows = [(1, "a b c a b", False), (2, "a d", False), (3, "a d", True)]
    docs = ngram_lm.prepared(spark.createDataFrame(rows, "doc_id bigint, text string, held boolean"), F.col("held"))
    model = ngram_lm.train(docs)
    # Start-start-a twice; start-a-b, a-b-c, b-c-a, c-a-b, a-b-end, start-a-d and a-d-end once.
    assert Counter(r.c for r in ngram_lm.ngrams(model).collect()) == {1: 7, 2: 1}
    d = ngram_lm.discounts({1: 7, 2: 1})
    score = {r.doc_id: r.score for r in ngram_lm.score(docs, model).collect()}
    # Start-start had a in both of its tokens, start-a d in one of two, a-d an end in its only one.
    assert math.isclose(score[3], math.log10(d[2]) + math.log10(d[1] / 2) + math.log10(d[1]), rel_tol=1e-9)


def test_counts_beyond_32_bits():
    """Trigrams of more than 2^32 occurrences keep their counts, beside others that don't."""
    import numpy as np

    from plotweave.llm import ngram_lm

    none = np.zeros(0, np.uint64)
    codes = [np.array([2, 2, 3]), np.array([2, 3, 2]), np.array([4, 4, 4])]
    blob = lambda c: ngram_lm._parts(ngram_lm._joined(*ngram_lm.pack(*codes, none, 5), ngram_lm.planes(np.array(c, "<i8"))))
    _, v, u, w, c = ngram_lm.merged([blob([1, 2, 3]), blob([1 << 33, 5, 1]), blob([(1 << 32) - 1, 1, 1])], 5)
    assert dict(zip(zip(v.tolist(), u.tolist(), w.tolist(), strict=True), c.tolist(), strict=True)) == {(2, 2, 4): (1 << 33) + (1 << 32), (2, 3, 4): 8, (3, 2, 4): 5}
