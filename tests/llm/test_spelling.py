"""Spelling variants against brute force."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plotweave.llm import spelling


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts):
    """Rows of ``variants``."""
    near = {w: {v for v in counts if one_edit(w, v)} for w in counts}
    form = {}
    for w, around in near.items():
        best = min(around, key=lambda v: (-counts[v], v), default=None)
        if best and counts[best] >= spelling.RATIO * counts[w]:
            form[w] = best
    out = set()
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(near[w]), counts[form[w]] if w in form else None))
    return out


def told(words, rank):
    """Pairs that the kernel tells, from keys sorted in one place."""
    rows = []
    for w in words:
        grid = np.frombuffer(w.encode("latin-1"), np.uint8)[None]
        for size, _, key, which, side, segment, places in spelling.word_keys(grid, rank):
            rows += [(size, int(k), len(w) - size, int(p), 2 * segment + side, *map(int, q), w.encode("latin-1"), 1) for k, p, q in zip(key, which, places, strict=True)]
    if not rows:
        return []
    names = ["size", "key", "longer", "which", "segment", "p0", "p1", "p2", "word", "n"]
    kinds = [pa.int32(), pa.int64(), pa.int8(), pa.int8(), pa.int8(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64()]
    table = pa.table([pa.array(c, k) for c, k in zip(zip(*sorted(rows), strict=True), kinds, strict=True)], names)
    return [(r["word"].decode("latin-1"), r["near"].decode("latin-1")) for b in spelling._pairs(table) for r in b.to_pylist()]


@settings(max_examples=150, deadline=None)
@given(st.sets(st.text("abé", min_size=7, max_size=12), max_size=40), st.randoms(use_true_random=False))
def test_every_pair_once(words, rng):
    for w in list(words):
        i = rng.randrange(len(w))
        words |= {w[:i] + rng.choice("abé") + w[i:], w[:i] + rng.choice("abé") + w[i + 1 :]}
    rank = np.full(1 << 16, 1 << 16, np.int64)
    grams = Counter((w[i] + w[i + 1]).encode("latin-1") for w in words for i in range(len(w) - 1))
    for place, (gram, _) in enumerate(sorted(grams.items(), key=lambda x: (x[1], x[0]))):
        rank[gram[0] * 256 + gram[1]] = place
    found = told(words, rank)
    assert sorted(found) == sorted((a, b) for a in words for b in words if one_edit(a, b))


def test_repeats_of_one_letter_and_long_words():
    rank = np.zeros(1 << 16, np.int64)
    words = {"a" * n for n in range(7, 14)} | {"ab" * 60, "ab" * 60 + "a", "ab" * 40 + "x" + "ab" * 20, "ab" * 40 + "xb" + "ab" * 19}
    assert sorted(told(words, rank)) == sorted((a, b) for a in words for b in words if one_edit(a, b))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    stems = ["".join(rng.choice("abcdeñü") for _ in range(rng.randint(7, 10))) for _ in range(30)]
    out = []
    for i in range(400):
        words = [rng.choice(stems[: 1 + i % 30]) for _ in range(12)]
        out.append((i, " ".join(w.upper() if rng.random() < 0.1 else w for w in words)))
    return [*out, (500, None), (501, ""), (None, "wordwithoutid wordwithoutid"), (502, "Ñandúes " * 3), (503, "x" * 3000 + " " + "x" * 3000), *out[:5]]


def test_variants_by_brute_force(spark, texts):
    counts = Counter()
    lower = str.maketrans(spelling.UPPER, spelling.LOWER)
    for i, text in texts:
        for run in __import__("re").findall(f"[{spelling.LETTERS}]+", (text or "").translate(lower)):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % spelling.ERROR_EVERY == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += len(run) >= spelling.MIN_LENGTH
    counts = {w: n for w, n in counts.items() if n >= spelling.MIN_COUNT}
    docs = spark.createDataFrame([(i, t, "w", 1) for i, t in texts], "doc_id bigint, text string, word string, n int")
    found = spelling.variants(docs, every=spelling.ERROR_EVERY)
    assert {tuple(r) for r in found.collect()} == brute(counts)
    assert any(form for _, form, *_ in brute(counts)) and max(map(len, counts)) == 3000


def test_roots_follow_forms(spark):
    rows = [("aaaaaaa", 1, 1, "aaaaaab", 10), ("aaaaaab", 10, 1, "aaaaabb", 100), ("aaaaabb", 100, 1, "aaaabbb", 1000), ("aaaabbb", 1000, 1, "aaabbbb", 10000), ("aaabbbb", 10000, 1, None, None)]
    formed = spark.createDataFrame(rows, "word string, n bigint, n_near bigint, form string, form_n bigint")
    assert {r.word: r.root for r in spelling.roots(formed).collect()} == {r[0]: "aaabbbb" for r in rows}


def test_empty(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
