"""Near-duplicates by shingle similarity, against brute-force Jaccard."""

from functools import partial
from itertools import combinations

import numpy as np
import pytest

from plotweave.llm import minhash, simhash, stages
from tests.llm.test_corpus_operators import brute_classes, brute_fingerprint


def brute_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def brute_components(texts):
    sets = {i: brute_set(t) for i, t in texts.items()}
    names = {i: i for i in texts}
    alike = [(a, b) for a, b in combinations(texts, 2) if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in alike:
            if names[a] != names[b]:
                names[a] = names[b] = min(names[a], names[b])
                changed = True
    return names


def changed_words(rng, words, n):
    out = list(words)
    for k in rng.choice(len(out), n, replace=False):
        out[k] = f"changed{rng.integers(1 << 40)}"
    return " ".join(out)


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(3)
    out = ["", None, " \n", "a b", "A  b", "one"]
    for size, changes in [(100, 1), (200, 2), (200, 5), (500, 5), (500, 10), (500, 30), (1000, 10), (3000, 20)]:
        for _ in range(4):
            words = [f"w{x}" for x in rng.integers(0, 5000, size)]
            out += [" ".join(words), changed_words(rng, words, changes)]
    # Many variants of one text: hot bands, where some pairs are alike and others not.
    words = [f"h{x}" for x in range(150)]
    out += [changed_words(rng, words, int(rng.integers(1, 8))) for _ in range(60)]
    return dict(enumerate(out))


@pytest.mark.parametrize("bucket, block", [(minhash.BUCKET, minhash.BLOCK), (2, 7), (0, 256)])
def test_components_of_similar_texts(spark, texts, monkeypatch, bucket, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, bucket=bucket).collect()}
    assert got == brute_components(texts)


def test_shared_counts(monkeypatch):
    monkeypatch.setattr(minhash, "COLUMNS", 5)
    rng = np.random.default_rng(6)
    one, other = ([np.unique(rng.integers(0, 40, n).astype(np.uint64)) for n in sizes] for sizes in ((0, 5, 30), (12, 1)))
    assert minhash.shared_counts(one, other).tolist() == [[len(set(a.tolist()) & set(b.tolist())) for b in other] for a in one]


def test_stage_tells_texts_of_one_identifier_apart(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(50)) for k in "abc")
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    kept = lambda rows: sorted(((r.doc_id, r.text[0]) for r in stages.one_of_each(spark.createDataFrame([(*r, "en", "s", 1) for r in rows], schema)).collect()), key=str)
    assert kept([(1, c), (5, c), (5, b)]) == [(1, "c"), (5, "b")]
    assert kept([(3, a), (None, a), (None, b)]) == [(3, "a"), (None, "b")]
    assert kept([(None, a), (None, a), (2, b), (2, b)]) == [(2, "b"), (None, "a")]


def test_stage_keeps_one_of_near_copies(spark):
    rng = np.random.default_rng(4)
    words = [f"w{x}" for x in range(200)]
    rows = [(1, " ".join(words)), (2, changed_words(rng, words, 2)), (3, changed_words(rng, words, 2)), (4, " ".join(reversed(words))), (5, changed_words(rng, words, 60))]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert sorted(r.doc_id for r in stages.one_of_each(docs).collect()) == [1, 4, 5]


def test_pairs_of_similarity_share_a_band():
    """Of 500 pairs of similarity 0.8 all are candidates."""
    rng = np.random.default_rng(5)
    for _ in range(500):
        pool = rng.integers(0, 1 << 64, 90, np.uint64)
        one, other = np.sort(pool[:81]), np.sort(pool[9:])
        assert (minhash.band_keys(one) == minhash.band_keys(other)).any() and minhash.similar(one, other) == (72 * 5 >= 90 * 4)


def simhash_texts():
    """Texts that SimHash joins and the exact check tells apart, and the other way round."""
    rng = np.random.default_rng(8)
    out = ["", None, "a b", "A  b", "one"]
    for size, changes in [(3000, 1), (3000, 2), (1000, 1), (200, 2)]:
        for _ in range(3):
            words = [f"w{x}" for x in rng.integers(0, 5000, size)]
            out += [" ".join(words), changed_words(rng, words, changes)]
    # One fingerprint, but what differs is most of the sets.
    line = " ".join(f"l{x}" for x in range(11)) + " "
    out += [line * 200 + " ".join(f"t{k}x{x}" for x in range(40)) for k in range(3)]
    # One set with two fingerprints, and near each of them a set of its own.
    a, b = (" ".join(f"{k}{x}" for x in range(100)) + " " for k in "ab")
    out += [a * 2 + b * 10, a * 10 + b * 2, a * 2 + b * 10 + "end", a * 10 + b * 2 + "other"]
    return dict(enumerate(out))


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 0])
def test_simhash_proposes(spark, bucket):
    """SimHash alone gives the similar ones of each of its classes."""
    texts = simhash_texts()
    sets, fps = {i: brute_set(t) for i, t in texts.items()}, {i: brute_fingerprint(t, 5) for i, t in texts.items()}
    classes, same = brute_classes(fps), {}
    for i in texts:
        same.setdefault(sets[i], []).append(i)
    met = lambda a, b: {classes[x] for x in same[sets[a]]} & {classes[x] for x in same[sets[b]]}
    alike = {(a, b) for a, b in combinations(texts, 2) if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    want = {i: i for i in texts}
    for _ in texts:
        for a, b in alike:
            if met(a, b):
                want[a] = want[b] = min(want[a], want[b])
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, bucket=bucket, bands=0).collect()} == want
    # The texts hold each case: joined by SimHash, joined by it wrongly, missed by it, near either fingerprint of one set.
    assert any(met(a, b) and sets[a] != sets[b] for a, b in alike)
    assert any(classes[a] == classes[b] and (a, b) not in alike for a, b in combinations(texts, 2)) and any(not met(a, b) for a, b in alike)
    last = max(texts)
    assert sets[last - 3] == sets[last - 2] and classes[last - 3] == classes[last - 1] != classes[last - 2] == classes[last]
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, bucket=bucket).collect()} == brute_components(texts)


def test_stage_goes_through_simhash(spark, monkeypatch):
    """The stage's groups come from op7's links of the texts' fingerprints, without MinHash too."""
    texts, seen, links = simhash_texts(), [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda distinct, *more: seen.append({r.fp % 2**64 for r in distinct.collect()}) or links(distinct, *more))
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts.items()], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = sorted(r.doc_id for r in stages.one_of_each(docs).collect())
    names = brute_components(texts)
    assert kept == sorted({*names.values()}) and seen == [{brute_fingerprint(t, 5) for t in texts.values()}]
    monkeypatch.setattr(minhash, "near_duplicates", partial(minhash.near_duplicates, bands=0))
    alone = {r.doc_id for r in stages.one_of_each(docs).collect()}
    assert {*kept} <= alone < {*texts} and max(texts) not in alone and len(alone) < len({brute_set(t) for t in texts.values()})
