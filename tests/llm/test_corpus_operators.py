"""SimHash, components, mixing, WARC, media and the language model."""

import gzip
import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plotweave.llm import components, golay, media, mixing, ngram_lm, queries, simhash, warc
from tests.conftest import DATA

WORDS64 = st.integers(0, 2**64 - 1)


# ---- Golay code and SimHash


def test_golay_code_is_perfect():
    words = np.arange(1 << 23, dtype=np.int64)
    low, high, patterns = golay.tables()
    errors = patterns[low[words & 4095] ^ high[words >> 12]][:, 0]
    weights = np.bitwise_count(errors.astype(np.uint32))
    assert weights.max() == 3
    assert np.bincount(weights).tolist() == [4096 * math.comb(23, k) for k in range(4)]
    used = (patterns >= 0).sum(1)
    assert set(used.tolist()) == {1, 6} and (used == 6).sum() == math.comb(23, 3)


@given(st.integers(0, 2**23 - 1), st.integers(0, 22))
@settings(max_examples=300, deadline=None)
def test_words_one_bit_apart_share_an_index(word, bit):
    a, b = golay.indices(np.array([word, word ^ 1 << bit]))
    assert set(a[a >= 0].tolist()) & set(b[b >= 0].tolist())


@given(WORDS64, st.lists(st.integers(0, 63), max_size=2))
@settings(max_examples=500, deadline=None)
def test_fingerprints_two_bits_apart_share_a_key(word, bits):
    other = word
    for b in bits:
        other ^= 1 << b
    keys, rows = simhash.fuzzy_keys(np.array([word, other], np.uint64))
    assert set(keys[rows == 0].tolist()) & set(keys[rows == 1].tolist())


def brute_fingerprint(text, n):
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[k : k + n]) for k in range(max(1, len(words) - n + 1))] if words else []
    total = [sum(xxhash.xxh64_intdigest(r, 42) >> b & 1 for r in runs) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * total[b] > len(runs))


def brute_classes(fps):
    names, parent = list(fps), {i: i for i in fps}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, a in enumerate(names):
        for b in names[:k]:
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in names}


@pytest.mark.parametrize("bucket", [64, 2])
def test_links_find_all_classes(spark, bucket):
    """Chains, dense groups and strangers, by the small and the large way."""
    rng = np.random.default_rng(11)
    fps = [int(x) for x in rng.integers(0, 2**63, 40)]
    for seed in fps[:6]:
        for _ in range(25):
            fps.append(int(rng.choice(fps[-3:] + [seed])) ^ 1 << int(rng.integers(64)) ^ 1 << int(rng.integers(64)))
    fps = list(dict.fromkeys(fps))
    frame = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp bigint")
    roots = {r.node: r.root for r in components.components(simhash.links(frame, bucket)).collect()}
    signed = {f: int(np.uint64(f).astype(np.int64)) for f in fps}
    want = brute_classes({i: f for i, f in enumerate(fps)})
    got, expected = {}, {}
    for i, f in enumerate(fps):
        got.setdefault(roots.get(signed[f], signed[f]), set()).add(i)
        expected.setdefault(want[i], set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, expected.values()))


def test_near_duplicates(spark):
    base = " ".join(f"word{i}" for i in range(200))
    texts = [base, None, "", " \n", base, base.upper(), base + " extra", "a b", "A  b", "one", *(f"other text number {i} " * 4 for i in range(20))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for n in (3, 5):
        want = {i: brute_fingerprint(t, n) for i, t in enumerate(texts)}
        classes = brute_classes(want)
        got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(docs, n).collect()}
        assert got == {i: (want[i], classes[i]) for i in want}
        assert want[1] == want[2] == want[3] == 0 and want[7] == want[8]


def test_long_text_in_parts(monkeypatch):
    text = " ".join(f"w{i * i % 97}" for i in range(500)).encode()
    whole = simhash.fingerprint(text, 3)
    monkeypatch.setattr(simhash, "AT_ONCE", 7)
    assert simhash.fingerprint(text, 3) == whole == brute_fingerprint(text.decode(), 3)


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
@settings(max_examples=5, deadline=None)
def test_components(spark, edges):
    parent = list(range(31))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {i: find(i) for i in range(31) if find(i) != i}


# ---- mixing


@given(st.lists(st.integers(0, 1000), min_size=1, max_size=12), st.floats(0.1, 2))
@settings(max_examples=200, deadline=None)
def test_water_fill(sizes, share):
    weights = [(5.0, 2.0, 1.0)[k % 3] for k in range(len(sizes))]
    got = mixing.water_fill(sizes, weights, share)
    assert math.isclose(sum(got), share * sum(sizes), abs_tol=1e-6)
    rates = {round(t / w, 6) for t, s, w in zip(got, sizes, weights, strict=True) if t < 2 * s - 1e-9}
    assert len(rates) <= 1 and all(t <= 2 * s + 1e-9 for t, s in zip(got, sizes, strict=True))
    top = max(rates, default=0)
    assert all(t / w <= top + 1e-5 for t, s, w in zip(got, sizes, weights, strict=True)) or not rates


@given(st.lists(st.integers(0, 60), min_size=1, max_size=5), st.integers(1, 9), st.integers(0, 99))
@settings(max_examples=100, deadline=None)
def test_splitting_tree(quotas, shards, seed):
    parts = [mixing.split_quotas(np.array(quotas), shards, s, seed) for s in range(shards)]
    assert (sum(p[0] for p in parts) == np.array(quotas)).all()
    before = np.zeros(len(quotas), int)
    for mine, first in parts:
        assert (first == before).all() and (mine >= 0).all()
        before = before + mine
    totals = [int(p[0].sum()) for p in parts]
    assert max(totals) - min(totals) <= math.ceil(math.log2(shards)) + 1 if shards > 1 else True


def mixed(spark, docs):
    mix = mixing.mix(docs)
    return mix.draws.orderBy("shard", "position").collect(), mixing.words_taken(mix).collect()


def test_the_tree_deals_all_draws(spark, monkeypatch):
    """The query's places: disjoint, without gaps, shards of even size, each source spread over them; another seed deals anew."""
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 40)
    monkeypatch.setattr(mixing, "DRAWS_PER_SHARD", 4)
    monkeypatch.setattr(mixing, "RANGE", 3)
    rows = [(i, "w " * 20, "ab"[i % 2]) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    places = {r.doc_id: [tuple(p) for p in r.places or ()] for r in mixing.words_taken(mixing.mix(docs)).collect()}
    flat = sorted(p for own in places.values() for p in own)
    assert len(flat) == len(set(flat)) and all(len(own) <= 2 for own in places.values())
    by_shard = Counter(s for s, _ in flat)
    assert set(by_shard) == set(range(max(by_shard) + 1)) and all(sorted(p for s, p in flat if s == k) == list(range(n)) for k, n in by_shard.items())
    assert len(by_shard) > 20 and max(by_shard.values()) < 4 * min(by_shard.values()) + 40
    again = {r.doc_id: [tuple(p) for p in r.places or ()] for r in mixing.words_taken(mixing.mix(docs.repartition(5))).collect()}
    other = {r.doc_id: [tuple(p) for p in r.places or ()] for r in mixing.words_taken(mixing.mix(docs, seed=1)).collect()}
    assert again == places and other != places


def test_ranges_of_shards_walk_the_same_tree():
    quotas = np.array([13, 0, 40, 7])
    whole = list(mixing.shard_quotas(quotas, 11, 0, 11, 5))
    parts = [x for a, b in ((0, 4), (4, 5), (5, 11)) for x in mixing.shard_quotas(quotas, 11, a, b, 5)]
    assert [s for s, _, _ in whole] == list(range(11))
    for (a, m, x), (b, n, y) in zip(whole, parts, strict=True):
        assert a == b and (m == n).all() and (x == y).all()


@pytest.mark.parametrize("block_words, per_shard", [(1 << 18, 16), (64, 3)])
def test_mix(spark, monkeypatch, block_words, per_shard):
    monkeypatch.setattr(mixing, "BLOCK_WORDS", block_words)
    monkeypatch.setattr(mixing, "DRAWS_PER_SHARD", per_shard)
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 40))), [None, "b", "a", "hot"][min(3, int(rng.integers(9)))]) for i in range(400)]
    rows += [(400, None, "a"), (401, "", None), (402, "  ", "empty")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    mix, taken = mixed(spark, docs)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    names = ["a", "b", "empty", "hot", None]
    want = dict(zip(names, mixing.water_fill([sizes[s] for s in names], [5.0, 2, 1, 5, 2]), strict=True))
    assert len(taken) == len(rows)
    for s in names:
        own = [r for r in taken if r.source == s]
        assert {round(r.target, 6) for r in own} == {round(want[s], 6)} and {r.source_size for r in own} == {sizes[s]}
        assert abs(sum(r.taken for r in own) - want[s]) <= (3 if block_words > 64 else 39)
    assert all(r.taken <= 2 * r.size and r.size == len((rows[r.doc_id][1] or "").split()) for r in taken)
    for shard in {r.shard for r in mix}:
        assert [r.position for r in mix if r.shard == shard] == list(range(sum(r.shard == shard for r in mix)))
    again, _ = mixed(spark, docs.repartition(7))
    assert [(r.shard, r.position, r.doc_id) for r in mix] == [(r.shard, r.position, r.doc_id) for r in again]


def test_mix_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert mixed(spark, docs) == ([], [])


# ---- WARC


def test_archive_in_pieces():
    rows = [(1, "http://é/ x\r\ny", b"\x00\xffpayload", None), (None, None, b"", None), (3, "u", b"z" * 5000, 1)]
    data = b"".join(warc.member(*r) for r in rows)
    assert data.endswith(b"\0") and gzip.decompress(data).count(b"WARC/1.1\r\n") == 3
    for piece in (1, 13, 1 << 20):
        got = [(warc.page_of(r.headers["warc-record-id"]), r.kind, r.payload, warc.page_of(r.headers.get("warc-refers-to"))) for r in warc.read_archive(data, piece)]
        assert got == [(1, "response", rows[0][2], None), (None, "response", b"", None), (3, "revisit", b"", 1)]


def test_large_record_ends_in_zero():
    data = warc.member(1, None, bytes(17 << 20), None, 1)
    assert data[-1] == 0 and next(warc.read_archive(data)).payload == bytes(17 << 20)


def packed(text: bytes) -> bytes:
    return gzip.compress(text)


def test_faults():
    good = gzip.decompress(warc.member(1, None, b"hello", None))
    for wrong in (good.replace(b"hello", b"jello"), good.replace(b"WARC/1.1", b"HTTP/1.1", 1), good[:-4], good.replace(b"Content-Length: ", b"Content-Length: 1"), good.replace(b"\r\nContent-Length", b"\r\nX-Length")):
        with pytest.raises(warc.WarcError):
            list(warc.read_archive(packed(wrong)))
    with pytest.raises(warc.WarcError, match="inside"):
        list(warc.read_archive(packed(good)[:-3]))


@pytest.mark.parametrize("file_bytes", [warc.FILE_BYTES, 700])
def test_round_trip_of_pages(spark, monkeypatch, file_bytes):
    monkeypatch.setattr(warc, "FILE_BYTES", file_bytes)
    big, other = "<p>é" + "x" * 1200, "y" * 1000
    rows = [(i, f"http://h/{i}", big) for i in (5, 9, 2)] + [(7, None, other), (8, "u", "short"), (10, "u", "short"), (11, "u", None), (12, "u", ""), (9, "again", big), (None, "u", big), (13, "u", "z" * 999), (14, "u", "z" * 999)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    records = warc.round_trip(pages)
    payloads = Counter((r.page_id, r.record_type, bytes(r.payload) if r.payload is not None else None) for r in records.collect())
    assert payloads[(9, "response", big.encode())] == 2 and payloads[(5, "revisit", None)] == 1
    got = Counter(map(tuple, warc.resolved(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()))
    want = Counter()
    for i, _, html in rows:
        data = (html or "").encode()
        last = max((j for j, _, x in rows if x == html and j is not None), default=None)
        again = len(data) >= 1000 and i != last
        want[(i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", last if again else None)] += 1
    assert got == want


# ---- media


@given(st.binary(max_size=6000).map(lambda b: b * 9))
@settings(max_examples=60, deadline=None)
def test_chunks_put_together(data):
    image = media.to_image(media.pad(data))
    parts = media.chunks(image)
    assert b"".join(p for _, p in parts) == image and media.from_image(image)[: len(data)] == data
    sizes = [len(p) for _, p in parts]
    assert all(media.MIN_CHUNK <= s <= media.MAX_CHUNK for s in sizes[:-1]) and 0 < sizes[-1] <= media.MAX_CHUNK


def test_gear_hash_is_the_rolling_one(monkeypatch):
    data = np.random.default_rng(1).integers(0, 256, 500).astype(np.uint8)
    h, want = 0, []
    for b in data.tolist():
        h = ((h << 1) + int(media.GEAR[b])) % 2**32
        want.append(h)
    assert media.gear_hashes(data).tolist() == want
    image = bytes(np.random.default_rng(2).integers(97, 110, 40_000).astype(np.uint8))
    whole = media.cuts(image)
    monkeypatch.setattr(media, "AT_ONCE", 1000)
    assert media.cuts(image) == whole and len(whole) > 10


def test_a_shared_passage_makes_shared_chunks():
    rng = np.random.default_rng(4)
    passage = bytes(rng.integers(97, 123, 20_000).astype(np.uint8))
    a, b = ({d for d, _ in media.chunks(media.to_image(media.pad(bytes(rng.integers(97, 123, n).astype(np.uint8)) + passage)))} for n in (777, 3210))
    assert len(a & b) >= 3


@pytest.mark.parametrize("max_shared", [media.MAX_SHARED, 0])
def test_media_round_trip(spark, max_shared):
    rng = np.random.default_rng(6)
    passage = "".join(map(chr, rng.integers(97, 123, 30_000)))
    texts = [None, "", "é" * 33, "x" * 64, passage, passage, "own start " * 200 + passage, "x" * 50_000, *["copy of a text " * 400] * 9]
    rows = [*enumerate(texts), (4, passage), (None, passage)]
    kept = media.store(spark.createDataFrame(rows, "doc_id bigint, text string"), max_shared)
    got = media.described(media.read(kept)).collect()
    assert len(got) == len(rows)
    seen = {}
    for r in got:
        data = (dict(rows)[r.doc_id] or "").encode()
        payload = data + bytes(-len(data) % 64 or (0 if data else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert seen.setdefault(payload, (r.media_bytes, r.media_sha256, r.feature)) == (r.media_bytes, r.media_sha256, r.feature)
    stored = sum(sum(map(len, r.own)) + sum(len(x.data) for x in r.lent) for r in kept.filter("doc_id is not null").dropDuplicates(["doc_id"]).collect())
    assert stored < 2 * len(passage) + 20_000


def test_missing_chunk_raises():
    with pytest.raises(ValueError, match="isn't in the store"):
        media.rebuilt([b"a"], [b"a"], [], [], None, "")
    with pytest.raises(ValueError, match="not rebuilt"):
        media.rebuilt([b"a"], [], [b"data"], [], None, "")


# ---- language model


def brute_discounts(counts, k=5):
    """Good-Turing's by count, from its formulas; smoothed counts of counts where the raw ones don't do."""
    n = Counter(counts)

    def ratio(f):
        a = (k + 1) * f(k + 1) / f(1)
        return {r: ((r + 1) * f(r + 1) / (r * f(r)) - a) / (1 - a) for r in range(1, k + 1)} if a != 1 else {0: -1}

    proper = lambda d: min(d.values()) > 0 and max(d.values()) <= 1
    if all(n[r] for r in range(1, k + 2)):
        d = ratio(lambda r: n[r])
        if n[k + 1] * (k + 1) < n[1] and proper(d):
            return d
    seen = [r for r in sorted(n) if r <= 64]
    if len(seen) > 1:
        z = []
        for i, r in enumerate(seen):
            q = seen[i - 1] if i else 0
            t = seen[i + 1] if i + 1 < len(seen) else 2 * r - q
            z.append((math.log(r), math.log(2 * n[r] / (t - q))))
        mx, my = (sum(x[i] for x in z) / len(z) for i in (0, 1))
        slope = sum((x - mx) * (y - my) for x, y in z) / sum((x - mx) ** 2 for x, _ in z)
        d = ratio(lambda r: r**slope)
        if slope < -1 and proper(d):
            return d
    less = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    return {r: (r - less) / r for r in range(1, k + 1)}


def brute_katz(rows):
    """(doc_id, text, held) -> held, n_tokens, n_known, log10 probability by document, by recursion over dictionaries; sums of probabilities are checked."""
    tok = lambda t: [*(t or "").encode().lower().split(), None]
    grams = [Counter(), Counter(), Counter()]
    for _, t, held in rows:
        w = [] if held else tok(t)
        for k in range(len(w)):
            run = ["", "", *w[: k + 1]]
            for order in range(3):
                grams[order][tuple(run[len(run) - order - 1 :])] += 1
    n = sum(grams[0].values())
    cut = []
    for g in grams:
        d = brute_discounts(g.values())
        cut.append({k: d.get(c, 1) * c for k, c in g.items()})
    unknown = 1 - sum(cut[0].values()) / n if n else 1.0
    p1 = {k[0]: x / n for k, x in cut[0].items()}
    if n and unknown < 1e-12:
        p1, unknown = {k[0]: c / (n + 1) for k, c in grams[0].items()}, 1 / (n + 1)
    seen = [{}, {}]
    for order in (1, 2):
        for k in grams[order]:
            seen[order - 1].setdefault(k[:-1], []).append(k[-1])
    shares, alphas = [{}, {}], [{}, {}]

    def p(context, w):
        if not context:
            return p1.get(w, unknown)
        own = shares[len(context) - 1].get((*context, w))
        return own if own is not None else alphas[len(context) - 1].get(context, 1.0) * p(context[1:], w)

    for order in (1, 2):
        for context, followers in seen[order - 1].items():
            total = sum(grams[order][(*context, w)] for w in followers)
            used = sum(cut[order][(*context, w)] for w in followers)
            total += total - used < 1e-12 * total
            for w in followers:
                shares[order - 1][(*context, w)] = cut[order][(*context, w)] / total
            alphas[order - 1][context] = (1 - used / total) / (1 - sum(p(context[1:], w) for w in followers))
    vocabulary = [*p1, b"unseen word"]
    for context in [*list(seen[1])[:40], *list(seen[0])[:40], ("never", "seen")]:
        assert math.isclose(sum(p(context, w) for w in vocabulary), 1, rel_tol=1e-9)
    out = {}
    for i, t, held in rows:
        w = ["", "", *tok(t)]
        out[i] = held, len(w) - 2, sum(x in p1 for x in w[2:]), sum(math.log10(p((w[k - 2], w[k - 1]), w[k])) for k in range(2, len(w)))
    return out, {(k[0]): c for k, c in grams[0].items()}, n


def small_buckets(monkeypatch, lot, bucket, words):
    monkeypatch.setattr(ngram_lm, "BATCH_TOKENS", lot)
    monkeypatch.setattr(ngram_lm, "BUCKET_TOKENS", bucket)
    monkeypatch.setattr(ngram_lm, "LEXICON", words)


@pytest.mark.parametrize("lot, bucket, words", [(ngram_lm.BATCH_TOKENS, ngram_lm.BUCKET_TOKENS, ngram_lm.LEXICON), (50, 100, 20), (300, 40, 8), (50, 1 << 20, 0)])
def test_katz(spark, monkeypatch, lot, bucket, words):
    """Against brute force: with all words in the lexicon or few, and with hot words over many buckets."""
    small_buckets(monkeypatch, lot, bucket, words)
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(f"W{min(int(x), 60)}" for x in rng.zipf(1.4, int(rng.integers(0, 30)))), i % 7 == 2) for i in range(120)]
    rows += [(120, None, False), (121, "", True), (122, "never seen words", True), (123, "w1 w1 never w1 w60 w59 w58", True)]
    docs = ngram_lm.prepared(spark.createDataFrame(rows, "doc_id bigint, text string, held boolean"), F.col("held"))
    model = ngram_lm.train(docs)
    assert (bucket > 40) or (model.lexicon.splits > 1).any()
    got = {r.doc_id: r for r in ngram_lm.score(docs, model).collect()}
    want = brute_katz(rows)[0]
    assert set(got) == set(want)
    for i, (held, n, known, score) in want.items():
        assert (got[i].held_out, got[i].n_tokens, got[i].n_known) == (held, n, known) and math.isclose(got[i].score, score, rel_tol=1e-9)


def test_query_of_katz(spark):
    """The query's rows on the smallest tables; Good-Turing is what discounts there."""
    rows = [(r.doc_id, r.text, zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect()]
    want, counts, n = brute_katz(rows)
    texts = {i: t for i, t, _ in rows}
    got = queries.op2_katz(spark, f"{DATA}/sf0.001").collect()
    assert len(got) == len(rows)
    for r in got:
        held, n_tokens, known, score = want[r.doc_id]
        base = sum(math.log10((counts[x] + 1 if x in counts else 1) / (n + len(counts) + 1)) for x in [*(texts[r.doc_id] or "").encode().lower().split(), None])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n_tokens, known, n)
        assert math.isclose(r.score, score, rel_tol=1e-9) and math.isclose(r.base_score, base, rel_tol=1e-9)


@pytest.mark.parametrize("rows", [[], [(1, "a b", True)], [(1, "a a", False), (2, "a a", False)], [(1, None, False)]])
def test_katz_of_little(spark, rows):
    docs = ngram_lm.prepared(spark.createDataFrame(rows, "doc_id bigint, text string, held boolean"), F.col("held"))
    got = {r.doc_id: r for r in ngram_lm.score(docs, ngram_lm.train(docs)).collect()}
    for i, (_, n, known, score) in brute_katz(rows)[0].items() if rows else []:
        assert (got[i].n_tokens, got[i].n_known) == (n, known) and math.isclose(got[i].score, score, rel_tol=1e-9, abs_tol=1e-9)
    assert len(got) == len(rows)


def test_discounts():
    assert ngram_lm.discounts({1: 100, 2: 40, 3: 22, 4: 14, 5: 10, 6: 7})[0] == 0
    good = ngram_lm.discounts({1: 1000, 2: 400, 3: 220, 4: 140, 5: 98, 6: 70})
    n = {1: 1000, 2: 400, 3: 220, 4: 140, 5: 98, 6: 70}
    assert all(0 < x <= 1 for x in good[1:])
    # What Good-Turing takes from counts up to k is the share of singletons.
    assert math.isclose(sum((1 - good[r]) * r * n[r] for r in range(1, 6)), n[1])
    assert ngram_lm.discounts({3: 5})[1:] == [0.5, 0.75, 2.5 / 3, 3.5 / 4, 0.9]
    # Counts that copies make irregular are smoothed, not given up.
    odd = {1: 1000, 2: 300, 3: 280, 4: 90, 5: 130, 6: 40, 7: 60, 9: 20}
    smooth = ngram_lm.discounts(odd)
    brute = brute_discounts([r for r, k in odd.items() for _ in range(k)])
    assert all(math.isclose(smooth[r], brute[r]) for r in range(1, 6)) and smooth[1:] == sorted(smooth[1:]) and smooth[1] < 0.6


@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9), st.integers(0, 9)), min_size=1, max_size=50), st.integers(0, 9))
@settings(max_examples=200, deadline=None)
def test_packed_trigrams(rows, known):
    v, u, w = (np.array(x) for x in zip(*sorted(set(rows)), strict=True))
    rare = np.arange(10 - known, dtype=np.uint64) * np.uint64(2**60) + np.uint64(7)
    hashes = np.concatenate([np.arange(known, dtype=np.uint64), rare])
    own, *codes = ngram_lm.unpack(ngram_lm.pack(v, u, w, rare, known))
    back = np.concatenate([np.arange(known, dtype=np.uint64), own])
    assert all((back[c] == hashes[x]).all() for c, x in zip(codes, (v, u, w), strict=True)) and set(own) <= set(rare)


def test_data_folder_is_there():
    assert DATA
