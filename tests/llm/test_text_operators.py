"""BPE, secrets, language identification, line deduplication and quality rules."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plotweave.llm import bpe, host_quality, language_id, line_dedup, mph, secrets
from plotweave.llm.queries import PATTERN, RANK_FILE
from tests.conftest import DATA

ENC = bpe.encoding(bpe.read_ranks(RANK_FILE), PATTERN)
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACED = "".join(map(chr, (32, 9, 10, 11, 12, 13)))


def docs_frame(spark, texts, sources=None, langs=None):
    rows = [(i, t, (langs or {}).get(i, "en"), sources[i] if sources else "s") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")


# ---- BPE


@given(st.text(alphabet="ab1 \n\t'é.日  ", max_size=300), st.integers(1, 40))
@settings(max_examples=200, deadline=None)
def test_segments_change_no_token(text, limit):
    parts = list(bpe.safe_segments(text, limit))
    assert "".join(parts) == text
    assert [i for p in parts for i in ENC.encode_ordinary(p)] == ENC.encode_ordinary(text)


def test_long_texts(monkeypatch):
    monkeypatch.setattr(bpe, "SEGMENT_CHARS", 50)
    for text in ("word and more, " * 400, "x" * 5000, " " * 3000 + "a", "né\n\n  x1 " * 300):
        assert bpe.encode_text(ENC, text) == ENC.encode_ordinary(text)


def test_runs_that_overflow_a_regex_engine():
    for n, tail in [(300_000, ""), (300_000, "a"), (300_000, "\n!")]:
        text = "word" + " " * n + tail
        assert bpe.encode_text(ENC, text) == ENC.encode_ordinary(text)
    for text in (" " * 2_000_000 + "end", "x" * 1_000_000, "-" * 1_000_000):
        assert ENC.decode_bytes(bpe.encode_text(ENC, text)) == text.encode()


def test_clashing_carried_columns_raise(spark):
    docs = docs_frame(spark, ["a"]).withColumn("ids", F.lit(1)).withColumn("score", F.lit(1)).withColumn("n_lines", F.lit(1))
    for call in (lambda: bpe.encode(docs, RANK_FILE, PATTERN, carry=("ids",)), lambda: bpe.decode(docs.withColumn("decoded", F.lit(1)), RANK_FILE, PATTERN), lambda: language_id.predict(docs, language_id.build({}), carry=("score",)), lambda: line_dedup.dedup_lines(docs, carry=("n_lines",)), lambda: line_dedup.dedup_lines(docs, carry=("source", "source"))):
        with pytest.raises(ValueError, match="clash"):
            call()


def test_bpe_round_trip(spark):
    texts = ["Hello  world's 12\n", "", None, "日本語 \U0001f600", "a" * 1000, "<|endoftext|>"]
    encoded = bpe.encode(docs_frame(spark, texts), RANK_FILE, PATTERN, carry=("lang",), verify=True)
    rows = {r.doc_id: r for r in bpe.decode(encoded, RANK_FILE, PATTERN).collect()}
    for i, t in enumerate(texts):
        want = ENC.encode_ordinary(t or "")
        assert np.frombuffer(rows[i].ids, "<u4").tolist() == want and rows[i].n_tokens == len(want)
        assert bytes(rows[i].decoded) == (t or "").encode() and rows[i].round_trip


def test_tokens_inside_a_character_decode_to_raw_bytes(spark):
    first = ENC.encode_ordinary("\U0001f600")[:1]
    frame = spark.createDataFrame([(1, bytearray(np.array(first, "<u4").tobytes())), (2, None)], "doc_id bigint, ids binary")
    got = {r.doc_id: bytes(r.decoded) for r in bpe.decode(frame, RANK_FILE, PATTERN).collect()}
    assert got == {1: "\U0001f600".encode()[: len(got[1])], 2: b""} and got[1]


def test_rank_file_bound(tmp_path, monkeypatch):
    (tmp_path / "r").write_bytes(b"x" * 10)
    monkeypatch.setattr(bpe, "MAX_RANK_BYTES", 5)
    with pytest.raises(ValueError, match="larger"):
        bpe.read_ranks(str(tmp_path / "r"))


# ---- secrets


def brute_base(text):
    """The base kinds found by hand, without the lengths in the patterns."""
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.IGNORECASE | re.ASCII):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(("assign", "access", "hex")[k], a, b) for a, k, b in sorted(out)]


@given(st.lists(st.sampled_from(["token", "Password", "api_key", "SECRET", "=", ": ", '"', "AKIA", "ABCDEFGH1234", "a1b2c3d4" * 4, "é", " ", "\n", "short", "abcdefgh", "'"]), max_size=14).map("".join))
@settings(max_examples=300, deadline=None)
def test_base_spans(text):
    assert secrets.base_spans(text) == brute_base(text)


def test_random_strings(spark):
    texts = {
        "key is q7Zr9xKfW2mPbT4vLs8dHn3J here": 1,
        "Antidisestablishmentarianism and internationalization": 0,
        "sha1 DA39A3EE5E6B4B0D3255BFEF95601890AFD80709 done": 0,
        "id 123e4567-e89b-12d3-a456-426614174000 end": 0,
        "some_long_snake_case_identifier_name_2": 0,
        "2024-01-02-2024-01-03-2024": 0,
        "token=q7Zr9xKfW2mPbT4vLs8dHn3J": 0,
        "": 0,
    }
    got = {r.doc_id: [s for s in r.spans if s.kind == secrets.ENTROPY] for r in secrets.scan(docs_frame(spark, [*texts, None]), RANK_FILE, PATTERN).collect()}
    for i, (text, n) in enumerate(texts.items()):
        assert len(got[i]) == n, text
        for s in got[i]:
            assert text[s.start : s.end] == "q7Zr9xKfW2mPbT4vLs8dHn3J"
    assert got[len(texts)] == []


# ---- language identification


def naive_phrases(symbols, sample):
    text, ref = "".join(map(chr, symbols)), "".join(map(chr, sample))
    count = at = 0
    while at < len(text):
        end = at + 1
        while end <= len(text) and text[at:end] in ref:
            end += 1
        at = max(at + 1, end - 1)
        count += 1
    return count


@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.lists(st.integers(0, 2), min_size=1, max_size=80), st.lists(st.integers(0, 3), min_size=1, max_size=80))
@settings(max_examples=100, deadline=None)
def test_phrase_counts(text, one, two):
    tables, roots, first = [], [], 0
    for sample in (one, two):
        edges = language_id.suffix_automaton(sample)
        dense = np.full((len(edges), 4), -1, np.int32)
        for s, out in enumerate(edges):
            for c, to in out.items():
                dense[s, c] = first + to
        tables.append(dense.ravel())
        roots.append(first)
        first += len(edges)
    model = language_id.Automata(["a", "b"], np.zeros(1, np.uint8), 4, np.concatenate(tables), np.array(roots), np.ones(2))
    blocks = [np.array(text, np.uint8), np.array(text[: len(text) // 2 + 1], np.uint8)]
    got = language_id.phrase_counts(model, blocks)
    assert got.tolist() == [[naive_phrases(b.tolist(), s) for s in (one, two)] for b in blocks]


def test_languages_are_told_apart(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    rest = language_id.remainder("doc_id", 5)
    model = language_id.fit(docs.filter(rest != 0))
    rows = language_id.predict(docs.filter(rest == 0), model, carry=("lang",)).collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and 0 <= r.score <= 1 for r in rows)
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.98


def test_language_cases(spark):
    docs = docs_frame(spark, ["the thing and the other", "le chat et la table", "und der die das"], langs={0: "en", 1: "fr", 2: None})
    model = language_id.fit(docs)
    assert model.languages == ["en", "fr"]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(docs_frame(spark, [None, "", "123 !", "the other thing", "日本", "le chat " * 3000]), model).collect()}
    assert got[0] == got[1] == got[2] == ("und", 0.0)
    assert got[3][0] == "en" and got[5][0] == "fr" and got[4][1] < 0.6
    none = language_id.fit(docs.filter("doc_id = 2"))
    assert none.languages == [] and language_id.predict(docs, none).first().lang_pred == "und"
    one = language_id.fit(docs.filter("doc_id = 0"))
    assert {r.score for r in language_id.predict(docs, one).collect()} == {1.0}


def test_languages_with_only_long_texts_are_learned(spark):
    rng = np.random.default_rng(2)
    words = {"en": "the and of thing other house water".split(), "de": "der und die sache andere wasser haus".split()}
    rows = [(None if i % 2 else 7, " ".join(rng.choice(words[k], 5000)), k) for k in words for i in range(5)]
    rows += [(i, "1234 " * 10, "xx") for i in range(2000)] + [(3, "1 é 2", "xx"), (4, "9", "yy")]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert model.languages == ["de", "en", "xx"]
    got = language_id.judge(model, ["the water of the house", "das wasser und die sache"])
    assert got[0] == ["en", "de"]


def test_every_one_of_many_languages_is_learned(spark):
    rows = [(i, f"{chr(0x4E00 + 40 * k + i)} text {chr(97 + k % 26) * 3}", f"l{k}") for k in range(250) for i in range(3)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert len(model.languages) == 250


def test_random_letters_are_in_no_language(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    model = language_id.fit(docs.filter(language_id.remainder("doc_id", 5) != 0))
    rng = np.random.default_rng(1)
    noise = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), n)) for n in (60, 300, 3000)]
    assert language_id.judge(model, noise)[3] == [False] * 3
    rows = language_id.predict(docs, model).filter("lang_pred <> 'und'").collect()
    assert sum(r.known for r in rows) >= 0.999 * len(rows)


# ---- lines


@given(st.sets(st.tuples(st.integers(0, 2**64 - 1), st.integers(0, 2**64 - 1)), max_size=400))
@settings(max_examples=60, deadline=None)
def test_perfect_hash(keys):
    high, low = (np.array([k[i] for k in keys], np.uint64) for i in (0, 1))
    built = mph.PerfectHash.build(high, low)
    assert sorted(built.index(high, low).tolist()) == list(range(len(keys)))


def test_perfect_hash_is_small():
    rng = np.random.default_rng(3)
    high, low = rng.integers(0, 2**63, (2, 100_000)).astype(np.uint64)
    built = mph.PerfectHash.build(high, low)
    assert built.nbytes * 8 / 100_000 < 6
    assert len(set(built.index(high, low).tolist())) == 100_000


def brute_lines(rows):
    key = lambda line: line.strip(SPACED).translate({c: c + 32 for c in range(65, 91)})
    held = {}
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= 40:
                held.setdefault(k, []).append(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if not (len(held.get(key(x), ())) >= 5 and max(held[key(x)]) != i)]
        out[i] = (len(lines), len(lines) - len(stay), "\n".join(stay))
    return out


@pytest.mark.parametrize("max_broadcast", [line_dedup.MAX_BROADCAST, 0])
def test_line_dedup(spark, monkeypatch, max_broadcast):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 3)
    common = "This line is held by very many of the documents, É"
    texts = [f"{common.upper() if i % 2 else '  ' + common}\t\nown {i}\n{'y' * 39}\n{'x' * 40 if i < 5 else 'z' * 40}\n {common}" for i in range(30)]
    texts += [None, "", "\n\n", common, *(f"line number {k % 7} that a handful of documents have in common\n" * 2 for k in range(60))]
    docs = docs_frame(spark, texts)
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in line_dedup.dedup_lines(docs, max_broadcast=max_broadcast, carry=("source",)).collect()}
    want = brute_lines(list(enumerate(texts)))
    assert got == want and sum(x[1] for x in want.values()) > 80


def test_line_dedup_null_ids_and_repeats(spark):
    line = "a line of text that is long enough to be looked at"
    rows = [(None, line), *((i, line) for i in range(4)), (3, line)]
    for bound in (line_dedup.MAX_BROADCAST, 0):
        got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string"), max_broadcast=bound).collect()
        assert Counter((r.doc_id, r.text) for r in got) == Counter([(None, ""), (0, ""), (1, ""), (2, ""), (3, line), (3, line)])


# ---- quality


def brute_counts(t):
    t = t or ""
    words = WORD.findall(t)
    grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    n = Counter(grams)
    marked = {k + j for k, g in enumerate(grams) if n[g] > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    failed = len(words) < 50 or 100 * len(marked) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(marked), failed


def test_quality_counts(spark):
    rng = np.random.default_rng(5)
    texts = [None, "", "a", "a b", "a b c", "a b c a b c", "a a a a a", "é#* |<\n\n  \né#* |<", "x y   z"]
    texts += [" ".join(rng.choice(list("abcd"), n)) for n in (10, 60, 300)] + ["\x0b".join(map(str, range(60))), "w " * 5000]
    got = {r.doc_id: tuple(r)[2:8] for r in host_quality.document_counts(docs_frame(spark, texts)).collect()}
    assert got == {i: brute_counts(t) for i, t in enumerate(texts)}


def test_hosts(spark):
    good, bad = " ".join(f"w{i}" for i in range(60)), "short"
    texts, sources = [], []
    for host, n, failures in (("clean", 40, 2), ("spam", 40, 38), ("tiny", 1, 1), ("mid", 40, 10), (None, 3, 1)):
        texts += [bad] * failures + [good] * (n - failures)
        sources += [host] * n
    rows = host_quality.judge(docs_frame(spark, texts, sources)).collect()
    kept = Counter((r.host, r.kept) for r in rows)
    assert kept[("spam", True)] == 0 and kept[("clean", True)] == 38 and kept[("mid", True)] == 30 and kept[(None, True)] == 2
    rates = {r.host: r.host_rate for r in rows}
    assert 0.5 < rates["tiny"] < 1 and rates["clean"] > 2 / 40 and rates["spam"] < 38 / 40 and rates[None] is None
    hosts = host_quality.host_counts(host_quality.document_counts(docs_frame(spark, [], [])))
    assert host_quality.fit_prior(hosts).alpha == 0


def test_digest_of_kept_text(spark):
    row = line_dedup.dedup_lines(docs_frame(spark, ["é\nx"])).first()
    assert hashlib.sha256(row.text.encode()).hexdigest() == hashlib.sha256("é\nx".encode()).hexdigest()
