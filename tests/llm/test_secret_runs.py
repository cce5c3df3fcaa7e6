"""Random strings of letters or digits alone are judged by their tokens."""

import base64
import random
import string
import time

from plotweave.llm import bpe, queries, secrets

ENC = bpe.encoding(bpe.read_ranks(queries.RANK_FILE), queries.PATTERN)


def found(s):
    return len(secrets.random_spans(f"see {s} there", ENC, [], secrets.MAX_CHARS_PER_TOKEN))


def test_random_letters_are_found():
    draw = random.Random(7)
    for alphabet, least in [(string.ascii_letters, 195), (string.ascii_lowercase, 170), (string.ascii_letters + string.digits, 195)]:
        assert sum(found("".join(draw.choices(alphabet, k=24))) for _ in range(200)) >= least
    assert sum(found("".join(draw.choices(string.ascii_letters, k=10)) + "_" + "".join(draw.choices(string.ascii_letters, k=12))) for _ in range(200)) >= 190


def test_long_digit_runs_are_judged_by_their_tokens():
    draw = random.Random(8)
    for _ in range(50):
        s = "".join(draw.choices(string.digits, k=40))
        assert found(s) == (len(s) < secrets.MAX_CHARS_PER_TOKEN * len(ENC.encode_ordinary(s)))


def test_known_forms_are_not():
    for s in ["2024-01-02-2024-01-03-2024", "src/a/b/c/d/e/f/g/h1/k2", "some_long_snake_case_identifier_name_2", "internationalization", "getUserAccountBalanceByName", "-" * 30, "123e4567-e89b-12d3-a456-426614174000"]:
        assert not found(s)


def test_recall_of_each_alphabet():
    draw = random.Random(9)
    alphabets = {"base62": string.ascii_letters + string.digits, "mixed": string.ascii_letters, "lower": string.ascii_lowercase}
    for name, alphabet in alphabets.items():
        hits = [found("".join(draw.choices(alphabet, k=draw.randint(20, 64)))) for _ in range(300)]
        assert sum(hits) >= 270, name
    assert sum(found(base64.b64encode(draw.randbytes(draw.randint(18, 48))).decode()) for _ in range(300)) >= 270


def test_time_follows_length():
    """A million of each candidate character, and the runs that a nested repeat would try in all ways."""
    for c in "aA0+/_=-":
        for s in (c * 1_000_000, "a" + c * 1_000_000 + "+", "1" + c * 1_000_000 + "x"):
            start = time.perf_counter()
            secrets.known_value(s, ENC, secrets.MAX_CHARS_PER_TOKEN)
            assert time.perf_counter() - start < 5
    start = time.perf_counter()
    text = "token=abcdefgh1 q7Zr9xKfW2mPbT4vLs8dHn3J " * 20_000
    base = secrets.base_spans(text)
    assert len(base) == 20_000 and len(secrets.random_spans(text, ENC, base, secrets.MAX_CHARS_PER_TOKEN)) == 20_000
    assert time.perf_counter() - start < 10


def test_query_reports_planted_strings(spark, tmp_path):
    rows = [(1, "see q7Zr9xKfW2mPbT4vLs8dHn3J there"), (2, "plain words"), (3, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.spans) for r in queries.op5_secrets(spark, str(tmp_path)).collect()}
    assert got == {1: (0, 0, 0, "token:4:28"), 2: (0, 0, 0, ""), 3: (0, 0, 0, "")}
