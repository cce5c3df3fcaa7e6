"""Secret scan: known patterns, and a token-efficiency test for random strings.

A string that a tokenizer's vocabulary can't compress is unlikely to be language or
code: natural words take 3 to 5 characters a token, random strings under 2. The
scan takes unbroken strings, leaves out known digests, UUIDs, dates and identifiers made of
efficient pieces, and reports those with fewer characters per token than a threshold.

Everything runs in one Arrow pass without a shuffle. Of random strings of 20 to 64
characters at least 0.9 are found, be they of base62, base64, mixed-case or lower-case letters alone
(tests hold each alphabet); upper-case hexadecimal of a digest's length is a digest, by definition.

Cases: a null or empty text has no spans; offsets are code points, the end exclusive; spans that
start together are in the order of the kinds, token last; a candidate that a base span touches isn't
reported twice; very long texts and strings are scanned whole, in time in proportion to their length;
repeated rows are scanned each; an empty table gives an empty table; columns other
than the two named are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from plotweave.llm.bpe import encoding, read_ranks
from plotweave.llm.common import with_text

KINDS = ("assign", "access", "hex")
ENTROPY = "token"
# The patterns and least lengths of the base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_ASSIGN, LEAST_ACCESS = 8, 16

#: Unbroken strings that the token-efficiency test looks at.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Below so many characters per token a candidate counts as random.
MAX_CHARS_PER_TOKEN = 2.0
# Lengths in hexadecimal digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512 digests.
DIGEST_LENGTHS = frozenset({32, 40, 56, 64, 96, 128})
#: Every alternative is linear: a repeat starts with a separator and goes on with a digit.
IDENTIFIER = re.compile(
    r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}"  # UUID
    r"|[_=+/-]+"  # rules
    r"|[_=+/-]*[0-9]{1,8}(?:[_=+/-]+[0-9]{1,8})*[_=+/-]*"  # dates, short numbers
)
#: snake_case, kebab-case, paths: strings split here, of pieces that are judged one by one.
SEPARATORS = re.compile(r"[_/-]+")
PIECE = re.compile(r"([A-Za-z]*)[0-9]{0,4}")
LEAST_PIECE = 4

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Spans of the base kinds, by start, then in the order of ``KINDS``.

    A failing assignment still uses up its text, so its least length can't go into the
    pattern. For the other two kinds every match is a maximal run, and it can.
    """
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(KINDS[k], start, end) for start, k, end in sorted(found)]


def known_value(s: str, enc: tiktoken.Encoding, threshold: float) -> bool:
    """Digests of usual lengths and ordinary identifiers aren't secrets by their looks."""
    if len(s) in DIGEST_LENGTHS and re.fullmatch("[0-9a-f]+|[0-9A-F]+", s):
        return True
    if IDENTIFIER.fullmatch(s):
        return True
    pieces = SEPARATORS.split(s)
    if len(pieces) < 2 or not pieces[0][:1].isalpha():
        return False
    matches = [PIECE.fullmatch(p) for p in pieces]
    return all(matches) and all(len(w) >= threshold * len(enc.encode_ordinary(w)) for w in (m[1] for m in matches) if len(w) >= LEAST_PIECE)


def random_spans(text: str, enc: tiktoken.Encoding, base: list[Span], threshold: float) -> list[Span]:
    """Candidates under the threshold that no base span (ordered by start) touches.

    Both lists are walked together: of the base spans that start before a candidate's end, the largest
    end tells whether one reaches into it.
    """
    out: list[Span] = []
    at, reach = 0, 0
    for m in CANDIDATE.finditer(text):
        s, (start, end) = m.group(), m.span()
        while at < len(base) and base[at][1] < end:
            reach = max(reach, base[at][2])
            at += 1
        if reach > start:
            continue
        if len(s) < threshold * len(enc.encode_ordinary(s)) and not known_value(s, enc, threshold):
            out.append((ENTROPY, start, end))
    return out


def scan(docs: DataFrame, rank_file: str, pattern: str, threshold: float = MAX_CHARS_PER_TOKEN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``spans``, an array of (kind, start, end), ordered by start."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(rank_file))
    struct = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    order = {k: i for i, k in enumerate((*KINDS, ENTROPY))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks.value, pattern)
        for batch in batches:
            rows = []
            for value in batch.column(1):
                text = value.as_py()
                spans = base_spans(text)
                spans += random_spans(text, enc, spans, threshold)
                spans.sort(key=lambda s: (s[1], order[s[0]]))
                rows.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, struct)], ["doc_id", "spans"])

    texts = with_text(docs, id_col, text_col)
    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")
