"""Byte-level BPE encoding and decoding with a local rank file.

``encode`` gives each text's token ids as little-endian unsigned 32-bit
integers, ``decode`` turns such ids back into raw bytes (which need not be valid
UTF-8: a token can end inside a character). Both run in Arrow batches; nothing is
shuffled. The rank file is read on the driver and broadcast: a vocabulary has a
fixed size, and ``MAX_RANK_BYTES`` is checked.

Cases: a null or empty text has no tokens; a null id list decodes to no bytes;
repeated rows are encoded each; an empty table gives an empty table; columns other
than the named ones are not read, so clashing names do no harm, but a carried column with the
name of an output raises. Very long texts are encoded whole, in segments; a segment of more than
``MAX_SEGMENT`` characters (a run without a safe boundary, as of a million blanks, on which
the tokenizer's own regex engine overflows its stack) is split by the ``regex`` library instead.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotweave.llm.common import no_clash, slices, with_text

#: A rank file beyond this isn't broadcast but refused.
MAX_RANK_BYTES = 64 << 20
#: Texts longer than this many characters are cut at safe boundaries before the regex runs.
SEGMENT_CHARS = 1 << 16
#: Longer segments don't go to the tokenizer's regex engine.
MAX_SEGMENT = 1 << 18
#: A pattern of which any text is one match.
WHOLE = r"[\s\S]+"

_ENCODINGS: dict[tuple[int, str], tiktoken.Encoding] = {}
#: What an encoding was made of, by its identity (encodings are never let go).
_MADE_OF: dict[int, tuple[bytes, str]] = {}


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        ranks = f.read(MAX_RANK_BYTES + 1)
    if len(ranks) > MAX_RANK_BYTES:
        raise ValueError(f"rank file {path} is larger than {MAX_RANK_BYTES} bytes")
    return ranks


def encoding(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file's content; built once per process."""
    key = (hash(ranks), pattern)
    if key not in _ENCODINGS:
        pairs = (line.split() for line in ranks.splitlines() if line.strip())
        table = {base64.b64decode(token): int(rank) for token, rank in pairs}
        _ENCODINGS[key] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        _MADE_OF[id(_ENCODINGS[key])] = ranks, pattern
    return _ENCODINGS[key]


def safe_segments(text: str, limit: int = SEGMENT_CHARS) -> Iterator[str]:
    """Cut ``text`` where no match of a GPT-style split pattern can cross.

    Such a pattern never continues a letter or digit run into white space, and
    white space opens a match rather than closing one with letters. So a cut
    between an alphanumeric character and a following blank or line feed leaves every
    match as it is. A run without such a place stays whole.
    """
    start, n = 0, len(text)
    while n - start > limit:
        cut = _boundary(text, start + limit)
        if cut is None:
            break
        yield text[start:cut]
        start = cut
    yield text[start:]


def _boundary(text: str, at: int) -> int | None:
    """The first safe place at or after ``at``."""
    while at < len(text):
        places = [p for p in (text.find(" ", at), text.find("\n", at)) if p >= 0]
        if not places:
            return None
        at = min(places)
        if text[at - 1].isalnum():
            return at
        at += 1
    return None


def encode_text(enc: tiktoken.Encoding, text: str) -> list[int]:
    """The ids of a text of any length, by an encoding that ``encoding`` made."""
    if len(text) <= SEGMENT_CHARS:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for part in safe_segments(text):
        if len(part) <= MAX_SEGMENT:
            ids += enc.encode_ordinary(part)
        else:
            ranks, pattern = _MADE_OF[id(enc)]
            one = encoding(ranks, WHOLE)
            for match in regex.finditer(pattern, part):
                ids += one.encode_ordinary(match.group())
    return ids


def encode(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = (), verify: bool = False) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids`` (binary, little-endian unsigned 32-bit) of each row, then the carried columns.

    With ``verify``, last, ``round_trip``: whether the ids decode to the text's bytes.
    """
    spark: SparkSession = docs.sparkSession
    no_clash(carry, "doc_id", "n_tokens", "ids", "round_trip")
    ranks = spark.sparkContext.broadcast(read_ranks(rank_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks.value, pattern)
        for batch in slices(batches):
            counts, ids, same = [], [], []
            for value in batch.column(1):
                text = value.as_py()
                tokens = encode_text(enc, text)
                counts.append(len(tokens))
                ids.append(np.array(tokens, "<u4").tobytes())
                if verify:
                    same.append(enc.decode_bytes(tokens) == text.encode())
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.binary()), *batch.columns[2:]]
            names = ["doc_id", "n_tokens", "ids", *carry]
            if verify:
                columns.append(pa.array(same, pa.bool_()))
                names.append("round_trip")
            yield pa.RecordBatch.from_arrays(columns, names)

    texts = with_text(docs, id_col, text_col, *(F.col(c).alias(f"_{k}") for k, c in enumerate(carry)))
    kind = texts.schema["doc_id"].dataType.simpleString()
    more = "".join(f", `{c}` {texts.schema[f'_{k}'].dataType.simpleString()}" for k, c in enumerate(carry))
    return texts.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids binary{more}{', round_trip boolean' * verify}")


def decode(encoded: DataFrame, rank_file: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """The columns of ``encoded``, then ``decoded`` (binary).

    An id outside the vocabulary raises.
    """
    ranks = encoded.sparkSession.sparkContext.broadcast(read_ranks(rank_file))
    no_clash(encoded.columns, "decoded")
    at = encoded.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks.value, pattern)
        for batch in slices(batches):
            decoded = [enc.decode_bytes(np.frombuffer(ids.as_py() or b"", "<u4").tolist()) for ids in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.binary())], [*batch.schema.names, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{fields}, decoded binary")
