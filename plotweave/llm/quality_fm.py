"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

With features ``x_i`` a text scores ``w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j``, through a sigmoid (Rendle 2010). The pairs are
never listed: by the sum-of-squares identity they are ``1/2 sum_f ((sum_i v_if x_i)² - sum_i v_if² x_i²)``, linear in the features of a text.

Features: the A-Z-lower-cased words ``[^\\x20\\x09-\\x0D]+`` in ``BUCKETS`` hash buckets (the logarithm of their count, of unit length
together); each structure statistic's bin (shares of letters, digits and symbols, repeated words and lines, lengths), of ``BINS`` made
from quantiles of the sample; and each metadata column's value, numbers by their power of two.

The model is fitted on the driver from a bounded sample: of each label the ``SAMPLE_ROWS`` distinct identifiers that come first in hash
order, each with one text (the one with the smallest hash); rows weigh so that labels count as in all labelled rows. Texts
become features where they lie; at most ``2 * SAMPLE_ROWS`` rows of at most ``BUCKETS`` numbers come to the driver. Scoring is one pass
without a shuffle, the model (a few hundred kilobytes) broadcast.

Cases: a null or empty text has no words and is scored by its statistics; labels other than 0 and 1, and labels without identifier or document, are
left out; repeated labels count once; with both labels for a document both are learned; without any label every score is 0.5, with
one label only scores lean to it; very long texts are read whole; repeated rows are scored each; null metadata is a value of its own; an empty
table gives an empty table. Only the columns named are read; a carried column with the name of an output raises.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotweave.llm.common import byte_values, no_clash, slices

BUCKETS, RANK = 1 << 13, 8
#: Identifiers of each label in the sample at most.
SAMPLE_ROWS, SPARE = 2048, 4
BINS, META_BUCKETS = 10, 256
EPOCHS, BATCH, RATE, DECAY, SEED = 20, 64, 0.05, 1e-4, 13
#: Value of a bin that holds, beside words of unit length together.
BIN_VALUE = 0.5
STATISTICS = ("words", "word_bytes", "distinct", "top_word", "repeated", "lines", "line_words", "repeated_lines", "upper", "digits", "bars", "symbols", "shouts", "stops", "other_signs", "beyond_ascii")
#: Words whose bucket a worker remembers.
REMEMBERED = 1 << 18
_CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digits": b"0123456789", "bars": b"|", "symbols": b"#*$%&<>", "shouts": b"!?", "stops": b".,;:", "other_signs": b"\"'()-/=@[\\]^_`{}~+"}


def class_table() -> np.ndarray:
    """Which bytes are of which class of ``_CLASSES``; the last is beyond ASCII."""
    table = np.zeros((256, len(_CLASSES) + 1), np.int64)
    for k, members in enumerate(_CLASSES.values()):
        table[list(members), k] = 1
    table[128:, -1] = 1
    return table


_TABLE = class_table()
_BUCKET_OF: dict[bytes, int] = {}


def statistics(text: bytes, words: list[bytes], counts: Counter) -> list[float]:
    """The values of ``STATISTICS``."""
    n, size = len(words), max(1, len(text))
    lines = [line for line in text.split(b"\n") if line.strip()]
    signs = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _TABLE
    total = max(1, n)
    return [
        math.log1p(n),
        sum(map(len, words)) / total,
        len(counts) / total,
        max(counts.values(), default=0) / total,
        sum(map(eq, words, words[1:])) / total,
        math.log1p(len(lines)),
        math.log1p(n / max(1, len(lines))),
        1 - len(set(lines)) / max(1, len(lines)),
        *(signs / size).tolist(),
    ]


def bucket(word: bytes) -> int:
    found = _BUCKET_OF.get(word)
    if found is None:
        if len(_BUCKET_OF) >= REMEMBERED:
            _BUCKET_OF.clear()
        found = _BUCKET_OF[word] = zlib.crc32(word) % BUCKETS
    return found


def text_features(text: bytes) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Buckets, their values, and the statistics of a text."""
    words = text.split()
    counts = Counter(words)
    lowered: Counter = Counter()
    for word, n in counts.items():
        lowered[bucket(word.lower())] += n
    at = np.fromiter(lowered.keys(), np.int32, len(lowered))
    value = np.log1p(np.fromiter(lowered.values(), np.float64, len(lowered)))
    order = np.argsort(at)
    return at[order], (value / max(1e-9, math.sqrt(float(value @ value))))[order], statistics(text, words, counts)


def metadata_bucket(name: str, value) -> int:
    """A bucket for a metadata value: a number by its power of two, else its text."""
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        value = math.frexp(value)[1] if math.isfinite(value) else str(value)
    return zlib.crc32(f"{name}={value}".encode("utf-8", "surrogatepass")) % META_BUCKETS


@dataclass
class Model:
    """Weights; features are buckets of words, then bins of statistics, then buckets of metadata."""

    bias: float = 0.0
    linear: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS + len(STATISTICS) * BINS + META_BUCKETS))
    factors: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS + len(STATISTICS) * BINS + META_BUCKETS, RANK)))
    edges: list[np.ndarray] = field(default_factory=lambda: [np.zeros(0)] * len(STATISTICS))
    metadata: tuple[str, ...] = ()

    def features(self, at: np.ndarray, value: np.ndarray, stats: Sequence[float], meta: Sequence) -> tuple[np.ndarray, np.ndarray]:
        """All features of a text; there is always one."""
        bins = [BUCKETS + k * BINS + int(np.searchsorted(self.edges[k], s, "left")) for k, s in enumerate(stats)]
        first = BUCKETS + len(STATISTICS) * BINS
        more = np.array(bins + [first + metadata_bucket(n, v) for n, v in zip(self.metadata, meta, strict=True)], np.int64)
        return np.concatenate([at, more]), np.concatenate([value, np.full(len(more), BIN_VALUE)])

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Probability of label 1 of each row of features."""
        return sigmoid(self.raw(rows)[0])

    def raw(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Scores before the sigmoid, and what the gradient needs: sums of factors by row, features, values and their rows."""
        starts = np.cumsum([0, *(len(at) for at, _ in rows[:-1])])
        at, value = np.concatenate([a for a, _ in rows]), np.concatenate([v for _, v in rows])
        own = self.factors[at] * value[:, None]
        sums = np.add.reduceat(own, starts, 0)
        squares = np.add.reduceat((own * own).sum(1), starts)
        raw = self.bias + np.add.reduceat(self.linear[at] * value, starts) + 0.5 * ((sums * sums).sum(1) - squares)
        return raw, sums, at, value, np.repeat(np.arange(len(rows)), [len(a) for a, _ in rows])


def sigmoid(raw: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def stat_edges(values: np.ndarray) -> np.ndarray:
    """Edges of at most ``BINS`` bins: zero has a bin of its own, what's above it is cut at quantiles."""
    above = values[values > 0]
    return np.unique(np.concatenate([[0.0], np.quantile(above, np.arange(1, BINS - 1) / (BINS - 1))])) if len(above) else np.zeros(1)


def train(rows: list[tuple[np.ndarray, np.ndarray, list[float], list]], labels: np.ndarray, weights: np.ndarray, metadata: tuple[str, ...] = (), epochs: int = EPOCHS, rate: float = RATE) -> Model:
    """A model of rows (buckets, values, statistics, metadata) by stochastic gradients (Adagrad) of the weighted logistic loss."""
    model = Model(metadata=metadata)
    if not len(rows):
        return model
    model.edges = [stat_edges(np.array([r[2][k] for r in rows])) for k in range(len(STATISTICS))]
    features = [model.features(*r) for r in rows]
    rng = np.random.default_rng(SEED)
    model.factors = rng.normal(0, 0.05, model.factors.shape)
    share = float((weights @ labels + 1) / (weights.sum() + 2))
    model.bias = math.log(share / (1 - share))
    seen_linear, seen_factors = np.full(model.linear.shape, 1e-2), np.full(model.factors.shape, 1e-2)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for start in range(0, len(rows), BATCH):
            picked = order[start : start + BATCH]
            raw, sums, at, value, row = model.raw([features[i] for i in picked])
            error = (sigmoid(raw) - labels[picked]) * weights[picked]
            slope = error[row] * value
            where, place = np.unique(at, return_inverse=True)
            linear = np.bincount(place, slope) + DECAY * model.linear[where]
            per_factor = slope[:, None] * (sums[row] - model.factors[at] * value[:, None])
            factors = np.stack([np.bincount(place, per_factor[:, f]) for f in range(RANK)], 1) + DECAY * model.factors[where]
            seen_linear[where] += linear**2
            seen_factors[where] += factors**2
            model.linear[where] -= rate * linear / np.sqrt(seen_linear[where])
            model.factors[where] -= rate * factors / np.sqrt(seen_factors[where])
            model.bias -= rate * float(error.mean())
    return model


def sampled(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[DataFrame, dict[int, int]]:
    """``doc_id``, ``label``, ``text`` and metadata ``m0``... of the sample, and the number of labelled identifiers by label.

    ``docs`` has ``doc_id``, ``text`` and the metadata, ``labels`` has ``doc_id`` and ``label``. Distinct pairs have distinct
    hashes, so that a threshold on them, ``SPARE`` times as wide as needed, leaves enough.
    """
    pairs = labels.filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("label").cast("int").alias("label")).distinct()
    pairs = pairs.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("_hash", F.xxhash64("doc_id", "label"))
    counts = {r.label: r.n for r in pairs.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    early = F.lit(False)
    for label, n in counts.items():
        share = SPARE * rows / n
        early = early | ((F.col("label") == label) & (F.lit(True) if share >= 0.5 else F.col("_hash") < int(-(2**63) + share * 2**64)))
    first = Window.partitionBy("label").orderBy("_hash", "doc_id")
    picked = pairs.filter(early).withColumn("_place", F.row_number().over(first)).filter(F.col("_place") <= rows).select("doc_id", "label")
    # At most 2 * rows rows.
    bounded = F.broadcast(picked)
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    found = docs.join(bounded, "doc_id").withColumn("_row", F.struct(F.xxhash64("text").alias("h"), "text", *others))
    one = found.groupBy("doc_id", "label").agg(F.min("_row").alias("_row"))
    return one.select("doc_id", "label", "_row.text", *(f"_row.{c}" for c in others)), counts


def _texts(docs: DataFrame, id_col: str, text_col: str, metadata: Sequence[str], *more: Column) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *(F.col(c).alias(f"m{k}") for k, c in enumerate(metadata)), *more)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "label", metadata: tuple[str, ...] = (), rows: int = SAMPLE_ROWS) -> Model:
    """The model of the labelled documents; ``labels`` has the identifier and the label."""
    sample, counts = sampled(_texts(docs, id_col, text_col, metadata), labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label")), rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            found = [text_features(t) for t in byte_values(batch.column(2))]
            columns = [pa.array([f[k] for f in found], pa.list_(kind)) for k, kind in enumerate((pa.int32(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(1), *columns, *batch.columns[3:]], names)

    meta = [f"m{k}" for k in range(len(metadata))]
    names = ["doc_id", "label", "at", "value", "stats", *meta]
    kinds = dict(sample.dtypes)
    # Two labels of at most ``rows`` rows, of at most BUCKETS numbers.
    collected = sample.mapInArrow(run, ", ".join(["doc_id string, label int, at array<int>, value array<double>, stats array<double>", *(f"{m} {kinds[m]}" for m in meta)])).collect()
    collected.sort(key=lambda r: (zlib.crc32(r.doc_id.encode()), r.doc_id, r.label))
    label = np.array([r.label for r in collected], np.float64)
    each = {k: counts[k] / max(1, int((label == k).sum())) for k in counts}
    weight = np.array([each[r.label] for r in collected], np.float64)
    weight /= max(1e-9, weight.mean()) if len(weight) else 1
    return train([(np.array(r["at"], np.int32), np.array(r["value"]), r["stats"], [r[m] for m in meta]) for r in collected], label, weight, metadata)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """``doc_id``, ``score`` (0 to 1), then the carried columns."""
    no_clash(carry, "doc_id", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    n_meta = len(model.metadata)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in slices(batches, 256):
            meta = [batch.column(2 + k).to_pylist() for k in range(n_meta)]
            rows = [own.features(*text_features(t), [m[i] for m in meta]) for i, t in enumerate(byte_values(batch.column(1)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.scores(rows)), *batch.columns[2 + n_meta :]], ["doc_id", "score", *carry])

    texts = _texts(docs, id_col, text_col, model.metadata, *(F.col(c).alias(f"_{k}") for k, c in enumerate(carry)))
    kinds = dict(texts.dtypes)
    return texts.mapInArrow(run, ", ".join([f"doc_id {kinds['doc_id']}, score double", *(f"`{c}` {kinds[f'_{k}']}" for k, c in enumerate(carry))]))
