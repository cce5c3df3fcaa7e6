"""Language identification by cross-parsing entropy.

Each language has a suffix automaton of sample text. A text is parsed against it
from left to right into phrases, each the longest match that the sample holds; with
``c`` phrases over ``m`` symbols and a sample of ``n`` symbols, ``c * log2(n + a) / m``
estimates the bits a symbol that the language's statistics need for the text (Ziv
and Merhav 1993); a phrase names a place in the sample or one of the ``a`` symbols of the alphabet, without
which a tiny sample's phrases would cost nothing. The language that needs fewest wins.

Texts are lower-cased, every run of other characters than letters becomes one
blank, and the rest are parsed in blocks of ``BLOCK`` symbols, all blocks of an Arrow
batch and all languages in step with each other, so that the work is table
look-ups on whole vectors. Every symbol of a text is parsed.

The automata are fitted on a bounded sample. Of each language the ``SAMPLE_ROWS`` distinct texts with a letter that come first in the order of
their hashes are candidates, however often and under whatever identifiers they are repeated. They are taken whole, in that
order, until the language has ``SAMPLE_SYMBOLS`` letters and blanks (fewer beyond ten languages). Texts of more than 1 / ``SHARE`` of that
are passed over at first, lest one fills the sample; where the others don't fill half of it, slices of them at places that their hashes choose do.
So a language is learned if one labelled text of it has a letter, however long or repeated its texts are. The automata are built on the driver
and broadcast; these parameters and ``MAX_LANGUAGES`` bound their size. Most states have one successor and keep just that; only states with several, about
a third, have a row of the transition table.

For each language the model also knows the bits that its own symbols in random order
need: what needs as many isn't in that language (``known``).

Cases: a null text and one without a letter are ``und`` with score 0; equal
entropies give the language that sorts first; with one language the score is 1; with
none learned every text is ``und``; equal texts of a language are one candidate of its sample, identifiers don't
matter; very long texts are parsed whole; repeated rows are judged each; an empty table
gives an empty table. Only the columns named are read; a carried column with the name of an output raises.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotweave.llm.common import no_clash, slices

UNDETERMINED = "und"
#: Candidates of a language's sample at most and at least, and of all languages' together; how many times as many are sorted.
SAMPLE_ROWS, LEAST_ROWS, ALL_ROWS, SPARE = 256, 4, 2560, 8
#: Letters and blanks of a language's sample, and of all together; the part of it that a text may have to be taken first.
SAMPLE_SYMBOLS, ALL_SYMBOLS, SHARE = 1 << 16, 10 << 16, 16
#: More labels than this aren't languages, and raise.
MAX_LANGUAGES = 1000
#: Letters that get a symbol of their own; others share ``FOLDS`` symbols by code point.
OWN_SYMBOLS, FOLDS = 64, 8
BLOCK = 1024
#: Symbols in random order that the noise level is measured on.
NOISE_SYMBOLS = 1 << 13
#: Symbols parsed at once.
AT_ONCE = 1 << 21
BLANK, NO_SYMBOL = 0, 255


@dataclass
class Automata:
    """Transitions of all languages' automata, -1 where there is none.

    The first states have a row each, ``table[state * width + symbol]``; after these rows is an empty one for all others, which have
    one successor, ``following``, for one symbol, ``only``. The last of them is no state and follows nothing. A table without
    ``only`` has a row for every state.
    """

    languages: list[str]
    symbols: np.ndarray  # by code point
    width: int
    table: np.ndarray
    roots: np.ndarray
    bits: np.ndarray  # of a phrase, by language
    only: np.ndarray | None = None
    following: np.ndarray | None = None
    noise: np.ndarray | None = None  # bits a symbol of each sample in random order

    def __post_init__(self) -> None:
        if self.only is None:
            self.table = np.append(self.table, np.full(self.width, -1, self.table.dtype))
            self.only, self.following = np.full(1, NO_SYMBOL, np.uint8), np.full(1, -1, np.int32)

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The states after ``symbol``."""
        rows = len(self.table) // self.width - 1
        to = self.table[np.minimum(state, rows) * self.width + symbol]
        other = np.maximum(state - rows, -1)
        return np.where(self.only[other] == symbol, self.following[other], to)


_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")


def symbol_table(samples: list[str]) -> tuple[np.ndarray, int]:
    """A symbol for each code point: blank for all but letters."""
    counts = Counter(c for s in samples for c in s.lower() if c.isalpha())
    own = [c for c, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:OWN_SYMBOLS]]
    table = np.zeros(0x110000, np.uint8)
    points = np.flatnonzero(letters())
    table[points] = 1 + len(own) + points % FOLDS
    for k, c in enumerate(own):
        table[ord(c)] = 1 + k
    return table, 1 + len(own) + FOLDS


def to_symbols(text: str, table: np.ndarray) -> np.ndarray:
    """Symbols of a text, runs of blanks as one, none at the ends."""
    s = table[code_points(text)]
    keep = s != BLANK
    keep[1:] |= s[:-1] != BLANK
    s = s[keep]
    start, end = int(len(s) > 0 and s[0] == BLANK), len(s) - int(len(s) > 1 and s[-1] == BLANK)
    return s[start:end]


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton of all substrings, state 0 its start (Blumer et al. 1985)."""
    edges: list[dict[int, int]] = [{}]
    length, link, last = [0], [-1], 0
    for c in symbols:
        state = len(edges)
        edges.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in edges[p]:
            edges[p][c] = state
            p = link[p]
        if p >= 0:
            q = edges[p][c]
            if length[q] != length[p] + 1:
                clone = len(edges)
                edges.append(dict(edges[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and edges[p].get(c) == q:
                    edges[p][c] = clone
                    p = link[p]
                link[q] = clone
                q = clone
            link[state] = q
        last = state
    return edges


def build(samples: dict[str, list[str]]) -> Automata:
    """Automata of the languages' sample texts."""
    languages = sorted(samples)
    table, width = symbol_table([t for texts in samples.values() for t in texts])
    automata, bits, shuffled = [], [], []
    for language in languages:
        joined: list[int] = []
        for text in samples[language]:
            joined += [BLANK, *to_symbols(text, table).tolist()]
        automata.append(suffix_automaton(joined))
        bits.append(np.log2(len(joined) + width))
        shuffled.append(np.random.default_rng(len(joined)).permutation(np.array(joined, np.uint8))[:NOISE_SYMBOLS])
    # States with several successors are numbered first, and starts with them.
    wide = [np.array([k == 0 or len(out) > 1 for k, out in enumerate(edges)]) for edges in automata]
    rows, narrow = sum(int(w.sum()) for w in wide), sum(int((~w).sum()) for w in wide)
    dense, only, following = np.full((rows + 1, width), -1, np.int32), np.full(narrow + 1, NO_SYMBOL, np.uint8), np.full(narrow + 1, -1, np.int32)
    roots, first_wide, first_narrow = [], 0, 0
    for edges, has_row in zip(automata, wide, strict=True):
        number = np.where(has_row, first_wide + np.cumsum(has_row) - 1, rows + first_narrow + np.cumsum(~has_row) - 1)
        for state, out in enumerate(edges):
            for c, to in out.items():
                if has_row[state]:
                    dense[number[state], c] = number[to]
                else:
                    only[number[state] - rows], following[number[state] - rows] = c, number[to]
        roots.append(int(number[0]))
        first_wide, first_narrow = first_wide + int(has_row.sum()), first_narrow + int((~has_row).sum())
    model = Automata(languages, table, width, dense.ravel(), np.array(roots, np.int64), np.array(bits), only, following)
    if languages:
        blocks = [s[a : a + BLOCK] for s in shuffled for a in range(0, len(s), BLOCK)]
        of = np.repeat(np.arange(len(languages)), [-(-len(s) // BLOCK) for s in shuffled])
        phrases = np.zeros((len(languages), len(languages)))
        np.add.at(phrases, of, phrase_counts(model, blocks))
        model.noise = np.diag(phrases) * model.bits / [max(1, len(s)) for s in shuffled]
    return model


def phrase_counts(model: Automata, blocks: list[np.ndarray]) -> np.ndarray:
    """Phrases of each block (row) for each language (column)."""
    n, k = len(blocks), len(model.languages)
    order = np.argsort([-len(b) for b in blocks], kind="stable")
    lengths = np.array([len(blocks[i]) for i in order])
    grid = np.zeros((n, int(lengths[0]) if n else 0), np.uint8)
    for row, i in enumerate(order):
        grid[row, : lengths[row]] = blocks[i]
    steps = np.ascontiguousarray(grid.T)
    # The table's values are states; a root's row restarts a phrase.
    rows = model.table.reshape(-1, model.width)
    restart = rows[model.roots]  # language x symbol
    roots = model.roots[:, None]
    state = np.repeat(roots, n, 1)
    count = np.zeros((k, n), np.int32)
    active = n
    for t in range(steps.shape[0]):
        while active and lengths[active - 1] <= t:
            active -= 1
        c = steps[t, :active]
        here = state[:, :active]
        to = model.step(here, c)
        lost = to < 0
        # A state that is a root's opens a phrase: at the start, and after a symbol that the sample lacks.
        count[:, :active] += lost | (here == roots)
        again = np.maximum(restart[:, c], roots)
        state[:, :active] = np.where(lost, again, to)
    out = np.empty((n, k), np.int32)
    out[order] = count.T
    return out


def judge(model: Automata, texts: Iterable[str | None]) -> tuple[list[str], list[float], list[float | None], list[bool]]:
    """Language, score, the winner's bits a symbol, and whether the text looks like that language, for each text.

    It does if its phrases but for the first, which any text has, need fewer bits than random order.
    """
    own = [to_symbols(t, model.symbols) if t else np.zeros(0, np.uint8) for t in texts]
    blocks = [s[a : a + BLOCK] for s in own for a in range(0, len(s), BLOCK)]
    of = np.repeat(np.arange(len(own)), [-(-len(s) // BLOCK) for s in own])
    phrases = np.zeros((len(own), len(model.languages)))
    start = 0
    step = max(1, AT_ONCE // BLOCK)
    for start in range(0, len(blocks), step):
        np.add.at(phrases, of[start : start + step], phrase_counts(model, blocks[start : start + step]))
    lang, score, bits, known = [], [], [], []
    entropy = phrases * model.bits / np.maximum(1, [[len(s)] for s in own]) if own else phrases
    for symbols, e in zip(own, entropy, strict=True):
        if not len(symbols) or not len(e):
            lang.append(UNDETERMINED)
            score.append(0.0)
            bits.append(None)
            known.append(False)
            continue
        best = int(np.argmin(e))
        second = float(np.min(np.delete(e, best))) if len(e) > 1 else float("inf")
        lang.append(model.languages[best])
        score.append(1.0 if second == float("inf") else second / (second + float(e[best])))
        bits.append(float(e[best]))
        known.append(bool(e[best] - model.bits[best] / len(symbols) < model.noise[best]))
    return lang, score, bits, known


def sample_bounds(languages: int) -> tuple[int, int]:
    """Candidates and symbols of each language's sample."""
    return max(LEAST_ROWS, min(SAMPLE_ROWS, ALL_ROWS // max(1, languages))), min(SAMPLE_SYMBOLS, ALL_SYMBOLS // max(1, languages))


def sample_rows(labelled: DataFrame) -> DataFrame:
    """``lang``, ``place``, ``n`` (letters and single blanks of the text) and ``text``: these, of longer texts a slice of the length that a text may have.

    Distinct texts of each language are estimated first (``MAX_LANGUAGES`` numbers come to the driver), so that only about
    ``SPARE`` times the texts that are needed are sorted.
    """
    usable = labelled.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).withColumn("_hash", F.xxhash64("text"))
    counts = usable.groupBy("lang").agg(F.approx_count_distinct("_hash").alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    rows, symbols = sample_bounds(len(counts))
    most = max(1, symbols // SHARE)
    early = F.lit(False)
    for r in counts:
        share = SPARE * rows / r.n
        own = F.col("lang") == r.lang
        # Hashes of distinct texts spread evenly: one in SPARE of those let through is enough.
        early = early | (own if share >= 0.5 else own & (F.col("_hash") < int(-(2**63) + share * 2**64)))
    distinct = usable.filter(early).groupBy("lang", "_hash").agg(F.min("text").alias("text"))
    first = Window.partitionBy("lang").orderBy("_hash", "text")
    picked = distinct.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= rows)
    letters_only = F.trim(F.regexp_replace("text", r"[^\p{L}]+", " "))
    spare = F.greatest(F.length("_letters") - most + 1, F.lit(1))
    start = F.pmod(F.xxhash64("_hash", "place"), spare).cast("int")
    return picked.withColumn("_letters", letters_only).select("lang", "place", F.length("_letters").alias("n"), F.substr("_letters", 1 + start, F.lit(most)).alias("text"))


def chosen(rows: list, symbols: int) -> dict[str, list[str]]:
    """Texts of each language's sample from its candidates (``sample_rows``)."""
    most = max(1, symbols // SHARE)
    samples: dict[str, list[str]] = {}
    for long in (False, True):
        for r in sorted(rows, key=lambda r: (r.lang, r.place)):
            own = samples.setdefault(r.lang, [])
            held = sum(map(len, own))
            if (r.n > most) == long and (not own or held + len(r.text) <= (symbols // 2 if long else symbols)):
                own.append(r.text)
    return samples


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Automata:
    """Automata from the bounded sample described above; identifiers aren't read."""
    rows = sample_rows(labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))).collect()
    return build(chosen(rows, sample_bounds(len({r.lang for r in rows}))[1]))


def predict(docs: DataFrame, model: Automata, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score`` (0 to 1), ``bits`` a symbol, ``known``, then the carried columns."""
    no_clash(carry, "doc_id", "lang_pred", "score", "bits", "known")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            lang, score, bits, known = judge(shared.value, (text.as_py() for text in batch.column(1)))
            columns = [batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(bits, pa.float64()), pa.array(known, pa.bool_()), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score", "bits", "known", *carry])

    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *(F.col(c).alias(f"_{k}") for k, c in enumerate(carry)))
    kinds = {f.name: f.dataType.simpleString() for f in texts.schema}
    fields = [f"doc_id {kinds['doc_id']}", "lang_pred string", "score double", "bits double", "known boolean", *(f"`{c}` {kinds[f'_{k}']}" for k, c in enumerate(carry))]
    return texts.mapInArrow(run, ", ".join(fields))


def remainder(id_col: str, modulus: int) -> Column:
    """The remainder of the CRC-32 of an identifier as text."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(modulus))
