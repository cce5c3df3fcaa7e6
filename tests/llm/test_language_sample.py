"""The bounded sample of language identification: no language is lost, texts are whole, automata are exact."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plotweave.llm import language_id

GERMAN = ["der hund und die katze liegen im garten", "das wetter ist heute schön und warm", "wir gehen morgen in die stadt", "ich habe das buch noch nicht gelesen"]


@pytest.mark.parametrize("text", ["the quick brown fox jumps over the lazy dog", "what is seen here is repeated often", "one text of many rows", "and yet another of them"])
def test_repeated_rows_dont_lose_a_language(spark, text):
    english = spark.range(20_000).select(F.lit(1).cast("bigint").alias("doc_id"), F.lit(text).alias("text"), F.lit("en").alias("lang"))
    german = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.element_at(F.array(*map(F.lit, GERMAN)), (F.col("id") % 4 + 1).cast("int")), F.lit(" "), F.col("id").cast("string"), F.translate(F.col("id").cast("string"), "0123456789", "aeioubrstn")).alias("text"), F.lit("de").alias("lang"))
    model = language_id.fit(english.unionByName(german))
    assert model.languages == ["de", "en"]
    assert [r.lang_pred for r in language_id.predict(english.limit(1), model).collect()] == ["en"]


def test_null_identifiers_and_languages_of_one_row(spark):
    rows = [(None, f"word{chr(97 + i % 26)} number {i} of the english rows", "en") for i in range(3000)] + [(None, "jeden polski wiersz tutaj", "pl"), (7, None, "xx"), (8, "123", "yy")]
    found = language_id.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert found.languages == ["en", "pl"]


def test_texts_are_whole_and_long_ones_fill_the_rest(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(5))
    short = [" ".join(word() for _ in range(50)) for _ in range(20)]
    long = [" ".join(word() for _ in range(5000)) for _ in range(3)]
    rows = [(i, t, "en") for i, t in enumerate(short + long)] + [(100, long[0] + "z", "fr")]
    found = language_id.sample_rows(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()
    _, symbols = language_id.sample_bounds(2)
    samples = language_id.chosen(found, symbols)
    assert set(short) <= set(samples["en"]) and len(samples["fr"]) == 1
    sliced = [t for t in samples["en"] if t not in short]
    assert len(sliced) == 3 and all(len(t) == symbols // language_id.SHARE and any(t in x for x in long) for t in sliced)
    assert sum(map(len, samples["en"])) <= symbols


def test_automata_hold_exactly_the_substrings():
    rng = random.Random(2)
    samples = {k: ["".join(rng.choice("abcd ") for _ in range(200)) for _ in range(3)] for k in ("x", "y")}
    model = language_id.build(samples)
    assert len(model.table) // model.width < len(model.only)
    for k, language in enumerate(model.languages):
        joined = "".join(map(chr, [x for t in samples[language] for x in (0, *language_id.to_symbols(t, model.symbols).tolist())]))
        for _ in range(300):
            start, size = rng.randrange(len(joined)), rng.randrange(1, 9)
            part = joined[start : start + size] if rng.random() < 0.5 else "".join(rng.choice(joined) for _ in range(size))
            state = np.array([model.roots[k]])
            for c in part:
                state = model.step(state, np.array([ord(c)], np.uint8)) if state[0] >= 0 else state
            assert (state[0] >= 0) == (part in joined)
