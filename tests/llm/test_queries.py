"""The registered queries and the pipeline: SQL twins, odd tables, and brute force over the stages."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plotweave.llm import bpe, language_id, line_dedup, mixing, queries, stages
from tests.conftest import DATA, as_rows
from tests.llm.test_corpus_operators import brute_classes, brute_fingerprint
from tests.llm.test_minhash import brute_components
from tests.llm.test_text_operators import brute_base

SMALL = f"{DATA}/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_twin(spark, duck, name):
    found = queries.QUERIES[name](spark, SMALL)
    want = duck(SMALL, queries.ORACLE_SQL[name])
    assert as_rows(found.columns, found.collect()) == as_rows([d[0] for d in want.description], want.fetchall())


def test_one_query_for_each_operator():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Nulls everywhere, empty and long texts, repeated rows, extra columns with names that the operators use."""
    folder = tmp_path_factory.mktemp("odd")
    long = "A long text of words, " * 8000 + "x" * 30_000
    line = "a line that is found in more than five documents"
    rows = [(1, None, "en", "a", 0), (2, "", None, None, None), (None, "a text without an id", "en", "b", 1), (3, long, "en", "b", 1), (3, long, "en", "b", 1), (4, "x", None, None, 1)]
    rows += [(10 + i, f"{line}\nown words number {i} and some more", "de" if i % 2 else "en", "c", 2) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    extra = {"ids": F.lit("x"), "fp": F.lit(1), "h": F.lit("h"), "row": F.lit(2), "n_lines": F.lit(3), "score": F.lit("s"), "host": F.lit(None).cast("string"), "size": F.lit(9), "digest": F.lit("d"), "_key": F.lit(0)}
    docs.withColumns(extra).write.parquet(f"{folder}/documents.parquet")
    pages = [(1, None, None), (2, "u", ""), (None, "u", "z" * 2000), (3, "u", "z" * 2000), (3, "u", "z" * 2000), (4, "u", "y" * 3_000_000)]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumns(extra).write.parquet(f"{folder}/pages.parquet")
    vectors = [(1, None), (2, [1.0] * 63), (None, [0.5] * 64), (3, [1.5] * 64), (3, [1.5] * 64), (4, [float("nan")] * 64), (5, [float(i) for i in range(64)])]
    spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>").withColumns(extra).write.parquet(f"{folder}/embeddings.parquet")
    labels = [(1, 1, None), (3, 0, 1), (3, 0, 1), (None, 1, 0), (10, None, 0), (11, 1, 0), (12, 0, 0), (13, 1, 0)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").withColumns(extra).write.parquet(f"{folder}/labels.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def empty(spark, odd, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for t in ("documents", "pages", "embeddings", "labels"):
        spark.read.parquet(f"{odd}/{t}.parquet").limit(0).write.parquet(f"{folder}/{t}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_odd_rows(spark, odd, name):
    key, n = {"op4_warc": ("page_id", 6), "op12_ball_kmeans": ("vec_id", 4)}.get(name, ("doc_id", 14))
    rows = queries.QUERIES[name](spark, odd).collect()
    if name == "op11_spelling":
        # A row for each word: those of at least seven letters that are found twice.
        assert {"x" * 30_000, "another"} & {r.word for r in rows} == {"x" * 30_000} and all(r.n >= 2 and r.root for r in rows)
        return
    assert len(rows) == n and Counter(r[key] for r in rows)[3] == 2
    same = [tuple(r) for r in rows if r[key] == 3]
    assert same[0] == same[1] or name == "op8_mixing"


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_empty_tables(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).collect() == []


def test_pipeline_of_odd_rows(spark, odd, empty):
    rows = corpus_pipeline.run(spark, odd).collect()
    assert all(r.round_trip for r in rows) and {r.doc_id for r in rows} <= {None, 3, 4, *range(10, 18)}
    assert corpus_pipeline.run(spark, empty).collect() == []


def brute_languages(docs, rows):
    """The languages of the texts that are kept, by plain searches in the samples."""
    labelled = docs.filter(language_id.remainder("doc_id", 5) != 0)
    model = language_id.fit(labelled)
    found = language_id.sample_rows(labelled).collect()
    samples = language_id.chosen(found, language_id.sample_bounds(len({r.lang for r in found}))[1])
    joined = {k: "".join(map(chr, [x for t in v for x in (0, *language_id.to_symbols(t, model.symbols).tolist())])) for k, v in samples.items()}
    out = {}
    for i, r in rows.items():
        symbols = "".join(map(chr, language_id.to_symbols(r.text or "", model.symbols).tolist()))
        counts = {}
        for k, sample in joined.items() if symbols else ():
            counts[k] = 0
            for block in (symbols[a : a + language_id.BLOCK] for a in range(0, len(symbols), language_id.BLOCK)):
                at = 0
                while at < len(block):
                    end = at + 1
                    while end < len(block) and block[at : end + 1] in sample:
                        end += 1
                    at, counts[k] = end, counts[k] + 1
        if counts:
            cost = dict(zip(model.languages, model.bits, strict=True))
            best = min(sorted(counts), key=lambda k: counts[k] * cost[k])
            if (counts[best] - 1) * cost[best] / len(symbols) < model.noise[model.languages.index(best)]:
                out[i] = best
    return out


def test_language_stage_rejects_what_is_in_no_language(spark):
    draw = random.Random(3)
    noise = " ".join("".join(draw.choices("bcdfghjklmnpqrstvwxz", k=draw.randint(3, 12))) for _ in range(40))
    own = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = spark.createDataFrame([(-1, noise, None, "s", len(noise)), (-2, "1234 !?", "en", "s", 7), (-3, None, None, None, None), (-4, "", "en", "s", 0), (-5, "the of and", None, None, 10), (-5, "the of and", None, None, 10)], own.schema)
    kept = Counter(r.doc_id for r in stages.known_language(own.unionByName(odd)).collect())
    assert [kept[k] for k in (-1, -2, -3, -4, -5)] == [0, 0, 0, 0, 2]
    assert sum(kept[r.doc_id] for r in own.collect()) >= 0.99 * own.filter(F.col("text").rlike(r"\p{L}")).count()
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert Counter(r.doc_id for r in stages.known_language(unlabelled).collect()) == {-1: 1, -5: 2}


def test_order_of_the_mix_reaches_the_tokens(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 40)
    monkeypatch.setattr(mixing, "DRAWS_PER_SHARD", 4)
    monkeypatch.setattr(stages, "MAX_FILES", 5)
    rows = [(i, "w " * 20 + str(i), "en", "ab"[i % 2], 42) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    stages.mixed(docs).write.parquet(f"{tmp_path}/mixed")
    tokens = stages.encoded(spark.read.parquet(f"{tmp_path}/mixed"), queries.RANK_FILE, queries.PATTERN).collect()
    want = [r.doc_id for r in mixing.mix(docs).draws.orderBy("shard", "position").collect()]
    assert [r.doc_id for r in sorted(tokens, key=lambda r: (r.file, r.row))] == want and len({r.file for r in tokens}) == 5
    assert {r.file for r in stages.encoded(docs, queries.RANK_FILE, queries.PATTERN).collect()} == {None}


def test_a_host_verdict_changes_kept(spark, tmp_path):
    good, bad = " ".join(f"w{i}" for i in range(60)), "short"
    rows = [(i, bad if i < 45 else good, "spam") for i in range(50)] + [(100 + h * 50 + i, bad if i < 3 else good, f"h{h}") for h in range(6) for i in range(50)]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.base_failed, r.kept) for r in queries.op3_host_quality(spark, str(tmp_path)).collect()}
    assert got == {i: (t == bad, t != bad and s != "spam") for i, t, s in rows}


def test_query_rows_by_brute_force(spark):
    """The digests and numbers of the queries that SQL can't express, on whole tables."""
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    enc = bpe.encoding(bpe.read_ranks(queries.RANK_FILE), queries.PATTERN)
    for r in queries.op1_bpe(spark, SMALL).collect():
        ids = enc.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(texts[r.doc_id].encode()))
    for r in queries.op5_secrets(spark, SMALL).collect():
        base = brute_base(texts[r.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == (*(sum(x[0] == k for x in base) for k in ("assign", "access", "hex")), sha(joined.encode()))
        assert set(joined.split(",")) - {""} <= set(r.spans.split(","))
    for r in queries.op6_language(spark, SMALL).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and (r.lang_pred == "und") == (not any(c.isalpha() for c in texts[r.doc_id]))
    fps = {i: brute_fingerprint(t, 3) for i, t in texts.items()}
    classes = brute_classes(fps)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op7_simhash(spark, SMALL).collect()} == {i: (f"{f:016x}", classes[i]) for i, f in fps.items()}
    for r in queries.op8_mixing(spark, SMALL).collect():
        places = [p for p in r.places.split(",") if p]
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id])) and r.taken == r.size * len(places) == r.size * r.copies
    for r in queries.op10_media(spark, SMALL).collect():
        data = texts[r.doc_id].encode()
        payload = data + bytes(-len(data) % 64 or (0 if data else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), sha(payload), zlib.crc32(payload[-64:]))


def test_stages(spark):
    """Each stage against its decisions made by hand, on what the stage before it kept."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    start = {r.doc_id: r for r in docs.collect()}
    told = corpus_pipeline.language(spark, docs, SMALL)
    assert told.columns == docs.columns
    want = brute_languages(docs, start)
    first = {r.doc_id: r for r in told.collect()}
    assert set(first) == set(want) and len(want) > 150
    assert all(first[i].lang == want[i] and first[i].asDict() | {"lang": 0} == start[i].asDict() | {"lang": 0} for i in first)

    lined = corpus_pipeline.lines(spark, told, SMALL)
    assert lined.columns == docs.columns
    held = {}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    for i, r in first.items():
        for k in {key(x) for x in r.text.split("\n")}:
            if len(k) >= line_dedup.MIN_CHARS:
                held.setdefault(k, set()).add(i)
    lost = lambda i, x: len(held.get(key(x), ())) >= line_dedup.MIN_DOCS and max(held[key(x)]) != i
    second = {r.doc_id: r for r in lined.collect()}
    for i, r in first.items():
        text = "\n".join(x for x in r.text.split("\n") if not lost(i, x))
        assert (second[i].text, second[i].n_chars) == (text, len(text))

    single = corpus_pipeline.near_duplicates(spark, lined, SMALL)
    assert single.columns == docs.columns
    names = brute_components({i: r.text for i, r in second.items()})
    third = {r.doc_id: r for r in single.collect()}
    assert set(third) == {i for i, k in names.items() if k == i} and all(third[i] == second[i] for i in third)

    mix = corpus_pipeline.mixing(spark, single, SMALL)
    assert mix.columns == docs.columns
    fourth = Counter(r.doc_id for r in mix.collect())
    taken = mixing.words_taken(mixing.mix(single)).collect()
    assert fourth == Counter({r.doc_id: r.copies for r in taken if r.copies})

    last = corpus_pipeline.tokens(spark, mix, SMALL).collect()
    enc = bpe.encoding(bpe.read_ranks(queries.RANK_FILE), queries.PATTERN)
    assert Counter(r.doc_id for r in last) == fourth
    assert all(r.n_tokens == len(enc.encode_ordinary(third[r.doc_id].text)) and len(r.ids) == 4 * r.n_tokens and r.round_trip for r in last)


def test_mix_of_repeated_rows(spark):
    rows = [(1, "a b c d", "en", "s", 7), (1, "a b c d", "en", "s", 7), (2, "e f g h", "en", "s", 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    taken = sum(r.copies for r in mixing.words_taken(mixing.mix(docs)).collect())
    assert stages.mixed(docs).count() == taken
    assert stages.one_of_each(docs).count() == 2


def test_fit_needs_labels_outside_the_fold(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    held = docs.filter(language_id.remainder("doc_id", 5) == 0)
    assert language_id.fit(held.filter(language_id.remainder("doc_id", 5) != 0)).languages == []


def test_lines_of_repeated_identifiers_against_sql(spark, duck, odd, tmp_path):
    """Rows that repeat an identifier are documents each, for the operator, its shuffled probe and SQL."""
    line = "a line of more than forty characters, found again"
    rows = [(1, line)] * 4 + [(2, line)] + [(None, f"{line}\nown"), (None, line), (7, None), (7, f"{line.upper()} \n\n{line}"), (7, f"{line.upper()} \n\n{line}")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    columns = ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    for folder in (str(tmp_path), odd):
        con = duckdb.connect()
        con.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
        want = as_rows(columns, con.execute(f"select {', '.join(columns)} from ({queries.ORACLE_SQL['op9_lines']})").fetchall())
        assert as_rows(columns, queries.op9_lines(spark, folder).select(*columns).collect()) == want
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for probes in (2, line_dedup.PROBES):
            shuffled = line_dedup.dedup_lines(docs, max_broadcast=0, probes=probes)
            assert as_rows(columns, shuffled.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256")).collect()) == want


def test_stage_keeps_one_of_null_and_empty_texts(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = spark.createDataFrame([(5, None, "en", "s", 0), (5, "", "en", "s", 0), (5, "", "en", "s", 0)], schema)
    assert stages.one_of_each(docs).count() == 1
