"""The factorisation machine: its identity, its gradients' effect, and held-out accuracy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plotweave.llm import language_id, quality_fm, queries
from tests.conftest import DATA


def test_sum_of_squares_identity():
    rng = np.random.default_rng(1)
    model = quality_fm.Model()
    model.bias, model.linear, model.factors = 0.3, rng.normal(size=model.linear.shape), rng.normal(size=model.factors.shape)
    rows = [(rng.choice(2000, n, replace=False), rng.normal(size=n)) for n in (1, 2, 9)]
    for (at, value), got in zip(rows, model.raw(rows)[0], strict=True):
        want = 0.3 + model.linear[at] @ value
        for i in range(len(at)):
            for j in range(i):
                want += model.factors[at[i]] @ model.factors[at[j]] * value[i] * value[j]
        assert got == pytest.approx(want)


def test_features():
    at, value, stats = quality_fm.text_features("The the THE end| end|\n\nThe end".encode())
    assert at.tolist() == sorted({quality_fm.bucket(w) for w in (b"the", b"end", b"end|")}) and value @ value == pytest.approx(1)
    named = dict(zip(quality_fm.STATISTICS, stats, strict=True))
    assert named["words"] == math.log1p(7) and named["repeated"] == 1 / 6 * 6 / 7 and named["lines"] == math.log1p(2) and named["bars"] == 2 / 30
    assert quality_fm.text_features(b"")[0].tolist() == []
    assert quality_fm.metadata_bucket("n", 5) == quality_fm.metadata_bucket("n", 7) != quality_fm.metadata_bucket("n", 9)
    assert 0 <= quality_fm.metadata_bucket("n", None) < quality_fm.META_BUCKETS and 0 <= quality_fm.metadata_bucket("n", math.inf)


def test_pairs_are_learned():
    """Labels that only a pair of words tells, which no linear model can."""
    texts = [(a + " " + b, int(a[-1] == b[-1])) for a in ("red0", "red1") for b in ("sea0", "sea1")] * 40
    rows = [(*quality_fm.text_features(t.encode()), []) for t, _ in texts]
    label = np.array([y for _, y in texts], float)
    model = quality_fm.train(rows, label, np.ones(len(rows)), epochs=60, rate=0.2)
    scores = model.scores([model.features(*r) for r in rows])
    assert ((scores > 0.5) == (label == 1)).all()


def test_held_out_accuracy_of_the_query(spark):
    folder = f"{DATA}/sf0.1"
    rows = queries.op13_quality(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 500 and sum(r.predicted == r.quality for r in held) >= 0.98 * len(held)
    assert sum(r.predicted for r in held if r.quality) >= 0.98 * sum(r.quality for r in held)
    assert all(r.predicted == (r.score >= 0.7) for r in rows)


@pytest.fixture
def odd(spark):
    docs = [(i, f"good words in a row {i}" if i % 2 else f"bad | bad | {i}", i, "z") for i in range(60)]
    docs += [(100, None, None, "z"), (101, "", 0, "z"), (None, "no identifier", 1, "z"), (1, "another text of one", 5, "z"), (1, "another text of one", 5, "z"), (102, "long " * 50_000, 250_000, "z")]
    return spark.createDataFrame(docs, "doc_id bigint, text string, n_chars int, label string")


def test_odd_rows(spark, odd):
    labels = spark.createDataFrame([(i, i % 2, "t") for i in range(60)] + [(1, 1, "t"), (2, 1, "t"), (None, 1, "t"), (3, None, "t"), (4, 7, "t"), (999, 0, "t")], "doc_id bigint, quality int, text string")
    model = quality_fm.fit(odd, labels, label_col="quality", metadata=("n_chars",), rows=40)
    scored = quality_fm.score(odd, model, carry=("label",)).collect()
    assert len(scored) == 66 and all(0 <= r.score <= 1 and r.label == "z" for r in scored)
    by_id = {r.doc_id: r.score for r in scored}
    assert by_id[11] > 0.5 > by_id[10]
    again = quality_fm.score(odd.repartition(7), quality_fm.fit(odd.repartition(3), labels, label_col="quality", metadata=("n_chars",), rows=40)).collect()
    assert {(r.doc_id, r.score) for r in again} == {(r.doc_id, r.score) for r in scored}


def test_few_labels(spark, odd):
    none = spark.createDataFrame([], "doc_id bigint, label int")
    assert {r.score for r in quality_fm.score(odd, quality_fm.fit(odd, none)).collect()} == {0.5}
    ones = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id bigint, label int")
    assert all(r.score > 0.5 for r in quality_fm.score(odd, quality_fm.fit(odd, ones)).collect())
    assert quality_fm.score(odd.limit(0), quality_fm.fit(odd, ones)).collect() == []
    with pytest.raises(ValueError, match="clash"):
        quality_fm.score(odd.withColumn("score", F.lit(1)), quality_fm.Model(), carry=("score",))


def test_one_identifier_of_a_third_of_the_labels(spark):
    """A label's sample is drawn from distinct identifiers, so a repeated one can't fill it."""
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("label"))
    labels = labels.unionByName(spark.range(20_000).select(F.lit(1).cast("bigint").alias("doc_id"), F.lit(1).alias("label")))
    sample, counts = quality_fm.sampled(docs, labels, 10)
    assert counts == {0: 150, 1: 150} and sorted(r.label for r in sample.collect()) == [0] * 10 + [1] * 10


def test_folds(spark):
    held = language_id.remainder("doc_id", 4) == 2
    rows = queries.op13_quality(spark, f"{DATA}/sf0.001").join(spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", held.alias("want")), "doc_id").collect()
    assert rows and all(r.held_out == r.want for r in rows)
