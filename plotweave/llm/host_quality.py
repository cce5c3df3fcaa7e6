"""Quality rules for documents and, from their failures, for hosts. Built-in functions only.

Each document gets word, symbol, line and repetition counts and fails the base rules
on its own. Failures are then added up by host. A host's raw failure rate says little
where it has few documents, so it is shrunk towards the rate of all: a beta prior is
fitted to the hosts' rates by the moments of the beta-binomial (Kleinman 1973), and a
host whose posterior rate is above ``MAX_RATE`` fails with all its documents.

The counts are written to the shared folder once, so that the texts are read once; a
few numbers a document go through the aggregation (partial first) and the join with
the hosts. Spark picks the join by size and splits hot hosts.

Cases: a null text counts as empty and fails; a document without a host (null) is
judged on its own; repeated rows are documents each; with no document or no
host, nothing fails by host; hosts of equal rates share a verdict; very long texts are counted whole. Only the
columns named are read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotweave.llm.common import materialize

BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Words of the windows whose repetition counts.
WINDOW = 3
#: Hosts above this posterior failure rate lose all their documents.
MAX_RATE = 0.5
#: Bounds of the correlation of two documents of a host, for a proper prior.
LEAST_RHO, MOST_RHO = 1e-6, 1 - 1e-6


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def repeated_words(words: Column) -> Column:
    """Words inside windows that occur twice or more.

    Windows are compared as 64-bit hashes. Sorting them with their places brings
    equal ones together; the places of repeated ones, sorted, then cover three words
    each, fewer where they overlap. Linear but for the sorts.
    """
    windows = F.transform(F.slice(words, 1, F.greatest(F.size(words) - (WINDOW - 1), F.lit(0))), lambda w, i: F.xxhash64(w, *(F.get(words, i + k) for k in range(1, WINDOW))))

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(places, k + 1) - p, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def repeated(pairs: Column) -> Column:
        same = lambda k, x: F.get(pairs, k)["h"] == x["h"]
        places = F.transform(pairs, lambda x, k: F.when(same(k - 1, x) | same(k + 1, x), x["i"]))
        return bound(F.array_sort(F.filter(places, lambda p: p.isNotNull())), covered)

    def counted(all_windows: Column) -> Column:
        pairs = F.transform(all_windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        some = F.size(F.array_distinct(all_windows)) < F.size(all_windows)
        return F.when(some, bound(F.sort_array(pairs), repeated)).otherwise(0)

    return bound(windows, counted)


def document_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """``doc_id``, ``host``, the counts and ``base_failed``."""
    text = F.col("text")
    split = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    split = split.select("doc_id", "host", "text", F.filter(F.split("text", BLANKS), lambda w: w != "").alias("words"), F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    counts = split.select(
        "doc_id",
        "host",
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        F.length(F.regexp_replace(text, F.lit(f"[^{SYMBOLS}]+"), F.lit(""))).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        repeated_words(F.col("words")).cast("bigint").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return counts.withColumn("base_failed", failed)


@dataclass(frozen=True)
class BetaPrior:
    alpha: float
    beta: float


def host_counts(counts: DataFrame) -> DataFrame:
    """``host``, ``n``, ``failed`` of documents that have a host."""
    return counts.filter(F.col("host").isNotNull()).groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("int")).alias("failed"))


def fit_prior(hosts: DataFrame) -> BetaPrior:
    """The beta prior whose beta-binomial has the moments of the hosts' failures.

    ``rho``, the correlation of two documents of a host, comes from the weighted squared
    deviations of the hosts' rates; ``alpha + beta = 1 / rho - 1``.
    """
    sums = hosts.agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("n"), F.sum("failed").alias("f"), F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"), F.sum(F.col("failed").cast("double") * F.col("failed") / F.col("n")).alias("ff")).first()
    m, n, f, nn, ff = (float(x or 0) for x in sums)
    mean = f / n if n else 0.0
    spread = mean * (1 - mean)
    room = n - (nn / n if n else 0.0) - (m - 1)
    rho = (ff - n * mean * mean - spread * (m - 1)) / (spread * room) if spread > 0 and room > 0 else LEAST_RHO
    strength = 1 / min(MOST_RHO, max(LEAST_RHO, rho)) - 1
    return BetaPrior(mean * strength, (1 - mean) * strength)


def host_verdicts(hosts: DataFrame, prior: BetaPrior, max_rate: float = MAX_RATE) -> DataFrame:
    """``host``, ``host_rate`` (posterior mean) and ``host_failed``."""
    rate = (F.col("failed") + prior.alpha) / (F.col("n") + (prior.alpha + prior.beta))
    return hosts.select("host", rate.alias("host_rate"), (rate > max_rate).alias("host_failed"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_rate: float = MAX_RATE) -> DataFrame:
    """The counts of each document with ``host_rate`` and ``kept``."""
    counts = materialize(document_counts(docs, id_col, text_col, host_col), "quality-counts")
    hosts = host_counts(counts)
    verdicts = host_verdicts(hosts, fit_prior(hosts), max_rate)
    return counts.join(verdicts, "host", "left").withColumn("kept", ~(F.col("base_failed") | F.coalesce("host_failed", F.lit(False))))
