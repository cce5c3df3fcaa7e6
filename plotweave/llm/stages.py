"""The operators as stages: each takes documents and returns those it keeps, with their columns.

Columns of a table of documents other than ``COLUMNS`` are dropped; a missing one raises.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plotweave.llm import bpe, language_id, line_dedup, minhash, mixing

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Files of the mixed documents at most.
MAX_FILES = 1 << 14


def known_language(docs: DataFrame, folds: int = 5) -> DataFrame:
    """Documents in a language that was learned, with that language as their ``lang``.

    Learns from the labelled documents outside the held-out fold. Rejected are documents without a letter (null and
    empty ones too) and those whose letters look as random to every language as their own order
    shuffled (``language_id``'s ``known``). Where no language is learned (no label, an empty table) nothing is
    rejected for its language, and ``lang`` stays. Repeated rows are judged each, ties go to the language that
    sorts first, very long texts are parsed whole.
    """
    rest = language_id.remainder("doc_id", folds)
    model = language_id.fit(docs.filter(F.coalesce(rest, F.lit(0)) != 0))
    if not model.languages:
        return docs.select(*COLUMNS).filter(F.col("text").rlike(r"\p{L}"))
    judged = language_id.predict(docs, model, carry=COLUMNS[1:]).filter("known")
    return judged.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def fewer_lines(docs: DataFrame) -> DataFrame:
    """Documents without the lines that others repeat, their length counted anew.

    A null or empty text is one empty line, and comes out empty; repeated rows count each; the largest
    identifier keeps a line, so ties can't occur; very long texts and lines are read whole; an empty
    table gives an empty table.
    """
    kept = line_dedup.dedup_lines(docs, carry=("lang", "source"))
    return kept.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity of 0.8 or more).

    Groups are proposed by SimHash, as ``op7`` finds them, and by MinHash for what lies beyond its two bits; the exact
    similarity decides (``minhash``).
    The one that stays has the smallest identifier (null ones last), then the smallest hash of its text, and of equal rows
    one. Null and empty texts are a group; an identifier that several texts have keeps those that are chosen, not
    the others; very long texts are compared whole; an empty table gives an empty table.
    """
    found = minhash.near_duplicates(docs)
    first = found.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("first"))
    chosen = first.select(F.col("first.doc_id").alias("_name"), F.col("first.text_hash").alias("_hash")).distinct()
    own_hash = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    kept = docs.select(*COLUMNS).join(chosen, F.col("doc_id").eqNullSafe(F.col("_name")) & (own_hash == F.col("_hash")), "left_semi")
    again = Window.partitionBy("doc_id", own_hash).orderBy("lang", "source", "n_chars", "text")
    return kept.withColumn("_place", F.row_number().over(again)).filter("_place = 1").select(*COLUMNS)


def mixed(docs: DataFrame) -> DataFrame:
    """Documents as often as the mix takes them, in files in the order of its shards, and by position within a shard.

    A draw names a document by identifier and text; where several rows have both, they all
    meet it, and the first takes its place. A null or empty text has no words and is never drawn; a null source is a source;
    a very long document is drawn whole; an empty table gives an empty table.
    """
    mix = mixing.mix(docs)
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias("_name")
    drawn = mix.draws.join(mix.rows.select("row", "h"), "row").select(F.col("h").alias("_key"), named("doc_id"), "shard", "position")
    keyed = docs.select(*COLUMNS, F.xxhash64("doc_id", F.lit(mixing.SEED), F.coalesce("text", F.lit(""))).alias("_key"), named("doc_id"))
    # Partitioned as the join is: no further exchange.
    place = Window.partitionBy("_key", "_name", "shard", "position").orderBy("lang", "source", "n_chars")
    joined = keyed.join(drawn, ["_key", "_name"]).withColumn("_place", F.row_number().over(place)).filter("_place = 1")
    # Neighbouring shards share a file, within which they lie in order.
    files = min(mix.shards, MAX_FILES)
    file = F.floor(F.col("shard") * files / mix.shards).cast("int")
    return joined.repartitionById(files, file).sortWithinPartitions("shard", "position").select(*COLUMNS)


def encoded(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """Token ids of each document, decoded again to see that they hold its bytes, with its place in the mix.

    The mixed documents lie in files in the order of shards, and in a file in the order of shards and positions; so
    ``file`` and ``row``, where ``docs`` is a table of files (else null), keep that order for who reads the tokens.
    A null or empty text has no ids; repeated rows are encoded each; very long texts are encoded whole; an empty
    table gives an empty table.
    """
    try:
        placed = docs.select(*COLUMNS, F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    except AnalysisException:  # no table of files
        placed = docs.select(*COLUMNS, F.lit(None).cast("string").alias("file"), F.lit(None).cast("bigint").alias("row"))
    ids = bpe.encode(placed, rank_file, pattern, carry=("lang", "source", "file", "row"), verify=True)
    return ids.select("doc_id", "lang", "source", "file", "row", "n_tokens", "ids", "round_trip")
