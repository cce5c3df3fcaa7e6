"""The stream ends where the batch is."""

from pyspark.sql import functions as F

from plotweave.operators import alpha
from plotweave.plans import grid_queries
from plotweave.streaming.alpha import run_alpha, stream_counts
from tests.conftest import DATA


def test_stream_equals_batch(spark, tmp_path):
    px = grid_queries.windowed(spark, f"{DATA}/sf0.001").withColumn("time", F.timestamp_millis(F.col("event_id") * 60_000))
    px.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(px.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    found = {}

    def sink(df, number):
        found[number] = sorted(map(tuple, df.select("win_id", "richness", F.round("shannon", 9)).collect()))

    query = run_alpha(stream_counts(stream, ["win_id"], "event_type"), ["win_id"], sink, checkpoint=str(tmp_path / "cp"))
    query.awaitTermination(120)
    counts = alpha.species_counts(px, ["win_id"], "event_type")
    want = sorted(map(tuple, alpha.alpha(counts, ["win_id"]).select("win_id", "richness", F.round("shannon", 9)).collect()))
    assert len(found) > 1 and found[max(found)] == want


def test_stream_by_time(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", i) for i in range(10)] + [(1, "b", 70)], "w int, s string, i int").withColumn("time", F.timestamp_millis(F.col("i") * 60_000))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    seen = []
    query = run_alpha(stream_counts(stream, ["w"], "s", "time"), ["start", "w"], lambda df, n: seen.append(df.collect()), checkpoint=str(tmp_path / "cp"), mode="update")
    query.awaitTermination(120)
    assert len({r.start for batch in seen for r in batch}) == 2
