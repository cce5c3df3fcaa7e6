"""How the standard tables stand for rasters, spectra and abundances."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotweave.operators.windows import tile_id

N_COLS, TILE_ROWS, N_BANDS = 100, 20, 64
BANDS = ("value", "minute", "k")
WAVELENGTHS = tuple(400 + 33 * i for i in range(N_BANDS))

#: The same frames in SQL, to head a query's common table expressions.
PIXELS_SQL = """px as (select event_id, event_id // 100 as r, event_id % 100 as c, (event_id // 100) // 20 as tile, value,
  (hour(ts) * 60 + minute(ts))::double as minute, json_extract_string(props, '$.k')::double as k, event_type, user_id from events)"""
SPECTRA_SQL = "sp as (select vec_id, label, embedding::double[] as x from embeddings)"
ABUNDANCE_SQL = """ab as (select s_nationkey as site, p_brand as cid, count(*) as n from lineitem
  join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey group by 1, 2)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raster of 100 columns: ``event_id r c tile``, three bands, a class and a plot."""
    rows = table(spark, sf_dir, "events").withColumn("r", F.floor(F.col("event_id") / N_COLS).cast("bigint")).withColumn("c", F.col("event_id") % N_COLS)
    minute = (F.hour("ts") * 60 + F.minute("ts")).cast("double")
    return rows.select("event_id", "r", "c", tile_id(F.col("r"), TILE_ROWS).alias("tile"), "value", minute.alias("minute"), F.get_json_object("props", "$.k").cast("double").alias("k"), "event_type", "user_id")


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectra of 64 bands: ``vec_id label x``."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))


def abundance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites, species and counts: ``site cid n``."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("cid"))
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("site"))
    pairs = lines.groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    return pairs.join(part, "l_partkey").join(supplier, "l_suppkey").groupBy("site", "cid").agg(F.sum("n").alias("n"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, as sums depend on their order."""
    return df.select(*(F.round(f.name, digits).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name) for f in df.schema))
