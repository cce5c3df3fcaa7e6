"""Asset lookup in item collections (JSON with ``features[*].assets.<name>.href``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotweave.functions.names import product_date


def asset_paths(collections: DataFrame, json: str, asset: str) -> DataFrame:
    """``href``, ``acquired`` of one asset of every feature."""
    kind = "struct<features:array<struct<assets:map<string,struct<href:string>>>>>"
    rows = collections.select(F.explode(F.from_json(F.col(json), kind)["features"]).alias("x"))
    href = F.col("x")["assets"][asset]["href"]
    return rows.select(href.alias("href")).filter("href is not null").withColumn("acquired", product_date(F.col("href")))


def asset_of_date(collections: DataFrame, json: str, asset: str, date: Column) -> DataFrame:
    return asset_paths(collections, json, asset).filter(F.col("acquired") == date)
