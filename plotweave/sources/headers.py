"""Raster headers: text files of ``key = value`` lines, values in braces over several lines."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Header keys with numeric values.
NUMERIC_KEYS = ("samples", "lines", "bands", "header offset", "data type", "byte order", "default bands", "data ignore value", "wavelength", "fwhm", "data gain values", "band names")
ENTRY = r"(?m)^[ \t]*([^=\n{}]+?)[ \t]*=[ \t]*(\{[^}]*\}|[^\n]*)"


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``key``, ``value``, ``numbers`` of every header file under ``path``."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    wrong = ~F.lower("path").endswith(".hdr")
    checked = files.withColumn("text", F.when(wrong, F.raise_error(F.concat(F.lit("not a header file: "), "path"))).otherwise(F.col("text")))
    return entries(checked, "path", "text")


def entries(files: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, ``key``/``value`` pairs of header texts, keys in lower case, braces removed; numeric values as arrays.

    A text without the magic word, or with unbalanced braces, raises.
    """
    t = F.col(text)
    fault = (F.instr(F.substring_index(t, "\n", 1), "ENVI") == 0) | (F.length(F.regexp_replace(t, r"[^{]", "")) != F.length(F.regexp_replace(t, r"[^}]", "")))
    good = F.when(fault, F.raise_error(F.concat(F.lit("not a raster header: "), F.col(key).cast("string")))).otherwise(t)
    pairs = F.arrays_zip(F.regexp_extract_all(good, F.lit(ENTRY), F.lit(1)).alias("k"), F.regexp_extract_all(good, F.lit(ENTRY), F.lit(2)).alias("v"))
    rows = files.select(F.col(key), F.explode(pairs).alias("x")).select(key, F.lower(F.trim("x.k")).alias("name"), F.trim(F.regexp_replace("x.v", r"^\{|\}\s*$", "")).alias("value"))
    return rows.withColumn("numbers", F.when(F.col("name").isin(*NUMERIC_KEYS), numbers(F.col("value"))))


def header_entries(text: str) -> dict[str, str]:
    """Keys, in lower case, and values of one header text, for who plans a scan; braces are removed. What isn't a header raises."""
    if "ENVI" not in text.split("\n", 1)[0] or text.count("{") != text.count("}"):
        raise ValueError("not a raster header")
    return {k.strip().lower(): v.strip().removeprefix("{").removesuffix("}").strip() for k, v in re.findall(ENTRY, text)}


def numbers(value: Column) -> Column:
    """A comma-separated list of numbers, null if one of them isn't."""
    found = F.transform(F.split(value, ","), lambda x: F.trim(x).try_cast("double"))
    return F.when(F.forall(found, lambda x: x.isNotNull()), found)
