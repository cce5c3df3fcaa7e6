"""Queries over names and small matrices made of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotweave.functions import names
from plotweave.plans.bindings import table
from plotweave.sources import assets

#: Products of several levels, with and without a folder: what stands before and after the date.
PRODUCTS = [("/data/S2A_MSIL2A_", "T105031_N0510_R051_T31TEJ.SAFE"), ("S2B_MSIL2A_", "T104319_R008_T32TMT"), ("S2B_MSIL1C_", "T104319"), ("/data/S2A_MSIL2A_", "T000000/")]
#: Ends of file names.
ENDINGS = [".tif", ".tif.gz", ".tar.bz2", "", ".d/scene.tiff", ".tif.aux.xml", ".tfw", "/.hidden", "/.b.tif"]


def _pick(values, number):
    return F.element_at(F.array(*map(F.lit, values)), (number % len(values) + 1).cast("int"))


def product_date(spark, sf_dir):
    """Names of products of the days of events."""
    e = F.col("event_id")
    name = F.concat(_pick([a for a, _ in PRODUCTS], e), F.date_format("ts", "yyyyMMdd"), _pick([b for _, b in PRODUCTS], e))
    return table(spark, sf_dir, "events").select("event_id", names.product_date(name).alias("acquired"))


def _paths(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.col("url"), _pick(ENDINGS, F.col("page_id"))).alias("path"))


def path_parts(spark, sf_dir):
    p = F.col("path")
    return _paths(spark, sf_dir).select("page_id", names.header_path(p).alias("header"), names.without_extension(p, True).alias("stem"), names.image_path(p).alias("image"))


def image_list(spark, sf_dir):
    return _paths(spark, sf_dir).select(names.image_path(F.col("path")).alias("image")).distinct()


def page_paths(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", names.without_extension(url).alias("stem"), names.header_path(url).alias("header"))


def split_lines(spark, sf_dir):
    """Lines of keys and values, with and without blanks, made of events."""
    e = F.col("event_id")
    line = F.concat(_pick(["", "  "], e), "event_type", _pick([" = ", "=", "  =", " "], e), "props", _pick(["= x", " "], e))
    key, value = names.key_and_value(F.col("line"))
    rows = table(spark, sf_dir, "events").select("event_id", line.alias("line"))
    return rows.filter(F.instr("line", "=") > 0).select("event_id", key.alias("name"), value.alias("value"))


def asset_lookup(spark, sf_dir):
    """One item a document of events: a collection whose features are made of ``props``."""
    item = lambda d, k: F.concat(F.lit('{"assets":{"B04":{"href":"/s/S2A_MSIL2A_' + d + 'T10_'), k, F.lit('_B04.tif"},"B08":{"href":"/s/S2A_MSIL2A_' + d + 'T10_'), k, F.lit('_B08.tif"}}}'))
    k = F.get_json_object("props", "$.k")
    json = F.concat(F.lit('{"features":['), item("20240101", k), F.lit(","), item("20240202", k), F.lit("]}"))
    rows = table(spark, sf_dir, "events").select(json.alias("json"))
    return assets.asset_of_date(rows, "json", "B08", F.lit("2024-02-02").cast("date")).groupBy("href", "acquired").agg(F.count(F.lit(1)).alias("n"))


def array_tile(spark, sf_dir):
    """Two by two numbers of each nation, side by side three times and twice below."""
    m = F.array(F.array("n_nationkey", "n_regionkey"), F.array(F.col("n_regionkey") + 1, F.length("n_name"))).cast("array<array<bigint>>")
    tiled = table(spark, sf_dir, "nation").select("n_nationkey", F.posexplode(names.tile_matrix(m, 2, 3)).alias("i", "row"))
    return tiled.select("n_nationkey", F.col("i").cast("bigint").alias("i"), F.array_join(F.transform("row", lambda x: x.cast("string")), ",").alias("cells"))


def linear_index(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    row, col = F.col("event_id") % 100 + 1, F.floor(F.col("event_id") / 100) + 1
    return events.select("event_id", names.linear_index(row, col, 100).cast("bigint").alias("ix"))


QUERIES = {f.__name__: f for f in (product_date, path_parts, image_list, page_paths, split_lines, asset_lookup, array_tile, linear_index)}

_PICK = lambda values, number: "list_extract([" + ", ".join(f"'{v}'" for v in values) + f"], ({number} % {len(values)} + 1)::int)"
_STEM = r"regexp_replace({}, '([^.]+.+)\.[A-Za-z0-9]+$', '\1')"
_PLAIN = r"regexp_replace(path, '\.(gz|bz2|xz)$', '')"
_IMAGE = r"regexp_replace(regexp_replace(path, '\.aux\.xml$', ''), '\.tfw$', '.tiff')"
_PATHS = f"p as (select page_id, url || {_PICK(ENDINGS, 'page_id')} as path from pages)"
_LINE = f"{_PICK(['', '  '], 'event_id')} || event_type || {_PICK([' = ', '=', '  =', ' '], 'event_id')} || props || {_PICK(['= x', ' '], 'event_id')}"

ORACLE_SQL = {
    "product_date": f"with p as (select event_id, {_PICK([a for a, _ in PRODUCTS], 'event_id')} || strftime(ts, '%Y%m%d') || {_PICK([b for _, b in PRODUCTS], 'event_id')} as name from events) select event_id, try_strptime(nullif(regexp_extract(regexp_extract(name, '([^/]*)/*$', 1), 'MSIL2A_(\\d{{8}})T', 1), ''), '%Y%m%d')::date as acquired from p",
    "path_parts": f"with {_PATHS} select page_id, {_STEM.format('path')} || '.hdr' as header, {_STEM.format(_PLAIN)} as stem, {_IMAGE} as image from p",
    "image_list": f"with {_PATHS} select distinct {_IMAGE} as image from p",
    "page_paths": f"select page_id, {_STEM.format('url')} as stem, {_STEM.format('url')} || '.hdr' as header from pages",
    "split_lines": f"with p as (select event_id, {_LINE} as line from events) select event_id, trim(split_part(line, '=', 1)) as name, trim(substr(line, instr(line, '=') + 1)) as value from p where instr(line, '=') > 0",
    "asset_lookup": "select '/s/S2A_MSIL2A_20240202T10_' || json_extract_string(props, '$.k') || '_B08.tif' as href, date '2024-02-02' as acquired, count(*) as n from events group by 1, 2",
    "array_tile": "with m as (select n_nationkey, 0 as i, n_nationkey as a, n_regionkey as b from nation union all select n_nationkey, 1, n_regionkey + 1, length(n_name) from nation) select n_nationkey, (i + 2 * t)::bigint as i, concat_ws(',', a, b, a, b, a, b) as cells from m, range(2) as r(t)",
    "linear_index": "select event_id, (event_id // 100) * 100 + event_id % 100 + 1 as ix from events",
}
