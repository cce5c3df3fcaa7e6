"""Rasters: every interleave, the bytes that are read, tasks that fail, mosaics that overlap."""

import io
import json
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, LessThanOrEqual

from plotweave.sources import maps, rasters


class Counted(io.BytesIO):
    """A file that notes what is read of it."""

    def __init__(self, data):
        super().__init__(data)
        self.runs = []

    def read(self, n=-1):
        self.runs.append((self.tell(), n))
        return super().read(n)


def stored(values, interleave, kind, order=0, offset=0):
    """Bytes and description of an array (band, line, column)."""
    n, lines, samples = values.shape
    raster = rasters.Raster("x.dat", 0, 0, lines, samples, tuple(f"b{i}" for i in range(n)), interleave, kind, order, offset, -32768.0 if kind == 2 else None)
    axes = {"bsq": (0, 1, 2), "bil": (1, 0, 2), "bip": (1, 2, 0)}[interleave]
    return b"\0" * offset + np.ascontiguousarray(values.transpose(axes)).astype(raster.kind).tobytes(), raster


@pytest.mark.parametrize("interleave", rasters.INTERLEAVES)
@pytest.mark.parametrize("kind,order,offset", [(2, 1, 7), (4, 0, 0), (12, 0, 512), (5, 1, 0)])
def test_windows_of_every_layout(interleave, kind, order, offset):
    values = np.arange(3 * 11 * 7).reshape(3, 11, 7).astype(float)
    if kind == 2:
        values[1, 4, 3] = -32768
    data, raster = stored(values, interleave, kind, order, offset)
    want = np.where(values == -32768, np.nan, values)
    for window in ((0, 11, 0, 7), (2, 5, 0, 7), (4, 9, 2, 6)):
        r0, r1, c0, c1 = window
        found = raster.window(Counted(data), ["b2", "b1"], *window)
        assert np.array_equal(found, want[[2, 1], r0:r1, c0:c1], equal_nan=True)
    with pytest.raises(ValueError, match="ends early"):
        raster.window(Counted(data[:-1]), ["b2"], 0, 11, 0, 7)


@pytest.mark.parametrize("interleave,runs", [("bsq", 1), ("bil", 3), ("bip", 3)])
def test_only_the_asked_bytes_are_read(interleave, runs):
    data, raster = stored(np.zeros((4, 100, 10)), interleave, 4)
    f = Counted(data)
    raster.window(f, ["b2"], 50, 53, 0, 10)
    # A line's bands are interleaved by pixel in bip, so there the whole of three lines.
    assert len(f.runs) == runs and sum(n for _, n in f.runs) == 3 * 10 * 4 * (4 if interleave == "bip" else 1)


def test_headers_round_trip():
    raster = rasters.Raster("a/b.dat", 5, 7, 3, 4, ("red", "near ir"), "bip", 12, 1, 16, -1.0)
    assert rasters.from_header(rasters.to_header(raster), "a/b.dat") == raster
    plain = rasters.from_header("ENVI\nsamples = 4\nlines = 2\nbands = 2\ndata type = 4\n", "x.img")
    assert (plain.bands, plain.interleave, plain.r0, plain.ignore) == (("band_1", "band_2"), "bsq", 0, None)
    for text in ("samples = 4", "ENVI\nsamples = {4", "ENVI\nsamples = 4\nlines = 2", "ENVI\nsamples = 1\nlines = 1\nbands = 2\nband names = {a, a}", "ENVI\nsamples = 1\nlines = 1\nbands = 1\ndata type = 6"):
        with pytest.raises(ValueError):
            rasters.from_header(text, "x")


def test_filters_narrow_the_lines():
    tiles = [rasters.Raster(f"{i}", 10 * i, 0, 10, 5, ("a",)) for i in range(10)]
    reader = rasters.FilteredReader(tiles, ["a"], (5, 80))
    other = EqualTo(("c",), 3)
    left = list(reader.pushFilters([GreaterThan(("r",), 19), LessThanOrEqual(("r",), 44), IsNotNull(("r",)), other, In(("r",), (22, 40))]))
    assert left == [other, In(("r",), (22, 40))] and (reader.first, reader.last) == (22, 41)
    assert {t.path for p in reader.partitions() for t in p.rasters} == {"2", "3", "4"}


def table(spark, n=12, width=9):
    cells = spark.range(n * width).select((F.col("id") / width).cast("bigint").alias("r"), (F.col("id") % width).alias("c"))
    missing = F.when(F.col("r") * 7 % 5 != 0, F.col("r") * 1.5 - F.col("c"))
    return cells.select("r", "c", (F.col("r") * 100.0 + F.col("c")).alias("a"), missing.alias("b"), F.floor(F.col("r") / 5).alias("tile"))


@pytest.mark.parametrize("interleave", rasters.INTERLEAVES)
def test_round_trip(spark, tmp_path, interleave):
    px, path = table(spark), f"{tmp_path}/m"
    rasters.write_mosaic(px, path, ["a", "b"], interleave=interleave)
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(rasters.read_raster(spark, path)) == rows(px.select("r", "c", "a", "b"))
    part = rasters.read_raster(spark, f"file://{path}", ["b"], (4, 6)).filter("b is not null")
    assert rows(part) == rows(px.filter("r between 4 and 6 and b is not null").select("r", "c", "b"))
    tiles = json.load(open(f"{path}/{rasters.INDEX}"))
    single = rasters.read_raster(spark, f"{path}/{tiles[1]['path']}")
    assert rows(single) == rows(px.filter("tile = 1").select("r", "c", "a", "b"))
    with pytest.raises(Exception, match="no bands z"):
        rasters.read_raster(spark, path, ["z"]).collect()


def test_pushed_filters_of_a_session(spark, tmp_path):
    rasters.write_mosaic(table(spark), f"{tmp_path}/m", ["a"])
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        found = rasters.read_raster(spark, f"{tmp_path}/m").filter("r >= 3 and r < 5 and c = 2")
        assert sorted(r.r for r in found.collect()) == [3, 4]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_first_valid_value_wins(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(rasters, "BLOCK_VALUES", 32)
    monkeypatch.setattr(rasters, "BLOCK_COLUMNS", 4)
    rows = []
    for t, (r0, c0) in enumerate([(0, 0), (3, 2), (2, 5), (40, 40)]):
        rows += [(t, r0 + i, c0 + j, None if (i + j + t) % 3 == 0 else float(100 * t + 10 * i + j), 1.0 if t == 2 else None) for i in range(6) for j in range(5)]
    want = {}
    for _, r, c, a, b in rows:
        one = want.setdefault((r, c), [None, None])
        one[:] = [one[0] if one[0] is not None else a, one[1] if one[1] is not None else b]
    rasters.write_mosaic(spark.createDataFrame(rows, "tile int, r int, c int, a double, b double"), f"{tmp_path}/m", ["a", "b"])
    reader = rasters.RasterReader(rasters.rasters_at(f"{tmp_path}/m"), ["a", "b"], None)
    assert len(reader.partitions()) > 8
    found = {(r["r"], r["c"]): [r["a"], r["b"]] for p in reader.partitions() for batch in reader.read(p) for r in batch.to_pylist()}
    assert found == {k: v for k, v in want.items() if v != [None, None]}


def test_tiles_are_replaced_and_others_stay(spark, tmp_path):
    path = f"{tmp_path}/m"
    px = table(spark)
    rasters.write_mosaic(px, path, ["a"])
    rasters.write_mosaic(px.filter("tile = 1").withColumn("a", F.lit(-1.0)), path, ["a"])
    found = rasters.read_raster(spark, path)
    assert found.filter("a = -1").count() == px.filter("tile = 1").count() and found.count() == px.count()
    # A mosaic may be made from what it replaces: the old tiles go when the new ones are in the index.
    rasters.write_mosaic(found.withColumn("a", F.col("a") + 1).withColumn("tile", F.lit("all")), path, ["a"], overwrite=True)
    assert rasters.read_raster(spark, path).agg(F.min("a"), F.count("a")).first() == (0.0, px.count())
    assert len([f for f in os.listdir(path) if f.endswith(".dat")]) == 1


def test_a_failed_job_leaves_the_old_mosaic(spark, tmp_path):
    path = f"{tmp_path}/m"
    rasters.write_mosaic(table(spark), path, ["a"])
    before = sorted(os.listdir(path))
    broken = table(spark).withColumn("a", F.when((F.col("r") == 11) & (F.col("c") == 8), F.raise_error(F.lit("broken")).cast("double")).otherwise(F.col("a")))
    with pytest.raises(Exception, match="broken"):
        rasters.write_mosaic(broken, path, ["a"], overwrite=True)
    assert sorted(os.listdir(path)) == before
    assert rasters.read_raster(spark, path).count() == table(spark).count()


def test_a_task_that_fails_is_tried_again(tmp_path):
    """Two attempts of a task: what the first wrote is deleted, and only what the second reports is in the index."""
    import pyarrow as pa

    batch = lambda t, a: pa.RecordBatch.from_pydict({"tile": [t], "r": [0], "c": [t], "a": [a], "_r0": [0], "_r1": [0], "_c0": [t], "_c1": [t]})
    schema = type("S", (list,), {})([type("F", (), {"name": n})() for n in ("tile", "r", "c", "a", "_r0", "_r1", "_c0", "_c1")])
    writer = rasters.MosaicWriter(f"{tmp_path}/m", schema, "bil", False)

    def lost():
        yield batch(0, 1.0)
        yield batch(1, 2.0)
        raise OSError("executor lost")

    with pytest.raises(OSError):
        writer.write(lost())
    assert os.listdir(f"{tmp_path}/m") == []
    first, again = (writer.write(iter([batch(0, 1.0), batch(1, 2.0)])) for _ in range(2))
    writer.commit([again, None])
    writer.abort([first])
    found = rasters.rasters_at(f"{tmp_path}/m")
    assert [t.tile for t in found] == ["0", "1"] and len(os.listdir(f"{tmp_path}/m")) == 5
    assert math.isnan(found[0].ignore)


def test_nothing_to_read_or_write(spark, tmp_path):
    rasters.write_mosaic(table(spark).limit(0), f"{tmp_path}/m", ["a"])
    assert rasters.read_raster(spark, f"{tmp_path}/m").columns == ["r", "c"] and rasters.read_raster(spark, f"{tmp_path}/m").collect() == []


def test_a_map_isnt_compacted_onto_itself(spark, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/p")
    with pytest.raises(ValueError, match="reads"):
        maps.compact(spark.read.parquet(f"{tmp_path}/p"), f"file:{tmp_path}/p", 1)
    maps.compact(spark.read.parquet(f"{tmp_path}/p"), f"{tmp_path}/q", 1)
    assert spark.read.parquet(f"{tmp_path}/q").count() == 5
