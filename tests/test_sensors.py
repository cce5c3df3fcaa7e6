"""Names of sensors' bands, masks of another resolution."""

import pytest

from plotweave.operators import sensors


def test_names_and_roles(spark):
    ten = [f"x{i}" for i in range(10)]
    px = spark.createDataFrame([(0, 0, *range(10))], "r int, c int, " + ", ".join(f"{b} int" for b in ten))
    for name in ("S2", "sentinel_2", "Sentinel-2", "SENTINEL2"):
        row = sensors.named_bands(px, ten, name, 10).first()
        assert (row.blue, row.red, row.nir, row.B8A, row.B12) == (0.0, 2.0, 6.0, 7.0, 9.0)
    assert sensors.named_bands(px.drop("x9"), ten[:9], "S2", 20).first().nir == 6.0
    assert sensors.named_bands(px, ten[:6], "landsat 8", 30).first().nir == 3.0
    for wrong in (("spot", 10), ("S2", 30), ("S2", 20)):
        with pytest.raises(ValueError):
            sensors.named_bands(px, ten, *wrong)
    with pytest.raises(ValueError, match="cr_swir"):
        sensors.index_tiles(px.withColumnRenamed("r", "tile").selectExpr("*", "0 as r"), ten[:6], sensor="landsat", resolution=30)


def test_masks_and_thresholds(spark):
    rows = [(0, r, c, 100.0, 10.0, 50.0) for r in range(4) for c in range(4)]
    px = spark.createDataFrame(rows, "tile int, r int, c int, blue double, red double, nir double")
    px = px.selectExpr("tile", "r", "c", "blue as a", "0D as b", "red as d", "nir as e", "0D as f", "0D as g")
    mask = spark.createDataFrame([(0, 0, 1), (0, 1, 0), (1, 0, 1)], "r int, c int, mask int")
    found = sensors.index_tiles(px, list("abdefg"), ["ndvi"], "landsat", 30, mask, 2).collect()
    assert {(x.r, x.c) for x in found if x["mask"] == 1} == {(r, c) for r in range(4) for c in (0, 1)}
    assert all((x.ndvi is None) == (x["mask"] == 0) for x in found) and len(found) == 16
    assert {x["mask"] for x in sensors.index_tiles(px, list("abdefg"), ["ndvi"], "landsat", 30, blue_most=99.0).collect()} == {0}
    assert {x["mask"] for x in sensors.index_tiles(px, list("abdefg"), ["ndvi"], "landsat", 30).collect()} == {1}
