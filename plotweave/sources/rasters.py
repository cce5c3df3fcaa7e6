"""Rasters as a Spark data source: binary files with a text header, and mosaics of tiles.

``raster`` reads a file (its header is beside it) or a mosaic, a folder of tiles with an index, as rows ``r``, ``c`` and a
double for each band. A partition is a block of lines and columns. Only the bytes of the wanted bands and lines are read:
bands by the option ``bands``, lines by the option ``lines`` or, where the session pushes filters to Python sources
(``spark.sql.python.filterPushdown.enabled``), by conditions on ``r``. All three interleaves are known.

Written, a frame with a tile, ``r``, ``c`` and bands becomes a mosaic. A task writes its tiles under names that no other
attempt has; the index, replaced in one step when all tasks have succeeded, is what makes them visible. A failed
attempt leaves nothing that anyone reads, and its files are deleted.

Where tiles overlap, a band's value is that of the first tile, in the order of tiles, that has a valid one. Pixels without a valid
value in any wanted band are no rows.

Files are reached through ``pyarrow.fs``, so paths may be local or of an object store that it knows.
"""

from __future__ import annotations

import json
import math
import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from plotweave.operators.bounded import small
from plotweave.sources.headers import header_entries

# The numbers of data types in headers, as array types.
DATA_TYPES = {1: "u1", 2: "i2", 3: "i4", 4: "f4", 5: "f8", 12: "u2", 13: "u4", 14: "i8", 15: "u8"}
INTERLEAVES = ("bsq", "bil", "bip")
#: Pixels of a partition at most, all bands together.
BLOCK_VALUES = 1 << 22
#: Columns of a block at most.
BLOCK_COLUMNS = 1 << 12
INDEX = "index.json"
#: Files whose footprint the index of a mosaic may hold.
MAX_TILES = 1_000_000


@dataclass(frozen=True)
class Raster:
    """A raster file: where it lies in the grid (``r0``, ``c0``), its layout, and its bands by name."""

    path: str
    r0: int
    c0: int
    lines: int
    samples: int
    bands: tuple[str, ...]
    interleave: str = "bil"
    data_type: int = 5
    byte_order: int = 0
    offset: int = 0
    ignore: float | None = None
    tile: str = ""

    @property
    def kind(self) -> np.dtype:
        return np.dtype((">" if self.byte_order else "<") + DATA_TYPES[self.data_type])

    def window(self, file, bands: Sequence[str], r0: int, r1: int, c0: int, c1: int) -> np.ndarray:
        """Values (band, line, column) of grid lines ``r0`` to ``r1`` and columns ``c0`` to ``c1`` (ends excluded), which lie in the raster; NaN where there is none.

        ``file`` has ``seek`` and ``read``. Runs of bytes that follow each other are read at once.
        """
        size, n = self.kind.itemsize, len(self.bands)
        at = [self.bands.index(b) for b in bands]
        first, last, left, right = r0 - self.r0, r1 - self.r0, c0 - self.c0, c1 - self.c0
        whole = left == 0 and right == self.samples

        def run(start: int, count: int) -> np.ndarray:
            file.seek(self.offset + start * size)
            data = file.read(count * size)
            if len(data) != count * size:
                raise ValueError(f"{self.path} ends early")
            return np.frombuffer(data, self.kind)

        out = np.empty((len(at), last - first, right - left), self.kind)
        if self.interleave == "bip":
            for i in range(last - first):
                line = run(((first + i) * self.samples + left) * n, (right - left) * n).reshape(right - left, n)
                out[:, i] = line[:, at].T
        elif self.interleave == "bsq" and whole:
            for k, b in enumerate(at):
                out[k] = run((b * self.lines + first) * self.samples, (last - first) * self.samples).reshape(last - first, self.samples)
        else:
            for i in range(last - first):
                for k, b in enumerate(at):
                    line = b * self.lines + first + i if self.interleave == "bsq" else (first + i) * n + b
                    out[k, i] = run(line * self.samples + left, right - left)
        values = out.astype(np.float64)
        if self.ignore is not None and not math.isnan(self.ignore):
            values[values == self.ignore] = np.nan
        return values


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path within it."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))


def read_text(path: str) -> str:
    system, name = file_system(path)
    with system.open_input_stream(name) as f:
        return f.read().decode()


def from_header(text: str, path: str) -> Raster:
    """What a header says of the raster at ``path``."""
    found = header_entries(text)
    number = lambda k, default=None: float(found[k]) if k in found else default
    missing = [k for k in ("samples", "lines", "bands") if k not in found]
    if missing:
        raise ValueError(f"the header of {path} lacks {', '.join(missing)}")
    n = int(number("bands"))
    named = [b.strip() for b in found["band names"].split(",")] if "band names" in found else [f"band_{i + 1}" for i in range(n)]
    interleave, kind = found.get("interleave", "bsq").lower(), int(number("data type", 4))
    if len(named) != n or len(set(named)) != n:
        raise ValueError(f"{path} doesn't name its {n} bands one by one")
    if interleave not in INTERLEAVES or kind not in DATA_TYPES:
        raise ValueError(f"{path} has an unknown interleave or data type: {interleave}, {kind}")
    place = lambda k: int(number(k, 1.0)) - 1
    return Raster(path, place("y start"), place("x start"), int(number("lines")), int(number("samples")), tuple(named), interleave, kind, int(number("byte order", 0.0)), int(number("header offset", 0.0)), number("data ignore value"))


def to_header(raster: Raster) -> str:
    """A header that ``from_header`` reads."""
    ignore = [] if raster.ignore is None else [f"data ignore value = {raster.ignore}"]
    rows = [f"samples = {raster.samples}", f"lines = {raster.lines}", f"bands = {len(raster.bands)}", f"header offset = {raster.offset}", "file type = ENVI Standard", f"data type = {raster.data_type}", f"interleave = {raster.interleave}"]
    rows += [f"byte order = {raster.byte_order}", f"x start = {raster.c0 + 1}", f"y start = {raster.r0 + 1}", *ignore, f"band names = {{{', '.join(raster.bands)}}}"]
    return "ENVI\n" + "\n".join(rows) + "\n"


def header_of(path: str) -> str:
    """The header's path of a raster file."""
    return re.sub(r"\.[A-Za-z0-9]+$", "", path) + ".hdr"


def rasters_at(path: str) -> list[Raster]:
    """The file at ``path``, or the tiles of the mosaic there, in their order."""
    system, name = file_system(path)
    if system.get_file_info(name).type == fs.FileType.Directory:
        return [Raster(**{**t, "path": f"{path.rstrip('/')}/{t['path']}", "bands": tuple(t["bands"])}) for t in json.loads(read_text(f"{path.rstrip('/')}/{INDEX}"))]
    return [from_header(read_text(header_of(path)), path)]


@dataclass
class Block(InputPartition):
    """Lines and columns of the grid, and the rasters that they meet."""

    r0: int
    r1: int
    c0: int
    c1: int
    rasters: tuple[Raster, ...]


class RasterReader(DataSourceReader):
    def __init__(self, rasters: list[Raster], bands: Sequence[str], lines: tuple[int, int] | None):
        self.rasters, self.bands = rasters, tuple(bands)
        top, bottom = min((t.r0 for t in rasters), default=0), max((t.r0 + t.lines for t in rasters), default=0)
        self.first, self.last = (top, bottom) if lines is None else (max(top, lines[0]), min(bottom, lines[1] + 1))

    def partitions(self) -> list[Block]:
        left, right = min((t.c0 for t in self.rasters), default=0), max((t.c0 + t.samples for t in self.rasters), default=0)
        width = max(1, min(BLOCK_COLUMNS, right - left))
        height = max(1, BLOCK_VALUES // (width * max(1, len(self.bands))))
        # Tiles by block of lines and columns, so that a mosaic of many tiles isn't searched for each block.
        cells: dict[tuple[int, int], list[Raster]] = {}
        for t in self.rasters:
            low, high = max(t.r0, self.first), min(t.r0 + t.lines, self.last)
            if low < high:
                for i in range((low - self.first) // height, (high - 1 - self.first) // height + 1):
                    for j in range((t.c0 - left) // width, (t.c0 + t.samples - 1 - left) // width + 1):
                        cells.setdefault((i, j), []).append(t)
        return [Block(self.first + i * height, min(self.last, self.first + (i + 1) * height), left + j * width, min(right, left + (j + 1) * width), tuple(own)) for (i, j), own in sorted(cells.items())]

    def open(self, path: str):
        system, name = file_system(path)
        return system.open_input_file(name)

    def read(self, partition: Block) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there are no blocks
            return
        p = partition
        values = np.full((len(self.bands), p.r1 - p.r0, p.c1 - p.c0), np.nan)
        for t in p.rasters:
            r0, r1, c0, c1 = max(p.r0, t.r0), min(p.r1, t.r0 + t.lines), max(p.c0, t.c0), min(p.c1, t.c0 + t.samples)
            own = [b for b in self.bands if b in t.bands]
            if not own or r0 >= r1 or c0 >= c1:
                continue
            with self.open(t.path) as f:
                found = t.window(f, own, r0, r1, c0, c1)
            for k, b in enumerate(own):
                held = values[self.bands.index(b), r0 - p.r0 : r1 - p.r0, c0 - p.c0 : c1 - p.c0]
                np.copyto(held, found[k], where=np.isnan(held))
        valid = ~np.isnan(values)
        r, c = np.nonzero(valid.any(0))
        columns = [pa.array(v[r, c], mask=~ok[r, c]) for v, ok in zip(values, valid, strict=True)]
        for start in range(0, max(1, len(r)), 1 << 16):
            part = slice(start, start + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(r[part] + p.r0), pa.array(c[part] + p.c0), *(x[part] for x in columns)], ["r", "c", *self.bands])


class FilteredReader(RasterReader):
    """Takes conditions on ``r`` as well. Spark refuses such a reader where a session doesn't push filters."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            value = getattr(f, "value", None)
            if getattr(f, "attribute", None) != ("r",) or not (isinstance(f, (IsNotNull, In)) or isinstance(value, int)):
                yield f
            elif isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    self.first = max(self.first, value + isinstance(f, GreaterThan))
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.last = min(self.last, value + (not isinstance(f, LessThan)))
            elif isinstance(f, In) and f.value:
                self.first, self.last = max(self.first, min(f.value)), min(self.last, max(f.value) + 1)
                yield f  # lines between those listed
            elif not isinstance(f, IsNotNull):
                yield f


@dataclass
class Written(WriterCommitMessage):
    tiles: list[dict]


class MosaicWriter(DataSourceArrowWriter):
    """Rows sorted by tile, line and column, with the tile's extent in ``_r0 _r1 _c0 _c1``, to a file a tile."""

    def __init__(self, path: str, schema: StructType, interleave: str, overwrite: bool):
        self.path, self.interleave, self.overwrite = path.rstrip("/"), interleave, overwrite
        self.bands = tuple(f.name for f in schema if f.name not in ("tile", "r", "c", "_r0", "_r1", "_c0", "_c1"))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, folder = file_system(self.path)
        system.create_dir(folder, recursive=True)
        tiles: list[dict] = []
        held: list[pa.RecordBatch] = []
        try:
            for batch in iterator:
                start = 0
                names = batch.column("tile").to_pylist()
                for k in range(1, batch.num_rows + 1):
                    if k == batch.num_rows or names[k] != names[start]:
                        if held and held[0].column("tile")[0].as_py() != names[start]:
                            tiles.append(self.tile(system, folder, held))
                            held = []
                        held.append(batch.slice(start, k - start))
                        start = k
            if held:
                tiles.append(self.tile(system, folder, held))
        except BaseException:
            delete(system, folder, tiles)
            raise
        return Written(tiles)

    def tile(self, system: fs.FileSystem, folder: str, held: list[pa.RecordBatch]) -> dict:
        """Write one tile; a task holds one at a time."""
        rows = pa.Table.from_batches(held)
        first = lambda c: rows.column(c)[0].as_py()
        r0, c0 = first("_r0"), first("_c0")
        raster = Raster(f"{uuid.uuid4().hex}.dat", r0, c0, first("_r1") - r0 + 1, first("_c1") - c0 + 1, self.bands, self.interleave, ignore=math.nan, tile=str(first("tile")))
        values = np.full((len(self.bands), raster.lines, raster.samples), np.nan)
        at = rows.column("r").to_numpy() - r0, rows.column("c").to_numpy() - c0
        for k, b in enumerate(self.bands):
            values[(k, *at)] = rows.column(b).cast(pa.float64()).fill_null(math.nan).to_numpy()
        order = {"bsq": (0, 1, 2), "bil": (1, 0, 2), "bip": (1, 2, 0)}[self.interleave]
        with system.open_output_stream(f"{folder}/{raster.path}") as f:
            f.write(np.ascontiguousarray(values.transpose(order)).astype(raster.kind).tobytes())
        with system.open_output_stream(f"{folder}/{header_of(raster.path)}") as f:
            f.write(to_header(raster).encode())
        return asdict(raster)

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = file_system(self.path)
        system.create_dir(folder, recursive=True)
        new = [t for m in messages if m is not None for t in m.tiles]
        there = system.get_file_info(f"{folder}/{INDEX}").type == fs.FileType.File
        old = json.loads(read_text(f"{self.path}/{INDEX}")) if there else []
        names = {t["tile"] for t in new}
        stay = [] if self.overwrite else [t for t in old if t["tile"] not in names]
        tiles = sorted(stay + new, key=lambda t: (len(t["tile"]), t["tile"]) if t["tile"].isdigit() else (1 << 30, t["tile"]))
        if len(tiles) > MAX_TILES:
            delete(system, folder, new)
            raise ValueError(f"more than {MAX_TILES} tiles")
        with system.open_output_stream(f"{folder}/{INDEX}.new") as f:
            f.write(json.dumps(tiles).encode())
        system.move(f"{folder}/{INDEX}.new", f"{folder}/{INDEX}")
        kept = {t["path"] for t in tiles}
        delete(system, folder, [t for t in old if t["path"] not in kept])

    def abort(self, messages: list[Written | None]) -> None:
        system, folder = file_system(self.path)
        delete(system, folder, [t for m in messages if m is not None for t in m.tiles])


def delete(system: fs.FileSystem, folder: str, tiles: list[dict]) -> None:
    for t in tiles:
        for name in (t["path"], header_of(t["path"])):
            if system.get_file_info(f"{folder}/{name}").type == fs.FileType.File:
                system.delete_file(f"{folder}/{name}")


class RasterSource(DataSource):
    """Options of reading: ``path``, ``bands`` (comma-separated), ``lines`` (first:last), ``push`` (whether the session pushes filters); of writing: ``path``, ``interleave``."""

    @classmethod
    def name(cls) -> str:
        return "raster"

    def rasters(self) -> list[Raster]:
        return rasters_at(self.options["path"])

    def wanted(self, rasters: list[Raster]) -> list[str]:
        known = list(dict.fromkeys(b for t in rasters for b in t.bands))
        asked = [b for b in self.options.get("bands", "").split(",") if b] or known
        unknown = [b for b in asked if b not in known]
        if unknown:
            raise ValueError(f"no bands {', '.join(unknown)}")
        return asked

    def schema(self) -> str:
        return ", ".join(["r bigint", "c bigint", *(f"`{b}` double" for b in self.wanted(self.rasters()))])

    def reader(self, schema: StructType) -> RasterReader:
        lines = self.options.get("lines")
        kind = FilteredReader if self.options.get("push") == "true" else RasterReader
        return kind(self.rasters(), [f.name for f in schema if f.name not in ("r", "c")], tuple(map(int, lines.split(":"))) if lines else None)

    def writer(self, schema: StructType, overwrite: bool) -> MosaicWriter:
        interleave = self.options.get("interleave", "bil")
        if interleave not in INTERLEAVES:
            raise ValueError(f"no interleave {interleave}")
        return MosaicWriter(self.options["path"], schema, interleave, overwrite)


def read_raster(spark: SparkSession, path: str, bands: Sequence[str] = (), lines: tuple[int, int] | None = None) -> DataFrame:
    """Rows ``r``, ``c`` and bands of a raster file or a mosaic; of some bands and of the lines first to last only, if given."""
    spark.dataSource.register(RasterSource)
    reader = spark.read.format("raster").option("path", path).option("push", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
    if bands:
        reader = reader.option("bands", ",".join(bands))
    return (reader if lines is None else reader.option("lines", f"{lines[0]}:{lines[1]}")).load()


def write_mosaic(pixels: DataFrame, path: str, bands: Sequence[str], tile: str = "tile", interleave: str = "bil", overwrite: bool = False) -> None:
    """A raster file for each tile of pixels (``r``, ``c``, bands), in a mosaic; tiles written before under the same name are replaced, with ``overwrite`` all.

    Of rows of one tile and pixel one is kept. Tiles are shuffled whole, one after another in a task.
    """
    pixels.sparkSession.dataSource.register(RasterSource)
    rows = pixels.select(F.coalesce(F.col(tile).cast("string"), F.lit("")).alias("tile"), F.col("r").cast("bigint").alias("r"), F.col("c").cast("bigint").alias("c"), *(F.col(b).cast("double").alias(b) for b in bands))
    extents = rows.groupBy("tile").agg(F.min("r").alias("_r0"), F.max("r").alias("_r1"), F.min("c").alias("_c0"), F.max("c").alias("_c1"))
    placed = rows.join(small(extents), "tile").repartition("tile").sortWithinPartitions("tile", "r", "c", *bands)
    placed.write.format("raster").option("path", path).option("interleave", interleave).mode("overwrite" if overwrite else "append").save()
