"""Names of products, files and header lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def product_date(name: Column) -> Column:
    """Acquisition date in the name of a level-2A product."""
    return F.try_to_date(F.regexp_extract(base_name(name), r"MSIL2A_(\d{8})T", 1), "yyyyMMdd")


# Fixed value: a name keeps its extension if less than two characters, the first no dot, come before it.
EXTENSION = r"([^.]+.+)\.[A-Za-z0-9]+$"


def without_extension(path: Column, compression: bool = False) -> Column:
    """A path without its last extension; with ``compression``, first without one of a compressed file."""
    if compression:
        path = F.regexp_replace(path, r"\.(gz|bz2|xz)$", "")
    return F.regexp_replace(path, EXTENSION, "$1")


def header_path(path: Column) -> Column:
    """Where the header of an image lies."""
    return F.concat(without_extension(path), F.lit(".hdr"))


def image_path(path: Column) -> Column:
    """The image that a side-car file belongs to."""
    return F.regexp_replace(F.regexp_replace(path, r"\.aux\.xml$", ""), r"\.tfw$", ".tiff")


def key_and_value(line: Column, separator: str = "=", trim: bool = True) -> tuple[Column, Column]:
    """Both sides of the first separator of a line."""
    at = F.instr(line, separator)
    key, value = F.substring(line, F.lit(1), at - 1), F.substring(line, at + len(separator), F.length(line))
    return (F.trim(key), F.trim(value)) if trim else (key, value)


def repeat_array(values: Column, times: int) -> Column:
    """An array's values over and over."""
    return F.flatten(F.array_repeat(values, times))


def tile_matrix(rows: Column, down: int, across: int) -> Column:
    """A matrix, an array of rows, as tiles ``down`` by ``across``."""
    return repeat_array(F.transform(rows, lambda r: repeat_array(r, across)), down)


def linear_index(row: Column, col: Column, n_rows: int) -> Column:
    """The column-major index of a cell, all counted from 1."""
    return (col - 1) * n_rows + row
