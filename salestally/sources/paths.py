"""Paths of export files and the names of the sheets they belong to."""

from __future__ import annotations

import os

from pyspark.sql import Column
from pyspark.sql import functions as F


def decoded(path: Column) -> Column:
    """Path as listings show it; the metadata columns are percent-encoded and may have more slashes."""
    return F.regexp_replace(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), "^file:/+", "file:/")


_FOLDER_LIKE_FILE = r"\.(csv|parquet|json|orc)$"


def sheet_root(path: Column) -> Column:
    """Path of a sheet: the file's folder where that is named like a file, else the file."""
    folder = F.regexp_replace(path, "/[^/]*$", "")
    return F.when(folder.rlike(_FOLDER_LIKE_FILE), folder).otherwise(path)


def sheet_of(path: Column) -> Column:
    """Name of the sheet a file belongs to."""
    name = F.element_at(F.split(sheet_root(path), "/"), -1)
    return F.regexp_replace(name, r"\.[^.]*$", "")


def inside(folder: str, pattern: str | None = None) -> str:
    """Files or folders of a folder whose names fit a pattern."""
    return os.path.join(folder, pattern or "*")
