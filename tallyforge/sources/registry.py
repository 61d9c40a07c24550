"""Which reader takes which format. A format can be registered once."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame

from tallyforge.sources import workbooks

Reader = Callable[[DataFrame], DataFrame]


class Readers:
    def __init__(self) -> None:
        self._of: dict[str, Reader] = {}

    def register(self, format: str, reader: Reader) -> None:
        if format in self._of:
            raise ValueError(f"{format} has a reader already")
        self._of[format] = reader

    def get(self, format: str | None) -> Reader:
        if format is None:
            raise ValueError("unknown_format")
        if format not in self._of:
            raise ValueError("unsupported_format")
        return self._of[format]

    def cells(self, files: DataFrame) -> DataFrame:
        """Cells of all files whose detected format has a reader."""
        return reduce(DataFrame.unionByName, [reader(files.where(files["format"] == f)) for f, reader in self._of.items()])


def default_readers() -> Readers:
    out = Readers()
    out.register("csv", workbooks.csv_cells)
    out.register("xlsx", workbooks.xlsx_cells)
    out.register("xls", workbooks.xls_cells)
    return out
