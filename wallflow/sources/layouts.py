"""From cells by position to columns by name, with the header of each file looked up at run time."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wallflow.operators.joins import BROADCAST_BYTES, BROADCAST_ROWS

# Fields in the header of a row's file.
WIDTH = "_fields_of_header"


class Layout:
    """Headers of files, by the name under which rows show the file.

    Names that differ in case alone are one column, under the name met first,
    as in a union by name; of such a name twice in one header the last counts.
    ``nameless`` keeps a column without a name.
    """

    def __init__(self, headers: Mapping[str, Sequence[str]], nameless: bool = True):
        self.headers = {key: tuple(names) for key, names in headers.items()}
        self.nameless = nameless

    @property
    def width(self) -> int:
        return max(map(len, self.headers.values()))

    @cached_property
    def columns(self) -> list[str]:
        names: dict[str, str] = {}
        for header in dict.fromkeys(self.headers.values()):
            for name in header:
                if name or self.nameless:
                    names.setdefault(name.lower(), name)
        return [*names.values()]

    def places(self, header: Sequence[str]) -> list[int | None]:
        """For each column, which cell of such a file it is."""
        own = {name.lower(): i for i, name in enumerate(header)}
        return [own.get(c.lower()) for c in self.columns]

    def table(self, spark: SparkSession) -> DataFrame:
        """``(_path, _width, _places)``, a row per file; marked for broadcast if its size, known here, allows."""
        kinds = {header: i for i, header in enumerate(dict.fromkeys(self.headers.values()))}
        files = spark.createDataFrame([(key, kinds[h]) for key, h in self.headers.items()], "_path string, _kind int")
        rows = [(i, len(h), self.places(h)) for h, i in kinds.items()]
        headers = spark.createDataFrame(rows, "_kind int, _width int, _places array<int>")
        wide = 8 * len(self.columns)
        fits = lambda n, size: n <= BROADCAST_ROWS and size <= BROADCAST_BYTES
        headers = F.broadcast(headers) if fits(len(kinds), wide * len(kinds)) else headers
        table = files.join(headers, "_kind").drop("_kind")
        size = sum(len(key) + wide for key in self.headers)
        return F.broadcast(table) if fits(len(self.headers), size) else table


def cell_names(width: int) -> list[str]:
    return [f"_c{i}" for i in range(width)]


def cells_of_records(records: DataFrame, sep: str, width: int, odd: str | None = None) -> DataFrame:
    """``records`` with the cells of each ``value``, a CSV record that may hold line breaks in quotes.

    Column ``odd`` holds the record again if it has more or fewer than ``width`` cells.
    """
    schema = ", ".join(f"{c} string" for c in [*cell_names(width), *([odd] if odd else [])])
    options = {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "multiLine": "true"}
    if odd:
        options["columnNameOfCorruptRecord"] = odd
    parsed = records.withColumn("_parsed", F.from_csv("value", schema, options))
    return parsed.select(*records.columns, "_parsed.*")


def lay_out(
    cells: DataFrame,
    layout: Layout,
    change: Callable[[Column], Column],
    before: Sequence[str] = (),
    behind: Sequence[str] = (),
) -> DataFrame:
    """Named columns, changed, between those of ``before`` and ``behind``; last ``WIDTH``, the number of fields in the file's header.

    With one header for all files the names are known as it is. Otherwise the
    table of files is looked up, see ``Layout.table``.
    """
    headers = set(layout.headers.values())
    if len(headers) == 1:
        places = layout.places(next(iter(headers)))
        chosen = [change(F.col(f"_c{i}")).alias(c) for c, i in zip(layout.columns, places, strict=True)]
        return cells.select(*before, *chosen, *behind, F.lit(layout.width).alias(WIDTH))
    laid = cells.join(layout.table(cells.sparkSession), "_path")
    laid = laid.withColumn("_cells", F.array(*cell_names(layout.width)))
    chosen = [change(F.get("_cells", F.get("_places", F.lit(i)))).alias(c) for i, c in enumerate(layout.columns)]
    return laid.select(*before, *chosen, *behind, F.col("_width").alias(WIDTH))
