"""Rule CSVs to one DataFrame of text columns with row numbers."""

from __future__ import annotations

import csv
import warnings
from collections import defaultdict
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wallflow.functions.text import clean_cell, strip_ws
from wallflow.operators.ordering import number_file_rows
from wallflow.sources.layouts import WIDTH, Layout, cell_names, cells_of_records, lay_out
from wallflow.sources.listing import File, FileFacts, ReadReport, escaped, file_facts, find_files
from wallflow.sources.quoting import quoted_records
from wallflow.sources.streams import stream_records


def rule_header(line: str) -> tuple[str, tuple[str, ...]]:
    """Delimiter and column names of a rule file's header line.

    The delimiter is ``;`` if the line has one. Names are trimmed, lose a
    leading ``#`` and quotes, and are lower-cased; repeats get ``_1``, ``_2``.
    Where that gives a name twice, the last column of the name counts.
    """
    line = line.strip().lstrip("#")
    delimiter = ";" if ";" in line else ","
    names, repeats = [], defaultdict(int)
    for cell in next(csv.reader([line], delimiter=delimiter)):
        name = cell.strip().lstrip("#").strip('"').lower()
        names.append(f"{name}_{repeats[name]}" if repeats[name] else name)
        repeats[name] += 1
    return delimiter, tuple(names)


PLACES = ["_row", "_file", "_line"]


def _scan(spark: SparkSession, paths: Sequence[str], sep: str, width: int, multi_line: bool) -> DataFrame:
    lines = (
        spark.read.schema(", ".join(f"{c} string" for c in cell_names(width)))
        .options(header=False, sep=sep, quote='"', escape='"', multiLine=multi_line, mode="PERMISSIVE")
        .csv([escaped(p) for p in paths])
    )
    return lines.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start"))


def _rows(spark: SparkSession, facts: list[FileFacts], sep: str, width: int, multi_line: bool | None) -> DataFrame:
    """Cells of all rows with text in the files of one separator; ``_seq`` counts them in a split without gaps."""
    needs = lambda f: multi_line is not False and sep in f.open_quotes
    plain = [f.file.path for f in facts if not f.file.streamed and not needs(f)]
    split = [f.file.path for f in facts if not f.file.streamed and needs(f) and not f.old_breaks]
    whole = [f.file.path for f in facts if not f.file.streamed and needs(f) and f.old_breaks]
    streamed = [(f.file.path, f.file.key) for f in facts if f.file.streamed]
    cells = cell_names(width)
    out = []
    if split:
        joined = quoted_records(spark, [escaped(p) for p in split], sep, drop_header=False)
        if joined is None:
            whole += split
        else:
            out.append(cells_of_records(joined, sep, width).drop("value"))
    if streamed:
        found = stream_records(spark, streamed, sep).select(F.col("value").cast("string").alias("value"), "_path", F.lit(0).cast("long").alias("_start"))
        out.append(cells_of_records(found, sep, width).drop("value"))
    out += [_scan(spark, p, sep, width, lines) for p, lines in ((plain, False), (whole, True)) if p]
    has_text = F.exists(F.array(*cells), lambda c: strip_ws(F.coalesce(c, F.lit(""))) != "")
    rows = None
    for part in out:
        part = part.filter(has_text).select(*cells, "_path", "_start", F.monotonically_increasing_id().alias("_seq"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


def read_rules(
    spark: SparkSession,
    paths: str | Sequence[str],
    *,
    multi_line: bool | None = None,
    may_be_empty: bool = False,
    report: ReadReport | None = None,
) -> DataFrame:
    """Rules of one or several files, in the order given.

    Every value is text, trimmed and without quotes on its ends; what a file
    lacks is ``""``. Adds ``_row`` (1, 2, ... over all files), ``_file`` and
    ``_line`` (1, 2, ... in each file, header and blank lines not counted).
    A file that is missing, empty or damaged is left out whole, warned of, and
    listed in ``report``. One pass finds the headers and the files in which a
    quoted cell holds a line break, which are read as records by all cores, see
    ``quoting``; ``multi_line=False`` takes each line as a row. One scan for
    each separator reads all files by position, and a table from file to header
    names the cells. Without any rule file this fails, unless ``may_be_empty``.
    """
    report = ReadReport() if report is None else report

    def left_out(path: str, what: str, reason: str) -> None:
        report.left_out[path] = reason
        warnings.warn(f"rule file {what}", stacklevel=3)

    wanted: list[File] = []
    for path in [paths] if isinstance(paths, str) else paths:
        found = find_files(spark, path)
        if found is None:
            left_out(path, f"not found: {path}", "not found")
        elif not found:
            # Spark lists no file without bytes.
            left_out(path, f"without a header: {path}", "no header")
        wanted += found or []
    facts = file_facts(spark, list(dict.fromkeys(wanted)))
    for f in facts:
        if f.damage:
            left_out(f.file.path, f"left out: {f.file.path}: {f.damage}", f.damage)
        elif f.header is None:
            left_out(f.file.path, f"without a header: {f.file.path}", "no header")
    facts = [f for f in facts if f.header is not None and not f.damage]
    if not facts:
        if may_be_empty:
            return spark.createDataFrame([], "_row long, _file string, _line long")
        raise FileNotFoundError("none of the rule files could be read")
    headers = {f.file.key: rule_header(f.header) for f in facts}
    # Cells without a name, or with that of a place, are not kept.
    named_cells = lambda names: ["" if n in PLACES else n for n in names]
    layout = Layout({key: named_cells(names) for key, (_, names) in headers.items()}, nameless=False)
    rows = None
    for sep in sorted({sep for sep, _ in headers.values()}):
        own = [f for f in facts if headers[f.file.key][0] == sep]
        part = _rows(spark, own, sep, layout.width, multi_line)
        rows = part if rows is None else rows.unionByName(part)
    order = spark.createDataFrame([(f.key, i, f.name) for i, f in enumerate(wanted) if f.key in headers], "_path string, _file_order int, _file string")
    # The first row of each file is its header, and gets line 0.
    numbered = number_file_rows(rows, order, header_rows=1).filter(F.col("_line") > 0)
    return lay_out(numbered, layout, clean_cell, before=PLACES).drop(WIDTH)
