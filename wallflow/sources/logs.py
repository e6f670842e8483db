"""Log CSVs to one DataFrame of text columns."""

from __future__ import annotations

import csv
import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wallflow.functions.fields import named
from wallflow.functions.text import drop_invalid_bytes
from wallflow.operators.flows import null_words_to_null
from wallflow.sources.layouts import WIDTH, Layout, cell_names, cells_of_records, lay_out
from wallflow.sources.listing import File, FileFacts, ReadReport, escaped, file_facts, find_files, on_machines
from wallflow.sources.quoting import quoted_records
from wallflow.sources.regular import regular_cells, shapes
from wallflow.sources.streams import kind_of, stream_records

BAD_LINE = "_corrupt_record"
ORDER = ["_path", "_start", "_seq"]


def header_names(line: str) -> list[str]:
    """Column names of a header line; repeats become ``name.1``, ``name.2``.

    Names that differ in case alone are repeats, since Spark could not tell
    them apart.
    """
    names, taken = [], set()
    for name in next(csv.reader([line])):
        unique, n = name, 0
        while unique.lower() in taken:
            n += 1
            unique = f"{name}.{n}"
        taken.add(unique.lower())
        names.append(unique)
    return names


def field_count(line: Column, sep: str = ",") -> Column:
    """Number of fields in a CSV record, separators inside quotes left out."""
    bare = F.regexp_replace(line, f'(^|{sep})"(?:[^"]|"")*+"', "$1")
    return F.length(bare) - F.length(F.replace(bare, F.lit(sep), F.lit(""))) + 1


def _too_long(record: Column, width: Column) -> Column:
    """Whether a record has more fields than its header; separators are counted first, which is cheap."""
    most = F.length(record) - F.length(F.replace(record, F.lit(","), F.lit(""))) + 1
    return F.when(most > width, field_count(record) > width).otherwise(F.lit(False))


def _place() -> list[Column]:
    return [
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_seq"),
    ]


def _scan(spark: SparkSession, paths: Sequence[str], columns: Sequence[str], **options) -> DataFrame:
    """Rows of files, by position; ``BAD_LINE`` holds records that are shorter or longer than ``columns``.

    A pruned parser does not see how many fields a line has, so all are read.
    """
    return (
        spark.read.schema(", ".join(f"`{c}` string" for c in [*columns, BAD_LINE]))
        .options(header=True, escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord=BAD_LINE, columnPruning=False, **options)
        .csv([escaped(p) for p in paths])
    )


def _same_header(spark: SparkSession, files: list[File], names: list[str], multi_line: bool) -> DataFrame:
    """All files by one scan, in which Spark holds each header against the first file's."""
    lines = _scan(spark, [f.path for f in files], names, multiLine=multi_line, enforceSchema=False)
    # The last term is always true; Spark refuses a scan of the raw record alone.
    raw = F.col(BAD_LINE)
    too_long = raw.isNotNull() & _too_long(raw, F.lit(len(names))) & (F.coalesce(F.length(named(names[0])), F.lit(0)) >= 0)
    return lines.filter(~too_long).select(*[null_words_to_null(named(n)).alias(n) for n in names], *_place())


def _rows(spark: SparkSession, facts: list[FileFacts], layout: Layout, multi_line: bool | None) -> DataFrame:
    """Cells of files: a scan, and two more branches for files that a scan cannot read as they are."""
    needs = lambda f: f.bad_bytes or (multi_line is not False and "," in f.open_quotes)
    plain = [f.file.path for f in facts if not f.file.streamed and not needs(f)]
    split = [f.file.path for f in facts if not f.file.streamed and needs(f) and not f.old_breaks]
    whole = [f.file.path for f in facts if not f.file.streamed and needs(f) and f.old_breaks]
    streamed = [(f.file.path, f.file.key) for f in facts if f.file.streamed]
    names = cell_names(layout.width)
    # The condition always holds; Spark refuses a scan of the raw record alone.
    raw = F.when(F.coalesce(F.length(names[0]), F.lit(0)) >= 0, F.coalesce(named(BAD_LINE), F.lit("")))
    out = []

    def add_records(records: DataFrame) -> None:
        text = records.withColumn("value", drop_invalid_bytes(F.col("value")))
        cells = cells_of_records(text, ",", layout.width, odd=BAD_LINE)
        # A record of just so many cells is not searched for them again; as many stand for it.
        full = F.lit("," * (layout.width - 1))
        out.append(cells.select(*names, F.coalesce(named(BAD_LINE), full).alias(BAD_LINE), *ORDER))

    if split:
        joined = quoted_records(spark, [escaped(p) for p in split], ",", drop_header=True, join=multi_line is not False)
        if joined is None:
            whole += split
        else:
            add_records(joined.withColumn("_seq", F.monotonically_increasing_id()))
    if streamed:
        found = stream_records(spark, streamed, ",").filter("n > 0")
        add_records(found.select(F.col("value").cast("string").alias("value"), "_path", F.lit(0).cast("long").alias("_start"), F.col("n").alias("_seq")))
    for paths, lines in ((plain, False), (whole, True)):
        if paths:
            scan = _scan(spark, paths, names, multiLine=lines, enforceSchema=True)
            out.append(scan.select(*names, raw.alias(BAD_LINE), *_place()))
    rows = out[0]
    for part in out[1:]:
        rows = rows.unionByName(part)
    return rows


def _facts(spark: SparkSession, files: list[File], multi_line: bool | None) -> list[FileFacts]:
    """Facts of each file; regular files that Python code in tasks can open are looked at as bytes, which is faster."""
    paths = {} if multi_line is False else {f.key: on_machines(f.path) for f in files if not f.streamed and not kind_of(f.name)}
    found = shapes(spark, [(p, key) for key, p in paths.items() if p], ",")
    facts = {f.file.key: f for f in file_facts(spark, [f for f in files if f.key not in found], ",")}
    for f in files:
        if shape := found.get(f.key):
            quotes = frozenset([","] if shape["ranges"] else [])
            facts[f.key] = FileFacts(f, shape["header"], open_quotes=quotes, ranges=shape["ranges"])
    return [facts[f.key] for f in files]


def read_logs(
    spark: SparkSession,
    path: str,
    *,
    multi_line: bool | None = None,
    same_header: bool = False,
    with_order: bool = False,
    report: ReadReport | None = None,
) -> DataFrame:
    """Rows of one log file, or of the ``.csv`` files of a folder (not below it).

    Files are united by column name; what a file lacks is null. One pass over
    the files finds their headers, and one scan reads them all by position; a
    table from file to header says which cell is which column, so the plan does
    not grow with the headers. Files in which a quoted cell holds a line break,
    or with bytes that are no UTF-8 (which are dropped), are read as records by
    all cores, see ``regular`` and ``quoting``. ``multi_line`` decides for all files whether
    quotes may hold line breaks. ``same_header`` promises
    that all files have the first one's header, which saves the pass; a file
    that breaks the promise fails the read. Compressed files that do not unpack
    to their end are left out whole, warned of, and listed in ``report``; other
    trouble fails the read. ``with_order`` adds the columns named in ``ORDER``,
    for breaking ties between rows of the same time.
    """
    report = ReadReport() if report is None else report
    found = find_files(spark, path)
    if not found:
        raise FileNotFoundError(f"no log file at {path}")
    is_file = len(found) == 1 and found[0].name == path.rstrip("/").rsplit("/", 1)[-1]
    chosen = [f for f in found if is_file or f.name.endswith((".csv", ".csv.gz", ".csv.bz2"))]
    if not chosen:
        raise FileNotFoundError(f"no .csv file in {path}")
    if same_header and not any(f.streamed for f in chosen):
        first = file_facts(spark, chosen[:1], ",")[0]
        names = header_names(first.header or "")
        rows = _same_header(spark, chosen, names, True if multi_line is None else multi_line)
        return rows if with_order else rows.drop(*ORDER)
    facts = _facts(spark, chosen, multi_line)
    for f in facts:
        if f.damage or f.header is None:
            report.left_out[f.file.name] = f.damage or "no header"
        if f.damage:
            warnings.warn(f"log file left out: {f.file.name}: {f.damage}", stacklevel=2)
    facts = [f for f in facts if f.header is not None and not f.damage]
    if not facts:
        raise ValueError(f"no log file with a header at {path}")
    layout = Layout({f.file.key: tuple(header_names(f.header)) for f in facts})
    # Of a record with one cell alone an empty line would be no different.
    regular = [f for f in facts if f.ranges and len(layout.headers[f.file.key]) > 1]
    parts = []
    if regular:
        headers = [layout.headers[f.file.key] for f in regular]
        found = regular_cells(spark, [(f.ranges, len(h), layout.places(h)) for f, h in zip(regular, headers, strict=True)], ",")
        parts.append(found.select(*[null_words_to_null(F.col(f"_c{i}")).alias(c) for i, c in enumerate(layout.columns)], *ORDER))
    apart = {f.file.key for f in regular}
    if others := [f for f in facts if f.file.key not in apart]:
        cells = lay_out(_rows(spark, others, layout, multi_line), layout, null_words_to_null, behind=[BAD_LINE, *ORDER])
        # Short rows stay, padded with nulls; rows with more fields than their header go.
        parts.append(cells.filter(~_too_long(F.col(BAD_LINE), F.col(WIDTH))).drop(BAD_LINE, WIDTH))
    logs = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
    return logs if with_order else logs.drop(*ORDER)
