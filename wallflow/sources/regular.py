"""CSV files whose quotes stand only where a CSV writer puts them, read as bytes by all cores.

A quote begins a cell, ends one, or is doubled inside one; anything else, and
carriage returns, NUL and bytes that are no UTF-8, makes a file irregular, and
irregular files go the ways that know what to do with them. In a regular file
an odd number of quotes before a byte says that it is quoted. So one pass over
ranges of bytes finds, 64 bytes to a word, what each range does to a reader
that begins outside quotes and to one that begins inside, and whether either
meets something irregular. Which of both is true follows from the ranges before.
The second pass cuts each range into records and cells.

Files must be where Python code in tasks can open them, as for ``streams``.
"""

from __future__ import annotations

import codecs
import json
import os
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.csv as pacsv
from pyspark.sql import DataFrame, SparkSession

from wallflow.session import map_arrow
from wallflow.sources.layouts import cell_names
from wallflow.sources.streams import PIECE, lines

# Bytes looked at in one go: what is made of them stays in a core's cache.
_BLOCK = 1 << 19
# Bytes of records that are parsed in one go; a longer record is parsed alone.
_CHUNK = 1 << 22
_BLANK = bytes(range(33))
# What Unicode calls white space, as in the patterns of ``listing``.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_TEXT = re.compile(f"[^\r]*[^{_SPACE}][^\r]*")

_SHAPE = "path string, begin long, flips boolean, odd_outside boolean, odd_inside boolean, break_outside boolean, break_inside boolean, header string, head_at long"


def _words(found: np.ndarray) -> np.ndarray:
    """Truth values as bits, the first of each word the lowest."""
    packed = np.packbits(found, bitorder="little")
    return np.concatenate([packed, np.zeros(-len(packed) % 8, np.uint8)]).view("<u8")


def _quoted(quotes: np.ndarray, inside: bool) -> np.ndarray:
    """Bits of the bytes after which a reader is inside quotes that stood there, or not, before them."""
    bits = quotes.copy()
    for by in (1, 2, 4, 8, 16, 32):
        bits ^= bits << np.uint64(by)
    # The highest bit of a word tells whether its quotes are odd in number.
    turned = np.bitwise_xor.accumulate(np.concatenate([np.array([inside], "<u8"), bits[:-1] >> np.uint64(63)]))
    return bits ^ (np.uint64(0) - turned)


def _places(bits: np.ndarray) -> np.ndarray:
    """Which bits are set; few are, so only their words are taken apart."""
    words = np.flatnonzero(bits)
    rows, columns = np.nonzero(np.unpackbits(bits[words].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(bool))
    return 64 * words[rows] + columns


def _next(bits: np.ndarray, first: bool) -> np.ndarray:
    """Bits moved to the byte behind, ``first`` in front."""
    moved = bits << np.uint64(1)
    moved[1:] |= bits[:-1] >> np.uint64(63)
    moved[0] |= np.uint64(first)
    return moved


class _Shape:
    """What bytes, given one block after another, do to a reader from outside quotes and to one from inside."""

    def __init__(self, before: bytes, sep: bytes):
        self.sep = sep[0]
        self.flips = False
        self.odd, self.breaks = [False, False], [False, False]
        self.quote = before == b'"'
        self.edge = before in (b"", b"\n", b'"', sep)

    def add(self, block: bytes) -> None:
        a = np.frombuffer(block, np.uint8)
        quotes, ends = _words(a == 34), _words(a == 10)
        edges = quotes | ends | _words(a == self.sep)
        after = _quoted(quotes, self.flips)
        before = after ^ quotes
        # Outside, a quote begins a cell, or stands behind one that it makes double; behind a cell's end is no text.
        strange = (quotes & ~_next(edges, self.edge)) | (_next(quotes, self.quote) & ~edges)
        if len(a) % 64:
            strange[-1] &= np.uint64((1 << len(a) % 64) - 1)
        for state, outside in enumerate((~before, before)):
            self.odd[state] |= bool((strange & outside).any())
            self.breaks[state] |= bool((ends & ~outside).any())
        self.flips ^= bool(np.bitwise_xor.reduce(quotes).item().bit_count() % 2)
        self.quote, self.edge = block[-1] == 34, block[-1] in (10, 34, self.sep)


def _look(path: str, start: int, end: int, sep: bytes) -> tuple:
    """``flips``, ``odd`` and ``breaks`` of a range; odd for both readers if its bytes make the file irregular."""
    with open(path, "rb") as file:
        file.seek(max(start - 1, 0))
        shape = _Shape(file.read(1) if start else b"", sep)
        decoder, left, first = codecs.getincrementaldecoder("utf-8")("strict"), end - start, start > 0
        while left and (piece := file.read(min(left, PIECE))):
            left -= len(piece)
            text = piece
            if first:
                # A character that begins before the range is looked at there.
                text, first = re.sub(rb"\A[\x80-\xbf]{1,3}", b"", piece), False
            if not left:
                text += re.match(rb"[\x80-\xbf]{0,3}", file.read(3))[0]
            try:
                if not text.isascii() or decoder.getstate()[0]:
                    decoder.decode(text, final=not left)
                bad = b"\r" in piece or b"\x00" in piece
            except UnicodeDecodeError:
                bad = True
            for at in range(0, 0 if bad else len(piece), _BLOCK):
                shape.add(piece[at : at + _BLOCK])
            if bad or all(shape.odd):
                return False, [True, True], [True, True]
        return shape.flips, shape.odd, shape.breaks


def _pieces(path: str) -> Iterator[bytes]:
    with open(path, "rb") as file:
        while piece := file.read(PIECE):
            yield piece


def _head(path: str) -> tuple[str | None, int | None]:
    """The first line with text, without what is no UTF-8, and where the first record begins that is not blank."""
    at, head_at = 0, None
    for line in lines(_pieces(path)):
        if head_at is None and line.strip(_BLANK):
            head_at = at
        at += len(line) + 1
        if found := _TEXT.search(line.decode("utf-8", "replace")):
            return found[0].lstrip("\ufeff") or None, head_at
    return None, head_at


def _in_tasks(spark: SparkSession, ranges: Sequence[dict], run, schema: str) -> DataFrame:
    """Batches that ``run`` makes of each range; small ranges share a task."""
    size, tasks, room = _range_bytes(spark, sum(r["end"] - r["start"] for r in ranges)), [], 0
    for r in ranges:
        if r["end"] - r["start"] > room:
            tasks.append([])
            room = size
        tasks[-1].append(r)
        room -= r["end"] - r["start"]
    sent = [json.dumps(t) for t in tasks]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                for r in json.loads(sent[i]):
                    yield from run(r)

    found = map_arrow(spark.range(0, len(sent), 1, len(sent)), each, schema)
    # Spark would take this for as small as the row a task that it is made of, and send it to all tasks of a join.
    # The rows of an RDD, here none, are as many as can be.
    return found.union(spark.createDataFrame(spark.sparkContext.emptyRDD(), found.schema))


def _bytes_of(spark: SparkSession, name: str) -> int:
    """A size in Spark's settings."""
    return spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))


def _range_bytes(spark: SparkSession, total: int) -> int:
    """Size of ranges, by Spark's settings for splits; two or more a core, since a task costs a tenth of a second."""
    most, least = (_bytes_of(spark, f"spark.sql.files.{n}") for n in ("maxPartitionBytes", "openCostInBytes"))
    return max(1, min(most, max(least, total // (2 * spark.sparkContext.defaultParallelism))))


def shapes(spark: SparkSession, files: Sequence[tuple[str, str]], sep: str) -> dict[str, dict]:
    """By key, of each regular file of ``(path, key)``: its ``header``, and ``ranges`` if a quoted cell holds a line break.

    Nothing is said of files that are irregular, nor of any if they hold less
    together than Spark reckons it costs to open a file.
    """
    sizes = {key: os.path.getsize(path) for path, key in files}
    total = sum(sizes.values())
    if total < _bytes_of(spark, "spark.sql.files.openCostInBytes"):
        return {}
    step = _range_bytes(spark, total)
    cut = {
        key: [{"path": path, "key": key, "start": at, "end": min(at + step, sizes[key]), "size": sizes[key]} for at in range(0, sizes[key], step)]
        for path, key in files
    }

    def look(r: dict) -> Iterator[pa.RecordBatch]:
        flips, odd, breaks = _look(r["path"], r["start"], r["end"], sep.encode())
        header, head_at = _head(r["path"]) if r["start"] == 0 and not all(odd) else (None, None)
        row = (r["key"], r["start"], flips, *odd, *breaks, header, head_at)
        types = (pa.string(), pa.int64(), *[pa.bool_()] * 5, pa.string(), pa.int64())
        names = [f.split()[0] for f in _SHAPE.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=names)

    seen = {(r["path"], r["begin"]): r for r in _in_tasks(spark, [r for own in cut.values() for r in own], look, _SHAPE).collect()}
    found: dict[str, dict] = {}
    for key, own in cut.items():
        inside, breaks, regular = False, False, bool(own)
        for r in own:
            shape = seen[key, r["start"]]
            r["inside"], r["head_at"] = inside, seen[key, 0]["head_at"]
            regular &= not (shape["odd_inside"] if inside else shape["odd_outside"])
            breaks |= shape["break_inside"] if inside else shape["break_outside"]
            inside ^= shape["flips"]
        if regular and not inside:
            found[key] = {"header": seen[key, 0]["header"], "ranges": own if breaks else None}
    return found


def _chunks(r: dict) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """Whole records that begin in a range: where they stand in the file, their bytes, and where each ends there."""
    with open(r["path"], "rb") as file:
        if os.fstat(file.fileno()).st_size != r["size"]:
            raise ValueError(f"{r['path']}: the file changed while it was read")
        at, inside = r["start"], r["inside"]
        file.seek(max(at - 1, 0))
        # A range that begins inside a record leaves its rest to the one before.
        skip = at > 0 and (file.read(1) != b"\n" or inside)
        held, ends, length, done = [], [], 0, False
        while not done and (block := file.read(_BLOCK)):
            a = np.frombuffer(block, np.uint8)
            after = _quoted(_words(a == 34), inside)
            stops = _places(_words(a == 10) & ~after)
            inside = bool(after[(len(a) - 1) // 64].item() >> ((len(a) - 1) % 64) & 1)
            offset, at = at, at + len(a)
            if at >= r["end"] and len(last := np.flatnonzero(stops >= r["end"] - 1 - offset)):
                stops, done = stops[: last[0] + 1], True
            if skip:
                if not len(stops):
                    continue
                cut, skip = int(stops[0]) + 1, False
                block, stops, offset = block[cut:], stops[1:] - cut, offset + cut
            if not held:
                begin = offset
            if len(stops):
                ends.append(stops + length)
                whole = int(stops[-1]) + 1
                held.append(block[:whole])
                length += whole
                if length >= _CHUNK or done:
                    yield begin, b"".join(held), np.concatenate(ends)
                    held, ends, length, begin = [], [], 0, offset + whole
                block = block[whole:]
            if not done and block:
                held.append(block)
                length += len(block)
        if held and not skip and not done:
            # Of the last range: what is left is whole records, and one more if the file does not end with a line break.
            rest = b"".join(held)
            if not rest.endswith(b"\n"):
                ends.append(np.array([len(rest)]))
            yield begin, rest, np.concatenate(ends)


def _cells(records: bytes, width: int, sep: str) -> tuple[pa.Table, list[tuple[int, int]]]:
    """Cells of records, each as a text; and the places of those that have not ``width`` cells, with how many they have."""
    others: list[tuple[int, int]] = []

    def skip(row: pacsv.InvalidRow) -> str:
        others.append((row.number - 1, row.actual_columns))
        return "skip"

    names = cell_names(width)
    table = pacsv.read_csv(
        pa.BufferReader(records),
        pacsv.ReadOptions(use_threads=False, block_size=len(records) + 1, column_names=names),
        pacsv.ParseOptions(delimiter=sep, newlines_in_values=True, ignore_empty_lines=False, invalid_row_handler=skip),
        pacsv.ConvertOptions(check_utf8=False, column_types=dict.fromkeys(names, pa.string()), strings_can_be_null=False),
    )
    return table, others


def regular_cells(spark: SparkSession, files: Sequence[tuple[Sequence[dict], int, Sequence[int | None]]], sep: str) -> DataFrame:
    """Cells of each record, ``_path``, ``_start`` and ``_seq``, of regular files.

    A file is given by its ranges, the fields of its header, and for each column
    which of them it is; the columns are as many for all files. Blank records,
    the header and records of more cells than it are left out, those of fewer
    have nulls. ``_seq`` is where a record begins in its file.
    """
    cells = cell_names(len(files[0][2]))
    ranges = [{**r, "width": width, "places": list(places)} for own, width, places in files for r in own]

    def run(r: dict) -> Iterator[pa.RecordBatch]:
        def batches(table: pa.Table, seq: np.ndarray) -> Iterator[pa.RecordBatch]:
            lacking = pa.nulls(len(seq), pa.string())
            columns = [lacking if i is None or i >= table.num_columns else table.column(i) for i in r["places"]]
            columns += [pa.repeat(pa.scalar(r["key"]), len(seq)), pa.repeat(pa.scalar(r["start"]), len(seq)), pa.array(seq, pa.int64())]
            yield from pa.table(columns, names=[*cells, "_path", "_start", "_seq"]).to_batches()

        for begin, records, ends in _chunks(r):
            heads = np.r_[0, ends[:-1] + 1]
            table, others = _cells(records, r["width"], sep)
            # An empty line has come as a row of empty cells.
            full = np.ones(len(ends), bool)
            full[[i for i, _ in others]] = False
            wanted = (ends > heads) & (heads + begin != r["head_at"])
            keep = wanted[full]
            yield from batches(table if keep.all() else table.filter(pa.array(keep)), (heads + begin)[full & wanted])
            for n in sorted({n for _, n in others if n < r["width"]}):
                short = [i for i, k in others if k == n and wanted[i] and records[heads[i] : ends[i]].strip(_BLANK)]
                if short:
                    few, _ = _cells(b"\n".join(records[heads[i] : ends[i]] for i in short), n, sep)
                    yield from batches(few, heads[short] + begin)

    schema = ", ".join([*[f"{c} string" for c in cells], "_path string, _start long, _seq long"])
    return _in_tasks(spark, ranges, run, schema)
