"""A data source that reads files as streams: compressed ones to their end, and ones whose names Spark skips.

One task reads a file, in pieces of a megabyte, so a file costs the same memory
whatever its size. Files must be where Python code in tasks can open them: on
a file system of the machines, shared as Spark's own readers need it.
"""

from __future__ import annotations

import bz2
import json
import re
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from wallflow.session import with_package
from wallflow.sources.quoting import open_patterns

PIECE = 1 << 20
# Compressed input is fed in smaller steps: what follows a member is copied.
_STEP = 1 << 15
_BLANK = bytes(range(33))


def unpacked(pieces: Iterator[bytes], kind: str) -> Iterator[bytes]:
    """Content of a stream of compressed pieces, members one after another; raises where it is damaged."""
    unpacker = None
    for piece in pieces:
        for at in range(0, len(piece), _STEP):
            rest = piece[at : at + _STEP]
            while rest:
                if unpacker is None:
                    unpacker = zlib.decompressobj(31) if kind == "gz" else bz2.BZ2Decompressor()
                yield unpacker.decompress(rest) if kind == "gz" else unpacker.decompress(rest, max_length=PIECE)
                # A step of gzip is bounded by its format; bz2 holds back what is over.
                while kind == "bz2" and not unpacker.eof and not unpacker.needs_input:
                    yield unpacker.decompress(b"", max_length=PIECE)
                rest = unpacker.unused_data
                if unpacker.eof:
                    unpacker = None
    if unpacker is not None:
        raise EOFError("ends too early")


def kind_of(name: str) -> str:
    """``gz``, ``bz2``, or nothing for a file that is not compressed."""
    return next((k for k in ("gz", "bz2") if name.endswith(f".{k}")), "")


def content(path: str) -> Iterator[bytes]:
    """Pieces of a file, unpacked."""

    def raw() -> Iterator[bytes]:
        with open(path, "rb") as file:
            while piece := file.read(PIECE):
                yield piece

    return unpacked(raw(), kind_of(path)) if kind_of(path) else raw()


def lines(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Lines of a stream, without the break between them."""
    held: list[bytes] = []
    for piece in pieces:
        first, *rest = piece.split(b"\n")
        held.append(first)
        if rest:
            yield b"".join(held)
            yield from rest[:-1]
            held = [rest[-1]]
    if last := b"".join(held):
        yield last


def records(found: Iterator[bytes], sep: str) -> Iterator[bytes]:
    """Lines joined where a quoted cell goes over a line break; blank ones left out."""
    outside, inside = (re.compile(p.replace("\\z", "\\Z").encode()) for p in open_patterns(sep))
    open_: list[bytes] = []
    for line in found:
        if open_:
            open_.append(line)
            if b'"' not in line or inside.search(line):
                continue
            line, open_ = b"\n".join(open_), []
        elif b'"' in line and outside.search(line):
            open_ = [line]
            continue
        line = line[:-1].replace(b"\r\n", b"\n") if line.endswith(b"\r") else line
        if line.strip(_BLANK):
            yield line
    if open_:
        yield b"\n".join(open_)


class _File(InputPartition):
    pass


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.mode, self.files = options["mode"], json.loads(options["files"])

    def partitions(self) -> list[_File]:
        return [_File(f) for f in self.files]

    def read(self, partition: _File) -> Iterator[tuple]:
        path, key, sep = partition.value
        if self.mode == "records":
            for n, record in enumerate(records(lines(content(path)), sep)):
                yield record, key, n
            return
        header, reason = None, None
        try:
            for line in lines(content(path)):
                text = line.decode("utf-8", "replace").strip()
                header = header or text.lstrip("﻿") or None
                if header and not kind_of(path):
                    break
        except (zlib.error, OSError, EOFError) as broken:
            reason = str(broken) or type(broken).__name__
        yield key, reason, header


class FileStreams(DataSource):
    """Options: ``files``, a JSON list of (path, key, separator), and ``mode``, ``probe`` or ``records``."""

    @classmethod
    def name(cls) -> str:
        return "file_streams"

    def schema(self) -> str:
        if self.options["mode"] == "records":
            return "value binary, _path string, n long"
        return "key string, reason string, header string"

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))


def _load(spark: SparkSession, mode: str, files: list[tuple[str, str, str]]) -> DataFrame:
    with_package(spark)
    spark.dataSource.register(FileStreams)
    return spark.read.format(FileStreams.name()).option("mode", mode).option("files", json.dumps(files)).load()


def probe(spark: SparkSession, files: list[tuple[str, str]]) -> DataFrame:
    """``(key, reason, header)`` of each ``(path, key)``: why a compressed file does not unpack to its end, else null; its first line with text."""
    return _load(spark, "probe", [(p, k, ",") for p, k in files])


def stream_records(spark: SparkSession, files: list[tuple[str, str]], sep: str) -> DataFrame:
    """``(value, _path, n)`` of each ``(path, key)``: its CSV records, counted from 0, blank ones left out."""
    return _load(spark, "records", [(p, k, sep) for p, k in files])
