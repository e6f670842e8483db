"""Files of a folder, and what one pass over them tells: header, quotes, damage."""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wallflow.session import map_arrow, scratch_root
from wallflow.sources.quoting import opens_quotes
from wallflow.sources.streams import PIECE, kind_of, probe, unpacked

# Spark's readers skip names that begin with "_" or ".". Where Python code in
# tasks cannot open such a file it is copied to a folder of this name, with one
# letter before its own name.
_VISIBLE = "hidden-names-"

# Names that other tools leave beside data; no rows are in them.
_BOOKKEEPING = re.compile(r"_SUCCESS|_temporary|_(?:started|committed)_.*|\..*\.crc")


def escaped(path: str) -> str:
    """``path`` with characters that Spark would read as a pattern escaped."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def file_name(metadata: Column) -> Column:
    """Own name of the file that a row comes from; Spark shows it as part of a URL, where ``+`` is itself."""
    name = F.url_decode(F.replace(metadata["file_name"], F.lit("+"), F.lit("%2B")))
    return F.when(metadata["file_path"].contains(f"/{_VISIBLE}"), F.substr(name, F.lit(2))).otherwise(name)


def list_files(spark: SparkSession, path: str) -> DataFrame | None:
    """``path`` to read, ``key`` as rows show it, ``name`` and ``modified`` of a file, or of a folder's own files.

    None if there is no such path. Contents are not read.
    """
    try:
        found = spark.read.format("binaryFile").load(escaped(path))
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" in str(missing.getCondition()):
            return None
        raise
    return found.select(
        "path",
        F.col("_metadata.file_path").alias("key"),
        file_name(F.col("_metadata")).alias("name"),
        F.col("modificationTime").alias("modified"),
    )


def _hidden(spark: SparkSession, path: str) -> list:
    """Status of the file, or the folder's files, whose names Spark's readers skip."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return []
    found = [s for s in system.listStatus(folder) if s.isFile() and s.getPath().getName()[0] in "_."]
    return [s for s in found if not _BOOKKEEPING.fullmatch(s.getPath().getName())]


@dataclass(frozen=True)
class File:
    """A file to read: its path, as rows show it, and its own name. ``streamed`` ones are read as a stream, since Spark skips them."""

    path: str
    key: str
    name: str
    streamed: bool = False


def _local(status) -> str | None:
    """Path for Python's own ``open``, if the file is on a file system of the machines."""
    uri = status.getPath().toUri()
    return uri.getPath() if (uri.getScheme() or "file") == "file" else None


def on_machines(path: str) -> str | None:
    """The same from a path that Spark lists."""
    match = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", path)
    return (path[5:] if path.startswith("file:") else None) if match else path


def find_files(spark: SparkSession, path: str) -> list[File] | None:
    """The file, or the folder's own files, by path; those that Spark skips as well. None if there is no such path."""
    files, hidden = list_files(spark, path), _hidden(spark, path)
    if files is None and not hidden:
        return None
    found = [] if files is None else [File(r["path"], r["key"], r["name"]) for r in files.collect()]
    copied = []
    for status in hidden:
        local, shown = _local(status), status.getPath()
        if local is None:
            copied.append(status)
        else:
            found.append(File(local, shown.toUri().toString(), shown.getName(), streamed=True))
    if copied:
        # In another store only the driver can open them.
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        folder = f"{scratch_root(spark).rstrip('/')}/{_VISIBLE}{uuid.uuid4().hex}"
        for status in copied:
            target = hadoop.Path(f"{folder}/x{status.getPath().getName()}")
            source = status.getPath().getFileSystem(conf)
            hadoop.FileUtil.copy(source, status.getPath(), target.getFileSystem(conf), target, False, conf)
        found += [File(r["path"], r["key"], r["name"]) for r in list_files(spark, folder).collect()]
    return sorted(found, key=lambda f: f.key)


def newest_file(spark: SparkSession, folder: str, keyword: str) -> str:
    """Path of the last modified file whose name contains ``keyword``; ``""`` if none."""
    files = list_files(spark, folder)
    if files is None:
        return ""
    newest = files.filter(F.col("name").contains(keyword)).agg(
        F.max_by("path", F.struct("modified", "path")).alias("path")
    )
    return newest.first()["path"] or ""


@dataclass
class ReadReport:
    """Files that gave no rows, with the reason. A damaged file gives none of its rows."""

    left_out: dict[str, str] = field(default_factory=dict)


@dataclass
class FileFacts:
    """A file as one pass saw it.

    ``header`` is its first line with text. ``open_quotes`` are the separators
    for which a quoted cell may hold a line break, ``bad_bytes`` tells whether
    some bytes are no UTF-8, ``old_breaks`` whether lines end with a carriage
    return alone. ``damage`` is why a compressed file does not unpack.
    """

    file: File
    header: str | None = None
    open_quotes: frozenset[str] = frozenset()
    bad_bytes: bool = False
    old_breaks: bool = False
    damage: str | None = None
    ranges: list[dict] | None = None


def _damage_elsewhere(spark: SparkSession, files: Sequence[File]) -> dict[str, str]:
    """Damaged compressed files that only Spark can open, with the reason; a file is one value there, up to 2 GB."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1), strict=True)
            reasons = [unpack_error(value.as_buffer(), kind_of(key)) for key, value in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(reasons, pa.string())], names=["key", "reason"])

    rows = spark.read.format("binaryFile").load([escaped(f.path) for f in files])
    found = map_arrow(rows.select(F.col("_metadata.file_path").alias("key"), "content"), unpack, "key string, reason string")
    return {r["key"]: r["reason"] for r in found.filter("reason IS NOT NULL").collect()}


def unpack_error(packed: bytes | pa.Buffer, kind: str) -> str | None:
    """Why a compressed file does not unpack; None if it does."""
    view = memoryview(packed)
    try:
        for _ in unpacked((bytes(view[at : at + PIECE]) for at in range(0, len(view), PIECE)), kind):
            pass
    except (zlib.error, OSError, EOFError) as broken:
        return str(broken)
    return None


def file_facts(spark: SparkSession, files: Sequence[File], seps: str = ",;") -> list[FileFacts]:
    """Facts of each file, ``open_quotes`` for the separators in ``seps``.

    Spark's own pass sends one row per file and task; compressed files, and
    those that Spark skips, are read as streams, by a task each.
    """
    facts = {f.key: FileFacts(f) for f in files}
    opened = {f.key: f.path if f.streamed else on_machines(f.path) for f in files if f.streamed or kind_of(f.name)}
    if streams := [(path, key) for key, path in opened.items() if path]:
        for r in probe(spark, streams).collect():
            facts[r["key"]].damage, facts[r["key"]].header = r["reason"], r["header"]
    if elsewhere := [facts[key].file for key, path in opened.items() if not path]:
        for key, reason in _damage_elsewhere(spark, elsewhere).items():
            facts[key].damage = reason
    paths = [escaped(f.file.path) for f in facts.values() if not f.file.streamed and not f.damage]
    if not paths:
        return [*facts.values()]
    value = F.col("value")
    lines = spark.read.option("lineSep", "\n").text(paths).select(
        "value",
        F.col("_metadata.file_path").alias("key"),
        F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at")).alias("at"),
    )
    ever = lambda c, name: F.coalesce(F.bool_or(c), F.lit(False)).alias(name)
    # A set beside the rest has lines grouped by hash; they would be sorted whole otherwise, long texts and all.
    found = lines.groupBy("key").agg(
        F.min_by(F.regexp_extract(value, "(?U)[^\\r]*\\S[^\\r]*", 0), F.when(value.rlike("(?U)\\S"), F.col("at"))).alias("header"),
        F.array_distinct(F.flatten(F.array(*[F.collect_set(F.when(opens_quotes(value, sep), sep)) for sep in seps]))).alias("open"),
        ever(~F.is_valid_utf8(value), "bad_bytes"),
        ever(value.contains("\r") & value.rlike("\r[^\r]"), "old_breaks"),
    )
    for r in found.collect():
        fact = facts[r["key"]]
        fact.header = (r["header"] or "").lstrip("\ufeff") or None
        fact.open_quotes = frozenset(r["open"])
        fact.bad_bytes, fact.old_breaks = r["bad_bytes"], r["old_breaks"]
    return [*facts.values()]
