"""CSV records whose quoted cells hold line breaks, read by all cores.

A line takes a reader that stands outside quotes, or inside, to one of both. A
task finds what its split does to either reading; a running composition over
the splits of a file tells in which one each split really begins. Lines are
then joined to records where they stand; of a record that goes over the end of
a split, the rest is brought from the next ones. All that reads the files
three times, so it is for those that need it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wallflow.operators.joins import fits_broadcast
from wallflow.session import map_arrow, materialise

# What a line does to a reader: 1 is added if it leaves one from outside inside
# quotes, 2 if it leaves one from inside there. A line without quotes changes nothing.
_SAME, _OPENS, _CLOSES = 2, 1, 0
_BLANK = bytes(range(33))


def open_patterns(sep: str) -> tuple[str, str]:
    """Patterns of lines that leave a reader inside quotes: one from outside, one from inside.

    A quote opens a cell at its first character only. Inside, two are one
    character; after one alone the rest up to the separator belongs to the cell.
    """
    inside = '[^"]*+(?:""[^"]*+)*+'
    cells = f'(?:[^{sep}"][^{sep}]*+{sep}|"{inside}"[^{sep}]*+{sep}|{sep})*+'
    opens = f'{cells}"{inside}\\z'
    return f"\\A{opens}", f'\\A{inside}(?:\\z|"[^{sep}]*+{sep}{opens})'


def opens_quotes(line: Column, sep: str) -> Column:
    """Whether a record that begins with this line goes on after it."""
    return F.when(line.contains('"'), line.rlike(open_patterns(sep)[0])).otherwise(F.lit(False))


def _effect(line: Column, sep: str) -> Column:
    outside, inside = open_patterns(sep)
    quotes = line.rlike(outside).cast("int") + 2 * line.rlike(inside).cast("int")
    return F.when(line.contains('"'), quotes).otherwise(F.lit(_SAME)).cast("byte")


def _lines(spark: SparkSession, paths: Sequence[str], sep: str, join: bool) -> DataFrame:
    """Lines with their effect, in order inside a split; ``split`` tells splits apart."""
    file, start = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    lines = spark.read.option("lineSep", "\n").text(list(paths))
    effect = _effect(F.col("value"), sep) if join else F.lit(_CLOSES).cast("byte")
    return lines.select(
        F.xxhash64(file, start).alias("split"), file.alias("_path"), start.alias("_start"), effect.alias("effect"), F.col("value").cast("binary").alias("value")
    )


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch cut where another split begins."""
    split = batch.column("split").to_numpy(zero_copy_only=False)
    heads = np.flatnonzero(np.r_[True, split[1:] != split[:-1]]) if len(split) else np.zeros(0, int)
    for a, b in zip(heads, np.r_[heads[1:], len(split)], strict=True):
        yield batch.slice(a, b - a)


def after(effects: np.ndarray, state: int) -> int:
    """Where lines leave a reader: 1 inside quotes, 0 outside."""
    turns = effects[effects != _SAME]
    fixed = np.flatnonzero(turns != _OPENS)
    if len(fixed):
        state, turns = int(turns[fixed[-1]] == 3), turns[fixed[-1] + 1 :]
    return (state + len(turns)) % 2


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each split does to a reader from outside and to one from inside."""
    now, states = None, (0, 1)

    def row() -> pa.RecordBatch:
        values = [[now[1]], [now[2]], [states[0]], [states[1]]]
        return pa.RecordBatch.from_arrays(
            [pa.array(v, t) for v, t in zip(values, (pa.string(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["_path", "_start", "out", "into"]
        )

    for batch in batches:
        for piece in _pieces(batch):
            split = piece.column("split")[0].as_py()
            if now is None or split != now[0]:
                if now is not None:
                    yield row()
                now, states = (split, piece.column("_path")[0].as_py(), piece.column("_start")[0].as_py()), (0, 1)
            effects = piece.column("effect").to_numpy(zero_copy_only=False)
            states = (after(effects, states[0]), after(effects, states[1]))
    if now is not None:
        yield row()


def _begun(splits: DataFrame) -> DataFrame:
    """Add ``state``: where a reader stands when the split begins."""
    file = Window.partitionBy("_path").orderBy("_start")
    before = file.rowsBetween(Window.unboundedPreceding, -1)
    turn = F.when((F.col("out") == 1) & (F.col("into") == 0), 1).otherwise(0)
    counted = splits.withColumn("_turns", F.sum(turn).over(file.rowsBetween(Window.unboundedPreceding, 0)))
    fixed = F.max(F.when(F.col("out") == F.col("into"), F.struct("_start", "_turns", "out"))).over(before)
    turns = F.coalesce(F.max("_turns").over(before), F.lit(0)) - F.coalesce(F.col("_fixed._turns"), F.lit(0))
    state = (F.coalesce(F.col("_fixed.out"), F.lit(0)) + turns) % 2
    return counted.withColumn("_fixed", fixed).select("_path", "_start", "out", "into", state.cast("int").alias("state"))


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of splits that begin inside a record: its lines there, and whether it ends."""
    now, lines, closed = None, [], False

    def row() -> pa.RecordBatch:
        values = [[now[1]], [now[2]], [b"\n".join(lines)], [closed]]
        return pa.RecordBatch.from_arrays(
            [pa.array(v, t) for v, t in zip(values, (pa.string(), pa.int64(), pa.binary(), pa.bool_()), strict=True)], names=["_path", "_start", "head", "closed"]
        )

    for batch in batches:
        for piece in _pieces(batch):
            split = piece.column("split")[0].as_py()
            if now is None or split != now[0]:
                if now is not None:
                    yield row()
                now, lines, closed = (split, piece.column("_path")[0].as_py(), piece.column("_start")[0].as_py()), [], False
            if not closed:
                ends = np.flatnonzero(piece.column("effect").to_numpy(zero_copy_only=False) < _SAME)
                closed = len(ends) > 0
                lines += piece.column("value").slice(0, int(ends[0]) + 1 if closed else None).to_pylist()
    if now is not None:
        yield row()


def _rests(splits: DataFrame, heads: DataFrame) -> DataFrame:
    """``(_path, _start, rest)``: what a split's last record has in the splits after it."""
    own = splits.join(heads, ["_path", "_start"], "left")
    whole = (F.col("state") == 1) & ~F.coalesce("closed", F.lit(True))
    before = Window.partitionBy("_path").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    opener = F.max(F.when(~whole, F.col("_start"))).over(before)
    parts = own.withColumn("_opener", opener).filter("state = 1").groupBy("_path", "_opener")
    texts = F.array_sort(F.collect_list(F.struct("_start", F.col("head").cast("string").alias("head"))))
    joined = parts.agg(F.array_join(F.transform(texts, lambda t: t["head"]), "\n").alias("rest"))
    return joined.select("_path", F.col("_opener").alias("_start"), "rest")


def _assemble(drop_header: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, open_, inside, header = None, [], False, False
        out: list[tuple[bytes, str, int, bool]] = []

        def add(record: bytes, goes_on: bool = False) -> None:
            nonlocal header
            if not goes_on and record.endswith(b"\r"):
                record = record[:-1].replace(b"\r\n", b"\n")
            if not record.strip(_BLANK):
                return
            if header:
                header = False
            else:
                out.append((record, now[1], now[2], goes_on))

        def flush() -> pa.RecordBatch:
            rows, out[:] = list(out), []
            columns = zip(*rows, strict=True) if rows else ((), (), (), ())
            types = (pa.binary(), pa.string(), pa.int64(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["value", "_path", "_start", "open"])

        def finish() -> None:
            if open_:
                add(b"\n".join(open_), goes_on=True)

        for batch in batches:
            for piece in _pieces(batch):
                split = piece.column("split")[0].as_py()
                if now is None or split != now[0]:
                    if now is not None:
                        finish()
                    now = (split, piece.column("_path")[0].as_py(), piece.column("_start")[0].as_py())
                    state = piece.column("state")[0].as_py()
                    if state is None:
                        raise ValueError(f"{now[1]}: the file or the size of splits changed while it was read")
                    # Until the record ends that began in an earlier split, lines are not this one's.
                    inside, open_ = state == 1, []
                    header = drop_header and now[2] == 0
                effects = piece.column("effect").to_numpy(zero_copy_only=False)
                for line, effect in zip(piece.column("value").to_pylist(), effects.tolist(), strict=True):
                    if inside:
                        inside = effect >= _SAME
                    elif open_:
                        open_.append(line)
                        if effect < _SAME:
                            add(b"\n".join(open_))
                            open_ = []
                    elif effect % 2:
                        open_ = [line]
                    else:
                        add(line)
            yield flush()
        if now is not None:
            finish()
        yield flush()

    return run


def quoted_records(
    spark: SparkSession, paths: Sequence[str], sep: str, *, drop_header: bool, join: bool = True
) -> DataFrame | None:
    """``(value, _path, _start)``: the records of the files, in order inside a split; blank ones left out.

    A record belongs to the split in which it begins. ``drop_header`` leaves
    out the first of each file. ``join=False`` takes each line as a record.
    Line breaks inside a record are those it ends with. A quote that is never
    closed takes the rest of its file. None if the splits
    are too many to be sent to every task.
    """
    lines = _lines(spark, paths, sep, join)
    splits = materialise(_begun(map_arrow(lines.drop("value"), _fold, "_path string, _start long, out int, into int")), "splits")
    if not fits_broadcast(splits):
        return None
    inner = F.broadcast(splits.filter("state = 1").select("_path", "_start"))
    begun = lines.join(inner, ["_path", "_start"], "left_semi")
    heads = map_arrow(begun, _heads, "_path string, _start long, head binary, closed boolean")
    rests = materialise(_rests(splits, heads), "rests")
    if not fits_broadcast(rests):
        return None
    known = lines.join(F.broadcast(splits.select("_path", "_start", "state")), ["_path", "_start"], "left")
    records = map_arrow(known, _assemble(drop_header), "value binary, _path string, _start long, open boolean")
    whole = records.join(F.broadcast(rests.withColumn("open", F.lit(True))), ["_path", "_start", "open"], "left")
    text = F.col("value").cast("string")
    joined = F.concat_ws("\n", text, "rest")
    plain = F.when(joined.endswith("\r"), F.replace(F.rtrim(joined, F.lit("\r")), F.lit("\r\n"), F.lit("\n"))).otherwise(joined)
    ended = F.when(F.col("open"), plain).otherwise(text)
    return whole.select(ended.alias("value"), "_path", "_start")
