"""Best-fit packing with swap-based local search.

Only the number of pieces of each length matters for a packing, so the search
runs on that histogram (at most one entry per length). Bins with the same
contents are one entry with a count. Best-fit decreasing gives a first packing.
Then bins below capacity exchange one piece for one, two for one, or hand over
a piece, whenever that increases the sum of squared fills: fuller bins get
fuller, and the others run empty and are dropped. Pieces are afterwards dealt
to the places of their length by their rank, which Spark counts in blocks.
"""

from __future__ import annotations

import base64
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wallflow.llm.common import slices, text_of
from wallflow.session import map_arrow, materialise

CAPACITY = 1_024
END_ID = 2

# Fixed value: the pre-tokens of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

Bins = Counter  # contents (tuple of lengths, longest first) -> number of bins


def best_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> Bins:
    """Best-fit decreasing on counts: equal bins are filled together."""
    bins: Bins = Counter()
    room: dict[int, Counter] = defaultdict(Counter)  # free space -> bins
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        for free in range(length, capacity):
            while left and room[free]:
                contents, n = next(iter(room[free].items()))
                per_bin = free // length
                full, rest = divmod(left, per_bin)
                use, each = (min(n, full), per_bin) if full else (1, rest)
                room[free][contents] -= use
                if not room[free][contents]:
                    del room[free][contents]
                room[free - each * length][contents + (length,) * each] += use
                left -= use * each
        per_bin = capacity // length
        full, rest = divmod(left, per_bin)
        if full:
            room[capacity - per_bin * length][(length,) * per_bin] += full
        if rest:
            room[capacity - rest * length][(length,) * rest] += 1
    for same in room.values():
        bins.update(same)
    return +bins


def _improved(a: tuple[int, ...], b: tuple[int, ...], capacity: int) -> tuple[tuple, tuple] | None:
    """The best move, one-for-one or two-for-one exchange that makes bin ``a`` (the fuller one) fuller.

    With a fixed total, squared fill grows exactly when the fuller bin gains.
    """
    room = capacity - sum(a)
    outs = [(), *{(x,) for x in a}]
    ins = [(x,) for x in set(b)] + list({(b[i], b[j]) for i in range(len(b)) for j in range(i)})
    best, gain = None, 0
    by_sum = {}
    for x in ins:
        by_sum.setdefault(sum(x), x)
    sums = sorted(by_sum)
    for out in outs:
        at = np.searchsorted(sums, room + sum(out), side="right") - 1
        if at >= 0 and sums[at] - sum(out) > gain:
            best, gain = (out, by_sum[sums[at]]), sums[at] - sum(out)
    # Two for one the other way: two pieces leave the fuller bin for a longer one.
    for two in {(a[i], a[j]) for i in range(len(a)) for j in range(i)}:
        for x in set(b):
            if gain < x - sum(two) <= room:
                best, gain = (two, (x,)), x - sum(two)
    if best is None:
        return None
    fuller, other = Counter(a), Counter(b)
    fuller.subtract(best[0])
    fuller.update(best[1])
    other.subtract(best[1])
    other.update(best[0])
    as_bin = lambda c: tuple(sorted(c.elements(), reverse=True))
    return as_bin(fuller), as_bin(other)


def local_search(bins: Bins, capacity: int = CAPACITY) -> Bins:
    """Improve underfull bins until no step between any two of them increases squared fill, or no bin can be spared.

    A bin is held against all others once, the emptiest first, and again only
    when it is made anew. Equal bins make the same step at once, so the number
    of documents does not matter.
    """
    bins = Counter(bins)
    fewest = -(-sum(sum(c) * n for c, n in bins.items()) // capacity)
    fullest = lambda c: (-sum(c), c)
    waiting = [(sum(c), c) for c in bins if sum(c) < capacity]
    heapify(waiting)
    while waiting and sum(bins.values()) > fewest:
        _, bin_ = heappop(waiting)
        # A bin may wait twice, or be gone.
        while bins[bin_]:
            for other in sorted((c for c in bins if bins[c] and sum(c) < capacity), key=fullest):
                a, b = sorted((bin_, other), key=fullest)
                if a == b and bins[a] < 2:
                    continue
                pair = _improved(a, b, capacity)
                if pair is not None:
                    break
            else:
                break
            n = bins[a] // 2 if a == b else min(bins[a], bins[b])
            for old in (a, b):
                bins[old] -= n
            for new in filter(None, pair):
                bins[new] += n
                if sum(new) < capacity:
                    heappush(waiting, (sum(new), new))
            bins = +bins
    return bins


class Plan:
    """Where the k-th piece of a length goes: blocks of consecutive ranks for each place in a kind of bin."""

    def __init__(self, bins: Bins):
        blocks: dict[int, list[tuple[int, int]]] = defaultdict(list)  # length -> (first bin, offset), with counts
        counts: dict[int, list[int]] = defaultdict(list)
        base = 0
        for contents, n in sorted(bins.items(), reverse=True):
            offset = 0
            for length in contents:
                blocks[length].append((base, offset))
                counts[length].append(n)
                offset += length
            base += n
        self.sequences = base
        self.blocks = {x: np.array(v, dtype=np.int64) for x, v in blocks.items()}
        self.ends = {x: np.cumsum(v) for x, v in counts.items()}

    def place(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        for length in np.unique(lengths):
            those = np.flatnonzero(lengths == length)
            rank, ends = ranks[those], self.ends[int(length)]
            at = np.searchsorted(ends, rank, side="right")
            start = np.where(at > 0, ends[at - 1], 0)
            sequence[those] = self.blocks[int(length)][at, 0] + rank - start
            offset[those] = self.blocks[int(length)][at, 1]
        return sequence, offset


class Tokens:
    """Ids of whole texts by a tokenizer file.

    Where the same vocabulary lies beside the file as ranks, texts go through
    those, which is several times as fast and gives the same ids. Texts with
    the string of a special token always go through the file itself.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        ranks = Path(path).with_suffix(".tiktoken")
        self.fast = None
        if ranks.exists():
            pairs = (line.split() for line in ranks.read_bytes().splitlines())
            table = {base64.b64decode(token): int(rank) for token, rank in pairs}
            self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a text."""
        if self.fast is None or any(x in text for x in self.special):
            found = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            found = self.fast.encode_ordinary(text)
        return np.array(found, dtype="<u4").tobytes()


@lru_cache(maxsize=2)
def _tokens(path: str) -> Tokens:
    return Tokens(path)


def pieces(df: DataFrame, tokenizer: str, id_col: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)`` of every row's text and its end mark.

    ``tokenizer`` is the path of a tokenizer file that every worker can read.
    Only texts longer than a sequence are cut; their first piece has the remainder.
    """
    end = np.array([END_ID], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            owner, piece, start, length, crc = [], [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                ids = _tokens(tokenizer).ids(text) + end
                n, at, k = len(ids) // 4, 0, 0
                size = n % capacity or min(n, capacity)
                while at < n:
                    owner.append(row)
                    piece.append(k)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(ids[4 * at : 4 * (at + size)]))
                    at, k, size = at + size, k + 1, capacity
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = [pa.array(x, kind) for x, kind in zip((piece, start, length, crc), kinds, strict=True)]
            owners = batch.column(0).take(pa.array(owner, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [owners, *columns], names=["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), text_of().alias("text"))
    return map_arrow(rows, run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(df: DataFrame, tokenizer: str, id_col: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of a text: its place ``start`` in the text, and ``sequence_id`` and ``offset``.

    A null text is empty and packs its end mark alone. Equal rows are packed
    one by one; a null identifier is an ordinary value; other columns are
    ignored; an empty table gives no rows. Full pieces are sequences of their own.
    """
    cut = materialise(
        pieces(df, tokenizer, id_col, capacity).withColumn("_block", F.spark_partition_id()), "pieces"
    )
    sizes = materialise(cut.groupBy("length", "_block").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    # At most one row per possible length.
    histogram = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = Plan(local_search(best_fit(histogram, capacity), capacity))
    shared = df.sparkSession.sparkContext.broadcast(plan)
    before = Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "_block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    # A block is what one task has tokenized, so no length is ever ranked in one task.
    inside = Window.partitionBy("length", "_block").orderBy("doc_id", "piece", "ids_crc32")
    # There are offsets for each length and task; they are not small, and the rows are in their order already.
    ranked = cut.withColumn("_rank", F.row_number().over(inside)).join(offsets.hint("merge"), ["length", "_block"])
    ranked = ranked.withColumn("_rank", (F.col("_rank") + F.col("_before") - 1).cast("long"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("length", "_rank"))
            sequence, offset = shared.value.place(length, rank)
            kept = [batch.column(x) for x in columns]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sequence), pa.array(offset)], names=[*columns, "sequence_id", "offset"]
            )

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return map_arrow(ranked.select(*columns, "_rank"), run, schema).withColumnRenamed("doc_id", id_col)


def sequences(df: DataFrame, placed: DataFrame, tokenizer: str, id_col: str = "doc_id") -> DataFrame:
    """The packed sequences ``(sequence_id, ids)`` of a table with unique identifiers, made from its texts again."""
    end = np.array([END_ID], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [_tokens(tokenizer).ids(x) + end for x in batch.column(1).to_pylist()]
            ids = pa.array([np.frombuffer(x, dtype="<u4").astype(np.int32) for x in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), text_of().alias("text"))
    whole = map_arrow(rows, run, "doc_id long, ids array<int>").withColumnRenamed("doc_id", id_col)
    part = F.slice("ids", F.col("start").cast("int") + 1, F.col("length").cast("int"))
    runs = placed.join(whole, id_col).select("sequence_id", F.struct("offset", part.alias("ids")).alias("_run"))
    ordered = F.sort_array(F.collect_list("_run"))
    return runs.groupBy("sequence_id").agg(F.flatten(F.transform(ordered, lambda r: r["ids"])).alias("ids"))
