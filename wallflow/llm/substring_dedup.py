"""Removal of word windows that documents with smaller identifiers hold already.

Lengths are doubled level by level up to the wanted window (13 words: 6, 13).
Windows repeated at one length alone are extended to the next; it ends when
none is left or the wanted length is reached. At the first level a window of
the wanted length is stood for by its least run of six words, by hash order:
equal windows choose equal runs, so none is lost, and two runs in nine words
are shuffled instead of nine. At higher levels it is stood for by the part of
the level's length around that run. The last level compares whole windows by
96 bits of hash.

A task looks at its texts in chunks. What a chunk settles by itself, since a
smaller document of the chunk has the window, is not asked again. So a window
meets its like from other chunks once a chunk, however many documents hold it.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wallflow.llm.common import slices
from wallflow.session import discard, map_arrow, materialise

WINDOW = 13
# The first level has this many words at least, and fewer than twice as many.
FIRST_WORDS = 6
# Words that a task compares among themselves; a longer text is a chunk of its own.
CHUNK_WORDS = 1 << 20
# Rows without identifier come after all others.
LAST = (1 << 63) - 1

_VOCABULARY = 1 << 20
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_OPEN, _WITNESS, _SETTLED = 0, 1, 2


def levels(window: int, first: int = FIRST_WORDS) -> list[int]:
    """Lengths from the first to ``window``, each twice the one before or one more than that."""
    out = [window]
    while out[0] >= 2 * first:
        out.insert(0, out[0] // 2)
    return out


class _Words(dict):
    """Hash of a word, kept for as many words as fit."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _VOCABULARY:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def _hashes(words: np.ndarray, at: np.ndarray, length: int, base: np.uint64) -> np.ndarray:
    h = np.zeros(len(at), dtype=np.uint64)
    for j in range(length):
        h = h * base + words[at + j]
    return _mixed(h)


class _Chunk:
    """Texts whose word hashes stand one after another."""

    def __init__(self):
        self.words: list[np.ndarray] = []
        self.docs: list[int] = []
        self.tags: list[int] = []
        self.spans: list[tuple[np.ndarray, np.ndarray]] = []
        self.n = 0

    def add(self, doc: int, tag: int, words: np.ndarray, spans: tuple[np.ndarray, np.ndarray] | None) -> None:
        self.words.append(words)
        self.docs.append(doc)
        self.tags.append(tag)
        if spans is not None:
            starts, counts = spans
            own = (starts >> 32) == tag
            self.spans.append(((starts[own] & 0xFFFFFFFF) + self.n, counts[own]))
        self.n += len(words)

    def windows(self, window: int, length: int, before: int | None, first: int) -> np.ndarray:
        """Places of the parts of ``length`` that stand for windows alive so far, each once."""
        words, sizes = np.concatenate(self.words), np.array([len(w) for w in self.words])
        self.all, ends = words, np.cumsum(sizes)
        self.starts = ends - sizes
        n = len(words) - window + 1
        if n <= 0:
            return np.zeros(0, dtype=np.int64)
        grams = _hashes(words, np.arange(len(words) - first + 1), first, _BASES[0])
        least, where = grams[:n].copy(), np.zeros(n, dtype=np.int64)
        for j in range(1, window - first + 1):
            less = grams[j : j + n] < least
            least[less] = grams[j : j + n][less]
            where[less] = j
        left = np.repeat(ends, sizes)[:n] - np.arange(n)
        start = np.flatnonzero(left >= window)
        anchor = start + where[start]
        part = lambda size: np.clip(anchor - (size - first) // 2, start, start + window - size)
        if before is not None:
            change = np.zeros(len(words) + 1, dtype=np.int64)
            for places, counts in self.spans:
                np.add.at(change, places, 1)
                np.add.at(change, places + counts, -1)
            alive = (np.cumsum(change) > 0)[part(before)]
            return np.unique(part(length)[alive])
        return np.unique(part(length))

    def rows(self, window: int, length: int, before: int | None, first: int) -> pa.RecordBatch:
        """Windows of one level: open ones, witnesses of repeated ones, and runs of settled ones."""
        at, last = self.windows(window, length, before, first), length == window
        h1 = _hashes(self.all, at, length, _BASES[0])
        # Up to the last level a hash that is equal by chance costs a look, no more.
        h2 = (_hashes(_mixed(self.all), at, length, _BASES[1]) >> np.uint64(32) if last else np.zeros_like(h1)).astype(np.uint32)
        owner = np.searchsorted(self.starts, at, side="right") - 1
        doc, tag = np.array(self.docs, dtype=np.int64)[owner], np.array(self.tags, dtype=np.int64)[owner]
        place = (tag << 32) | (at - self.starts[owner])
        order = np.lexsort((doc, h2, h1))
        same = lambda i, j: (h1[i] == h1[j]) & (h2[i] == h2[j])
        heads = np.flatnonzero(np.r_[True, ~same(order[1:], order[:-1])]) if len(order) else order
        sizes = np.diff(np.r_[heads, len(order)])
        least = doc[order[heads]]
        settled = np.zeros(len(order), dtype=bool)
        if last:
            settled[order] = doc[order] > np.repeat(least, sizes)
            witness = order[:0]
        else:
            many = least < doc[order[heads + sizes - 1]]
            settled[order] = np.repeat(many, sizes)
            witness = order[heads[many]]
        # Rows keep the order of the text. What follows on and is settled, or has the same hash, is one row.
        i, j = np.arange(1, len(order)), np.arange(max(0, len(order) - 1))
        follows = (doc[i] == doc[j]) & (place[i] == place[j] + 1) & (settled[i] == settled[j]) & (settled[i] | same(i, j))
        run = np.flatnonzero(np.r_[True, ~follows]) if len(order) else order
        counts = np.diff(np.r_[run, len(order)])
        pick = np.concatenate([run, witness])
        state = np.r_[np.where(settled[run], _SETTLED, _OPEN), np.full(len(witness), _WITNESS)]
        # What is settled goes through the same shuffle; it is spread by document and place.
        k1 = np.where(state == _SETTLED, _mixed((place[pick] + doc[pick]).view(np.uint64)), h1[pick])
        n = np.r_[counts, np.ones(len(witness), dtype=np.int64)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(k1.view(np.int64)),
                pa.array(np.where(state == _SETTLED, np.uint32(0), h2[pick]).astype(np.uint32).view(np.int32)),
                pa.array(doc[pick]),
                pa.array(place[pick]),
                pa.array(n.astype(np.int32)),
                pa.array(state.astype(np.int8)),
            ],
            names=["h1", "h2", "doc", "place", "n", "state"],
        )


_LEVEL = "h1 long, h2 int, doc long, place long, n int, state byte"


def _tag(words: list[bytes]) -> int:
    """Tells texts of one identifier apart."""
    return zlib.crc32(b" ".join(words)) >> 1


def _split(text: bytes | None) -> list[bytes]:
    return (text or b"").split()


def _spans(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """The (places, counts) of each row."""
    flat, ends = column.flatten(), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).cumsum()
    places = flat.field("place").to_numpy(zero_copy_only=False)
    counts = flat.field("n").to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.r_[0, ends[:-1]].astype(np.int64)
    return [(places[a:b], counts[a:b]) for a, b in zip(starts, ends.astype(np.int64), strict=True)]


def _level(window: int, length: int, before: int | None, first: int, chunk_words: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, chunk = _Words(), _Chunk()
        for batch in slices(batches):
            docs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            spans = [None] * len(docs) if before is None else _spans(batch.column(2))
            for doc, text, alive in zip(docs, texts, spans, strict=True):
                words = _split(text)
                if len(words) < window:
                    continue
                values = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
                chunk.add(doc, _tag(words), values, alive)
                if chunk.n >= chunk_words:
                    yield chunk.rows(window, length, before, first)
                    chunk = _Chunk()
        if chunk.n:
            yield chunk.rows(window, length, before, first)

    return run


def _repeated(found: DataFrame, last: bool) -> DataFrame:
    """Places that survive a level: in two documents, or at the last level in a smaller one."""
    same = Window.partitionBy("h1", "h2")
    least, most, state = F.min("doc").over(same), F.max("doc").over(same), F.max("state").over(same)
    settled = F.col("state") == _SETTLED
    known = found.withColumn("_least", least)
    if last:
        kept = known.filter(settled | (F.col("_least") < F.col("doc")))
    else:
        known = known.withColumn("_many", (least < most) | (state >= _WITNESS))
        kept = known.filter(F.col("_many") & (F.col("state") != _WITNESS))
    return kept.groupBy("doc").agg(F.collect_set(F.struct("place", "n")).alias("spans"))


def _cut(window: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            total, gone, kept = [], [], []
            for text, (places, counts) in zip(batch.column(1).to_pylist(), _spans(batch.column(2)), strict=True):
                words = _split(text)
                n = 0
                if len(places):
                    own = (places >> 32) == _tag(words)
                    change = np.zeros(len(words) + 1, dtype=np.int64)
                    np.add.at(change, places[own] & 0xFFFFFFFF, 1)
                    np.add.at(change, (places[own] & 0xFFFFFFFF) + counts[own] + window - 1, -1)
                    stays = np.cumsum(change)[:-1] == 0
                    n = int(len(words) - stays.sum())
                    if n:
                        words_left = [words[i] for i in np.flatnonzero(stays)]
                total.append(len(words))
                gone.append(n)
                kept.append(b" ".join(words_left if n else words))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary())],
                names=["id", "n_words", "n_removed", "kept"],
            )

    return run


def remove_repeats(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    chunk_words: int = CHUNK_WORDS,
) -> DataFrame:
    """One row per row of ``df``: the identifier (a long), ``n_words``, ``n_removed`` and ``kept``, the words that stay.

    Removed is each word covered by a window of so many words whose sequence
    also starts in a document with a smaller identifier. Words are what stands
    between ASCII white space, unchanged; windows are judged on the input. A
    null or empty text has no words; a text shorter than a window keeps all.
    Rows with equal identifiers are not smaller than each other, so repeated
    rows lose the same words; rows without identifier come after all others and
    are equal among themselves. Other columns are ignored, so clashing names
    cannot matter; an empty table gives no rows. A text must fit in a task.
    """
    rows = df.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"),
        F.col(text_col).cast("binary").alias("body"),
    )
    lengths = levels(window)
    alive, before = None, None
    for length in lengths:
        texts = rows.select("doc", "body")
        texts = texts if alive is None else texts.join(alive, "doc").select("doc", "body", "spans")
        found = map_arrow(texts, _level(window, length, before, lengths[0], chunk_words), _LEVEL)
        now = materialise(_repeated(found, length == window), "windows")
        if alive is not None:
            discard(alive)
        alive, before = now, length
        if alive.isEmpty():
            break
    full = rows.join(alive, "doc", "left").select("id", "body", "spans")
    out = map_arrow(full, _cut(window), "id long, n_words long, n_removed long, kept binary")
    return out.select(F.col("id").alias(id_col), "n_words", "n_removed", F.col("kept").cast("string").alias("kept"))
