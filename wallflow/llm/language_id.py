"""Language identification by cross-parsing entropy.

Each language gets a suffix automaton of a bounded sample of its labelled text.
A text is parsed greedily into the longest phrases found in that sample; the
language that needs the fewest bits (phrases times the logarithm of the sample
length, per character) wins. Texts are cut into blocks of fixed length which
are parsed side by side, one character of every block at a time; a phrase ends
with its block, for every language alike.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wallflow.llm.common import slices
from wallflow.session import map_arrow

# The bounds of the labelled sample, per language.
SAMPLE_DOCUMENTS = 300
SAMPLE_CHARS_PER_DOCUMENT = 1_000
SAMPLE_CHARS = 40_000
MAX_LANGUAGES = 200
OVERSAMPLE = 3

BLOCK = 1_024
BATCH_CODES = 1 << 20
# Codes of characters: not a letter (a run of those is one space), letters that no sample has, then known letters.
SPACE, UNKNOWN, FIRST = 1, 2, 3
# The most frequent letters have a column each in the table of transitions; those of the others are looked up in a sorted list.
COLUMNS = 120

UNDETERMINED = "und"
SCHEMA = "lang_pred string, score double, phrase_chars double"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4")


def _squeezed(codes: np.ndarray) -> np.ndarray:
    """Each run of SPACE shortened to one, none at the ends."""
    space = codes == SPACE
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    codes = codes[keep]
    codes = codes[1:] if len(codes) and codes[0] == SPACE else codes
    return codes[:-1] if len(codes) and codes[-1] == SPACE else codes


class SuffixAutomaton:
    """Transitions of the automaton of one code sequence; state 1 is the start, 0 means none."""

    def __init__(self, codes: list[int], width: int):
        edges, link, length = [{}, {}], [0, 0], [0, 0]
        last = 1
        for c in codes:
            current = len(edges)
            edges.append({})
            length.append(length[last] + 1)
            link.append(1)
            p = last
            while p and c not in edges[p]:
                edges[p][c] = current
                p = link[p]
            if p:
                q = edges[p][c]
                if length[p] + 1 == length[q]:
                    link[current] = q
                else:
                    copy = len(edges)
                    edges.append(dict(edges[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p and edges[p].get(c) == q:
                        edges[p][c] = copy
                        p = link[p]
                    link[q] = link[current] = copy
            last = current
        self.table = np.zeros((len(edges), width), dtype=np.int32)
        # Transitions by codes beyond the table: state, code, next state.
        self.rare: list[tuple[int, int, int]] = []
        for state, row in enumerate(edges):
            for c, to in row.items():
                if c < width:
                    self.table[state, c] = to
                else:
                    self.rare.append((state, c, to))


class CrossParser:
    """Automata of several languages in one table, and the parse of many texts by all of them."""

    def __init__(self, samples: dict[str, list[str]], sample_chars: int = SAMPLE_CHARS):
        self.languages = sorted(samples)
        points = [np.concatenate([_points(t + "\n") for t in samples[x]] or [_points("")]) for x in self.languages]
        letters = _letters()
        seen, n = np.unique(np.concatenate([*points, _points("")]), return_counts=True)
        seen, n = seen[letters[seen]], n[letters[seen]]
        order = seen[np.argsort(-n, kind="stable")]
        self.known = np.concatenate([np.sort(order[:COLUMNS]), order[COLUMNS:]])
        self.width = FIRST + min(COLUMNS, len(order))
        tables, self.roots, self.bits, base = [np.zeros((1, self.width), np.int32)], [], [], 1
        rare = [np.zeros((0, 3), np.int64)]
        for p in points:
            codes = _squeezed(self.codes(p))[:sample_chars]
            automaton = SuffixAutomaton(codes.tolist(), self.width)
            table = automaton.table
            rare.append(np.array(automaton.rare, np.int64).reshape(-1, 3) + [base - 1, 0, base - 1])
            tables.append(np.where(table[1:] > 0, table[1:] + (base - 1), 0).astype(np.int32))
            self.roots.append(base)
            self.bits.append(math.log2(max(len(codes), 2)))
            base += len(table) - 1
        self.next = np.concatenate(tables).ravel()
        found = np.concatenate(rare)
        keys = found[:, 0] * self._codes_in_all + found[:, 1]
        self.rare_keys, self.rare_next = np.sort(keys), found[np.argsort(keys), 2].astype(np.int32)
        self._codes = None

    def __getstate__(self):
        return self.__dict__ | {"_codes": None}

    @property
    def _codes_in_all(self) -> int:
        return FIRST + len(self.known)

    def _go(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Next state of each language for a code of each block; 0 if there is none."""
        if self._codes_in_all == self.width:
            return self.next[states * self.width + codes]
        rare = codes >= self.width
        out = self.next[states * self.width + np.where(rare, UNKNOWN, codes)]
        if rare.any() and len(self.rare_keys):
            keys = np.broadcast_to(states, out.shape)[:, rare].astype(np.int64) * self._codes_in_all + codes[rare]
            at = np.minimum(np.searchsorted(self.rare_keys, keys), len(self.rare_keys) - 1)
            out[:, rare] = np.where(self.rare_keys[at] == keys, self.rare_next[at], 0)
        return out

    def codes(self, points: np.ndarray) -> np.ndarray:
        if getattr(self, "_codes", None) is None:
            table = np.where(_letters(), UNKNOWN, SPACE).astype(np.int32)
            table[self.known] = np.arange(FIRST, FIRST + len(self.known), dtype=np.int32)
            self._codes = table
        return self._codes[points]

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each code sequence in each language, as an array (texts, languages)."""
        total = np.zeros((len(texts), len(self.languages)), dtype=np.int64)
        blocks, owners, held = [], [], 0
        for i, codes in enumerate(texts):
            for at in range(0, len(codes), BLOCK):
                blocks.append(codes[at : at + BLOCK])
                owners.append(i)
                held += BLOCK
                if held >= BATCH_CODES:
                    self._parse(blocks, owners, total)
                    blocks, owners, held = [], [], 0
        if blocks:
            self._parse(blocks, owners, total)
        return total

    def _parse(self, blocks: list[np.ndarray], owners: list[int], total: np.ndarray) -> None:
        order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
        lengths = np.array([len(blocks[i]) for i in order])
        grid = np.zeros((lengths[0], len(order)), dtype=np.int32)
        for at, i in enumerate(order):
            grid[: len(blocks[i]), at] = blocks[i]
        active = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right")
        roots = np.array(self.roots, dtype=np.int32)[:, None]
        # State 0 has no transitions, so whatever comes next begins a phrase.
        state = np.zeros((len(self.roots), len(order)), dtype=np.int32)
        count = np.zeros(state.shape, dtype=np.int32)
        for t in range(lengths[0]):
            n = active[t]
            c = grid[t, :n]
            s = self._go(state[:, :n], c)
            miss = s == 0
            count[:, :n] += miss
            state[:, :n] = np.where(miss, self._go(roots, c), s)
        np.add.at(total, np.array(owners)[order], count.T)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float | None]]:
        letters = _letters()
        codes, lettered = [], []
        for t in texts:
            p = _points(t or "")
            lettered.append(bool(letters[p].any()))
            codes.append(_squeezed(self.codes(p)) if lettered[-1] else p[:0].astype(np.int32))
        if not self.languages:
            return [(UNDETERMINED, 0.0, None)] * len(texts)
        counts = self.phrases(codes)
        cost = counts * np.array(self.bits)
        best = cost.argmin(axis=1)
        out = []
        for i, (k, known) in enumerate(zip(best, lettered, strict=True)):
            if not known:
                out.append((UNDETERMINED, 0.0, None))
                continue
            rest = np.delete(cost[i], k)
            score = 1.0 if not len(rest) else 1.0 - float(cost[i, k]) / float(rest.min())
            out.append((self.languages[k], score, len(codes[i]) / float(counts[i, k])))
        return out


def held_out(id_col: str = "doc_id") -> Column:
    """Documents that are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def fit(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    documents: int = SAMPLE_DOCUMENTS,
    chars: int = SAMPLE_CHARS_PER_DOCUMENT,
) -> CrossParser:
    """Learn from at most ``documents`` labelled texts per language, spread by a hash of the identifier.

    The sample is bounded by the parameters at every input size; languages
    beyond the 200 first by name would be an error of the labels and raise.
    """
    labelled = df.filter(F.col(lang_col).isNotNull() & ~held_out(id_col) & F.col(text_col).isNotNull())
    labelled = labelled.select(
        F.col(lang_col).alias("_lang"), F.col(id_col).alias("_id"), F.substring(text_col, 1, chars).alias("_text")
    )
    counts = labelled.groupBy("_lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if not counts:
        return CrossParser({})
    # A draw by hash leaves a few times as many rows as are wanted, whatever the size of the language.
    share = F.lit(0.0)
    for row in counts:
        share = F.when(F.col("_lang") == row["_lang"], F.lit(min(1.0, OVERSAMPLE * documents / row["n"]))).otherwise(share)
    drawn = labelled.filter(F.pmod(F.xxhash64(F.lit("draw"), "_id"), F.lit(1 << 30)) < share * (1 << 30))
    rank = F.row_number().over(Window.partitionBy("_lang").orderBy(F.xxhash64("_id"), "_id"))
    picked = (
        drawn.withColumn("_rank", rank)
        .filter(F.col("_rank") <= documents)
        .orderBy("_lang", "_rank")
        .limit(documents * (MAX_LANGUAGES + 1))
        .collect()
    )
    samples: dict[str, list[str]] = {}
    for row in picked:
        samples.setdefault(row["_lang"], []).append(row["_text"])
    if len(samples) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages are labelled")
    return CrossParser(samples)


def identify(df: DataFrame, parser: CrossParser, text_col: str = "text") -> DataFrame:
    """Add ``lang_pred``, ``score`` (0 to 1) and ``phrase_chars`` (mean phrase length) to every row.

    A null text, one without letters, or any text when nothing was learned is
    ``und`` with score 0. Ties go to the first language by name, with score 0.
    The whole text is read, in blocks. Columns named like an added one are
    replaced; repeated rows are predicted alike; an empty table stays empty.
    """
    added = {"lang_pred", "score", "phrase_chars"}
    kept = df.select(*[F.col(c) for c in df.columns if c not in added])
    shared = df.sparkSession.sparkContext.broadcast(parser)
    at = kept.columns.index(text_col)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = shared.value.predict(batch.column(at).to_pylist())
            columns = [
                pa.array([x[k] for x in found], kind)
                for k, kind in enumerate((pa.string(), pa.float64(), pa.float64()))
            ]
            names = [*batch.schema.names, "lang_pred", "score", "phrase_chars"]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=names)

    schema = StructType(list(kept.schema))
    for name, kind in (x.split() for x in SCHEMA.split(", ")):
        schema = schema.add(name, kind)
    return map_arrow(kept, predict, schema)
