"""Near-duplicates by 64-bit SimHash and anchor points of a covering code.

Anchors are the words of the perfect Hamming code on bits 0 to 62 (covering
radius 1, found by a 6-bit syndrome), with bit 63 taken as it is. If two
fingerprints differ in two bits at most, some word lies within one bit of both
(the middle of the way); the anchor next to that word is within the covering
radius plus one of both. So every fingerprint is copied to the anchors within
radius 1 + 1 = 2, at most 33 of them, and compared with what it meets there.
Half the threshold is enough for that, and it bounds an anchor to 4,034
fingerprints whatever the data. Equal fingerprints are merged before.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wallflow.llm.common import slices
from wallflow.session import map_arrow, materialise

THRESHOLD = 2
SHINGLE_WORDS = 3
SEED = 42

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None) -> int:
    """SimHash of the word shingles of a text; 0 without words."""
    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *[e + 1 for e in ends[:-1]]]
    last = min(SHINGLE_WORDS, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[last:], strict=False)], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: str | None = None) -> DataFrame:
    """``(doc_id, fp)`` of every row, the fingerprint as a signed long, and the long column ``carry`` if named."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            more = [batch.column(2)] if carry else []
            names = ["doc_id", "fp", carry] if carry else ["doc_id", "fp"]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64)), *more], names=names)

    more = [F.col(carry).cast("long").alias(carry)] if carry else []
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *more)
    return map_arrow(rows, run, f"doc_id long, fp long, `{carry}` long" if carry else "doc_id long, fp long")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _syndrome(fp: Column) -> Column:
    """Exclusive or of the places (1 to 63) of the bits set; 0 for a code word."""
    out = F.lit(0)
    for p in range(6):
        mask = sum(1 << (place - 1) for place in range(1, 64) if place >> p & 1)
        parity = F.bit_count(fp.bitwiseAND(F.lit(_signed(mask)).cast("long"))) % 2
        out = out + parity * (1 << p)
    return out.cast("int")


def anchors(fp: Column) -> Column:
    """The anchors within radius 2: the nearest, it with bit 63 flipped, and those two flips away."""
    s = _syndrome(fp)
    bit = lambda place: F.call_function("shiftleft", F.lit(1).cast("long"), place - 1)
    home = F.when(s == 0, fp).otherwise(fp.bitwiseXOR(bit(s)))
    flipped = home.bitwiseXOR(F.lit(_signed(1 << 63)).cast("long"))
    places = F.filter(F.sequence(F.lit(1), F.lit(63)), lambda i: i < i.bitwiseXOR(s))
    pairs = F.filter(places, lambda i: (s != 0) & (i != s) & (i.bitwiseXOR(s) != 0))
    two = F.transform(pairs, lambda i: fp.bitwiseXOR(bit(i)).bitwiseXOR(bit(i.bitwiseXOR(s))))
    return F.concat(F.array(home, flipped), two)


def _forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links (smallest, other) that join what is connected among distinct fingerprints of one anchor."""
    left, out = np.sort(fps), []
    while len(left) > 1:
        front, rest = left[:1], left[1:]
        root = front[0]
        while len(front) and len(rest):
            near = np.zeros(len(rest), dtype=bool)
            for f in front:
                near |= np.bitwise_count((rest ^ f).view(np.uint64)) <= THRESHOLD
            front, rest = rest[near], rest[~near]
            out += [(int(root), int(f)) for f in front]
        left = rest
    return out


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links from rows sorted by anchor; the rows of an anchor may go over several batches."""
    held_a, held_f = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def linked(anchor: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]]) if len(anchor) else np.zeros(0, int)
        sizes = np.diff(np.r_[starts, len(anchor)])
        out = []
        for at, n in zip(starts[sizes > 1], sizes[sizes > 1], strict=True):
            out += _forest(np.unique(fp[at : at + n]))
        pairs = np.array(sorted(set(out)), dtype=np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    for batch in batches:
        a = np.concatenate([held_a, batch.column(0).to_numpy(zero_copy_only=False)])
        f = np.concatenate([held_f, batch.column(1).to_numpy(zero_copy_only=False)])
        if not len(a):
            continue
        cut = int(np.searchsorted(a, a[-1], side="left"))
        held_a, held_f = a[cut:], f[cut:]
        yield linked(a[:cut], f[:cut])
    yield linked(held_a, held_f)


def links(distinct: DataFrame) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints, enough to connect all within the threshold."""
    spread = distinct.select(F.explode(anchors(F.col("fp"))).alias("anchor"), "fp")
    met = spread.repartition("anchor").sortWithinPartitions("anchor", "fp")
    return map_arrow(met, _links, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(fp, root)`` of every linked fingerprint: the least one of its component.

    Alternating stars: every node's larger neighbours are hung under its least
    neighbour, then its smaller ones, until nothing changes. Each round is
    written out, so neither lineage nor driver grows with the links.
    """
    pairs = materialise(edges, "links")
    before = None
    while True:
        both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter("b > a AND b != m").select(F.col("m").alias("a"), "b").distinct()
        down = large.select(F.col("b").alias("x"), F.col("a").alias("y"))
        low = down.groupBy("x").agg(F.min("y").alias("m"))
        small = (
            down.join(low, "x")
            .select("m", F.explode(F.array("x", "y")).alias("b"))
            .filter("m != b")
            .select(F.least("m", "b").alias("a"), F.greatest("m", "b").alias("b"))
            .distinct()
        )
        pairs = materialise(small, "links")
        mark = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        now = pairs.agg(F.count(F.lit(1)).alias("n"), mark.alias("h")).first()
        if now == before:
            return pairs.groupBy("b").agg(F.min("a").alias("root")).withColumnRenamed("b", "fp")
        before = now


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: str | None = None
) -> DataFrame:
    """One row per row of ``df``: the identifier, ``fp``, ``root`` and ``component_id``, the least identifier reachable.

    ``root`` is the least fingerprint of the component, ``carry`` names a long
    column to hand on. Null texts and texts without words have fingerprint 0
    and are linked like any other. Equal rows and equal texts share a component. Null identifiers
    are never the least one unless a component has no other. Other columns are
    ignored, so clashing names cannot matter; an empty table gives no rows.
    """
    docs = materialise(fingerprints(df, id_col, text_col, carry), "fingerprints")
    distinct = materialise(docs.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    tree = components(links(distinct))
    rooted = distinct.join(tree, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "root", "component_id")
    # A hot fingerprint is one row on the right; the left is split by adaptive execution.
    return docs.join(named, "fp").select(
        F.col("doc_id").alias(id_col), "fp", "root", "component_id", *([carry] if carry else [])
    )
