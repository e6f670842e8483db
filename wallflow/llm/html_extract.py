"""Main text of web pages, with boilerplate found by a suffix order over each host.

Pages are cut into blocks of visible text. The suffixes of all token streams of
a host are sorted by the hash of the host and their first ``MIN_RUN`` tokens,
spread over tasks by ranges of that order; a suffix that runs over the end of
its page is none. Equal prefixes on distinct pages make covered runs; what they
cover is boilerplate, the unique runs stay. Markup has the last word in both
directions: blocks of an article stay though another page repeats them, and
marked menus, footers, adverts or comments go though nothing repeats them.

Most prefixes stand on one page. Tasks sort chunks of pages and first exchange
the leading bits of their prefixes, packed, a prefix once a chunk; only those
met by two chunks or two pages go on whole, with the least and greatest page.
So neither a host nor a frequent passage ever meets in one task, and what is
found does not depend on the number of a host's pages. Pages are parsed in
three passes, which costs less than to move them. Prefixes agree by 64 bits.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wallflow.llm.common import slices, small_enough
from wallflow.session import discard, map_arrow, materialise

MIN_RUN = 6
# Tokens that a task sorts at once, prefixes in a range, and characters of html a token takes about.
CHUNK = 1 << 20
RANGE = 1 << 20
TOKEN_CHARS = 8
# Prefixes that are sent to every task; more are joined by shuffle.
BROADCAST_PREFIXES = 2_000_000
# Bytes whose powers a task remembers.
KNOWN_POWERS = 1 << 20

CHROME, NEUTRAL, MAIN = 0, 1, 2

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+(?:>|\Z))"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[a-z0-9]+")

# Elements whose content is not text, up to their end tag.
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span"
    " strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figure footer form h1 h2 h3 h4 h5 h6"
    " header hr main menu nav ol p pre section table ul".split()
)
CHROME_ELEMENTS = frozenset(
    "nav header footer aside form head template svg canvas object audio video select button dialog menu".split()
)
CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr"
    " notice notices popup modal overlay newsletter subscribe signup sidebar aside menu nav navbar navigation breadcrumb"
    " breadcrumbs footer masthead comment comments disqus respond share sharing social related recommended widget"
    " pagination pager toolbar login search contentinfo complementary dialog alert".split()
)
MAIN_ELEMENTS = frozenset(("article", "main"))


def _role(name: str, attributes: str, parent: int) -> int:
    """Role of an element inside one of role ``parent``."""
    if parent == CHROME:
        return CHROME
    if name in CHROME_ELEMENTS and not (name == "header" and parent == MAIN):
        return CHROME
    own = MAIN if name in MAIN_ELEMENTS else parent
    if len(attributes) > 3 and name not in ("html", "body", "main"):
        found = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in _ATTRIBUTE.finditer(attributes)}
        if "hidden" in found or re.search(r"display\s*:\s*none", found.get("style", "")):
            return CHROME
        marked = " ".join(found.get(x, "") for x in ("class", "id", "role"))
        words = set(_WORD.findall(marked))
        if name == "article":
            words &= {"comment", "comments"}
        if words & CHROME_WORDS or ("header" in words and own != MAIN):
            return CHROME
        if found.get("role") == "main" or found.get("itemprop") == "articlebody":
            return MAIN
    return own


def blocks(page: str | None) -> list[tuple[int, str]]:
    """Role and text of the visible blocks of a page, in order."""
    page = page or ""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []
    parts: list[str] = []
    role, at, end = NEUTRAL, 0, len(page)

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((role, text))
            parts.clear()

    def text(piece: str) -> None:
        if piece:
            parts.append(html.unescape(piece) if "&" in piece else piece)

    while at < end:
        tag = _TAG.search(page, at)
        if tag is None:
            text(page[at:])
            break
        text(page[at : tag.start()])
        at = tag.end()
        if tag[2] is None:
            continue
        name = tag[2].lower()
        if tag[1]:
            if any(x == name for x, _ in stack):
                if name not in INLINE:
                    flush()
                while stack:
                    gone, was = stack.pop()
                    outer = stack[-1][1] if stack else NEUTRAL
                    if outer != was:
                        flush()
                    role = outer
                    if gone == name:
                        break
            elif name not in INLINE:
                flush()
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
            if name not in INLINE:
                flush()
            at = end if close is None else close.start()
            if close is not None:
                at = (page.find(">", at) + 1) or end
            continue
        if name not in INLINE:
            flush()
        if name in VOID or tag[3].endswith("/>"):
            continue
        if name in CLOSES_P or name == "li":
            # These end a paragraph, or an earlier item of the same list, that was left open.
            for depth in range(len(stack) - 1, -1, -1):
                above = stack[depth][0]
                if above == ("li" if name == "li" else "p"):
                    del stack[depth:]
                    role = stack[-1][1] if stack else NEUTRAL
                    break
                if above not in INLINE and above != "p":
                    break
        new = _role(name, tag[3], role)
        if new != role:
            flush()
        stack.append((name, new))
        role = new
    flush()
    return out


# A run's hash is a polynomial of a number per byte, so that of any run follows from sums over the page.
_BASE = 0x9E3779B97F4A7C15
_BYTES = np.array([xxhash.xxh64_intdigest(bytes([k])) for k in range(256)], dtype=np.uint64)


@lru_cache(maxsize=1)
def _known_powers() -> tuple[np.ndarray, np.ndarray]:
    return _powers(KNOWN_POWERS)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse."""
    both = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        powers = np.full(n + 1, base, dtype=np.uint64)
        powers[0] = 1
        both.append(np.cumprod(powers, dtype=np.uint64))
    return both[0], both[1]


def prefixes(text: str, seed: int, run: int = MIN_RUN) -> tuple[np.ndarray, int]:
    """Hashes of the ``run`` tokens from each token on that has so many after it, and the number of tokens."""
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    if not len(data):
        return np.empty(0, dtype=np.uint64), 0
    gaps = np.flatnonzero(data == 32)
    starts, ends = np.r_[0, gaps + 1], np.r_[gaps, len(data)]
    if len(starts) < run:
        return np.empty(0, dtype=np.uint64), len(starts)
    powers, inverse = _known_powers() if len(data) <= KNOWN_POWERS else _powers(len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[data] * powers[: len(data)], out=sums[1:])
    first = starts[: len(starts) - run + 1]
    found = (sums[ends[run - 1 :]] - sums[first]) * inverse[first] ^ np.uint64(seed)
    for _ in range(2):
        found *= np.uint64(0xBF58476D1CE4E5B9)
        found ^= found >> np.uint64(31)
    return found, len(starts)


def distinct_prefixes(found: list[np.ndarray], owners: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The prefixes of some pages in order, each with its least and greatest owner."""
    every = np.concatenate(found) if found else np.empty(0, dtype=np.uint64)
    owner = np.repeat(np.array(owners, dtype=np.int64), [len(x) for x in found])
    order = np.argsort(every)
    every, owner = every[order], owner[order]
    if not len(every):
        return every, owner, owner
    starts = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])
    return every[starts], np.minimum.reduceat(owner, starts), np.maximum.reduceat(owner, starts)


def cover(length: int, starts: np.ndarray, run: int = MIN_RUN) -> np.ndarray:
    """Which of ``length`` tokens lie in a run that begins at one of ``starts``."""
    edges = np.zeros(length + run + 1, dtype=np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + run, -1)
    return np.cumsum(edges)[:length] > 0


def pack(ascending: np.ndarray) -> bytes:
    """Ascending numbers as differences of seven bits a byte."""
    steps = np.diff(ascending, prepend=np.uint64(0))
    sizes, k = np.ones(len(steps), dtype=np.int64), 1
    while (more := steps >= np.uint64(1 << (7 * k))).any():
        sizes += more
        k += 1
    out = np.zeros(int(sizes.sum()), dtype=np.uint8)
    first = np.cumsum(sizes) - sizes
    for k in range(int(sizes.max(initial=0))):
        live = sizes > k
        piece = (steps[live] >> np.uint64(7 * k)) & np.uint64(127)
        out[first[live] + k] = piece.astype(np.uint8) | np.where(sizes[live] > k + 1, 128, 0).astype(np.uint8)
    return out.tobytes()


def unpack(packed: bytes) -> np.ndarray:
    data = np.frombuffer(packed, dtype=np.uint8)
    if not len(data):
        return np.empty(0, dtype=np.uint64)
    ends = np.flatnonzero(data < 128)
    first = np.r_[0, ends[:-1] + 1]
    shift = np.arange(len(data)) - np.repeat(first, ends - first + 1)
    return np.cumsum(np.add.reduceat((data & 127).astype(np.uint64) << (7 * shift).astype(np.uint64), first), dtype=np.uint64)


def _contains(ascending: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(ascending):
        return np.zeros(len(wanted), dtype=bool)
    at = np.minimum(np.searchsorted(ascending, wanted), len(ascending) - 1)
    return ascending[at] == wanted


class Members:
    """A set of 64-bit numbers; a table by leading bits answers for most that are not in it."""

    def __init__(self, ascending: np.ndarray) -> None:
        self.ascending = ascending
        self.shift = np.uint64(64 - min(len(ascending).bit_length() + 4, 26))
        self.table = np.zeros(1 << (64 - int(self.shift)), dtype=bool)
        self.table[ascending >> self.shift] = True

    def places(self, wanted: np.ndarray) -> np.ndarray:
        """Where ``wanted`` has numbers of the set."""
        perhaps = np.flatnonzero(self.table[wanted >> self.shift])
        return perhaps[_contains(self.ascending, wanted[perhaps])]


def read(host: str, page: str | None) -> tuple[list[tuple[int, str]], np.ndarray, int]:
    """Blocks of a page, their prefixes and the number of their tokens."""
    found = blocks(page)
    return found, *prefixes(" ".join([t for _, t in found]), xxhash.xxh64_intdigest(host))


def _owner(found: list[tuple[int, str]]) -> int:
    """Pages of a host with the same words outside of menus are one owner."""
    return xxhash.xxh64_intdigest(" ".join([t for r, t in found if r != CHROME])) - (1 << 63)


def _chunks(batches: Iterator[pa.RecordBatch], tokens: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Distinct prefixes of the pages of a task, some pages at a time. Columns are host and html."""
    found, owners, size = [], [], 0
    for batch in slices(batches):
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            shown, these, _ = read(host, page)
            found.append(these)
            owners.append(_owner(shown))
            size += len(these)
            if size >= tokens:
                yield distinct_prefixes(found, owners)
                found, owners, size = [], [], 0
    if size:
        yield distinct_prefixes(found, owners)


def _main_text(found: list[tuple[int, str]], starts: np.ndarray, length: int) -> tuple[str, int]:
    """Main text of a page of ``length`` tokens whose repeated runs begin at ``starts``, and the number of tokens they cover."""
    hidden = cover(length, starts) if len(starts) else np.zeros(length, dtype=bool)
    n = int(hidden.sum())
    if any(r == MAIN for r, _ in found):
        return " ".join([t for r, t in found if r == MAIN]), n
    at, kept = 0, []
    for role, text in found:
        words = text.split(" ")
        if role == NEUTRAL:
            kept.extend(w for w, h in zip(words, hidden[at : at + len(words)].tolist(), strict=True) if not h)
        at += len(words)
    return " ".join(kept), n


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))


def _sent(table: DataFrame, limit: int) -> Broadcast | None:
    """The numbers of a table of one column in order, for every task, if there are few enough."""
    if not small_enough(table, limit):
        return None
    numbers = table.toArrow().column(0).to_numpy()
    return table.sparkSession.sparkContext.broadcast(np.sort(numbers.view(np.uint64)))


def repeated_prefixes(pages: DataFrame, limit: int = BROADCAST_PREFIXES) -> DataFrame:
    """``(prefix)``: hashes of host and tokens that stand on two distinct pages of a host, of a table ``(host, html)``."""
    about = (pages.agg(F.sum(F.length("html").cast("long")).alias("n")).first()["n"] or 0) // TOKEN_CHARS + 1
    # Leading bits tell nearly all prefixes apart; the first of them are the range.
    bits = min(62, about.bit_length() + 8)
    ranges = min((about // RANGE).bit_length(), 24)
    low, chunk = bits - ranges, CHUNK

    def leading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found, least, greatest in _chunks(batches, chunk):
            short = found >> np.uint64(64 - bits)
            fresh = np.r_[True, short[1:] != short[:-1]]
            part = short >> np.uint64(low)
            edges = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            rows = []
            for lo, hi in zip(edges, [*edges[1:], len(short)], strict=True):
                these = short[lo:hi] & np.uint64((1 << low) - 1)
                several = these[least[lo:hi] < greatest[lo:hi]]
                rows.append((int(part[lo]), pack(these[fresh[lo:hi]]), pack(several)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)],
                names=["part", "met", "several"],
            )

    def meet(table: pa.Table) -> pa.Table:
        part = np.uint64(table.column("part")[0].as_py() << low)
        seen, times = np.unique(
            np.concatenate([unpack(x) for x in table.column("met").to_pylist()]), return_counts=True
        )
        several = np.concatenate([unpack(x) for x in table.column("several").to_pylist()])
        return pa.table({"short": pa.array((np.union1d(seen[times > 1], several) | part).view(np.int64))})

    met = map_arrow(pages, leading, "part int, met binary, several binary")
    candidates = materialise(met.groupBy("part").applyInArrow(meet, "short long"), "candidate-prefixes")
    sent = _sent(candidates, limit)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _chunks(batches, chunk):
            if sent is not None:
                here = _contains(sent.value, columns[0] >> np.uint64(64 - bits))
                columns = tuple(x[here] for x in columns)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x.view(np.int64)) for x in columns], names=["prefix", "least", "greatest"]
            )

    rows = map_arrow(pages, whole, "prefix long, least long, greatest long")
    owners = rows.groupBy("prefix").agg(F.min("least").alias("least"), F.max("greatest").alias("greatest"))
    found = materialise(owners.filter("least < greatest").select("prefix"), "repeated-prefixes")
    discard(candidates)
    return found


def extract_pages(df: DataFrame, broadcast_prefixes: int = BROADCAST_PREFIXES) -> DataFrame:
    """``(page_id, url, text, covered)`` of every row of a table with ``page_id, url, html``.

    ``covered`` counts the page's tokens inside repeated runs. A null or empty
    page has an empty text. A null url is host ''. Repeated rows are extracted
    alike, each for itself, and count as one page. A page is read whole at any
    length. Other columns are ignored; an empty table gives no rows. More
    repeated prefixes than ``broadcast_prefixes`` are joined by shuffle.
    """
    pages = df.select(F.col("page_id").cast("long").alias("page_id"), "url", host_of(F.col("url")).alias("host"), "html")
    repeats = repeated_prefixes(pages.select("host", "html"), broadcast_prefixes)
    sent = _sent(repeats, broadcast_prefixes)
    schema = "page_id long, url string, text string, covered long"

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members = None if sent is None else Members(sent.value)
        for batch in slices(batches):
            hosts, bodies = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            places = batch.column(4).to_pylist() if sent is None else [None] * len(hosts)
            out = []
            for host, body, known in zip(hosts, bodies, places, strict=True):
                found, here, length = read(host, body)
                starts = np.array(known or [], dtype=np.int64) if members is None else members.places(here)
                out.append(_main_text(found, starts, length))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array([t for t, _ in out], pa.string()), pa.array([n for _, n in out], pa.int64())],
                names=["page_id", "url", "text", "covered"],
            )

    if sent is not None:
        return map_arrow(pages, texts, schema)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 16):
            found = [read(h, x)[1] for h, x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            sizes = [len(x) for x in found]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(batch.column(0).to_numpy(), sizes)),
                    pa.array(np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])),
                    pa.array(np.concatenate(found).view(np.int64)),
                ],
                names=["row", "at", "prefix"],
            )

    # Equal rows have equal places.
    keyed = pages.withColumn("row", F.xxhash64("page_id", "url", "html"))
    hits = map_arrow(keyed.select("row", "host", "html"), placed, "row long, at int, prefix long").join(repeats, "prefix")
    places = hits.groupBy("row").agg(F.collect_set("at").alias("places"))
    return map_arrow(keyed.join(places, "row", "left").select("page_id", "url", "host", "html", "places"), texts, schema)
