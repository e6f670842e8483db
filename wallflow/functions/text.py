"""Text expressions. Everything here stays inside the JVM; no Python UDFs."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from wallflow.functions.net import CIDR

# Every character Unicode calls white space plus the four ASCII separators,
# i.e. what a rule editor's "trim" removes. Spark's trim() knows U+0020 only.
WHITESPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())

# A value made of these characters needs no quotes on a command line.
BARE = "[a-zA-Z0-9_.-]+"
_BARE_VALUE = f"^(?:{BARE}|{CIDR})\\z"
_QUOTED_BARE_VALUE = f'^"({BARE}|{CIDR})"\\z'

_EUROPEAN_END = "\u0250"
_HANGUL_FIRST, _HANGUL_LAST = 0xAC00, 0xD7A3
_LEAD = "".join(chr(0x1100 + i) for i in range(19))
_VOWEL = "".join(chr(0x1161 + i) for i in range(21))
_TAIL = "".join(chr(0x11A8 + i) for i in range(27))


def strip_ws(c: Column) -> Column:
    """Trim Unicode white space on both ends."""
    return F.btrim(c, F.lit(WHITESPACE))


def blank_to_null(c: Column) -> Column:
    """Trimmed text, or null when nothing is left."""
    return F.nullif(strip_ws(c), F.lit(""))


def or_default(c: Column, default: str) -> Column:
    """``default`` in place of null or empty text."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def clean_cell(c: Column) -> Column:
    """Value cleanup of a rule cell: trim, then drop double quotes on the ends."""
    return F.btrim(strip_ws(F.coalesce(c, F.lit(""))), F.lit('"'))


def drop_invalid_bytes(c: Column) -> Column:
    """Text without the bytes that are no UTF-8; a replacement character that stands in it stays.

    Invalid bytes become replacement characters and go; those of the text are
    written another way meanwhile, with U+0001, which is itself escaped.
    """
    mark, lost = F.lit("\x01"), F.lit("\ufffd")
    kept = F.replace(F.replace(c, mark, F.lit("\x01a")), lost, F.lit("\x01b"))
    gone = F.replace(F.make_valid_utf8(kept), lost, F.lit(""))
    back = F.replace(F.replace(gone, F.lit("\x01b"), lost), F.lit("\x01a"), mark)
    return F.when(F.is_valid_utf8(c), c).otherwise(back)


def base_form(ch: str) -> str:
    """One character (or constant) without accents: NFKD minus combining marks."""
    return "".join(d for d in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(d))


@lru_cache(maxsize=1)
def _accent_tables() -> tuple[str, str, str, tuple[str, ...]]:
    """Lookup strings derived from the Unicode database.

    Removing combining marks after NFKD works on each character by itself, so
    the whole function is a per-character mapping. Returns the characters that
    map to one other character and their targets (a source without a target is
    deleted), then those that expand to several and their expansions.
    """
    swap_from, swap_to, drop, wide, expansions = [], [], [], [], []
    for cp in range(0x80, 0x30000):
        if 0xD800 <= cp <= 0xDFFF or _HANGUL_FIRST <= cp <= _HANGUL_LAST:
            continue
        ch = chr(cp)
        base = base_form(ch)
        if base == ch:
            continue
        if not base:
            drop.append(ch)
        elif len(base) == 1:
            swap_from.append(ch)
            swap_to.append(base)
        else:
            wide.append(ch)
            expansions.append(base)
    return "".join(swap_from + drop), "".join(swap_to), "".join(wide), tuple(expansions)


def _expand(c: Column) -> Column:
    """Replace the characters that decompose into several (ligatures, Hangul)."""
    _, _, wide, expansions = _accent_tables()
    table = F.split(F.lit("\x00".join(expansions)), "\x00")

    def one(ch: Column) -> Column:
        n = F.ascii(ch) - F.lit(_HANGUL_FIRST)
        at = F.position(ch, F.lit(wide))
        tail = n % 28
        hangul = F.concat(
            F.substring(F.lit(_LEAD), F.floor(n / 588).cast("int") + 1, F.lit(1)),
            F.substring(F.lit(_VOWEL), F.floor((n % 588) / 28).cast("int") + 1, F.lit(1)),
            F.when(tail > 0, F.substring(F.lit(_TAIL), tail, F.lit(1))).otherwise(""),
        )
        return (
            F.when(ch.between(chr(_HANGUL_FIRST), chr(_HANGUL_LAST)), hangul)
            .when(at > 0, F.try_element_at(table, at))
            .otherwise(ch)
        )

    return F.array_join(F.transform(F.split(c, ""), one), "")


def strip_accents(c: Column) -> Column:
    """NFKD decomposition without its combining marks.

    ASCII text passes through. Text that a small table of European letters
    turns into ASCII needs nothing more. The rest goes through the full table,
    and only text with ligatures, fractions or Hangul is taken apart. Lookups
    use ``translate``, which hashes; a regex class of a thousand characters
    would try them one by one.
    """
    swap_from, swap_to, wide, _ = _accent_tables()
    near = [(a, b) for a, b in zip(swap_from, swap_to) if a < _EUROPEAN_END]
    european = F.translate(c, "".join(a for a, _ in near), "".join(b for _, b in near))
    has_wide = c.rlike(f"[{chr(_HANGUL_FIRST)}-{chr(_HANGUL_LAST)}]") | (
        F.length(F.translate(c, wide, "")) < F.length(c)
    )
    return (
        F.when(_is_ascii(c), c)
        .when(_is_ascii(european), european)
        .when(~has_wide, F.translate(c, swap_from, swap_to))
        .otherwise(_expand(F.translate(c, swap_from, swap_to)))
    )


def _is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def characters(c: Column) -> Column:
    """Number of characters. Spark walks from one to the next; that ASCII text has as many as bytes is seen in a third of the time."""
    # Bytes beyond ASCII, taken for Latin-1, need two each.
    latin = F.octet_length(F.decode(c.cast("binary"), "ISO-8859-1"))
    return F.when(latin == F.octet_length(c), latin).otherwise(F.length(c))


def is_bare(c: Column) -> Column:
    """The value needs neither cleaning nor quotes."""
    return c.rlike(_BARE_VALUE)


def quoted_unless_bare(clean: Column) -> Column:
    """Quotes around trimmed text without accents, unless it needs none."""
    quoted = F.concat(F.lit('"'), F.replace(clean, F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.regexp_replace(quoted, _QUOTED_BARE_VALUE, "$1")


def cli_value(c: Column) -> Column:
    """A value as it stands on a command line: bare when safe, else quoted."""
    return F.when(is_bare(c), c).otherwise(quoted_unless_bare(strip_ws(strip_accents(c))))


def constant_cli_value(value: str) -> str:
    """``cli_value`` of a constant that has no accents."""
    if re.fullmatch(f"{BARE}|{CIDR}", value):
        return value
    return '"' + value.replace('"', '\\"') + '"'


def split_names(c: Column) -> Column:
    """Comma list to array: trimmed, blanks dropped, order kept."""
    return F.filter(F.transform(F.split(c, ","), strip_ws), lambda x: x != "")


def first_of_list(c: Column) -> Column:
    """Text before the first comma."""
    return F.split_part(c, F.lit(","), F.lit(1))


def sorted_list(c: Column) -> Column:
    """Order-independent form of a ``,`` or ``;`` list.

    A value with at most one component comes back trimmed but otherwise as
    written, so ``"a,"`` and ``"a"`` stay different. Repeats are kept.
    """
    parts = F.filter(F.transform(F.split(c, "[,;]"), strip_ws), lambda x: x != "")
    return F.when(~c.rlike("[,;]"), strip_ws(c)).otherwise(
        F.when(F.size(parts) > 1, F.array_join(F.array_sort(parts), ",")).otherwise(strip_ws(c))
    )


NAME_LIMIT = 64


def capped_name(c: Column, limit: int = NAME_LIMIT) -> Column:
    """Names over ``limit`` characters keep ``limit - 3`` and end in dots."""
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit - 3), F.lit("..."))).otherwise(c)


def joined_reasons(missing: Column) -> Column:
    """``KIND:name, KIND:name`` from an array of (kind, name) structs."""
    return F.array_join(F.transform(missing, lambda m: F.concat(m["kind"], F.lit(":"), m["name"])), ", ")


def python_quoted(c: Column) -> Column:
    """Text in single quotes, or double ones when it contains a single quote."""
    body = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    body = F.replace(F.replace(F.replace(body, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit("\t"), F.lit("\\t"))
    single = F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'"))
    double = F.concat(F.lit('"'), body, F.lit('"'))
    return F.when(c.contains("'") & ~c.contains('"'), double).otherwise(single)
