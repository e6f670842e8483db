"""IPv4 predicates over text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted spellings of an address, a network and a range.
OCTET = "(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
HOST = f"(?:{OCTET}\\.){{3}}{OCTET}"
CIDR = f"{HOST}/(?:[0-2]?[0-9]|3[0-2])"
RANGE = f"{HOST}-{HOST}"


def is_host_ip(c: Column) -> Column:
    """The whole value is one dotted-quad address."""
    return c.rlike(f"^{HOST}\\z")


def is_ip_or_network(c: Column) -> Column:
    """The whole value is an address, a CIDR network or an address range."""
    return c.rlike(f"^(?:{HOST}|{CIDR}|{RANGE})\\z")


def host_object_name(ip: Column) -> Column:
    """Name given to the object generated for an address."""
    return F.concat(F.lit("H_"), F.translate(ip, ".", "_"))


def ip_text_rank(ip: Column) -> Column:
    """A long that orders addresses as their text sorts.

    At most 15 characters out of eleven, read as base-12 digits padded on the
    right, so that a prefix sorts before anything it starts.
    """
    digits = F.rpad(F.translate(ip, ".0123456789", "123456789ab"), 15, "0")
    return F.conv(digits, 12, 10).cast("long")
