"""IPv4 arithmetic and indicator types."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

from watchloom.functions.columns import as_column

# Feed type words -> indicator type; anything else is an ip.
IOC_TYPE_ALIASES = {
    "ip": "ip", "ip_address": "ip", "ipv4": "ip", "ipv6": "ip",
    "domain": "domain", "fqdn": "domain", "hostname": "domain",
    "hash": "hash", "md5": "hash", "sha1": "hash", "sha256": "hash", "file_hash": "hash", "hash_sha256": "hash",
    "useragent": "useragent", "user_agent": "useragent", "ua": "useragent",
    "url": "url", "email": "email", "cidr": "cidr",
}

FULL_MASK = 0xFFFFFFFF


def ioc_type_alias(word: Column | str) -> Column:
    # A map is asked once; the arms of a CASE would compute the word anew.
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(IOC_TYPE_ALIASES.items())])
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(as_column(word)))), F.lit("ip"))


def ipv4_long(address: Column | str) -> Column:
    """Dotted quad as an integer, 0 where it is not four numbers."""
    parts = F.split(as_column(address), r"\.")
    octets = [F.element_at(parts, i).try_cast("long") for i in range(1, 5)]
    value = octets[0] * 16777216 + octets[1] * 65536 + octets[2] * 256 + octets[3]
    return F.coalesce(F.when(F.size(parts) == 4, value), F.lit(0).cast("long")).bitwiseAND(F.lit(FULL_MASK))


def prefix_mask(prefix: Column) -> Column:
    """Network mask of a prefix length; 0 bits give mask 0."""
    host = F.pow(F.lit(2.0), 32 - prefix).cast("long")
    return F.lit(FULL_MASK + 1).cast("long") - host


def cidr_prefix(cidr: Column | str) -> Column:
    """Prefix length of a range; a missing or unusable one means a single host."""
    cidr = as_column(cidr)
    number = F.regexp_extract(cidr, r"^[^/]*/\s*([+-]?\d+)", 1).try_cast("int")
    return F.when(number.between(0, 32), number).otherwise(F.lit(32))


def cidr_bounds(cidr: Column | str) -> Column:
    """Struct of prefix length, first and last address of a range."""
    cidr = as_column(cidr)
    prefix = cidr_prefix(cidr)
    mask = prefix_mask(prefix)
    lo = ipv4_long(F.substring_index(cidr, "/", 1)).bitwiseAND(mask)
    return F.struct(prefix.alias("prefix"), lo.alias("lo"), (lo + (F.lit(FULL_MASK) - mask)).alias("hi"))
