"""Order-preserving key encodings, hex, record sizes and checksums, as Column expressions.

BINARY compares unsigned and lexicographically in Spark, with a prefix before
its extensions, so encoded keys sort as the values they stand for.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes besides key and value in a stored record and in a log record.
RECORD_HEAD, RECORD_CHECKSUM, LOG_HEAD = 16, 4, 17


def _big_endian(value: Column, n_bytes: int) -> Column:
    return F.unhex(F.lpad(F.hex(value.cast("bigint")), 2 * n_bytes, "0"))


def from_u64(value: Column) -> Column:
    """8 bytes big-endian; for values that are not negative this is the sort order."""
    return _big_endian(value, 8)


def from_i64(value: Column) -> Column:
    """8 bytes big-endian with the sign bit flipped, so negative values sort first."""
    return _big_endian(value.cast("bigint").bitwiseXOR(F.lit(-(1 << 63)).cast("bigint")), 8)


def to_i64(key: Column) -> Column:
    flipped = F.lpad(F.hex(key), 16, "0")
    high = F.conv(F.substring(flipped, 1, 8), 16, 10).cast("bigint") - (1 << 31)
    return F.shiftleft(high, 32) + F.conv(F.substring(flipped, 9, 8), 16, 10).cast("bigint")


def from_text(value: Column) -> Column:
    return F.encode(value, "UTF-8")


def composite(*parts: Column) -> Column:
    """Binary parts as one key that sorts by the parts in turn: 00 becomes 00 FF, and 00 01 ends a part."""
    pieces = []
    for part in parts:
        # bytes as two digits each with a separator, so that a replaced 00 is a whole byte
        digits = F.regexp_replace(F.hex(part), "(..)", "$1 ")
        pieces += [F.replace(digits, F.lit("00 "), F.lit("00 FF ")), F.lit("00 01 ")]
    return F.unhex(F.replace(F.concat(*pieces), F.lit(" "), F.lit("")))


def to_hex(value: Column) -> Column:
    """Lower-case hex; NULL is the empty string."""
    return F.lower(F.hex(F.coalesce(value, F.lit(b"").cast("binary"))))


def from_hex(text: Column) -> Column:
    """Bytes of hex digits of either case; NULL and empty are no bytes; anything else raises."""
    given = F.coalesce(text, F.lit(""))
    good = given.rlike("^([0-9a-fA-F]{2})*$")
    return F.when(good, F.unhex(given)).otherwise(F.raise_error(F.concat(F.lit("not hex: "), given)).cast("binary"))


def value_size(value: Column) -> Column:
    return F.coalesce(F.octet_length(value), F.lit(0)).cast("bigint")


def record_size(key: Column, value: Column) -> Column:
    """Bytes of a stored record: head, key, value and checksum."""
    return RECORD_HEAD + F.octet_length(key) + value_size(value) + RECORD_CHECKSUM


def log_size(key: Column, value: Column) -> Column:
    """Bytes of a log record: head, key and value."""
    return LOG_HEAD + F.octet_length(key) + value_size(value)


def record_bytes(key: Column, value: Column, seq: Column) -> Column:
    """A stored record without its checksum: key and value length (-1: tombstone), seq, key, value; big-endian."""
    length = F.when(value.isNull(), F.lit("FFFFFFFF")).otherwise(F.lpad(F.hex(F.octet_length(value)), 8, "0"))
    head = F.unhex(F.concat(F.lpad(F.hex(F.octet_length(key)), 8, "0"), length, F.lpad(F.hex(seq.cast("bigint")), 16, "0")))
    return F.concat(head, key, F.coalesce(value, F.lit(b"").cast("binary")))


def record_crc(key: Column, value: Column, seq: Column) -> Column:
    return F.crc32(record_bytes(key, value, seq))
