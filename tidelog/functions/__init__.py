"""Column functions: keys, names, checksums, rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digits of an offset in a segment key; keys then sort as offsets do.
OFFSET_DIGITS = 19


def segment_key(name: Column, start: Column) -> Column:
    return F.concat(name, F.lit("/seg-"), F.lpad(start.cast("string"), OFFSET_DIGITS, "0"))


def sanitized(address: Column) -> Column:
    """An address as part of a key: no separators."""
    return F.translate(F.replace(address, F.lit("://"), F.lit("_")), "/:", "__")


def zone_or_default(zone: Column) -> Column:
    return F.coalesce(F.nullif(zone, F.lit("")), F.lit("default"))


def unit_key(zone: Column, address: Column) -> Column:
    return F.concat_ws("/", F.lit("units"), zone_or_default(zone), sanitized(address))


def catalog_key(kind: str, name: Column) -> Column:
    """The key of a dataset, timeline or action."""
    return F.concat(F.lit(f"{kind}/"), name)


def action_id(number: Column, ms: Column | None = None) -> Column:
    """By number alone, or by the time it was submitted at and a number."""
    return F.format_string("action-%d", number) if ms is None else F.format_string("action-%d-%d", ms, number)


def lossy_text(value: Column) -> Column:
    """Bytes as text; what is not UTF-8 becomes replacement characters."""
    return F.make_valid_utf8(value.cast("string"))


def endpoint(address: Column) -> Column:
    """An address with a scheme."""
    return F.when(F.trim(address).rlike("^https?://"), F.trim(address)).otherwise(F.concat(F.lit("http://"), F.trim(address)))


def aligned(size: Column, to: int = 4096) -> Column:
    return F.floor((size + (to - 1)) / to).cast("long") * to


def epoch_ms(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def big_endian_head(payload: Column) -> Column:
    """The unsigned number in the first eight bytes."""
    return F.conv(F.hex(F.substring(payload, 1, 8)), 16, 10).cast("decimal(20,0)")


def soak_payload(number: Column, size: int = 256) -> Column:
    """Eight bytes of the number, big endian, then its low byte up to size."""
    return F.unhex(F.concat(F.lpad(F.hex(number), 16, "0"), F.repeat(F.lpad(F.hex(F.pmod(number, F.lit(256))), 2, "0"), size - 8)))


def fill_is_right(payload: Column) -> Column:
    """Whether the bytes after the eighth all are the number's low byte."""
    rest = F.hex(F.substring(payload, 9, 1 << 30))
    byte = F.lpad(F.hex((big_endian_head(payload) % 256).cast("long")), 2, "0")
    return F.repeat(byte, (F.length(rest) / 2).cast("int")) == rest


def first_difference(a: Column, b: Column) -> Column:
    """The first byte (from 0) at which two strings differ, their shorter length if one begins the other, null if equal."""
    x, y = F.hex(a), F.hex(b)
    shorter = F.least(F.length(a), F.length(b)).cast("int")
    at = F.filter(F.sequence(F.lit(0), F.greatest(shorter - 1, F.lit(0))), lambda i: F.substr(x, 2 * i + 1, F.lit(2)) != F.substr(y, 2 * i + 1, F.lit(2)))
    return F.when(x == y, F.lit(None).cast("int")).otherwise(F.coalesce(F.try_element_at(at, F.lit(1)), shorter))


def rendered(value: Column, kind: str) -> Column:
    """A value as text: NULL, integers and booleans plainly, floats without a trailing .0, binary as lossy UTF-8."""
    if kind in ("float", "double"):
        text = F.regexp_replace(value.cast("string"), r"\.0$", "")
    elif kind == "binary":
        text = lossy_text(value)
    elif kind in ("boolean", "int", "bigint", "string") or kind.startswith("varchar"):
        text = value.cast("string")
    else:
        text = F.lit(f"<{kind}>")
    return F.when(value.isNull(), F.lit("NULL")).otherwise(text)
