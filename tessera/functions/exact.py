"""Exact scalar rules as column expressions: wrapping 64-bit arithmetic, bit widths, strict parsing, exact decimal scaling."""

from __future__ import annotations

import base64

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_LONG, MIN_LONG = 2**63 - 1, -(2**63)


def wide(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def wrap(c: Column) -> Column:
    """A decimal folded into the signed 64-bit range, as wrapping arithmetic gives it."""
    half, full = F.lit(str(2**63)).cast("decimal(38,0)"), F.lit(str(2**64)).cast("decimal(38,0)")
    return (F.pmod(wide(c) + half, full) - half).cast("bigint")


def sub(a: Column, b: Column) -> Column:
    return wrap(wide(a) - wide(b))


def add(a: Column, b: Column) -> Column:
    return wrap(wide(a) + wide(b))


def zigzag(d: Column) -> Column:
    """Signed to unsigned (as a bit pattern): small magnitudes give small values."""
    return F.shiftleft(d, 1).bitwiseXOR(F.shiftright(d, 63))


def unzigzag(z: Column) -> Column:
    return F.shiftrightunsigned(z, 1).bitwiseXOR(-z.bitwiseAND(F.lit(1).cast("bigint")))


def bit_width(x: Column) -> Column:
    """Bits of an unsigned 64-bit pattern; 0 for 0."""
    return F.when(x == 0, F.lit(0)).otherwise(F.length(F.bin(x))).cast("int")


def byte_width(x: Column) -> Column:
    return F.ceil(bit_width(x) / 8).cast("int")


def varint_length(z: Column) -> Column:
    """Bytes of a base-128 varint, 1 to 10."""
    return F.greatest(F.lit(1), F.ceil(bit_width(z) / 7)).cast("int")


def ceil_div(a: Column, b: int) -> Column:
    return F.floor((wide(a) + (b - 1)) / F.lit(b)).cast("bigint")


def saturating_add(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_add(a, b), F.when(b > 0, F.lit(MAX_LONG)).otherwise(F.lit(MIN_LONG)))


def byte_plane(q: Column, k: int) -> Column:
    """Byte k of an unsigned pattern, the lowest first."""
    return F.shiftrightunsigned(q, 8 * k).bitwiseAND(F.lit(255).cast("bigint"))


def merge_planes(planes: list[Column]) -> Column:
    out = F.lit(0).cast("bigint")
    for k, plane in enumerate(planes):
        out = out.bitwiseOR(F.shiftleft(plane, 8 * k))
    return out


def exact_scaled(v: Column, power: int) -> Column:
    """round(v * 10**power), halves away from zero, if dividing back gives the same double; else null. Negative zero is refused."""
    s = F.lit(float(10**power))
    n = F.round(v * s)
    fits = (F.abs(n) < F.lit(9.2233720368547748e18)) & ~F.isnan(v) & (F.abs(v) < float("inf"))
    negative_zero = v.cast("string") == "-0.0"
    return F.when(fits & (n / s == v) & ~negative_zero, n.cast("bigint"))


def decimal_e8(text: Column) -> Column:
    """Unsigned decimal text with up to eight fraction digits times 10**8; null if it is not one or does not fit."""
    ok = text.rlike(r"^[0-9]+(\.[0-9]{0,8})?$")
    return F.when(ok, _scaled(text))


def _scaled(text: Column) -> Column:
    digits = F.concat(F.regexp_extract(text, r"^([0-9]+)", 1), F.rpad(F.regexp_extract(text, r"\.([0-9]*)$", 1), 8, "0"))
    return digits.try_cast("decimal(38,0)").try_cast("bigint")


def strict_decimal(text: Column) -> Column:
    """digits.8digits, exactly; else null."""
    return F.when(text.rlike(r"^[0-9]+\.[0-9]{8}$"), _scaled(text))


def strict_unsigned(text: Column) -> Column:
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("bigint"))


def strict_bool(text: Column) -> Column:
    return F.when(text == "True", F.lit(True)).when(text == "False", F.lit(False))


def source_hash_ok(text: Column) -> Column:
    """64 lower-case hex digits, not all zero."""
    return F.coalesce(text.rlike("^[0-9a-f]{64}$") & ~text.rlike("^0+$"), F.lit(False))


def little_endian(data: Column, offset: int, size: int) -> Column:
    """Unsigned little-endian field of a binary column, as decimal(20,0)."""
    big = F.concat(*[F.hex(F.substring(data, offset + i + 1, 1)) for i in reversed(range(size))])
    return F.conv(big, 16, 10).cast("decimal(20,0)")


def safe_text(value: str) -> str:
    """Allow-list for text that goes into a statement; refuses anything else."""
    if not value or not all(c.isascii() and (c.isalnum() or c in "_-./:+=,@") for c in value):
        raise ValueError(f"unsafe text: {base64.b64encode(value.encode()).decode()}")
    return value


def crc32(data: Column) -> Column:
    """IEEE CRC-32 of bytes or text."""
    return F.crc32(data.cast("binary"))


def rate(rows: Column, ns: Column) -> Column:
    """Million rows a second from rows and nanoseconds."""
    return rows * F.lit(1000.0) / ns


def mib_rate(size: Column, ns: Column) -> Column:
    """MiB a second."""
    return size * F.lit(1e9) / (ns * F.lit(float(1 << 20)))


def saving(a: Column, b: Column) -> Column:
    """How many percent a is below b."""
    return F.lit(100.0) * (F.lit(1.0) - a / b)


#: Patterns of text that must not be published.
LEAKS = (
    r"/home/[A-Za-z0-9_.-]+/",
    r"/Users/[A-Za-z0-9_. -]+/",
    r"(?<![0-9.])100\.(?:6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9])",
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    r"BEGIN [A-Z ]*PRIVATE KEY",
    r"/mnt/",
    r"/data/",
)


def leaks(text: Column) -> Column:
    """Whether text holds a path, private address, e-mail address or key."""
    return text.rlike("(?i)" + "|".join(LEAKS))


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of two non-negative longs: Euclid in at most 93 steps."""
    start = F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"))
    step = lambda s, _: F.struct(F.when(s["b"] == 0, s["a"]).otherwise(s["b"]).alias("a"), F.when(s["b"] == 0, s["b"]).otherwise(s["a"] % s["b"]).alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(93)), start, step, lambda s: s["a"])
