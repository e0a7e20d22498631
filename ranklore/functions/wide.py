"""Unsigned integers of 1 to 256 bits.

Up to 64 bits are DECIMAL(38,0) columns; they are multiplied by a 64-bit fraction as
bigint halves of 32 bits, so the arithmetic stays in generated code. Wider values are Python integers in Arrow
batches, carried as zero-padded lower-case hex of a fixed width, whose text order is
the numeric order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

WIDE = DecimalType(38, 0)
MAX_BITS = 256
_HALF = 1 << 32


def check_bits(bits: int) -> int:
    if not 1 <= bits <= MAX_BITS:
        raise ValueError(f"hash width must be 1 to {MAX_BITS} bits")
    return bits


def max_for_bits(bits: int) -> int:
    return (1 << check_bits(bits)) - 1


def hex_width(bits: int) -> int:
    return -(-bits // 4)


def to_hex(value: int, bits: int) -> str:
    return format(value & max_for_bits(bits), f"0{hex_width(bits)}x")


def to_bytes(value: int, bits: int) -> bytes:
    """Big-endian, ceil(bits / 8) bytes, bits above the width cleared."""
    return (value & max_for_bits(bits)).to_bytes(-(-bits // 8), "big")


def top_bits(value: int, bits: int, wanted: int) -> int:
    """The ``wanted`` most significant bits of a ``bits``-wide value (the value itself if narrower)."""
    return value >> (bits - wanted) if bits > wanted else value


def words(value: int) -> list[int]:
    """Four 64-bit words, the lowest first."""
    return [(value >> (64 * i)) & (2**64 - 1) for i in range(4)]


def fraction_to_q64(fraction: float) -> int:
    """trunc(f * 2^64): 0 for f <= 0, at least 1 for f > 0, all ones from 1 on."""
    if not fraction > 0.0:
        return 0
    if fraction >= 1.0:
        return 2**64 - 1
    n, d = fraction.as_integer_ratio()
    return max((n << 64) // d, 1)


def scale_fixed(factor: float) -> int:
    """A scale factor in 32.32 fixed point: rounded, at most one, at least one unit."""
    if not factor > 0.0:
        raise ValueError("the scale factor must be positive")
    return max(1, min(_HALF, int(min(factor, 1.0) * _HALF + 0.5)))


def scaled_range(bits: int, factor: float = 1.0) -> int:
    """The hash space of ``bits`` bits times the scale factor."""
    fixed = scale_fixed(factor)
    top = max_for_bits(bits)
    return top if fixed == _HALF else (top * fixed) >> 32


def _halved(x: Column) -> Column:
    half = F.lit(_HALF).cast(WIDE)
    return ((x - x % half) / half).cast(WIDE)


def _low(x: Column, bits: int) -> Column:
    return x.bitwiseAND(F.lit((1 << bits) - 1).cast("bigint"))


def _product32(x: Column, y: Column) -> tuple[Column, Column]:
    """High and low 32 bits of the product of two 32-bit numbers; no step passes 2^50."""
    upper, lower = x * F.shiftright(y, 16), x * _low(y, 16)
    middle = upper + F.shiftright(lower, 16)
    return F.shiftright(middle, 16), F.shiftleft(_low(middle, 16), 16).bitwiseOR(_low(lower, 16))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` written, and evaluated, once however often the body names it. Plain nesting
    would write it out at each place, and a filter that is pushed below the result would do so again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _fields(**columns: Column) -> Column:
    return F.struct(*[c.alias(name) for name, c in columns.items()])


def halves_times(high: Column, low: Column, fraction: Column) -> Column:
    """(size * q64(fraction)) >> 64, exactly, as a struct of its high and low 32 bits; ``size`` is given in the same way.

    Bigints all the way: the 128-bit product is added up from four of 64 bits by their halves."""

    def upper(v: Column) -> Column:
        return let(_fields(h=v["h"], l=v["l"], f=v["f"], a=F.floor(v["f"] * F.lit(float(_HALF))).cast("bigint")), lower)

    def lower(v: Column) -> Column:
        rest = F.floor((v["f"] * F.lit(float(_HALF)) - v["a"]) * F.lit(float(_HALF))).cast("bigint")
        least = (v["f"] > 0) & (v["a"] == 0) & (rest == 0)
        return let(_fields(h=v["h"], l=v["l"], a=v["a"], b=F.when(least, F.lit(1).cast("bigint")).otherwise(rest)), product)

    def product(v: Column) -> Column:
        up, below = product_halves(v["h"], v["l"], v["a"], v["b"])
        return _fields(high=up, low=below)

    return let(_fields(h=high, l=low, f=fraction), upper)


def q64_halves(fraction: Column) -> tuple[Column, Column]:
    """High and low 32 bits of trunc(f * 2^64) as bigints; f in [0, 1), at least one unit for f > 0."""
    high = F.floor(fraction * F.lit(float(_HALF)))
    low = F.floor((fraction * F.lit(float(_HALF)) - high) * F.lit(float(_HALF)))
    low = F.when((fraction > 0) & (high == 0) & (low == 0), F.lit(1)).otherwise(low)
    return high.cast("bigint"), low.cast("bigint")


def product_halves(high: Column, low: Column, a: Column, b: Column) -> tuple[Column, Column]:
    """As ``halves_times``, the fraction in halves ``a`` and ``b``; all arguments occur many times in the
    result, so they must be short: columns, literals or bound values."""
    b_up, _ = _product32(low, b)
    bb_up, bb_low = _product32(high, b)
    below = bb_low + b_up  # with bb_up above it: (size * b) >> 32
    a_up, a_low = _product32(low, a)
    aa_up, aa_low = _product32(high, a)
    carried = F.shiftright(a_low + _low(below, 32), 32)
    total = aa_low + a_up + bb_up + F.shiftright(below, 32) + carried
    return aa_up + F.shiftright(total, 32), _low(total, 32)


def halves_decimal(high: Column, low: Column) -> Column:
    return (high.cast(WIDE) * F.lit(_HALF).cast(WIDE) + low.cast(WIDE)).cast(WIDE)


def halves_hex(high: Column, low: Column, bits: int) -> Column:
    """Zero-padded lower-case hex of a number of up to 64 bits in two halves."""
    digits = F.concat(F.lpad(F.hex(high), 8, "0"), F.lpad(F.hex(low), 8, "0"))
    return F.lower(F.right(digits, F.lit(hex_width(bits))))


def decimal_halves(x: Column) -> tuple[Column, Column]:
    """High and low 32 bits of a DECIMAL of up to 64 bits, as bigints."""
    wide = x.cast(WIDE)
    return _halved(wide).cast("bigint"), (wide % F.lit(_HALF).cast(WIDE)).cast("bigint")


def times_fraction(size: Column, fraction: Column) -> Column:
    """(size * q64(fraction)) >> 64 for a DECIMAL size of up to 64 bits, exactly."""
    return let(halves_times(*decimal_halves(size), fraction), lambda p: halves_decimal(p["high"], p["low"]))


def divided(a: Column, b: Column) -> Column:
    """floor(a / b) of non-negative DECIMALs, exactly."""
    a, b = a.cast(WIDE), b.cast(WIDE)
    return ((a - a % b) / b).cast(WIDE)


def decimal_hex(x: Column, bits: int) -> Column:
    """Zero-padded lower-case hex of a DECIMAL of up to 64 bits."""
    return halves_hex(*decimal_halves(x), bits)
