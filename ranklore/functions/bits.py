"""Bit codes: signs of vectors packed into 64-bit words, and Hamming distance on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def sign_words(v: Column, dim: int) -> Column:
    """``array<bigint>``: bit i of word i // 64 is 1 where entry i is not negative."""
    words = []
    for start in range(0, dim, 64):
        bits = [
            F.when(F.get(v, F.lit(i)) >= 0, F.shiftleft(F.lit(1).cast("bigint"), i - start)).otherwise(F.lit(0).cast("bigint"))
            for i in range(start, min(dim, start + 64))
        ]
        words.append(reduce(lambda a, b: a.bitwiseOR(b), bits))
    return F.array(*words)


def bit(words: Column, i: int) -> Column:
    return F.shiftrightunsigned(F.get(words, F.lit(i // 64)), i % 64).bitwiseAND(F.lit(1).cast("bigint")).cast("int")


def to_signs(words: Column, dim: int) -> Column:
    """Entries +1 / -1 from the bits."""
    return F.array(*[bit(words, i) * 2 - 1 for i in range(dim)]).cast("array<double>")


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x
    )


def pack_codes(codes: Column, count: int, width: int) -> Column:
    """Small codes of ``width`` bits in one 64-bit word, first code lowest."""
    if count * width > 64:
        raise ValueError("the codes do not fit one word")
    parts = [F.shiftleft(F.get(codes, F.lit(i)).cast("bigint"), i * width) for i in range(count)]
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def unpack_codes(word: Column, count: int, width: int) -> Column:
    mask = F.lit((1 << width) - 1).cast("bigint")
    return F.array(*[F.shiftrightunsigned(word, i * width).bitwiseAND(mask).cast("int") for i in range(count)])
