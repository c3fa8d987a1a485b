"""Typed extraction from 32-byte hex words.

Logs and calldata are lower-case hex strings without prefix.  Everything here
is a Column expression, so filters on decoded values still reach the scan and
no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = 64  # hex digits


def word_at(data: Column, index: Column | int) -> Column:
    """The ``index``-th word (from 0) of a hex string."""
    return F.substring(data, F.lit(index * WORD + 1) if isinstance(index, int) else index * WORD + 1, F.lit(WORD))


def tail(word: Column, digits: int) -> Column:
    return F.right(word, F.lit(digits))


def address(word: Column) -> Column:
    """``0x`` and the last 20 bytes, lower case."""
    return F.concat(F.lit("0x"), F.lower(tail(word, 40)))


def boolean(word: Column) -> Column:
    return tail(word, 1) == "1"


def int64(word: Column) -> Column:
    """The low 64 bits as a two's complement long.  Serves int8..int64 and, by
    wrapping at 2**63, uint8..uint64."""
    return F.conv(tail(word, 16), 16, -10).cast("bigint")


def uint64_exact(word: Column) -> Column:
    """An unsigned 64-bit word without wrapping, as decimal(20,0)."""
    return F.conv(tail(word, 16), 16, 10).cast("decimal(20,0)")


def _limb(word: Column, index: int, digits: int) -> Column:
    return F.conv(F.substring(word, index * digits + 1, digits), 16, 10).cast("bigint")


def _limbs_120(word: Column) -> tuple[Column, Column]:
    """The last 30 digits of a word as two limbs of 60 bits."""
    return tuple(F.conv(F.substring(word, at, 15), 16, 10).cast("decimal(19,0)") for at in (35, 50))


def _decimal_120(word: Column) -> Column:
    """Words below 2**120."""
    high, low = _limbs_120(word)
    return high * F.lit(1 << 60).cast("decimal(19,0)") + low


def _negative_120(word: Column) -> Column:
    """What to take away from zero for words above -2**120: each limb's complement,
    and one."""
    high, low = _limbs_120(word)
    most = F.lit((1 << 60) - 1).cast("decimal(19,0)")
    return (most - high) * F.lit(1 << 60).cast("decimal(19,0)") + ((most - low) + F.lit(1).cast("decimal(1,0)"))


def _long_division(word: Column) -> Column:
    """Any word, by schoolbook division of eight 32-bit limbs by 10**9, nine
    digits at a time.  Interpreted, so it stands behind the 120-bit test."""
    billion = F.lit(1_000_000_000).cast("bigint")
    limbs = F.array(*[_limb(word, i, 8) for i in range(8)])

    def divide(number: Column) -> Column:
        start = F.struct(F.array().cast("array<bigint>").alias("q"), F.lit(0).cast("bigint").alias("r"))

        def step(state: Column, limb: Column) -> Column:
            value = state["r"] * F.lit(1 << 32) + limb
            return F.struct(
                F.concat(state["q"], F.array(F.call_function("div", value, billion))).alias("q"),
                (value % billion).alias("r"),
            )

        return F.aggregate(number, start, step)

    def round_(state: Column, _: Column) -> Column:
        split = divide(state["n"])
        # the pair is read through a one-element array so that it is made once
        return F.transform(
            F.array(split),
            lambda s: F.struct(s["q"].alias("n"), F.concat(F.lpad(s["r"].cast("string"), 9, "0"), state["text"]).alias("text")),
        )[0]

    start = F.struct(limbs.alias("n"), F.lit("").alias("text"))
    digits = F.aggregate(F.sequence(F.lit(1), F.lit(9)), start, round_, lambda s: s["text"])
    trimmed = F.ltrim(digits, F.lit("0"))
    return F.when(trimmed == "", F.lit("0")).otherwise(trimmed)


def uint_text(word: Column) -> Column:
    """An unsigned 256-bit word as exact decimal text."""
    small = F.left(word, F.lit(34)) == "0" * 34
    return F.when(small, _decimal_120(word).cast("string")).otherwise(_long_division(word))


def int_text(word: Column) -> Column:
    """A signed 256-bit word as exact decimal text.  Numbers of up to 120 bits
    stay in generated code; only longer ones are divided out."""
    negative = F.left(word, F.lit(1)) >= "8"
    flipped = F.translate(word, "0123456789abcdef", "fedcba9876543210")  # -x - 1
    # the magnitude is read through a one-element array so that it is made once
    long = F.transform(F.array(F.when(negative, _plus_one(flipped)).otherwise(word)), _long_division)[0]
    return (
        F.when(F.left(word, F.lit(34)) == "0" * 34, _decimal_120(word).cast("string"))
        .when(F.left(word, F.lit(34)) == "f" * 34, F.concat(F.lit("-"), _negative_120(word).cast("string")))
        .otherwise(F.concat(F.when(negative, F.lit("-")).otherwise(F.lit("")), long))
    )


def _plus_one(word: Column) -> Column:
    """Hex increment: the last digit that is not f goes up, the f's behind it
    become zeros."""
    kept = F.rtrim(word, F.lit("f"))
    n = F.length(kept)
    up = F.translate(F.substring(kept, n, F.lit(1)), "0123456789abcde", "123456789abcdef")
    return F.when(n == 0, F.lit("0" * WORD)).otherwise(
        F.concat(F.substring(kept, F.lit(1), n - 1), up, F.repeat(F.lit("0"), F.lit(WORD) - n))
    )


def sortable(word: Column, signed: bool = False) -> Column:
    """A 64-digit word that compares as text like the number it stands for."""
    if not signed:
        return word
    return F.concat(F.translate(F.left(word, F.lit(1)), "0123456789abcdef", "89abcdef01234567"), F.substring(word, 2, WORD - 1))


def number_key(word: Column, signed: bool = False) -> Column:
    """A 256-bit word as 32 bytes that compare like the number it stands for:
    the word itself, of signed numbers with the sign bit flipped."""
    return F.unhex(sortable(word, signed))


def key_bytes(number: int, signed: bool = False) -> bytes:
    """The key of a number that fits."""
    return (number + (1 << 255) if signed else number).to_bytes(32, "big")


def number_word(number: Column) -> Column:
    """A non-negative whole number of up to 38 digits (or its decimal text) as a
    32-byte word."""
    exact = number.cast("decimal(38,0)")
    half, quarter = F.lit(str(1 << 64)).cast("decimal(20,0)"), F.lit(1 << 32).cast("decimal(10,0)")
    high = F.call_function("div", exact, half)
    low = (exact % half).cast("decimal(20,0)")
    parts = (high, 16), (F.call_function("div", low, quarter), 8), ((low % quarter).cast("bigint"), 8)
    return F.lpad(F.concat(*[F.lpad(F.lower(F.hex(part)), digits, "0") for part, digits in parts]), WORD, "0")


def decimal_key(text: Column) -> Column:
    """Exact decimal text of up to 78 digits as text that compares like the
    number: a digit for the sign, then the digits (of a negative number their
    complements) at full width."""
    width = 78
    negative = F.concat(F.lit("0"), F.translate(F.lpad(F.substring(text, F.lit(2), F.lit(width)), width, "0"), "0123456789", "9876543210"))
    return F.when(F.left(text, F.lit(1)) == "-", negative).otherwise(F.concat(F.lit("1"), F.lpad(text, width, "0")))


def decimal38(text: Column) -> Column:
    """Decimal text as decimal(38,0), or null where it does not fit."""
    return text.try_cast("decimal(38,0)")


def offset_of(word: Column) -> Column:
    """A head word read as an offset or length; null beyond 2**31."""
    return F.when(F.left(word, F.lit(56)) == "0" * 56, F.conv(tail(word, 8), 16, 10).cast("bigint")).otherwise(F.lit(None).cast("bigint"))


def fixed_bytes(word: Column, n: int) -> Column:
    """The leading ``n`` bytes of a word."""
    return F.unhex(F.left(word, F.lit(2 * n)))


def hex_text(value: Column) -> Column:
    """Binary as ``0x`` and lower-case hex."""
    return F.concat(F.lit("0x"), F.lower(F.hex(value)))


def encode_word(value: Column) -> Column:
    """A non-negative number as a 32-byte word."""
    return F.lpad(F.lower(F.hex(value)), WORD, "0")


def pascal_case(name: Column) -> Column:
    return F.array_join(F.transform(F.split(name, "_"), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, F.lit(2), F.length(w)))), "")
