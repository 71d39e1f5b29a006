"""Unsigned integers of up to 256 bits (payload words of event logs).

A value is a struct of four 64-bit limbs, the highest first, each a
``decimal(20,0)``. Spark compares structs field by field, so ``<``, ``max``
and sorting are those of the numbers. Sums are limb by limb, which merges in
any order; :func:`carry` turns limb sums into a number once per result row.
A threshold needs no limbs at all: 32-byte words compare like their numbers
(:func:`word`), byte by byte.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a word; names of the limbs, highest first; 2^64.
WORD, LIMBS, BASE = 32, ("l3", "l2", "l1", "l0"), Decimal(2 ** 64)
LIMB_TYPE = "decimal(20,0)"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def word(c) -> Column:
    """Big-endian bytes as a word of 32 bytes. Longer payloads are words if
    the bytes in front are zero; otherwise they are no such integer: NULL."""
    c = _col(c)
    size = F.octet_length(c)
    front = F.ltrim(F.hex(F.substr(c, F.lit(1), size - WORD)), F.lit("0"))
    return F.when(size == WORD, c).when(size < WORD, F.lpad(c, WORD, b"\x00")).when(
        front == "", F.substring(c, -WORD, WORD))


def word_literal(value: int) -> Column:
    return F.lit(value.to_bytes(WORD, "big"))


def above_word(c, bound: int) -> Column:
    """``c > bound`` on payload bytes, without decoding them."""
    if bound < 0:
        return word(c).isNotNull()
    return word(c) > word_literal(bound) if bound < 2 ** 256 else F.lit(False)


def limbs(c) -> Column:
    """Payload bytes -> limbs (NULL limbs for NULL and for no integer). Words
    below 2^64, the usual amounts, are converted once; the higher limbs are
    looked at only where one of their bytes is set."""
    c = _col(c)
    size = F.octet_length(c)
    front = F.ltrim(F.hex(F.substr(c, F.lit(1), size - WORD)), F.lit("0"))
    readable = (size <= WORD) | (front == "")
    head = size - 8
    small = (head <= 0) | (F.substr(c, F.lit(1), head) == F.substr(F.lit(b"\x00" * (WORD - 8)), F.lit(1), head))

    def limb(k):  # counted from the end, so that short payloads are fine
        digits = F.conv(F.hex(F.substring(c, -8 * (4 - k), 8)), 16, 10)
        return F.coalesce(digits, F.lit("0")).cast(LIMB_TYPE)

    zero = F.lit(0).cast(LIMB_TYPE)
    return F.struct(*(F.when(readable & small, zero).when(readable, limb(k)).alias(LIMBS[k]) for k in range(3)),
                    F.when(readable, limb(3)).alias(LIMBS[3]))


def literal(value: int) -> Column:
    """A number as limbs, to compare with."""
    return F.struct(*(F.lit(Decimal(value >> (64 * (3 - k)) & (2 ** 64 - 1))).cast(LIMB_TYPE).alias(name)
                      for k, name in enumerate(LIMBS)))


def sum_limbs(c) -> Column:
    """Aggregate: limb sums (NULL without values)."""
    c = _col(c)
    return F.struct(*(F.sum(c.getField(name)).alias(name) for name in LIMBS))


def carry(df: DataFrame, name: str) -> DataFrame:
    """Limb sums in column ``name`` -> a number: limbs below 2^64 and a limb
    ``l4`` for what exceeds 256 bits."""
    over, fields = None, []
    for limb in reversed(LIMBS):
        total = f"`{name}`.{limb}" + (f" + {over}" if over else "")
        fields.insert(0, f"'{limb}', cast(({total}) % {BASE} as {LIMB_TYPE})")
        over = f"cast((({total}) - ({total}) % {BASE}) / {BASE} as {LIMB_TYPE})"
    return df.withColumn(name, F.expr(f"named_struct('l4', {over}, {', '.join(fields)})"))


def _high(c: Column, names) -> Column:
    """Is any of these limbs set?"""
    out = F.lit(False)
    for name in names:
        out = out | (c.getField(name) != 0)
    return out


def to_decimal(c, carried: bool = False) -> Column:
    """``decimal(38,0)`` below 2^126, else NULL. ``carried``: with ``l4``."""
    c = _col(c)
    high = _high(c, (("l4",) if carried else ()) + LIMBS[:2]) | (c.getField("l1") >= Decimal(2 ** 62))
    value = (c.getField("l1") * F.lit(BASE)).cast("decimal(38,0)") + c.getField("l0")
    return F.when(~high, value.cast("decimal(38,0)"))


def to_double(c, carried: bool = False) -> Column:
    """The nearest double below 2^126, beyond it correct to about 1e-15."""
    c = _col(c)
    total = F.lit(0.0)
    for k, name in enumerate((("l4",) if carried else ()) + LIMBS):
        power = 64 * (3 - k + (1 if carried else 0))
        total = total + c.getField(name).cast("double") * F.lit(float(2 ** power))
    return F.coalesce(to_decimal(c, carried).cast("double"), total)


def to_hex(c, carried: bool = False) -> Column:
    """All digits, 16 per limb."""
    c = _col(c)
    return F.concat(*(F.lpad(F.conv(c.getField(name).cast("string"), 10, 16), 16, "0")
                      for name in (("l4",) if carried else ()) + LIMBS))
