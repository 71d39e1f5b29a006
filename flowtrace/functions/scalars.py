"""Column-level helpers: unit scaling, hex display, payload decoding.

All of these are built-in Spark expressions, so they stay inside
whole-stage codegen; none of them needs a Python worker.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, TimestampNTZType, TimestampType

from . import wide


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lit_number(value, exact: bool) -> Column:
    """A numeric literal: Decimal when exact arithmetic is wanted, else double."""
    if exact:
        return F.lit(Decimal(str(value)))
    return F.lit(float(value))


def scale_units(raw, decimals: int, exact: bool = False, raw_precision: int = 38,
                safe: bool = False) -> Column:
    """Raw integer token amount -> whole tokens.

    ``exact=False`` follows the dashboards: ``CAST(raw AS DOUBLE) / 10^d``.
    ``exact=True`` keeps every digit: whole tokens and the remainder are
    scaled apart, as a product of 38-digit decimals would be rounded to six
    places. The result is ``decimal(38, d)``, so up to ``38 - d`` digits of
    whole tokens; more overflow (an error, or NULL without ANSI).
    ``safe=True`` uses ``try_cast``: a raw value that does not fit (a
    uint256 beyond 38 digits stored as text) becomes NULL instead of failing
    the job under ANSI mode; :func:`flowtrace.operators.transfers.quarantined`
    returns those rows.
    """
    raw = _col(raw)
    if exact:
        kind = f"decimal({raw_precision},0)"
        units = raw.try_cast(kind) if safe else raw.cast(kind)
        if raw_precision + decimals + 1 <= 38:
            return units * F.lit(Decimal(1).scaleb(-decimals))
        base = F.lit(Decimal(10) ** decimals).cast(f"decimal({decimals + 1},0)")
        rest = units % base
        whole = ((units - rest) / base).cast(f"decimal({37 - decimals},0)")
        part = rest.cast(f"decimal({decimals},0)") * F.lit(Decimal(1).scaleb(-decimals))
        return (whole + part).cast(f"decimal(38,{decimals})")
    as_double = raw.try_cast("double") if safe else raw.cast("double")
    return as_double / F.lit(float(10 ** decimals))


def hex_upper(c) -> Column:
    """Binary -> upper-case hex without prefix (``to_hex``)."""
    return F.hex(_col(c))


def hex_0x(c) -> Column:
    """Binary -> ``0x`` + lower-case hex: how chain tooling prints a
    varbinary. Never ``cast(binary as string)``, which decodes UTF-8."""
    return F.concat(F.lit("0x"), F.lower(F.hex(_col(c))))


def shorten(c, length: int, suffix: str = "...") -> Column:
    """First ``length`` characters followed by an ellipsis."""
    return F.concat(F.substring(_col(c), 1, length), F.lit(suffix))


def bytes_to_bigint(c) -> Column:
    """Big-endian varbinary -> bigint; NULL beyond the signed 64-bit range
    (see :func:`bytes_to_decimal` for wider words)."""
    return bytes_to_decimal(c).try_cast("bigint")


def bytes_to_decimal(c) -> Column:
    """Big-endian varbinary -> decimal(38,0); leading zero bytes are allowed.

    A value of 2^126 or more doesn't fit and becomes NULL, so that one payload
    does not end the job; :mod:`flowtrace.functions.wide` holds all values of
    32 bytes.
    """
    return wide.to_decimal(wide.limbs(c))


def int_to_bytes(c, width: int) -> Column:
    """Non-negative integer -> big-endian binary of ``width`` bytes.

    The short hex form is padded as bytes (binary ``lpad``), which is about
    twice as fast as padding a 2·width-character string."""
    return F.lpad(F.unhex(F.hex(_col(c).cast("bigint"))), width, b"\x00")


def text_to_bytes(c, width: int) -> Column:
    """UTF-8 text -> binary left-padded with zero bytes to ``width`` bytes."""
    return F.lpad(_col(c).cast("binary"), width, b"\x00")


def hex_literal(text: str) -> bytes:
    """``0x…`` text -> bytes, for address and topic literals."""
    body = text[2:] if text.lower().startswith("0x") else text
    if len(body) % 2:
        body = "0" + body
    return bytes.fromhex(body)


def truncate_time(c, unit: str, like: DataType | None = None) -> Column:
    """``date_trunc`` that keeps the input's timestamp flavour.

    Spark returns a session-zone ``timestamp`` even for ``timestamp_ntz``
    input; chain tables store UTC wall-clock times, so cast back when the
    source column was ``timestamp_ntz``. ``unit='date'`` yields a DATE.
    """
    c = _col(c)
    if unit == "date":
        return F.to_date(c)
    out = F.date_trunc(unit, c)
    if isinstance(like, TimestampNTZType):
        return out.cast("timestamp_ntz")
    if isinstance(like, TimestampType) or like is None:
        return out
    return out


def round_scaled(value, power: int, digits: int, exact: bool = False) -> Column:
    """``ROUND(value / 10^power, digits)`` (report scaling, e.g. to millions).

    Exact mode rounds first at ``digits - power`` places and then shifts the
    decimal point. The shifted value has at most ``digits`` decimals, which
    Spark keeps even when a wide decimal forces it to shrink the result
    scale (never below 6), so no second rounding can creep in.
    """
    value = _col(value)
    if exact:
        shifted = F.round(value, digits - power) * F.lit(Decimal(1).scaleb(-power))
        return F.round(shifted, digits)
    return F.round(value / F.lit(float(10 ** power)), digits)
