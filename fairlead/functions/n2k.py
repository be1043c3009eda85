"""NMEA 2000 identifiers and the four mapped messages as column expressions (M27, M28, PGN decoding)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fairlead.functions.units import KN_TO_MS

POSITION, COURSE_SPEED, ENGINE_RAPID, ENGINE_DYNAMIC = 129025, 129026, 127488, 127489


def _bits(x: Column, shift: int, mask: int) -> Column:
    return F.shiftrightunsigned(x, shift).bitwiseAND(F.lit(mask))


def split_id(can_id: Column) -> dict[str, Column]:
    """priority, pgn, source_address, destination_address (null for messages to all) of a 29-bit identifier."""
    x = can_id.cast("long")
    form, specific, page = _bits(x, 16, 0xFF), _bits(x, 8, 0xFF), _bits(x, 24, 1)
    to_all = form >= 240
    pgn = F.shiftleft(page, 16).bitwiseOR(F.shiftleft(form, 8)).bitwiseOR(F.when(to_all, specific).otherwise(0).cast("long"))
    return {
        "priority": _bits(x, 26, 7).cast("int"), "pgn": pgn.cast("int"), "source_address": _bits(x, 0, 0xFF).cast("int"),
        "destination_address": F.when(~to_all, specific).cast("int")}


def join_id(priority: Column, pgn: Column, source: Column) -> Column:
    p = pgn.cast("long")
    form = _bits(p, 8, 0xFF)
    specific = F.when(form >= 240, p.bitwiseAND(F.lit(0xFF))).otherwise(0).cast("long")
    parts = [(priority.cast("long").bitwiseAND(F.lit(7)), 26), (_bits(p, 16, 1), 24), (form, 16), (specific, 8), (source.cast("long").bitwiseAND(F.lit(0xFF)), 0)]
    out = F.lit(0).cast("long")
    for value, shift in parts:
        out = out.bitwiseOR(F.shiftleft(value, shift))
    return out


def unsigned(data: Column, start: int, size: int) -> Column:
    """Little-endian number in ``size`` bytes from ``start``; null if the data are shorter or it is the no-data value."""
    text = F.concat(*[F.hex(F.substring(data, start + size - i, 1)) for i in range(size)])
    value = F.conv(text, 16, 10).cast("long")
    return F.when((F.octet_length(data) >= start + size) & (value != (1 << 8 * size) - 1), value)


def signed(data: Column, start: int, size: int) -> Column:
    """As ``unsigned``, in two's complement; the largest positive number is the no-data value."""
    text = F.concat(*[F.hex(F.substring(data, start + size - i, 1)) for i in range(size)])
    value = F.conv(text, 16, 10).cast("long")
    half, whole = 1 << 8 * size - 1, 1 << 8 * size
    return F.when((F.octet_length(data) >= start + size) & (value != half - 1), F.when(value >= half, value - whole).otherwise(value))


def decode(pgn: Column, data: Column) -> dict[str, Column]:
    """Fields of the mapped messages, null where the message does not carry them."""
    is_ = lambda n: pgn == n
    return {
        "lat_deg": F.when(is_(POSITION), signed(data, 0, 4) * 1e-7), "lon_deg": F.when(is_(POSITION), signed(data, 4, 4) * 1e-7),
        "cog_deg": F.when(is_(COURSE_SPEED), F.degrees(unsigned(data, 2, 2) * 1e-4)),
        "sog_kn": F.when(is_(COURSE_SPEED), unsigned(data, 4, 2) * 0.01 / KN_TO_MS),
        "engine_rpm": F.when(is_(ENGINE_RAPID), unsigned(data, 1, 2) * 0.25),
        "engine_fuel_rate_l_per_h": F.when(is_(ENGINE_DYNAMIC), signed(data, 9, 2) * 0.1)}


def mapped(pgn: Column) -> Column:
    return pgn.isin(POSITION, COURSE_SPEED, ENGINE_RAPID, ENGINE_DYNAMIC)
