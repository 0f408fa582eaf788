"""Packing of 1-, 2- and 4-bit codes into bytes, little-endian within a byte."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.column import Column

from quillgraph.functions.planning import PACKED_BITS, check_bits


def pack(codes: Column, dim: int, bits: int) -> Column:
    """Array of bytes (0-255) of an array of codes: code i of a byte takes bits [bits*i, bits*(i+1)); the tail is zero."""
    per, mask = 8 // check_bits(bits, PACKED_BITS), (1 << bits) - 1
    filled = F.concat(codes.cast("array<int>"), F.array_repeat(F.lit(0), -dim % per))

    def byte(own: Column, b: Column) -> Column:
        parts = [F.shiftleft(F.element_at(own, b * per + i + 1).bitwiseAND(F.lit(mask)), bits * i) for i in range(per)]
        out = parts[0]
        for p in parts[1:]:
            out = out.bitwiseOR(p)
        return out

    return F.transform(F.array(filled), lambda own: F.transform(F.sequence(F.lit(0), F.lit(-(-dim // per) - 1)), lambda b: byte(own, b)))[0]  # the codes are made once


def unpack(packed: Column, dim: int, bits: int) -> Column:
    """Array of ``dim`` codes of an array of bytes, which is read once."""
    per, mask = 8 // check_bits(bits, PACKED_BITS), (1 << bits) - 1
    each = lambda byte: F.array(*[F.shiftright(byte, bits * i).bitwiseAND(F.lit(mask)) for i in range(per)])
    return F.slice(F.flatten(F.transform(packed.cast("array<int>"), each)), 1, dim)
