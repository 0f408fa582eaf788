"""Pure planning functions: codec choice, bit widths and cache allocation."""

from __future__ import annotations

from dataclasses import dataclass

#: Code widths in bits.
CODE_BITS = (1, 2, 4, 8, 16)
#: Widths that are packed into bytes.
PACKED_BITS = (1, 2, 4)


def check_bits(bits: int, allowed: tuple[int, ...] = CODE_BITS) -> int:
    """The width if it is allowed."""
    if bits not in allowed:
        raise ValueError(f"bits must be one of {allowed}, not {bits}")
    return bits


@dataclass(frozen=True)
class CodecLevel:
    """One level of a codec: method ``sq`` or ``vq`` with its parameters."""

    level: int
    method: str
    column_slice: int
    bits: int | None = None
    n_clusters: int | None = None


def plan_codec(dim: int, element_bits: int, ratio: int, n_clusters: int = 128, groups: int = 1, with_seeds: bool = False) -> list[CodecLevel]:
    """Levels for a target ratio: a precise one for seed nodes, if any, and the general one.

    Column slices of scalar levels are the dimension over ``groups``, rounded up to a multiple of 8.
    A ratio up to the element's bits gives scalar codes of bits / ratio; beyond, cluster ids over
    slices of ratio / element bytes, of twice that for ids of two bytes.
    """
    slice8 = -(-(-(-dim // groups)) // 8) * 8
    levels = [CodecLevel(0, "sq", slice8, bits=check_bits(element_bits // 8))] if with_seeds else []
    at = len(levels)
    if ratio <= element_bits:
        levels.append(CodecLevel(at, "sq", slice8, bits=check_bits(element_bits // ratio)))
        return levels
    if n_clusters > 32767:
        raise ValueError("ids of more than 32767 clusters cannot be decoded")
    width = ratio // (element_bits // 8) * (2 if n_clusters >= 257 else 1)
    levels.append(CodecLevel(at, "vq", width, n_clusters=n_clusters))
    return levels


def compressed_bytes(dim: int, level: CodecLevel) -> int:
    """Bytes that a row's codes take."""
    if level.method == "sq":
        return -(-dim * level.bits // 8)
    return -(-dim // level.column_slice) * (1 if level.n_clusters <= 256 else 2)


def allocate(capacity: float, weights: list[float], limits: list[float], rounds: int = 11, spare: int = 4) -> list[int]:
    """Split a capacity in proportion to weights, no part above its limit; what a full part leaves is dealt out again.

    Every round deals out the share not yet dealt, in proportion to the weights of all parts, to
    those still open. It ends once all is dealt, all are full, or after ``rounds``.
    """
    if capacity <= 0 or sum(weights) <= 0:
        return [0 for _ in weights]
    caps = [limit / capacity for limit in limits]
    shares, closed = [0.0] * len(weights), set()
    for _ in range(rounds):
        left = 1.0 - sum(shares)
        if left <= 1e-5 or len(closed) == len(weights):
            break
        for i in sorted(set(range(len(weights))) - closed):
            more = left * weights[i] / sum(weights)
            if shares[i] + more < caps[i]:
                shares[i] += more
            else:
                shares[i] = caps[i]
                closed.add(i)
    return [int(capacity * s) + spare for s in shares]
