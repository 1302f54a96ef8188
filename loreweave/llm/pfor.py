"""Patched frame-of-reference coding of token ids, vectorised over blocks.

A payload, little-endian throughout: magic ``LWP1``; ids per block, blocks, exceptions (u32 each); ids (u64); then by
block its minimum (u32), its width (u8), where its bits start (u32, one more than blocks) and where its exceptions
start (u32, one more than blocks); the packed bits; the exceptions' places in their blocks (u16) and values (u32).
A block is its ids less its minimum, packed at the width that holds the given percentile of them; those that need more
bits are exceptions. The two start arrays are the block index: decode_range() touches only the blocks it needs.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC, BLOCK, PERCENTILE = b"LWP1", 256, 0.95
_HEAD = struct.Struct("<4sIIIQ")


def _widths(x: np.ndarray) -> np.ndarray:
    """Bits that each number takes, 0 for 0."""
    return np.where(x > 0, np.floor(np.log2(np.maximum(x, 1).astype(np.float64))).astype(np.int64) + 1, 0)


def _packed(rows: np.ndarray, w: int) -> np.ndarray:
    """The low w bits of each number, most significant first, rows of whole bytes."""
    if w in (8, 16, 32):
        return np.ascontiguousarray(rows.astype(f">u{w // 8}")).view(np.uint8)
    kind, bits = _wide(w)
    some = np.unpackbits(rows.astype(kind).view(np.uint8).reshape(rows.size, bits // 8), axis=1)[:, bits - w :]
    return np.packbits(some.reshape(len(rows), rows.shape[1] * w), axis=1)


def _unpacked(taken: np.ndarray, w: int, block: int) -> np.ndarray:
    if w in (8, 16, 32):
        return taken.view(f">u{w // 8}")
    kind, bits = _wide(w)
    some = np.zeros((len(taken) * block, bits), np.uint8)
    some[:, bits - w :] = np.unpackbits(taken, axis=1)[:, : block * w].reshape(len(taken) * block, w)
    return np.packbits(some, axis=1).view(kind).reshape(len(taken), block)


def _wide(w: int) -> tuple[str, int]:
    return (">u2", 16) if w <= 16 else (">u4", 32)


def encode(ids: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> bytes:
    ids = np.asarray(ids, dtype=np.uint32)
    n = len(ids)
    blocks = -(-n // block)
    padded = np.empty(blocks * block, dtype=np.uint32)
    padded[:n] = ids
    if blocks:
        padded[n:] = ids[-1]
    rows = padded.reshape(blocks, block)
    least = rows.min(axis=1) if blocks else np.zeros(0, np.uint32)
    rest = rows - least[:, None]
    at = min(block - 1, max(0, int(np.ceil(percentile * block)) - 1))
    width = _widths(np.partition(rest, at, axis=1)[:, at]) if blocks else np.zeros(0, np.int64)
    over = rest > ((1 << width) - 1)[:, None]
    row, place = np.nonzero(over)
    values = rest[over]
    rest = np.where(over, 0, rest)
    starts = np.zeros(blocks + 1, np.int64)
    np.cumsum(-(-block * width // 8), out=starts[1:])
    body = np.zeros(starts[-1], np.uint8)
    for w in np.unique(width):
        if w:
            of = np.flatnonzero(width == w)
            packed = _packed(rest[of], int(w))
            body[starts[of][:, None] + np.arange(packed.shape[1])] = packed
    exceptions = np.zeros(blocks + 1, np.int64)
    np.cumsum(np.bincount(row, minlength=blocks), out=exceptions[1:])
    return b"".join([
        _HEAD.pack(MAGIC, block, blocks, len(values), n), least.astype("<u4").tobytes(), width.astype(np.uint8).tobytes(), starts.astype("<u4").tobytes(),
        exceptions.astype("<u4").tobytes(), body.tobytes(), place.astype("<u2").tobytes(), values.astype("<u4").tobytes(),
    ])


def decode_range(payload: bytes, first: int, last: int) -> np.ndarray:
    """Ids first to last (exclusive) of a payload, as unsigned 32-bit integers."""
    magic, block, blocks, n_over, n = _HEAD.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("not a payload of this format")
    first, last = max(0, first), min(last, n)
    if first >= last:
        return np.zeros(0, np.uint32)
    at = _HEAD.size
    parts = []
    for kind, count in (("<u4", blocks), ("<u1", blocks), ("<u4", blocks + 1), ("<u4", blocks + 1)):
        parts.append(np.frombuffer(payload, kind, count, at))
        at += parts[-1].nbytes
    least, width, starts, exceptions = parts
    body = np.frombuffer(payload, np.uint8, int(starts[-1]), at)
    at += body.nbytes
    place = np.frombuffer(payload, "<u2", n_over, at)
    values = np.frombuffer(payload, "<u4", n_over, at + place.nbytes)
    lo, hi = first // block, -(-last // block)
    out = np.zeros((hi - lo, block), np.uint32)
    for w in np.unique(width[lo:hi]):
        if w:
            of = np.flatnonzero(width[lo:hi] == w)
            taken = body[starts[lo:hi][of].astype(np.int64)[:, None] + np.arange(-(-block * int(w) // 8))]
            out[of] = _unpacked(taken, int(w), block)
    own = slice(int(exceptions[lo]), int(exceptions[hi]))
    row = np.repeat(np.arange(hi - lo), np.diff(exceptions[lo : hi + 1].astype(np.int64)))
    out[row, place[own]] = values[own]
    out += least[lo:hi, None]
    return out.reshape(-1)[first - lo * block : last - lo * block]


def decode(payload: bytes) -> np.ndarray:
    return decode_range(payload, 0, _HEAD.unpack_from(payload)[4])
