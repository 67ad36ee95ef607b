"""CRC-32C of many byte strings at once, with numpy, and its masked form."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

POLYNOMIAL = 0x82F63B78  # Castagnoli, reflected
MASK_DELTA = 0xA282EAD8
BLOCK = 512

_W = np.uint32


@lru_cache(maxsize=1)
def _tables() -> np.ndarray:
    """Row k: the register after a byte and k zero bytes."""
    first = np.arange(256, dtype=_W)
    for _ in range(8):
        first = np.where(first & 1, (first >> _W(1)) ^ _W(POLYNOMIAL), first >> _W(1))
    rows = [first]
    for _ in range(7):
        rows.append(first[rows[-1] & _W(255)] ^ (rows[-1] >> _W(8)))
    return np.array(rows)


@lru_cache(maxsize=64)
def _zeros(log2_bytes: int) -> np.ndarray:
    """What 2**n zero bytes make of a register, by each of its four bytes."""
    values = np.arange(256, dtype=_W)[None, :] << (np.arange(4, dtype=_W) * _W(8))[:, None]
    if log2_bytes == 0:
        return _tables()[0][values & _W(255)] ^ (values >> _W(8))
    half = _zeros(log2_bytes - 1)
    return _apply(half, _apply(half, values))


def _apply(table: np.ndarray, register: np.ndarray) -> np.ndarray:
    out = table[0][register & _W(255)]
    for k in range(1, 4):
        out = out ^ table[k][(register >> _W(8 * k)) & _W(255)]
    return out


def crc32c(parts: list[bytes]) -> np.ndarray:
    """The checksums as unsigned 32-bit integers.

    Each string is cut into blocks, filled up with zeros in front (which leave an empty register as it
    is); all blocks run at once and are then joined, block after block, with a shift of one block.
    """
    if not parts:
        return np.empty(0, _W)
    lengths = np.array([len(p) for p in parts], np.int64)
    blocks = -(-lengths // BLOCK)
    gaps = blocks * BLOCK - lengths
    data = b"".join(x for p, gap in zip(parts, gaps.tolist(), strict=True) for x in (bytes(gap), p))
    words = np.frombuffer(data, "<u8").reshape(-1, BLOCK // 8)
    table = _tables()
    register = np.zeros(len(words), _W)
    for k in range(BLOCK // 8):
        x = words[:, k] ^ register
        register = table[7][x & np.uint64(255)]
        for byte in range(1, 8):
            register = register ^ table[7 - byte][(x >> np.uint64(8 * byte)) & np.uint64(255)]
    first = np.cumsum(blocks) - blocks
    shift = _zeros(BLOCK.bit_length() - 1)
    out = np.zeros(len(parts), _W)
    for k in range(int(blocks.max())):
        more = np.flatnonzero(blocks > k)
        out[more] = _apply(shift, out[more]) ^ register[first[more] + k]
    start = np.full(len(parts), 0xFFFFFFFF, _W)
    for bit in range(int(lengths.max()).bit_length()):
        has = np.flatnonzero(lengths >> bit & 1)
        start[has] = _apply(_zeros(bit), start[has])
    return out ^ start ^ _W(0xFFFFFFFF)


@lru_cache(maxsize=1)
def _byte_table() -> list[int]:
    return _tables()[0].tolist()


def crc32c_of_few(data: bytes) -> int:
    """The checksum of a few bytes, one after the other; ``crc32c`` is for many or long strings."""
    register, table = 0xFFFFFFFF, _byte_table()
    for byte in data:
        register = table[(register ^ byte) & 255] ^ register >> 8
    return register ^ 0xFFFFFFFF


def masked(crc: np.ndarray) -> np.ndarray:
    """Checksums of data that may hold checksums: rotated right by 15 bits, plus a constant."""
    crc = crc.astype(_W)
    return (crc >> _W(15) | crc << _W(17)) + _W(MASK_DELTA)
