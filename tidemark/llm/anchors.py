"""Content-defined anchors: positions that equal passages share.

Of the byte runs of length ``gram`` inside each window of ``window`` bytes, the one with the least hash is an
anchor. Which one it is depends on the window's bytes only, so equal windows have equal anchors at equal places.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: Bytes of a key; the highest bit is left to the users of keys.
KEY_BITS = 47
KEY_MASK = np.uint64((1 << KEY_BITS) - 1)
#: Bytes that are worked on at once; positions inside such a piece take 24 bits.
PIECE = 1 << 18
_PLACE = np.uint64((1 << 24) - 1)
_ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` bytes from each position on; bytes beyond the end count as 0."""
    n = len(data)
    padded = np.zeros(n + gram + 16, np.uint8)
    padded[:n] = data
    words = np.ndarray((n + gram,), "<u8", padded, strides=(1,)).copy()
    mixed = np.zeros(n, np.uint64)
    for k, at in enumerate(range(0, gram - 7, 8)):
        mixed += words[at : at + n] * _ODD[k % 3]
        mixed ^= mixed >> np.uint64(31)
    if gram % 8:
        mixed += words[gram - 8 : gram - 8 + n] * _ODD[2]
        mixed ^= mixed >> np.uint64(29)
    mixed *= _ODD[3]
    return mixed ^ (mixed >> np.uint64(32))


def _least(values: np.ndarray, size: int) -> np.ndarray:
    """Minimum of each run of ``size`` values."""
    have = 1
    while have * 2 <= size:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    return np.minimum(values[: len(values) - (size - have)], values[size - have :]) if have < size else values


def anchors(texts: Sequence[bytes], window: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, key, place, first, last) of the anchors of all texts, in pieces; a text may be of any length.

    ``first`` and ``last`` are the starts of the windows that have the anchor at ``place``; each window of each
    text has one anchor.
    """
    held: list[tuple[int, int, bytes]] = []
    size = 0
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - window + 1), PIECE):
            part = text[at : at + PIECE + window - 1] if at or len(text) > PIECE + window - 1 else text
            if len(part) < window:
                continue
            if size and size + len(part) > PIECE:
                yield _of(held, window, gram)
                held, size = [], 0
            held.append((i, at, part))
            size += len(part)
    if held:
        yield _of(held, window, gram)


def _of(held: list[tuple[int, int, bytes]], window: int, gram: int) -> tuple[np.ndarray, ...]:
    data = np.frombuffer(b"".join(p for _, _, p in held), np.uint8)
    ends = np.cumsum([len(p) for _, _, p in held])
    starts = np.r_[0, ends[:-1]]
    mixed = hashes(data, gram)
    packed = (mixed & ~_PLACE) | np.arange(len(mixed), dtype=np.uint64)
    least = _least(packed, window - gram + 1)
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    inside[ends - window + 1] -= 1
    open_ = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)[: len(least)]
    at = np.flatnonzero(open_)
    place = (least[at] & _PLACE).astype(np.int64)
    new = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    place, first, last = place[new], at[new], at[np.r_[new[1:], len(at)] - 1]
    piece = np.searchsorted(ends, place, "right")
    rows, offsets = (np.array([h[k] for h in held], np.int64) for k in (0, 1))
    move = offsets[piece] - starts[piece]
    return rows[piece], mixed[place] & KEY_MASK, place + move, first + move, last + move
