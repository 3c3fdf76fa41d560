"""Hashes of words and word shingles for whole texts, vectorised over the bytes.

A word is a run of bytes other than space and \\x09-\\x0D after A-Z are lower-cased. Texts of any length are cut into
pieces at white space, so memory follows the piece and not the text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import xxhash

PIECE = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _byte_values() -> np.ndarray:
    values = np.array([xxhash.xxh3_64_intdigest(bytes([b]), seed=77) for b in range(256)], dtype=np.uint64)
    values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
    return values


_VALUES = _byte_values()
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, PIECE + 1), base, dtype=np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if len(have) <= 2 * PIECE:
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _hash_piece(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a piece, and where they start."""
    if not len(data):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    space = _SPACE[data]
    edge = np.empty(len(data) + 1, bool)
    edge[0], edge[-1] = not space[0], not space[-1]
    np.not_equal(space[1:], space[:-1], out=edge[1:-1])
    at = np.flatnonzero(edge)
    starts, ends = at[0::2], at[1::2]
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * _power(_BASE, len(data)), out=total[1:])
    h = (total[ends] - total[starts]) * _power(_INVERSE, len(data) + 1)[starts]
    return mix(h + (ends - starts).astype(np.uint64)), starts


def _cut(text: bytes) -> Iterator[bytes]:
    """Pieces of about PIECE bytes that end at white space."""
    at = 0
    while len(text) - at > PIECE:
        end = at + PIECE
        while end < len(text) and not _SPACE[text[end]]:
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def words_of(texts: Iterable[bytes]) -> Iterator[np.ndarray]:
    """The word hashes of each text, in order; small texts are hashed together."""
    held: list[bytes] = []
    size = 0

    def flush() -> Iterator[np.ndarray]:
        if held:
            h, starts = _hash_piece(np.frombuffer(b"\n".join(held), np.uint8))
            ends = np.cumsum([len(x) + 1 for x in held])
            yield from np.split(h, np.searchsorted(starts, ends[:-1]))
            held.clear()

    for text in texts:
        if size + len(text) > PIECE:
            yield from flush()
            size = 0
        if len(text) > PIECE:
            yield np.concatenate([_hash_piece(np.frombuffer(x, np.uint8))[0] for x in _cut(text)])
        else:
            held.append(text)
            size += len(text) + 1
    yield from flush()


def shingles_of(words: np.ndarray, k: int) -> np.ndarray:
    """The distinct hashes of k words in a row, sorted; of all words if there are fewer; none without words."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    take = min(k, n)
    h = words[: n - take + 1] + np.uint64(take)
    for j in range(1, take):
        h = h * np.uint64(0xD6E8FEB86659FD93) + words[j : n - take + 1 + j]
    return np.unique(mix(h))
