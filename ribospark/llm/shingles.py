"""Word shingles of whole texts as 64-bit hashes, computed for many texts at once with numpy."""

from __future__ import annotations

import numpy as np

PIECE = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                p = np.full(size, base, np.uint64)
                p[0] = 1
                _powers[name] = np.cumprod(p, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over all 64."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def _pieces(data: bytes):
    """(start, end) of pieces of about ``PIECE`` bytes, cut between words."""
    a, n = 0, len(data)
    while a < n:
        end = n
        if n - a > PIECE:
            end = max(data.rfind(c, a, a + PIECE) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            end = end if end > a else n
        yield a, end
        a = end


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word, A-Z lowered."""
    starts, hashes = [], []
    for a, end in _pieces(data):
        raw = np.frombuffer(data, np.uint8, end - a, a)
        edge = np.diff(_SPACE[raw].astype(np.int8), prepend=1, append=1)
        s, e = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        up, down = _table(len(raw) + 1)
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((_LOWER[raw] + np.uint64(1)) * up[: len(raw)], dtype=np.uint64)])
            hashes.append(mix((sums[e] - sums[s]) * down[s]))
        starts.append(s + a)
    return (np.concatenate(starts), np.concatenate(hashes)) if starts else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer than ``k`` words has its whole sequence as one."""
    out, group, size = [], [], 0
    for x in texts:
        group.append(x)
        size += len(group[-1])
        if size > PIECE:
            out += _sets(group, k)
            group, size = [], 0
    return out + _sets(group, k)


def _sets(group: list[bytes], k: int) -> list[np.ndarray]:
    if not group:
        return []
    ends = np.cumsum([len(x) + 1 for x in group])
    starts, words = word_hashes(b"\n".join(group))
    last = np.searchsorted(starts, ends)
    first = np.concatenate([[0], last[:-1]])
    if len(words) >= k:
        h = np.zeros(len(words) - k + 1, np.uint64)
        with np.errstate(over="ignore"):
            for j in range(k):
                h = mix(h * np.uint64(3) + words[j : len(words) - k + 1 + j])
    out = []
    for a, b in zip(first, last, strict=True):
        if b - a >= k:
            out.append(np.unique(h[a : b - k + 1]))
        elif b > a:
            short = np.full(1, b - a, np.uint64)
            with np.errstate(over="ignore"):
                for w in words[a:b]:
                    short = mix(short * np.uint64(5) + w)
            out.append(short)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed 64-bit numbers."""
    with np.errstate(over="ignore"):
        one, two = mix(shingles + np.uint64(11)).sum(dtype=np.uint64), mix(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return tuple(int(np.uint64(x).view(np.int64)) for x in (one, two))
