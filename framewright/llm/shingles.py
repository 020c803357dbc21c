"""Word-shingle sets of many texts at once, by numpy over their UTF-8 bytes."""

from __future__ import annotations

import re

import numpy as np

_UPPER = bytes(range(65, 91))
LOWERED = bytes.maketrans(_UPPER, _UPPER.lower())
_BLANK = re.compile(rb"[\x09-\x0d\x20]")
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_random = np.random.default_rng(20240229)
_BYTE = _random.integers(1, 1 << 63, 256, np.uint64)
BASE = int(_random.integers(1, 1 << 63)) * 2 + 1 & (1 << 64) - 1
_INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes hashed in one go.
AT_ONCE = 1 << 18


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that scatters them."""
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


_POWERS = powers(BASE, AT_ONCE + 1), powers(_INVERSE, AT_ONCE + 1)


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash for each word of lower-cased bytes; a text is cut at spaces into pieces of about AT_ONCE bytes, or one longer word."""
    out, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + AT_ONCE)
        if end < len(raw):
            cut = max(raw.rfind(s, at, end) for s in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            found = _BLANK.search(raw, end) if cut < at else None
            end = cut + 1 if cut >= at else found.end() if found else len(raw)
        b = np.frombuffer(raw, np.uint8, end - at, at)
        space = np.concatenate([[True], _SPACE[b], [True]])
        edge = np.flatnonzero(space[1:] != space[:-1])
        first, last = edge[::2], edge[1::2]
        sums = np.zeros(len(b) + 1, np.uint64)
        up, down = _POWERS if len(b) < AT_ONCE + 1 else (powers(BASE, len(b) + 1), powers(_INVERSE, len(b) + 1))
        np.cumsum(_BYTE[b] * up[: len(b)], out=sums[1:])
        out.append(mix((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_set(text: str, k: int) -> np.ndarray:
    """The sorted distinct hashes of runs of k words; fewer words are one run, no words none."""
    h = word_hashes(text.encode().translate(LOWERED))
    if not len(h):
        return h
    n = max(1, len(h) - k + 1)
    total = np.full(n, min(k, len(h)), np.uint64)
    for i in range(min(k, len(h))):
        total = mix(total * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(total)


def set_key(s: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    with np.errstate(over="ignore"):
        return np.array([s.sum(dtype=np.uint64), mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)], "<u8").tobytes()
