"""Words and word shingles of texts as 64-bit hashes, many texts at a time.

A word is a maximal run of letters, digits and underscores (`\\w+`) of the lower-cased text. Its hash is a polynomial over its
UTF-8 bytes, read off prefix sums of the whole buffer, so no Python loop runs over words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np

CHUNK = 1 << 20  # bytes hashed at once
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_ODD_CHARACTERS = re.compile(r"[^\w\x00-\x7f]")
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        inverse = pow(_BASE, -1, 1 << 64)
        ones = np.ones(n, _U)
        ones[1:] = _U(_BASE)
        _powers["up"] = np.cumprod(ones)
        ones[1:] = _U(inverse)
        _powers["down"] = np.cumprod(ones)
    return _powers["up"], _powers["down"]


def normal(text: str) -> bytes:
    """The lower-cased text with every character that is in no word, ASCII aside, as a space: then all bytes from 128 are in words."""
    text = text.lower()
    if not text.isascii():
        text = _ODD_CHARACTERS.sub(" ", text)
    return text.encode("utf-8", "replace")


def _words_of(buffer: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end (bytes) of the words of a buffer."""
    raw = np.frombuffer(buffer, np.uint8)
    n = len(raw)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = _IS_WORD[raw]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    up, down = _power_tables(n + 1)
    sums = np.zeros(n + 1, _U)
    np.cumsum((raw.astype(_U) + _U(1)) * up[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts]), starts, ends


def _pieces(buffer: bytes) -> Iterator[tuple[int, bytes]]:
    """Offset and bytes of parts of at most CHUNK bytes, cut where no word is; a longer word stays whole."""
    at, n = 0, len(buffer)
    while at < n:
        end = min(at + CHUNK, n)
        if end < n:
            cut = end
            while cut > at and _IS_WORD[buffer[cut - 1]]:
                cut -= 1
            if cut == at:
                cut = end
                while cut < n and _IS_WORD[buffer[cut]]:
                    cut += 1
            end = cut
        yield at, buffer[at:end]
        at = end


def hashes(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in order, and where each text's begin: an array of one more entry than texts."""
    sizes = np.zeros(len(texts) + 1, np.int64)
    parts: list[np.ndarray] = []
    held, first, length = [], 0, 0

    def flush(last: int) -> None:
        if not held:
            return
        buffer = b"\n".join(held)
        offsets = np.cumsum([0, *[len(b) + 1 for b in held]])
        for at, piece in _pieces(buffer):
            found, starts, _ = _words_of(piece)
            parts.append(found)
            sizes[first + 1 : last + 1] += np.diff(np.searchsorted(starts + at, offsets))
        held.clear()

    for i, t in enumerate(texts):
        b = normal(t or "")
        if held and length + len(b) > CHUNK:
            flush(i)
            first, length = i, 0
        held.append(b)
        length += len(b) + 1
    flush(len(texts))
    return (np.concatenate(parts) if parts else np.zeros(0, _U)), np.cumsum(sizes)


def grams(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` words; of the whole, if there are fewer words; none if there are none."""
    n = len(words)
    if n == 0:
        return words
    k = min(size, n)
    out = np.full(n - k + 1, k, _U)
    for j in range(k):
        out = out * _U(0xD6E8FEB86659FD93) + words[j : j + n - k + 1]
    return mix(out)


def shingles(words: np.ndarray, size: int = 5) -> np.ndarray:
    """The set of grams, ascending."""
    return np.unique(grams(words, size))
