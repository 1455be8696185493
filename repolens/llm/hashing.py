"""Word and n-gram hashes of whole texts, vectorised over bytes.

Texts are UTF-8 bytes in which a 256-entry table has turned every separator into
a blank and lower-cased A-Z. A word's hash is a polynomial over its bytes modulo
2**64, mixed with its length; an n-gram's hash combines its word hashes by place
and is mixed again. Equal words have equal hashes on every machine.
"""

from __future__ import annotations

import numpy as np

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Words between ASCII white space.
BLANK_TABLE = bytes(32 if c == 32 or 9 <= c <= 13 else _LOWER[c] for c in range(256))
#: Words of ASCII letters, digits and everything beyond ASCII.
WORD_TABLE = bytes(_LOWER[c] if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
SEGMENT = 500_000  # a byte takes about 50 bytes of arrays while it is hashed
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_PLACE = np.uint64(0xD6E8FEB86659FD93)
_powers = np.ones(1, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        more = np.full(2 * n, _BASE)
        more[0] = 1
        _powers = np.multiply.accumulate(more)
    return _powers


def spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of translated bytes."""
    word = np.frombuffer(data, np.uint8) != 32
    edge = np.flatnonzero(np.diff(word.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return edge[::2], edge[1::2]


def _hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts, ends = spans(data)
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64)
    lengths = ends - starts
    raw = np.frombuffer(data, np.uint8)
    first = np.cumsum(lengths) - lengths
    place = np.arange(first[-1] + lengths[-1]) - np.repeat(first, lengths)
    values = (raw[raw != 32].astype(np.uint64) + np.uint64(1)) * powers(int(lengths.max()))[place]
    return starts, ends, mix(np.add.reduceat(values, first) + lengths.astype(np.uint64) * _PLACE)


def words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of translated bytes, computed in segments of bounded size."""
    if len(data) <= SEGMENT:
        return _hashes(data)
    parts, at = [], 0
    while at < len(data):
        cut = data.rfind(b" ", at, at + SEGMENT) + 1
        if cut <= at:
            cut = data.find(b" ", at + SEGMENT) + 1 or len(data)
        s, e, h = _hashes(data[at:cut])
        parts.append((s + at, e + at, h))
        at = cut
    return tuple(np.concatenate(x) for x in zip(*parts))


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place on; as many as there are whole n-grams."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(count, np.uint64)
    for j in range(n):
        total = total * _PLACE + hashes[j:j + count]
    return mix(total + np.uint64(n))


def joined(texts: list[bytes | None], table: bytes):
    """Texts translated and joined: (bytes, word starts, word ends, word hashes, index of each text's first word)."""
    shown = [t.translate(table) if t else b"" for t in texts]
    data = b" ".join(shown)
    starts, ends, hashes = words(data)
    begins = np.cumsum([0, *(len(t) + 1 for t in shown)])
    return data, starts, ends, hashes, np.searchsorted(starts, begins)


def chunks(texts: list[bytes | None], size: int = SEGMENT):
    """Index ranges of neighbouring texts of about ``size`` bytes together (a longer text alone)."""
    at, total = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if total and total + n > size:
            yield at, i
            at, total = i, 0
        total += n + 1
    if at < len(texts):
        yield at, len(texts)
