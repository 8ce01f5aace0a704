"""Word and shingle hashes of many texts at once, without a Python object per word."""

from __future__ import annotations

import numpy as np

P = np.uint64(0x5851F42D4C957F2D)
P_INVERSE = np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))
#: The bytes of words, a-z and 0-9.
IN_WORD = np.zeros(256, dtype=bool)
IN_WORD[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True
BITS = 48
MASK = np.uint64((1 << BITS) - 1)

_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("p", ())) < n:
        size = max(n, 1 << 20)
        for name, base in (("p", P), ("i", P_INVERSE)):
            a = np.full(size, base, dtype=np.uint64)
            a[0] = 1
            _powers[name] = np.multiply.accumulate(a)
    return _powers["p"][:n], _powers["i"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, in order, and the place of its text. Words: runs of a-z and 0-9 of the lower-cased text."""
    blob = np.frombuffer("\0".join(t.replace("\0", " ") for t in texts).lower().encode("utf-8", "surrogatepass") + b"\0", dtype=np.uint8)
    if not len(texts):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    word = IN_WORD[blob]
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    power, inverse = _power(len(blob))
    total = np.zeros(len(blob) + 1, dtype=np.uint64)
    np.cumsum((blob.astype(np.uint64) + np.uint64(1)) * power, out=total[1:])
    h = mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))
    return h, np.searchsorted(np.flatnonzero(blob == 0), start)


def shingle_hashes(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash (48 bits) of each run of ``width`` words, the place of its text, and each text's number of words."""
    h, text = word_hashes(texts)
    count = np.bincount(text, minlength=len(texts)) if len(texts) else np.zeros(0, dtype=np.int64)
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), count
    s = h[:n]
    for k in range(1, width):
        s = mix(s) + h[k : k + n] * np.uint64(2 * k + 1)
    inside = text[:n] == text[width - 1 :]
    return mix(s[inside]) & MASK, text[:n][inside], count


def shingle_sets(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``shingle_hashes``, but each hash once a text, sorted by text and hash. At most 65,536 texts."""
    s, text, count = shingle_hashes(texts, width)
    key = np.sort((text.astype(np.uint64) << np.uint64(BITS)) | s)
    if len(key):
        key = key[np.r_[True, key[1:] != key[:-1]]]
    return key & MASK, (key >> np.uint64(BITS)).astype(np.int64), count


def slices(texts: list[str], most_bytes: int = 1 << 20, most_texts: int = 8192):
    """(from, to) of stretches of texts that stay small; a longer text comes alone."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and (size + len(t) > most_bytes or i - at >= most_texts):
            yield at, i
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, len(texts)
