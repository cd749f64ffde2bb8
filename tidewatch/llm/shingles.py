"""Words and five-word shingles of texts as 64-bit hashes, computed on bytes in bulk.

Words are maximal runs of bytes other than blank and 09-0D, with A-Z in lower case.  A word's hash is a
polynomial over randomly coded bytes, a shingle's one over its words' hashes; both are the same for every
text, so hashes can be compared across tasks.  Polynomials modulo 2**64 are equal for some pairs of very long
words whatever the codes, so words beyond ``LONG_WORD`` bytes have a cryptographic hash.
"""

from __future__ import annotations

import hashlib

import numpy as np

SHINGLE = 5
GROUP = 1 << 18         # bytes hashed at once
LONG_WORD = 256

_rng = np.random.default_rng(20260101)
_fold = np.arange(256)
_fold[65:91] += 32
_CODE = (_rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1))[_fold]
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15
_STEP = _rng.integers(0, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` or more powers of the base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, GROUP + (1 << 17))
        _powers[:] = []
        for base in (_BASE, pow(_BASE, -1, 2**64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers.append(np.multiply.accumulate(steps))
    return _powers[0][:n], _powers[1][:n]


def _hash_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, hash) of every word."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    blank = _BLANK[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]])))
    start, end = edge[::2], edge[1::2]
    up, down = powers(len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_CODE[raw] * up, out=total[1:])
    hashes = mix((total[end] - total[start]) * down[start])
    for i in np.flatnonzero(end - start > LONG_WORD).tolist():
        word = data[start[i]:end[i]].lower()            # of bytes: A-Z only
        hashes[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    return start, hashes


def _pieces(text: bytes):
    """A long text in pieces that end at blanks, so that the working memory stays small."""
    at = 0
    while len(text) - at > 2 * GROUP:
        cut = at + GROUP
        found = min((k for k in (text.find(c, cut) for c in (b" ", b"\n", b"\t", b"\r", b"\v", b"\f")) if k >= 0),
                    default=len(text))
        yield text[at:found]
        at = found
    yield text[at:]


def words(texts: list[bytes]) -> list[np.ndarray]:
    """Word hashes of each text, in order."""
    out: list[np.ndarray] = []
    group: list[bytes] = []
    size = 0

    def flush():
        start, hashes = _hash_words(b" ".join(group))
        ends = np.cumsum([len(t) + 1 for t in group])
        out.extend(np.split(hashes, np.searchsorted(start, ends)[:-1]))
        group.clear()

    for text in texts:
        if len(text) > 2 * GROUP:
            if group:
                flush()
            out.append(np.concatenate([_hash_words(p)[1] for p in _pieces(text)]))
            size = 0
            continue
        group.append(text)
        size += len(text) + 1
        if size > GROUP:
            flush()
            size = 0
    if group:
        flush()
    return out


def shingle_set(word_hashes: np.ndarray) -> np.ndarray:
    """Sorted distinct shingle hashes; a text of fewer words than a shingle has one, of all its words."""
    n = len(word_hashes)
    if not n:
        return word_hashes
    if n < SHINGLE:
        return mix(np.array([(word_hashes * _STEP[:n]).sum(dtype=np.uint64) + np.uint64(n)], np.uint64))
    m = n - SHINGLE + 1
    total = word_hashes[:m] * _STEP[0]
    for k in range(1, SHINGLE):
        total = total + word_hashes[k:k + m] * _STEP[k]
    found = np.sort(mix(total))
    return found[np.concatenate([[True], found[1:] != found[:-1]])]
