"""Word shingles of many texts at once, as 64-bit hashes in numpy arrays."""

from __future__ import annotations

import numpy as np

_R = np.random.default_rng(20240229)
#: Factors for the bytes of a word by place (longer words wrap round) and for the words of a shingle.
BYTE_FACTORS = _R.integers(1, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
WORD_FACTORS = _R.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Words hashed at once.
BLOCK = 1 << 14


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers (multiply and shift, a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each white-space-parted lower-cased word, first word of each text and the end)."""
    raw = [t.lower().encode() for t in texts]
    sizes = np.array([len(r) + 1 for r in raw])
    data = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
    inside = data > 32
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    first = np.searchsorted(start, np.concatenate([[0], np.cumsum(sizes)]))
    if len(start) == 0:
        return np.empty(0, np.uint64), first
    out = np.empty(len(start), np.uint64)
    for at in range(0, len(start), BLOCK):   # by blocks: the numbers for each byte take many times the text
        s, e = start[at:at + BLOCK], end[at:at + BLOCK]
        here = slice(s[0], e[-1])
        place = np.arange(s[0], e[-1]) - np.repeat(s, np.diff(np.append(s, e[-1])))
        part = np.where(inside[here], (data[here].astype(np.uint64) + np.uint64(1)) * BYTE_FACTORS[place & 4095], np.uint64(0))
        out[at:at + BLOCK] = mix(np.add.reduceat(part, s - s[0]) + (e - s).astype(np.uint64))
    return out, first


def shingles(texts: list[str], words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hash, text number) for every run of ``words`` words; a shorter text with words is one shingle."""
    h, first = word_hashes(texts)
    n = np.diff(first)
    if len(h) == 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    padded = np.concatenate([h, np.zeros(words, np.uint64)])
    text = np.repeat(np.arange(len(texts)), n)
    left = np.repeat(first[1:], n) - np.arange(len(h))  # words from here to the text's end
    total = np.zeros(len(h), np.uint64)
    for j in range(words):
        total += np.where(left > j, padded[j:j + len(h)] * WORD_FACTORS[j], np.uint64(0))
    starts = np.arange(len(h)) - np.repeat(first[:-1], n)
    use = (left >= words) | (starts == 0)
    return mix(total[use]), text[use]


def counted(hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, hash) with how often each occurs, ordered by both."""
    order = np.lexsort((hashes, text))
    h, t = hashes[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    at = np.flatnonzero(new)
    return h[at], t[at], np.diff(np.append(at, len(h)))


def compare(a: list[str], b: list[str], words: int = 5, weighted: bool = True):
    """Shingle multisets (or sets) of each pair of texts: (size of a, size of b, common, excess, pair).

    ``excess`` holds a number for each copy of a shingle that b has beyond a's
    copies, ``pair`` the pair it belongs to.
    """
    n = len(a)
    h, t, c = counted(*shingles(a + b, words))
    if not weighted:
        c = np.ones_like(c)
    total = np.bincount(t, weights=c, minlength=2 * n)
    pair, side = t % n, t // n
    order = np.lexsort((side, h, pair))
    h, pair, side, c = h[order], pair[order], side[order], c[order]
    both = np.flatnonzero((h[1:] == h[:-1]) & (pair[1:] == pair[:-1])) if len(h) else np.empty(0, int)
    common = np.bincount(pair[both], weights=np.minimum(c[both], c[both + 1]), minlength=n) if len(both) else np.zeros(n)
    over = np.where(side == 1, c, 0)
    over[both + 1] = np.maximum(0, c[both + 1] - c[both])
    row = np.repeat(np.arange(len(h)), over)
    copy = np.arange(len(row)) - np.repeat(np.cumsum(over) - over, over)
    excess = mix(h[row] + (copy + 1).astype(np.uint64) * WORD_FACTORS[0])
    return total[:n], total[n:], common, excess, pair[row]


def overlap(a: list[str], b: list[str], words: int = 5, weighted: bool = True) -> np.ndarray:
    """Jaccard similarity of the shingle multisets (or sets) of each pair of texts; 0 if either has no words."""
    x, y, common, _, _ = compare(a, b, words, weighted)
    return np.where((x > 0) & (y > 0), common / np.maximum(x + y - common, 1), 0.0)


def parcels(texts: list, limit: int = 2 << 20):
    """Ranges of neighbouring texts of about ``limit`` characters; a longer text is alone."""
    return ranges([len(t) for t in texts], limit)


def ranges(sizes: list[int], limit: int):
    """Ranges of neighbouring rows whose sizes add up to about ``limit``; a larger row is alone."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if len(sizes):
        yield start, len(sizes)
