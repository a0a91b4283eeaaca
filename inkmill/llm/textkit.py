"""Vectorised word and shingle hashing over batches of whole texts (numpy, no per-word Python).

Words are maximal runs of bytes other than space and 0x09-0x0D.  A batch of texts is laid out as one
byte buffer.  A word's hash is the sum of one random number for each byte and its place in the word
(tabulation hashing: no structure in words makes two of them collide), taken from one cumulative sum,
so a batch costs a handful of passes over its bytes whatever the number of words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U64 = np.uint64
_SEP = np.zeros(256, dtype=bool)
_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
# ASCII letters and digits, ASCII signs other than the apostrophe, and all else
_KIND = np.full(256, 3, dtype=np.uint8)
_KIND[[b for b in range(128) if chr(b).isalnum()]] = 1
_KIND[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "'"]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the splitmix64 finaliser)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: The random number of each of the first places in a word and each byte; those of later places are made alike.
_PLACES = 1 << 9
_STRETCH = 1 << 18
_TABLE = mix(np.arange(_PLACES << 8, dtype=np.uint64) + U64(0x6A09E667F3BCC909))


def span_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each span start:end of bytes, wherever it lies; spans do not overlap."""
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    size = end - start
    ends = np.cumsum(size)
    out = np.empty(len(start), dtype=np.uint64)
    begin = 0
    while begin < len(start):  # some spans at a time, so that little memory is touched
        base = int(ends[begin - 1]) if begin else 0
        stop = max(begin + 1, int(np.searchsorted(ends, base + _STRETCH, side="right")))
        n, last = size[begin:stop], ends[begin:stop] - base
        place = np.arange(last[-1]) - np.repeat(last - n, n)
        key = (place << 8) | values[place + np.repeat(start[begin:stop], n)]
        own = _TABLE[key] if int(n.max()) <= _PLACES else mix(key.astype(np.uint64) + U64(0x6A09E667F3BCC909))
        total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(own, dtype=np.uint64)))
        out[begin:stop] = mix((total[last] - total[last - n]) ^ n.astype(np.uint64))
        begin = stop
    return out


class Words:
    """The words of a batch of texts.

    ``hash[i]`` identifies word i, ``start``/``end`` are byte offsets in ``buf``; the words of text t
    are ``first[t]:first[t + 1]``.  None counts as an empty text.  With ``parts`` words are cut further
    between an ASCII letter or digit and an ASCII sign other than the apostrophe.
    """

    def __init__(self, texts: list[str | None], lower: bool = False, parts: bool = False):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        lengths = np.fromiter((len(r) + 1 for r in raw), dtype=np.int64, count=len(raw))
        self.buf = np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)
        ends = np.cumsum(lengths)
        if lower:
            self.buf = _LOWER[self.buf]
        sep = _SEP[self.buf]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], sep)).view(np.int8)))
        self.start, self.end = edge[0::2], edge[1::2]
        if parts:
            kind = _KIND[self.buf]
            cut = np.flatnonzero((kind[1:] ^ kind[:-1]) == 3) + 1  # 1 beside 2
            cut = cut[~sep[cut] & ~sep[cut - 1]]
            self.start, self.end = np.sort(np.concatenate((self.start, cut))), np.sort(np.concatenate((self.end, cut)))
        self.first = np.concatenate(([0], np.searchsorted(self.start, ends)))
        self.hash = span_hash(self.buf, self.start, self.end)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive items of h; the last k - 1 places are not meaningful."""
    out = np.zeros_like(h)
    n = len(h) - k + 1
    if n > 0:
        acc = h[:n].copy()
        for j in range(1, k):  # not a polynomial: the shift keeps regular sequences of words apart
            acc ^= acc >> U64(31)
            acc *= U64(0xD6E8FEB86659FD93)
            acc += h[j : j + n]
        out[:n] = mix(acc)
    return out


def run_valid(first: np.ndarray, n_words: int, k: int) -> np.ndarray:
    """True where k consecutive words from this one lie in one text."""
    ok = np.zeros(n_words, dtype=bool)
    if n_words:
        last = np.repeat(first[1:], np.diff(first))
        ok[:] = np.arange(n_words) + k <= last
    return ok


def slices(sizes: list[int], limit: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Cut a batch into stretches of about ``limit`` characters; one text is never cut."""
    begin, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)
