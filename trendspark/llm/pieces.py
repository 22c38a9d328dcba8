"""Pre-tokens of byte-level BPE vocabularies for whole batches of texts, as numpy arrays.

The split is the one that ``public_tokenizers.PATTERN`` describes:

* a letter run, a number run or a run of other characters, each with one blank before it;
* the contractions 's 't 're 've 'm 'll 'd where a piece begins with the apostrophe;
* white space, of which the last character before something else is cut off (a blank goes
  to the next piece, any other white space is a piece of its own).

Characters get one of four classes from a table, pieces begin where the class changes, and the
rules above move a few of these places. So a batch costs a fixed number of array operations
and no work for each character in Python. ``tests/llm/test_tokens.py`` holds it against the
pattern itself.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

SPACE, LETTER, NUMBER, OTHER, BREAK = 0, 1, 2, 3, 4
CHUNK_CHARS = 600_000


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((SPACE, r"\s+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            out[np.frombuffer(m.group().encode("utf-32-le"), np.uint32)] = kind
    return out


#: Odd 64-bit factors of the two polynomial hashes.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse, modulo 2**64, for i < n."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            a = np.full(n, b, np.uint64)
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        have = _powers[base] = (out[0], out[1])
        if n > 4 * CHUNK_CHARS:  # a single very long text: not kept
            del _powers[base]
    return have


class Pieces:
    """The different pre-tokens of some texts, and which of them stand where.

    ``different``: the strings; ``which``: for each piece in order, its index in ``different``;
    ``text``: for each piece in order, the index of its text.
    """

    def __init__(self, texts: list[str]):
        self.n_texts = len(texts)
        joined = "\n".join([*texts, ""]) if texts else ""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        breaks = np.cumsum(lengths + 1) - 1
        cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        begin, end = bounds(cps, breaks)
        self.text = np.searchsorted(breaks, begin)
        hashes = []
        for base in BASES:
            up, down = powers(base, len(cps) + 1)
            sums = np.zeros(len(cps) + 1, np.uint64)
            np.cumsum((cps.astype(np.uint64) + np.uint64(base >> 7)) * up[: len(cps)], out=sums[1:])
            hashes.append((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64) * np.uint64(base))
        _, first, which = np.unique(hashes[0], return_index=True, return_inverse=True)
        if not np.array_equal(hashes[1][first][which], hashes[1]):  # two pieces under one hash: by the strings themselves
            seen: dict[str, int] = {}
            spans = zip(begin.tolist(), end.tolist(), strict=True)
            which = np.fromiter((seen.setdefault(joined[a:b], len(seen)) for a, b in spans), np.int64, len(begin))
            self.different = list(seen)
        else:
            self.different = [joined[a:b] for a, b in zip(begin[first].tolist(), end[first].tolist(), strict=True)]
        self.which = which

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sum for each text of a value of each different piece."""
        return np.bincount(self.text, weights=values[self.which], minlength=self.n_texts).astype(np.int64)

    def ids(self, encoded: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and how many each text has; ``encoded``: uint32 ids of each different piece."""
        size = np.fromiter(map(len, encoded), np.int64, len(encoded)) // 4
        flat = np.frombuffer(b"".join(encoded), np.uint32)
        at = np.cumsum(size) - size
        size_of, start = size[self.which], at[self.which]
        out_at = np.cumsum(size_of) - size_of
        take = np.arange(int(size_of.sum())) + np.repeat(start - out_at, size_of)
        return flat[take], self.sums(size)


def bounds(cps: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of every piece; ``breaks``: places of the one character after each text."""
    if not len(cps):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = class_table()[cps]
    kind[breaks] = BREAK
    start = np.ones(len(cps), bool)
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start[breaks] = True
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & (kind[1:] != BREAK))
    start[last] = True
    start[last[cps[last] == 32] + 1] = False
    mark = np.flatnonzero((cps[:-1] == 39) & start[:-1] & (kind[1:] == LETTER) & (kind[:-1] == OTHER))
    if len(mark):
        one = cps[mark + 1]
        two = cps[np.minimum(mark + 2, len(cps) - 1)]
        short = np.isin(one, [ord(c) for c in "stmd"])
        pair = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        start[mark[short | pair] + 1] = False
        start[mark[short] + 2] = True
        start[mark[pair] + 3] = True
    at = np.flatnonzero(start)
    end = np.append(at[1:], len(cps))
    real = kind[at] != BREAK
    return at[real], end[real]


class Bounded(dict):
    """A cache that is emptied when full, so that it stays small in a long task."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def room(self, more: int) -> None:
        if len(self) + more > self.most:
            self.clear()


class Recent(dict):
    """A cache of two generations: when the young one is full it becomes the old one, and what comes
    up again moves to the new young one. So frequent pre-tokens stay while rare ones go; at most
    twice ``most`` entries and those of one chunk are held."""

    def __init__(self, most: int = 150_000):
        super().__init__()
        self.most, self.old = most, {}

    def __missing__(self, word):
        value = self[word] = self.old[word]
        return value

    def unknown(self, words: list) -> list:
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()
        return [w for w in words if w not in self and w not in self.old]
