"""Vectorised text kit shared by the Arrow operators.

Texts are handled as arrays of code points. A batch is walked in slices of about
``SLICE`` characters; a longer text is cut where a non-space character meets a
blank, which is a word boundary for every tokenisation used here, so memory per
slice is bounded by ``SLICE`` plus the longest unbroken word.

Words are hashed by two polynomials over the field of 2**31 - 1 elements, mixed
to 64 bits. Two different words of n characters agree with probability (n / 2**31)
squared at most; where that would change a result, callers compare the characters
as well (``differ``).
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np

SLICE = 1 << 18
U64 = np.uint64
PRIME = (1 << 31) - 1
BASES = 1_292_913_986, 1_850_600_128
#: A place where a text may be cut: before a blank that follows a non-space.
_CUT = re.compile(r"(?<=\S)[ \t\n]")

_tables: list[tuple[np.ndarray, np.ndarray]] = []

#: The blanks of the contracts: space and \x09-\x0D.
BLANK = np.zeros(0x110000, bool)
BLANK[[0x20, 9, 10, 11, 12, 13]] = True


def _folded(x: np.ndarray) -> np.ndarray:
    """x below 2**62 modulo PRIME."""
    x = (x & U64(PRIME)) + (x >> U64(31))
    x = (x & U64(PRIME)) + (x >> U64(31))
    return np.where(x >= U64(PRIME), x - U64(PRIME), x)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, U64)
    while len(out) < n:
        out = np.concatenate([out, _folded(out * U64(pow(base, len(out), PRIME)))])
    return out


def _powers_for(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers of each base and of its inverse, for spans in ``n`` characters; those of a longer text are not kept."""
    global _tables
    if _tables and len(_tables[0][0]) > n:
        return _tables
    found = [(_powers(b, max(n + 1, SLICE + 4096)), _powers(pow(b, -1, PRIME), max(n + 1, SLICE + 4096))) for b in BASES]
    if n <= 2 * SLICE:
        _tables = found
    return found


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> U64(31))
    h = h * U64(0x7FB5D329728EA185)
    h ^= h >> U64(27)
    h *= U64(0x81DADEF4BC2DD44D)
    h ^= h >> U64(33)
    return h


def mix_int(x: int) -> int:
    return int(mix(np.array([x & (2**64 - 1)], U64))[0])


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def span_hashes(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of each span of ``codes``; equal spans have equal hashes wherever they stand."""
    held = (end - start).astype(U64) * U64(0xD6E8FEB86659FD93)
    values = codes.astype(U64) + U64(1)
    total = np.zeros(len(codes) + 1, U64)
    for shift, (power, root) in zip((33, 2), _powers_for(len(codes)), strict=True):
        x = values * power[: len(codes)]
        np.cumsum((x & U64(PRIME)) + (x >> U64(31)), out=total[1:])  # terms below 2**32, so sums of 2**32 characters fit
        held ^= _folded(_folded(total[end] - total[start]) * root[start]) << U64(shift)
    return mix(held)


def spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers begin[i] .. begin[i] + size[i] - 1 of all i, one after another."""
    at = np.cumsum(size) - size
    return np.repeat(begin - at, size) + np.arange(int(size.sum()))


def differ(codes: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether each span of ``codes`` differs from the ``size`` characters of ``other`` that begin at ``begin``."""
    out = end - start != size
    same = np.flatnonzero(~out)
    n = size[same].astype(np.int64)
    unequal = codes[spread(start[same], n)] != other[spread(begin[same], n)]
    if unequal.any():
        out[same[np.repeat(np.arange(len(n)), n)[unequal]]] = True
    return out


def identities(codes: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Numbers of spans with hashes ``h`` that are equal exactly where the spans' characters are; characters are compared about SLICE at a time."""
    _, first, number = np.unique(h, return_index=True, return_inverse=True)
    known: dict[bytes, int] = {}
    for a, b in batches((end - start).tolist(), SLICE):
        one = first[number[a:b]]
        for i in (a + np.flatnonzero(differ(codes, start[a:b], end[a:b], codes, start[one], end[one] - start[one]))).tolist():
            number[i] = len(first) + known.setdefault(codes[start[i] : end[i]].tobytes(), len(known))
    return number


def slices(texts: list[str], limit: int = SLICE) -> Iterator[tuple[np.ndarray, np.ndarray, str]]:
    """Pieces of texts, joined: (document of each piece, first character of each piece and the end, joined text)."""
    docs: list[int] = []
    parts: list[str] = []
    held = 0

    def out():
        at = np.zeros(len(parts) + 1, np.int64)
        np.cumsum([len(p) for p in parts], out=at[1:])
        return np.array(docs, np.int64), at, "".join(parts)

    for i, text in enumerate(texts):
        pos, n = 0, len(text)
        while True:
            if n - pos <= limit:
                stop = n
            else:
                m = _CUT.search(text, pos + limit)
                stop = m.start() if m else n
            if held and held + stop - pos > limit:
                yield out()
                docs, parts, held = [], [], 0
            docs.append(i)
            parts.append(text[pos:stop] if pos or stop < n else text)
            held += stop - pos
            pos = stop
            if pos >= n:
                break
    if docs:
        yield out()


def runs(flag: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true, which end at ``breaks`` too."""
    before = np.empty_like(flag)
    before[:1] = False
    before[1:] = flag[:-1]
    inner = breaks[(breaks > 0) & (breaks < len(flag))]
    first = flag & ~before
    first[inner] = flag[inner]
    after = np.empty_like(flag)
    after[-1:] = False
    after[:-1] = flag[1:]
    last = flag & ~after
    last[inner - 1] = flag[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def offsets(docs: np.ndarray, n: int) -> np.ndarray:
    """Where the rows of each of ``n`` documents begin, rows being in the order of documents."""
    out = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(docs, minlength=n), out=out[1:])
    return out


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words `[^\\x20\\x09-\\x0D]+` of all texts, and where those of each text begin."""
    hashes, owners = [], []
    for docs, at, joined in slices(texts):
        codes = code_points(joined)
        start, end = runs(~BLANK[codes], at)
        hashes.append(span_hashes(codes, start, end))
        owners.append(docs[np.searchsorted(at, start, "right") - 1])
    if not hashes:
        return np.zeros(0, U64), np.zeros(len(texts) + 1, np.int64)
    return np.concatenate(hashes), offsets(np.concatenate(owners), len(texts))


def per_document(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of values between offsets."""
    total = np.zeros(len(values) + 1, values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def windows(h: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of ``n`` words inside documents, and the index of each one's first word."""
    if len(h) < n:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    size = len(h) - n + 1
    g = np.zeros(size, U64)
    for k in range(n):
        g = g * U64(0xA0761D6478BD642F) + h[k : k + size]
    end = np.repeat(off[1:], np.diff(off))[:size]
    first = np.flatnonzero(np.arange(size) + n <= end)
    return mix(g[first]), first


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers of pairs that are equal exactly where both parts are."""
    return np.unique(a * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1]


def batches(sizes: Iterable[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes come to about ``limit`` together; a larger row stands alone."""
    first, held = 0, 0
    i = -1
    for i, size in enumerate(sizes):
        if held and held + size > limit:
            yield first, i
            first, held = i, 0
        held += size + 1
    if i >= first:
        yield first, i + 1


class HashMap:
    """An open-addressing map of 64-bit hashes to 32-bit numbers, looked up and filled by whole arrays.

    It grows as needed; zero is not a valid key (mixed hashes are never made zero by callers that OR in a bit).
    """

    def __init__(self, bits: int = 12):
        self._new(bits)

    def _new(self, bits: int) -> None:
        self.bits, self.n = bits, 0
        self.keys = np.zeros(1 << bits, U64)
        self.vals = np.full(1 << bits, -1, np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U64(0x9FB21C651E98DF25)) >> U64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values, -1 where a key is missing."""
        keys = keys | U64(1)
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.vals[slot], -1).astype(np.int32)
        left = np.flatnonzero((found != keys) & (found != 0))
        mask = (1 << self.bits) - 1
        while len(left):
            slot_l = (slot[left] + 1) & mask
            slot[left] = slot_l
            found = self.keys[slot_l]
            hit = found == keys[left]
            out[left[hit]] = self.vals[slot_l[hit]]
            left = left[~hit & (found != 0)]
        return out

    def put(self, keys: np.ndarray, vals: np.ndarray) -> None:
        """Adds keys that are new and distinct."""
        need = self.n + len(keys)
        if need * 2 > len(self.keys):
            old = self.keys != 0
            k, v = self.keys[old], self.vals[old]
            self._new(max(self.bits + 1, int(np.ceil(np.log2(max(need, 1) * 2)))))
            self._put(k, v)
        self._put(keys | U64(1), vals.astype(np.int32))

    def _put(self, keys: np.ndarray, vals: np.ndarray) -> None:
        self.n += len(keys)
        slot = self._slot(keys)
        left = np.arange(len(keys))
        mask = (1 << self.bits) - 1
        while len(left):
            s = slot[left]
            free = self.keys[s] == 0
            mine = left[free]
            self.keys[slot[mine]] = keys[mine]  # of several, the last one written stays
            won = np.zeros(len(left), bool)
            won[free] = self.keys[slot[mine]] == keys[mine]
            self.vals[slot[left[won]]] = vals[left[won]]
            left = left[~won]
            slot[left] = (slot[left] + 1) & mask
