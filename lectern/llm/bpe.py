"""Byte-pair encoding with vocabularies of public tokenizers.

Two encoders of one word share the tables: ``Backtracker`` walks the longest
tokens an Aho-Corasick automaton finds and steps back where two neighbours are
not compatible; ``PrefixCounts`` holds, for every prefix of a word, the last
token of its encoding and its number of tokens. Words met before are kept in a
table of bounded size and found by hash; their characters are then compared, so a
text costs a few array operations a word and ids never rest on a hash alone.

A pair of tokens is compatible when encoding their joined text gives back the
two. The ids of a vocabulary must be in the order of its merges, which is
checked when it is read.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import ahocorasick
import numpy as np

from .vec import HashMap, code_points, differ, runs, slices, span_hashes, spread

#: White space of Unicode, as the tokenizers' patterns take it.
WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SPACE, LETTER, NUMBER, OTHER = range(4)
#: Bytes that the table of words met may take, and pairs of tokens whose compatibility is remembered; both are refilled when full.
ROOM, PAIRS = 100_000_000, 1_000_000
#: What may follow an apostrophe in a contraction.
ONE, TWO = "stmd", ("re", "ve", "ll")


@lru_cache(1)
def _classes() -> np.ndarray:
    kind = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        major = unicodedata.category(chr(c))[0]
        if major == "L":
            kind[c] = LETTER
        elif major == "N":
            kind[c] = NUMBER
    kind[WHITE] = SPACE
    return kind


@lru_cache(1)
def _lower() -> np.ndarray:
    """Lower case of each code point; -1 where it has several characters."""
    out = np.arange(0x110000, dtype=np.int32)
    for c in range(0x110000):
        low = chr(c).lower()
        if len(low) != 1:
            out[c] = -1
        elif ord(low) != c:
            out[c] = ord(low)
    return out


@lru_cache(1)
def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(plain))
    return [out[b] for b in range(256)]


class Vocabulary:
    """Tokens as strings of symbols. A symbol is a byte, or 256 + byte for the last byte of a word where the vocabulary marks word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("unk_token") or model.get("byte_fallback") or model.get("continuing_subword_prefix"):
            raise ValueError("not a plain byte-level BPE vocabulary")
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        back = {s: chr(b) for b, s in enumerate(byte_symbols())}
        self.tokens: list[str] = [""] * (max(model["vocab"].values()) + 1)
        for token, k in model["vocab"].items():
            if token in self.special:
                continue
            ends = self.suffix and token.endswith(self.suffix) and token != self.suffix
            body = token[: -len(self.suffix)] if ends else token
            if any(c not in back for c in body):
                continue
            s = "".join(back[c] for c in body)
            self.tokens[k] = s[:-1] + chr(256 + ord(s[-1])) if ends else s
        self.ids = {s: k for k, s in enumerate(self.tokens) if s}
        self.longest = max(map(len, self.ids))
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        last = -1
        for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            x, y = model["vocab"][a], model["vocab"][b]
            z = model["vocab"][a + b]
            if z <= last or z in self.halves:
                raise ValueError("ids are not in the order of merges")
            last = z
            self.halves[z] = x, y
            self.merged[x, y] = z
        self.automaton = ahocorasick.Automaton()
        for s, k in self.ids.items():
            if self.reachable(s, k):
                self.automaton.add_word(s, (len(s), k))
        self.automaton.make_automaton()
        #: Of the tokens that are a proper prefix of each token, the longest; -1 where there is none.
        self.shorter = [self._shorter(s) for s in self.tokens]
        #: Pairs, as left << 32 | right, whose compatibility is known; emptied, never replaced.
        self.known: dict[int, bool] = {}

    def reachable(self, s: str, token: int) -> bool:
        """Whether merges make this token."""
        return len(s) == 1 or token in self.halves

    def _shorter(self, s: str) -> int:
        for n in range(len(s) - 1, 0, -1):
            token = self.ids.get(s[:n], -1)
            if token >= 0 and self.reachable(s[:n], token):
                return token
        return -1

    def symbols(self, word: str) -> str:
        s = word.encode("utf-8", "surrogatepass").decode("latin-1")
        return s[:-1] + chr(256 + ord(s[-1])) if self.suffix else s

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two stay apart when their joined text is encoded.

        Only symbols at the border can join across it. Going back through the
        merges that made the two, latest first, the border tokens at each moment
        are known; a merge of them comes in the way if it ranks before the merge
        that the moment is waiting for.
        """
        key = left << 32 | right
        known = self.known.get(key)
        if known is not None:
            return known
        a, b, bound = left, right, 1 << 62
        good = True
        while True:
            joint = self.merged.get((a, b))
            if joint is not None and joint < bound:
                good = False
                break
            made_a, made_b = self.halves.get(a), self.halves.get(b)
            if made_a is None and made_b is None:
                break
            # Of the two the one merged later is taken apart; at equal ranks the left one was merged first.
            if made_b is None or made_a is not None and a > b:
                bound, a = a, made_a[1]
            else:
                bound, b = b + 1, made_b[0]
        if len(self.known) > PAIRS:
            self.known.clear()
        self.known[key] = good
        return good

    def piece_bytes(self) -> tuple[np.ndarray, np.ndarray]:
        """All tokens' bytes one after another, and where each begins: the table that decoding reads."""
        parts = [bytes(ord(c) & 255 for c in s) for s in self.tokens]
        for text, k in self.special.items():
            parts += [b""] * (k + 1 - len(parts))
            parts[k] = text.encode()
        at = np.zeros(len(parts) + 1, np.int64)
        np.cumsum([len(p) for p in parts], out=at[1:])
        return np.frombuffer(b"".join(parts), np.uint8), at


class Backtracker:
    """Encodes a word by longest tokens, stepping back from pairs that are not compatible.

    Positions from which no compatible rest was found are not tried again, so the
    work is linear in the word.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary

    def __call__(self, word: str) -> list[int]:
        v, s = self.v, self.v.symbols(word)
        whole = v.ids.get(s)
        if whole is not None and v.reachable(s, whole) and self._alone(whole):
            return [whole]
        n, pos = len(s), 0
        longest = [-1] * n  # of the tokens that begin at a place; matches come by growing end, so the last one stays
        for end, (size, token) in v.automaton.iter(s):
            longest[end + 1 - size] = token
        tokens, shorter, known = v.tokens, v.shorter, v.known
        out: list[int] = []
        dead = set()
        t = longest[0]
        while True:
            while t >= 0:
                if not dead or (pos + len(tokens[t]), t) not in dead:
                    if not out:
                        break
                    good = known.get(out[-1] << 32 | t)
                    if v.compatible(out[-1], t) if good is None else good:
                        break
                t = shorter[t]
            if t >= 0:
                out.append(t)
                pos += len(tokens[t])
                if pos == n:
                    return out
                t = longest[pos]
                continue
            if not out:
                raise ValueError("the vocabulary does not cover this word")
            t = out.pop()
            dead.add((pos, t))
            pos -= len(tokens[t])
            t = shorter[t]

    def _alone(self, token: int) -> bool:
        made = self.v.halves.get(token)
        return made is None or self.v.merged.get(made) == token


class PrefixCounts:
    """For each prefix of a word, the last token of its encoding and how many tokens that has.

    A prefix's last token is the one whose own predecessor, known from a shorter
    prefix, is compatible with it. A vocabulary that marks word ends has a second
    row for prefixes taken as whole words.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary

    def _last(self, found, last: list[int]) -> int:
        """Where the last token of a prefix begins, given the tokens (beginning, token) that end it."""
        for before, token in found:
            if before == 0 or last[before] >= 0 and self.v.compatible(last[before], token):
                return before
        raise ValueError("the vocabulary does not cover this word")

    def total(self, word: str) -> int:
        return self.rows(word, False)[-1]

    def rows(self, word: str, every: bool = True) -> list[int]:
        """Tokens of each prefix taken as a whole word, by bytes; with ``every`` false only the whole word's is exact."""
        v = self.v
        s = v.symbols(word)
        n = len(s)
        last, count, known = [-1] * (n + 1), [0] * (n + 1), v.known
        for end, (size, token) in v.automaton.iter(s):
            if last[end + 1] >= 0:
                continue
            before = end + 1 - size
            if before:
                prior = last[before]
                good = known.get(prior << 32 | token) if prior >= 0 else False
                if not (v.compatible(prior, token) if good is None else good):
                    continue
            last[end + 1], count[end + 1] = token, count[before] + 1
        if -1 in last[1:]:
            raise ValueError("the vocabulary does not cover this word")
        if not v.suffix or not every:
            return count
        out = [0] * (n + 1)
        out[n] = count[n]
        for i in range(1, n):
            closing = []
            for b in range(max(0, i - v.longest), i):
                token = v.ids.get(s[b : i - 1] + chr(256 + ord(s[i - 1])))
                if token is not None:
                    closing.append((b, token))
            out[i] = count[self._last(closing, last)] + 1
        return out


def byte_level_spans(codes: np.ndarray, at: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pretokens of `'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`.

    at: where pieces begin; ends: for each piece, whether its text ends with it.
    """
    kind = _classes()[codes]
    start, end = _class_runs(kind, at)
    of = kind[start]
    piece = np.searchsorted(at, start, "right") - 1
    last_of_text = (end == at[piece + 1]) & ends[piece]
    gap = of == SPACE
    followed = gap & ~last_of_text
    lends = followed & (codes[end - 1] == 0x20)
    single = followed & ~lends
    has = np.zeros(len(start), bool)  # takes a space from the run before
    has[1:] = lends[:-1]
    first = np.where(has, start - 1, start)
    word_start, word_end = first[~gap], end[~gap]
    word_start, word_end, extra = _contract(codes, kind, word_start, word_end, start[~gap], end[~gap], of[~gap], has[~gap], at)
    long = followed & (end - start > 1)
    tail = gap & last_of_text
    s = np.concatenate([word_start, extra[0], start[long], start[tail], end[single] - 1])
    e = np.concatenate([word_end, extra[1], end[long] - 1, end[tail], end[single]])
    order = np.argsort(s, kind="stable")
    return s[order], e[order]


def word_end_spans(codes: np.ndarray, at: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pretokens of `'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+`, others dropped."""
    kind = _classes()[codes]
    start, end = _class_runs(kind, at)
    of = kind[start]
    keep = (of == LETTER) | (of == OTHER)
    none = np.zeros(int(keep.sum()), bool)
    s, e, extra = _contract(codes, kind, start[keep], end[keep], start[keep], end[keep], of[keep], none, at)
    digit = np.flatnonzero(kind == NUMBER)
    s, e = np.concatenate([s, extra[0], digit]), np.concatenate([e, extra[1], digit + 1])
    order = np.argsort(s, kind="stable")
    return s[order], e[order]


def _class_runs(kind: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    change = np.zeros(len(kind) + 1, bool)
    change[1:-1] = kind[1:] != kind[:-1]
    change[at] = True
    edge = np.flatnonzero(change)
    return edge[:-1], edge[1:]


def _contract(codes, kind, s, e, start, end, of, has, at):
    """Cuts contractions off the words that follow a lone apostrophe. Words: (s, e) with the space they took, (start, end) without."""
    lone = np.flatnonzero((of == OTHER) & ~has & (end - start == 1) & (codes[start] == 0x27))
    inside = np.zeros(len(codes) + 1, bool)
    inside[at] = True
    lone = lone[lone + 1 < len(start)]
    lone = lone[(start[lone + 1] == end[lone]) & (of[lone + 1] == LETTER) & ~inside[end[lone]]]
    if not len(lone):
        return s, e, (s[:0], e[:0])
    nxt = lone + 1
    a = codes[start[nxt]]
    size = end[nxt] - start[nxt]
    b = codes[np.minimum(start[nxt] + 1, len(codes) - 1)]
    take = np.zeros(len(lone), np.int64)
    for c in ONE:
        take[a == ord(c)] = 1
    for c, d in TWO:
        take[(a == ord(c)) & (b == ord(d)) & (size > 1)] = 2
    lone, nxt, take = lone[take > 0], nxt[take > 0], take[take > 0]
    s, e = s.copy(), e.copy()
    e[lone] += take
    s[nxt] += take
    keep = s < e
    return s[keep], e[keep], (s[:0], e[:0])


class Codec:
    """Encodes texts of one vocabulary file; the words met are kept in a table of about ``room`` bytes."""

    def __init__(self, path: str, room: int = ROOM, count_only: bool = False):
        self.v = Vocabulary(path)
        self.room, self.count_only = room, count_only
        self.one = PrefixCounts(self.v).total if count_only else Backtracker(self.v)
        self.spans = word_end_spans if self.v.suffix else byte_level_spans
        self._clear()
        # Of special strings at one place the longest counts, as the library has it.
        self.special = re.compile("|".join(re.escape(t) for t in sorted(self.v.special, key=lambda t: (-len(t), t)))) if self.v.special else None
        self.names = {k: t for t, k in self.v.special.items()}
        self._bytes = None

    def _clear(self) -> None:
        self.map, self.size = HashMap(12), 0
        self.odd: dict[str, int] = {}
        self.begin, self.spelt = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.length, self.chars = np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int32)
        self.pool, self.held = np.zeros(1 << 12, np.int32), 0
        self.letters, self.written = np.zeros(1 << 12, np.uint32), 0

    def _used(self) -> int:
        return 64 * self.size + 4 * (self.held + self.written)

    def normal(self, text: str) -> str:
        """The text as the vocabulary's normaliser leaves it, but for white space, which is dropped later."""
        if not self.v.suffix:
            return text
        if text.isascii():
            return text.lower()
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        low = _lower()[code_points(text)]
        if (low < 0).any():
            return "".join(c.lower() for c in text)
        return low.astype("<u4").tobytes().decode("utf-32-le")

    @staticmethod
    def _room(table: np.ndarray, n: int) -> np.ndarray:
        """The table, with place for ``n`` values."""
        if n <= len(table):
            return table
        out = np.zeros(max(n, len(table) * 3 // 2), table.dtype)
        out[: len(table)] = table
        return out

    def _add(self, words: list[str]) -> np.ndarray:
        """Entries of new words: their ids or counts, and their characters."""
        new = [self.one(w) for w in words]
        n = np.array(new if self.count_only else [len(x) for x in new], np.int32)
        size = np.array([len(w) for w in words], np.int32)
        low, top = self.size, self.size + len(words)
        for name in ("begin", "spelt", "length", "chars"):
            setattr(self, name, self._room(getattr(self, name), top))
        self.length[low:top], self.chars[low:top] = n, size
        codes = code_points("".join(words))
        self.letters = self._room(self.letters, self.written + len(codes))
        self.letters[self.written : self.written + len(codes)] = codes
        self.spelt[low:top] = self.written + np.cumsum(size) - size
        self.written += len(codes)
        if not self.count_only:
            total = int(n.sum())
            self.pool = self._room(self.pool, self.held + total)
            self.pool[self.held : self.held + total] = np.fromiter((t for x in new for t in x), np.int32, total)
            self.begin[low:top] = self.held + np.cumsum(n) - n
            self.held += total
        self.size = top
        return np.arange(low, top)

    def _entries(self, codes: np.ndarray, joined: str, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """The entry of each word of a slice. A word that only shares the hash of an entry gets one of its own, by its characters."""
        word = lambda i: joined[s[i] : e[i]]
        if self._used() > self.room:
            self._clear()
        keys = span_hashes(codes, s, e)
        entry = self.map.get(keys)
        missing = np.flatnonzero(entry < 0)
        if len(missing):
            fresh, where = np.unique(keys[missing] | np.uint64(1), return_index=True)
            self.map.put(fresh, self._add([word(i) for i in missing[where].tolist()]))
            entry = self.map.get(keys)
        for i in np.flatnonzero(differ(codes, s, e, self.letters, self.spelt[entry], self.chars[entry])).tolist():
            w = word(i)
            if w not in self.odd:
                self.odd[w] = int(self._add([w])[0])
            entry[i] = self.odd[w]
        return entry

    def _words(self, texts: list[str]):
        """For each slice: (entry of each word, the piece each belongs to, document of each piece)."""
        for docs, at, joined in slices(texts):
            codes = code_points(joined)
            if not len(codes):
                continue
            ends = np.ones(len(docs), bool)
            ends[:-1] = docs[1:] != docs[:-1]
            tail = docs[-1]
            ends[-1] = self._whole(texts, docs, at, int(tail))
            s, e = self.spans(codes, at, ends)
            yield self._entries(codes, joined, s, e), np.searchsorted(at, s, "right") - 1, docs

    def _whole(self, texts, docs, at, doc: int) -> bool:
        """Whether the last piece of a slice ends its document."""
        self._seen = getattr(self, "_seen", {})
        if self._seen.get("texts") is not texts:
            self._seen = {"texts": texts, "doc": -1, "n": 0}
        mine = np.flatnonzero(docs == doc)
        n = int(at[mine[-1] + 1] - at[mine[0]])
        before = self._seen["n"] if self._seen["doc"] == doc else 0
        self._seen |= {"doc": doc, "n": before + n}
        return before + n == len(texts[doc])

    def _parts(self, texts: list[str]) -> tuple[list[str], list[tuple[int, int]]]:
        """Texts cut at special strings: (ordinary parts, [(document, special id after the part or -1)])."""
        parts, owner = [], []
        for i, text in enumerate(texts):
            at = 0
            for m in self.special.finditer(text) if self.special else ():
                parts.append(self.normal(text[at : m.start()]))
                owner.append((i, self.v.special[m[0]]))
                at = m.end()
            parts.append(self.normal(text[at:] if at else text))
            owner.append((i, -1))
        return parts, owner

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where those of each begin)."""
        parts, owner = self._parts(texts)
        found, sizes = [], np.zeros(len(parts), np.int64)
        for entry, piece, docs in self._words(parts):
            n = self.length[entry].astype(np.int64)
            np.add.at(sizes, docs, np.bincount(piece, n, len(docs)).astype(np.int64))
            found.append(self.pool[spread(self.begin[entry], n)])
        ids = np.concatenate(found) if found else np.zeros(0, np.int32)
        extra = np.array([s >= 0 for _, s in owner], np.int64)
        if extra.any():
            edge = np.cumsum(sizes)[extra > 0]
            ids = np.insert(ids, edge, [s for _, s in owner if s >= 0])
        off = np.zeros(len(texts) + 1, np.int64)
        np.add.at(off, np.array([i for i, _ in owner], np.int64) + 1, sizes + extra)
        return ids, np.cumsum(off)

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        parts, owner = self._parts(texts)
        out = np.zeros(len(parts), np.int64)
        for entry, piece, docs in self._words(parts):
            np.add.at(out, docs, np.bincount(piece, self.length[entry], len(docs)).astype(np.int64))
        total = np.zeros(len(texts), np.int64)
        np.add.at(total, np.array([i for i, _ in owner], np.int64), out + np.array([s >= 0 for _, s in owner], np.int64))
        return total

    def prefix_table(self, text: str) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
        """(normalised text, end of each word and special string, tokens up to there, whether it is a special string)."""
        whole, ends, totals, marks, held, base = [], [], [], [], 0, 0
        for part, (_, special) in zip(*self._parts([text]), strict=True):
            done = base + len(part)
            for _, at, joined in slices([part]):
                codes = code_points(joined)
                if len(codes):
                    s, e = self.spans(codes, at, np.array([base + len(codes) == done]))
                    entry = self._entries(codes, joined, s, e)  # may replace the table of lengths
                    n = self.length[entry].astype(np.int64)
                    ends.append(base + e)
                    totals.append(held + np.cumsum(n))
                    marks.append(np.zeros(len(e), bool))
                    base, held = base + len(codes), held + int(n.sum())
            whole.append(part)
            if special >= 0:
                whole.append(self.names[special])
                base, held = base + len(whole[-1]), held + 1
                ends.append(np.array([base]))
                totals.append(np.array([held]))
                marks.append(np.array([True]))
        if not ends:
            return "".join(whole), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        return "".join(whole), np.concatenate(ends), np.concatenate(totals), np.concatenate(marks)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids, read from the offset table."""
        if self._bytes is None:
            self._bytes = self.v.piece_bytes()
        data, at = self._bytes
        return data[spread(at[ids], at[ids + 1] - at[ids])].tobytes()
