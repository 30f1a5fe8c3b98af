"""Token counts and token round trips of whole texts.

Counts come from prefix tables (see ``bpe.PrefixCounts``): for every prefix of a
word the exact number of its tokens, and sums over the words before it, so that
questions of budget or truncation need no second encoding. Encoding walks the
longest tokens and steps back from pairs that are not compatible
(``bpe.Backtracker``); decoding reads the tokens' bytes at their offsets.

Rows: a null text counts as empty; a null doc_id is carried along; repeated rows
are handled each; an empty table gives no rows; other columns are not read. Very long
texts are walked in slices (see ``vec``) and cost time in proportion; a word without
a break is held whole.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Codec, PrefixCounts, Vocabulary
from .common import arrow_map, plain, texts_of
from .packing import codec
from .vec import code_points

COUNTED, ROUND_TRIP = "word_bpe_49k.json", "byte_bpe_50k.json"
LIMIT = 2048


class PrefixTable:
    """Exact token counts of the prefixes of one text, for vocabularies that mark word ends."""

    def __init__(self, text: str, vocabulary: Codec):
        if not vocabulary.v.suffix:
            raise ValueError("prefixes end words only where the vocabulary marks word ends")
        self.codec = vocabulary
        self.text, self.ends, self.totals, self.marks = vocabulary.prefix_table(text)

    def count(self, chars: int) -> int:
        """Tokens of the first ``chars`` characters of the normalised text."""
        k = int(np.searchsorted(self.ends, chars, "right"))
        if k and k < len(self.ends) and self.marks[k] and not self.marks[k - 1] and self.ends[k - 1] < chars:
            k -= 1  # a cut special string is ordinary text, which may go on the word before it
        held = int(self.totals[k - 1]) if k else 0
        begin = int(self.ends[k - 1]) if k else 0
        if begin >= chars:
            return held
        # The cut lies within a word, or in white space: only that word's own prefixes are looked at.
        rest = self.text[begin:chars]
        codes = code_points(rest)
        s, e = self.codec.spans(codes, np.array([0, len(codes)]), np.array([True]))
        return held + sum(self._rows(rest[a:b]) for a, b in zip(s, e, strict=True))

    def _rows(self, word: str) -> int:
        return _prefixes(self.codec.v).rows(word)[-1]

    def fit(self, budget: int) -> tuple[int, int]:
        """The longest prefix that ends with a word and has at most ``budget`` tokens: (its characters, its tokens)."""
        k = int(np.searchsorted(self.totals, budget, "right"))
        return (int(self.ends[k - 1]), int(self.totals[k - 1])) if k else (0, 0)


@lru_cache(4)
def _prefixes(v: Vocabulary) -> PrefixCounts:
    return PrefixCounts(v)


def prefix_totals(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ends, totals): the token count at the end of every word of each normalised text."""
    path = path or public_tokenizers.path(COUNTED)

    def make():
        c = codec(path, True)

        def step(batch: pa.RecordBatch):
            tables = [PrefixTable(t, c) for t in texts_of(batch.column("text"))]
            return [batch.column("doc_id"), pa.array([t.ends for t in tables], pa.list_(pa.int64())), pa.array([t.totals for t in tables], pa.list_(pa.int64()))]

        return step

    return arrow_map(plain(docs, "doc_id", "text"), make, "doc_id long, ends array<long>, totals array<long>")


def fitted(totals: DataFrame, budget: int) -> DataFrame:
    """(doc_id, chars, n_tokens) of the longest prefix of whole words within ``budget`` tokens, from stored totals alone."""
    k = F.size(F.filter("totals", lambda n: n <= budget))
    at = lambda c: F.when(k > 0, F.try_element_at(c, k)).otherwise(F.lit(0).cast("long"))
    return totals.select("doc_id", at(F.col("ends")).alias("chars"), at(F.col("totals")).alias("n_tokens"))


def counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every document, in one pass and without a shuffle."""
    path = path or public_tokenizers.path(COUNTED)

    def make():
        c = codec(path, True)

        def step(batch: pa.RecordBatch):
            texts = texts_of(batch.column("text"))
            n = c.counts(texts)
            size = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            return [batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(n), pa.array(n > limit)]

        return step

    return arrow_map(plain(docs, "doc_id", "text"), make, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) of every document."""
    path = path or public_tokenizers.path(ROUND_TRIP)

    def make():
        c = codec(path)

        def step(batch: pa.RecordBatch):
            ids, off = c.encode(texts_of(batch.column("text")))
            return [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids.astype(np.int32)))]

        return step

    return arrow_map(plain(docs, "doc_id", "text"), make, "doc_id long, ids array<int>")


def decoded(ids: np.ndarray, c: Codec) -> str:
    """The text of ids; bytes that are not UTF-8 become replacement characters, as the tokenizers' decoder has it."""
    return c.decode(ids).decode("utf-8", "replace")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document; ids are handled and dropped batch by batch."""
    path = path or public_tokenizers.path(ROUND_TRIP)

    def make():
        c = codec(path)

        def step(batch: pa.RecordBatch):
            ids, off = c.encode(texts_of(batch.column("text")))
            raw, text = [], []
            for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                part = ids[a:b]
                raw.append(hashlib.sha256(part.astype("<u4").tobytes()).hexdigest())
                text.append(hashlib.sha256(decoded(part, c).encode()).hexdigest())
            return [batch.column("doc_id"), pa.array(np.diff(off)), pa.array(raw, pa.string()), pa.array(text, pa.string())]

        return step

    return arrow_map(plain(docs, "doc_id", "text"), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


