"""Packing by shortest pack first over the histogram of lengths.

Every document becomes its token ids and a closing id 0, cut into pieces of
CAPACITY and a rest. The pieces' lengths are counted; the driver places lengths, longest first, into the pack with most room,
a whole count at a time, and so gets packing patterns with their counts (numbers
bounded by CAPACITY, whatever the corpus holds). Pieces are ranked within their
length and joined with the patterns' slots by length and rank.

Rows: a null text counts as empty and packs its closing id; a null doc_id is
packed like any other; repeated rows are packed each; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import Codec
from .common import arrow_map, cut, plain, schema, texts_of

CAPACITY = 1024
END = 0
#: Pieces that are ranked in one group on average.
RANKED = 20_000
VOCABULARY = "byte_bpe_50k.json"

_codecs: dict[tuple, Codec] = {}


def codec(path: str, count_only: bool = False) -> Codec:
    """The worker's encoder of a vocabulary file; it keeps the words it has met between tasks."""
    key = path, count_only
    if key not in _codecs:
        _codecs[key] = Codec(path, count_only=count_only)
    return _codecs[key]


def cuts(total: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of a document's pieces, in their order."""
    rest = total % capacity
    return [capacity] * (total // capacity) + [rest] * (rest > 0)


def pieces(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens) of every piece."""
    path = path or public_tokenizers.path(VOCABULARY)

    def make():
        c = codec(path)

        def step(batch: pa.RecordBatch):
            ids, off = c.encode(texts_of(batch.column("text")))
            ids = ids.astype("<u4")
            at, start, length, crc, total = [], [], [], [], []
            close = np.array([END], "<u4").tobytes()
            for i, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
                raw = memoryview(ids[a:b].tobytes() + close)
                pos, n = 0, b - a + 1
                for size in cuts(n):
                    at.append(i)
                    start.append(pos)
                    length.append(size)
                    crc.append(zlib.crc32(raw[4 * pos : 4 * (pos + size)]))
                    total.append(n)
                    pos += size
            return [batch.column("doc_id").take(pa.array(at, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]

        return step

    return arrow_map(plain(docs, "doc_id", "text"), make, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths) of the packs that hold all lengths of the histogram."""
    open_: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = max((r for r, held in open_.items() if held and r >= length), default=None)
            if room is None:
                open_[capacity - length].append((left, (length,)))
                break
            count, held = open_[room].pop()
            used = min(count, left)
            if count > used:
                open_[room].append((count - used, held))
            open_[room - length].append((used, (*held, length)))
            left -= used
    return [x for room in sorted(open_) for x in open_[room]]


def slots(packs: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset) of every place in the patterns."""
    rank: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for count, held in packs:
        offset = 0
        for length in held:
            out.append((length, rank[length], rank[length] + count, sequence, offset))
            rank[length] += count
            offset += length
        sequence += count
    return out


def place(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces, which must be a stored table."""
    spark = parts.sparkSession
    n = parts.count()
    blocks = max(1, math.ceil(n / RANKED))
    keyed = parts.withColumn("block", F.pmod(F.xxhash64("doc_id", "start"), F.lit(blocks)))
    counts = cut(keyed.groupBy("length", "block").agg(F.count(F.lit(1)).alias("n")))
    total = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = slots(patterns(total, capacity))
    places = spark.createDataFrame(table, schema("length long, low long, high long, sequence long, offset long"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = counts.select("length", "block", before.alias("first"))
    inside = F.row_number().over(Window.partitionBy("length", "block").orderBy("doc_id", "start"))
    ranked = keyed.withColumn("inside", inside).join(first, ["length", "block"]).withColumn("rank", F.col("first") + F.col("inside") - 1)
    # A few thousand places at most: their number depends on the capacity, not on the corpus.
    on = (ranked["length"] == places["length"]) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    joined = ranked.join(F.broadcast(places), on)
    return joined.select("doc_id", "start", ranked["length"], "ids_crc32", "doc_tokens", (F.col("sequence") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset")


def pack(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece."""
    return place(cut(pieces(docs, path)))
