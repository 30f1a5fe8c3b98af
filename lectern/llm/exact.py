"""Exact deduplication against a history of digests.

The history's distinct digests are dealt into buckets by their first bytes; each
bucket becomes a minimal perfect hash whose slots hold the full digest and its
winner. New digests are looked up in their bucket's function and compared byte by
byte: members are repeats of the winner, nonmembers are grouped among themselves.

Texts are equal when identical after each run of blanks became one space; digests
are SHA-256 of that text. Rows: a null text counts as empty; a null doc_id never
wins over another and, alone in its group, is itself the one that stays; of rows
repeated under one doc_id and text exactly one stays; an empty history or table
gives empty results; other columns are not read; a very long text is only hashed.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, cut, join_sized, keep_one, plain, schema, ship, text_column
from .vec import U64, mix

#: Digests a bucket has on average; a bucket is what one task holds.
BUCKET = 8192
#: Bits a digest gets at each level of the perfect hash.
GAMMA = 2.0
INDEX = "bucket long, levels array<int>, bits binary, digests binary, winners binary"


def digest(text: str = "text") -> Column:
    """SHA-256 of the normalised text, 32 bytes."""
    return F.unhex(F.sha2(F.regexp_replace(text_column(text), BLANKS, " ").cast("binary"), 256))


def _hash(words: np.ndarray, level: int) -> np.ndarray:
    return mix(words[:, 1] * U64(2 * level + 0x9E3779B97F4A7C15) + mix(words[:, 2] + U64(level)))


class PerfectHash:
    """Distinct 32-byte digests to 0..n-1, one each: at every level the digests that meet no other take a bit, the rest go on."""

    def __init__(self, levels: list[int], bits: np.ndarray):
        self.levels, self.bits = levels, bits
        self.first = np.concatenate([[0], np.cumsum(levels)]).astype(np.int64)
        self.rank = np.concatenate([[0], np.cumsum(bits)]).astype(np.int64)

    @classmethod
    def build(cls, words: np.ndarray) -> PerfectHash:
        levels, bits, left = [], [], np.arange(len(words))
        while len(left):
            if len(levels) == 200:
                raise ValueError("digests are not distinct")
            size = max(2, math.ceil(GAMMA * len(left)))
            place = (_hash(words[left], len(levels)) % U64(size)).astype(np.int64)
            alone = np.bincount(place, minlength=size) == 1
            levels.append(size)
            bits.append(alone)
            left = left[~alone[place]]
        return cls(levels, np.concatenate(bits) if bits else np.zeros(0, bool))

    def slots(self, words: np.ndarray) -> np.ndarray:
        """Slot of each digest; any slot or -1 for one that was not built in."""
        out = np.full(len(words), -1, np.int64)
        left = np.arange(len(words))
        for level, size in enumerate(self.levels):
            at = self.first[level] + (_hash(words[left], level) % U64(size)).astype(np.int64)
            hit = self.bits[at]
            out[left[hit]] = self.rank[at[hit]]
            left = left[~hit]
        return out


def _words(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, 4)


def _build(table: pa.Table) -> pa.Table:
    words = _words(table.column("digest"))
    f = PerfectHash.build(words)
    order = np.argsort(f.slots(words))
    winners = np.asarray(table.column("keep_id"), np.int64)[order]
    row = [table.column("bucket")[0].as_py(), f.levels, np.packbits(f.bits).tobytes(), words[order].tobytes(), winners.tobytes()]
    kinds = [pa.int64(), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary()]
    return pa.table([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=["bucket", "levels", "bits", "digests", "winners"])


def _probe(index: pa.Table, queries: pa.Table) -> pa.Table:
    winner = np.zeros(queries.num_rows, np.int64)
    member = np.zeros(queries.num_rows, bool)
    if index.num_rows and queries.num_rows:
        row = {k: index.column(k)[0].as_py() for k in ("levels", "bits", "digests", "winners")}
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=sum(row["levels"])).astype(bool)
        held = np.frombuffer(row["digests"], np.uint64).reshape(-1, 4)
        words = _words(queries.column("digest"))
        slot = PerfectHash(row["levels"], bits).slots(words)
        known = slot >= 0
        member[known] = (held[slot[known]] == words[known]).all(axis=1)
        winner[member] = np.frombuffer(row["winners"], np.int64)[slot[member]]
    return pa.table([queries.column("digest"), pa.array(winner, mask=~member), pa.array(member)], names=["digest", "winner", "member"])


def _bucket(n: int) -> Column:
    return F.pmod(F.conv(F.hex(F.substring("digest", 1, 6)), 16, 10).cast("long"), F.lit(n))


def buckets_for(digests: int) -> int:
    return max(1, math.ceil(digests / BUCKET))


def build_index(history: DataFrame, buckets: int) -> DataFrame:
    """One row a bucket of a history of distinct (digest, keep_id)."""
    ship(history.sparkSession)
    keyed = history.select(_bucket(buckets).alias("bucket"), "digest", "keep_id")
    return keyed.groupBy("bucket").applyInArrow(_build, schema(INDEX))


def probe(index: DataFrame, digests: DataFrame, buckets: int) -> DataFrame:
    """(digest, winner, member) of distinct digests."""
    ship(digests.sparkSession)
    keyed = digests.select(_bucket(buckets).alias("bucket"), "digest")
    return index.groupBy("bucket").cogroup(keyed.groupBy("bucket")).applyInArrow(_probe, schema("digest binary, winner long, member boolean"))


def classes(history: DataFrame, arrived: DataFrame) -> DataFrame:
    """(digest, keep_id, group_size) of two tables of (doc_id, digest): the history's winners hold, what it lacks is grouped by itself."""
    grouped = lambda d: d.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    old, new = cut(grouped(history)), cut(grouped(arrived))
    n = buckets_for(max(old.count(), new.count()))
    index = cut(build_index(old, n))
    found = cut(probe(index, new, n).join(new.withColumnRenamed("keep_id", "first_id"), "digest"))
    members = found.where("member").select("digest", F.col("winner").alias("keep_id"), "n")
    others = found.where("not member").select("digest", F.col("first_id").alias("keep_id"), "n")
    return old.unionByName(members).unionByName(others).groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest) of every row."""
    return plain(docs, "doc_id", "text").select("doc_id", digest().alias("digest"))


def resolve(rows: DataFrame) -> DataFrame:
    """(digest, keep_id, group_size) of (doc_id, digest) rows: the lower half of the ids' range is the history, the rest arrives later."""
    low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    middle = low + (high - low) // 2 if low is not None else 0
    older = F.col("doc_id").isNotNull() & (F.col("doc_id") <= F.lit(middle))
    return classes(rows.where(older), rows.where(~older))


def dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = cut(digests(docs))
    each = rows.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("rows"))
    full = join_sized(each, cut(resolve(rows)), ["digest"], "group_size")
    numbered = full.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return numbered.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    rows = cut(digests(docs))
    each = rows.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("rows"))
    stay = join_sized(each, cut(resolve(rows)), ["digest"], "group_size").where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    return keep_one(docs, cut(stay.select("doc_id", "digest", "rows")), digest())
