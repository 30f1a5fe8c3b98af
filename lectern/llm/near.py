"""Near duplicates: DartMinHash signatures, a banded join, and exact checks.

Every distinct shingle of WORDS words throws darts into its region (its weight
wide, rank high), by a Poisson process that depends on the shingle alone; a text
keeps, for each of K coordinates, the dart of lowest rank. Two texts agree in a
coordinate with the probability of their weighted Jaccard similarity, and a text
costs its shingles plus about K ln K darts. Bands of ROWS coordinates are joined;
pairs that meet are checked exactly on their sets. Weights are 1, so that similarity
is that of shingle sets; with ``weighted`` they are the times that a text has each
shingle, and sets are written as plain ones of (shingle, how often before).

Within a band's bucket no pairs are listed. All members are compared with
one pivot (the member whose buckets are fullest). Members similar to the pivot
are linked. Two members that are not both linked to pivot p can only be similar
if they share a shingle outside p or lack a common shingle of p: with neither,
their similarity is at most that of each to p. So pivots with unlinked members
deal their members into new buckets, (p, shingle outside p) and (p, shingle
missing from p). Counts of missing and extra shingles bound how many two similar
members must share, so few of them are dealt, and ordinary edits are not dealt by
missing ones at all (see ``_next_keys``). Dealt buckets of up to SMALL members are
closed by comparing the pairs that those counts allow; larger ones go through the
same step again.

Classes are the connected components of the links. A pair at similarity 0.8 is
missed by all bands with probability (1 - 0.8**ROWS)**BANDS, about 1 in 10,000.

Rows: a null text counts as empty; texts without words form one class; a text
of fewer than WORDS words is one shingle; a null doc_id is returned with a null
class and is linked to nothing; of rows repeated under one doc_id and text one
stays, different texts under one doc_id are judged apart; other columns are not
read. A very long text is walked in slices; its shingles are held at once.
"""

from __future__ import annotations

import hashlib
import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, cut, join_sized, keep_one, plain, texts_of
from .vec import U64, mix, mix_int, windows, words

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 40, 7
K = BANDS * ROWS
#: Darts thrown at first, a coordinate; those who lack a coordinate throw on.
DARTS = math.log(K) + 4
#: Slots of the filter that spares documents without candidates the second pass: FILTER_EACH for each candidate, 32 MB of bits at most.
FILTER_EACH, FILTER_MOST = 16, 1 << 28
#: Pairs of one pivot that go to one task together.
SALT = 256
#: A dealt bucket of no more members is closed by comparing those that can be similar; a larger one gets a pivot.
SMALL = 1024


def shingles(texts: list[str], weighted: bool = False, n: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, the weight of each, and where those of each begin."""
    h, off = words(texts)
    g, first = windows(h, off, n)
    doc = np.searchsorted(off, first, "right") - 1
    size = np.diff(off)
    short = np.flatnonzero((size > 0) & (size < n))
    if len(short):
        whole = np.zeros(len(short), U64)
        for i, d in enumerate(short):
            x = mix_int(int(size[d]))
            for w in h[off[d] : off[d + 1]].tolist():
                x = (x * 0xA0761D6478BD642F + w) & (2**64 - 1)
            whole[i] = mix_int(x)
        g, doc = np.concatenate([g, whole]), np.concatenate([doc, short])
    order = np.lexsort((g, doc))
    g, doc = g[order], doc[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    out = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.bincount(doc[at], minlength=len(texts)), out=out[1:])
    return g[at], np.diff(np.append(at, len(g))) if weighted else np.ones(len(at), np.int64), out


def elements(g: np.ndarray, times: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The weighted sets as plain ones: a shingle met ``t`` times gives t elements. Their overlap is that of the weights."""
    number = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
    out = np.repeat(g, times)
    more = number > 0
    out[more] = mix(out[more] + number[more].astype(U64) * U64(0x8CB92BA72F3D8DD7))
    total = np.zeros(len(times) + 1, np.int64)
    np.cumsum(times, out=total[1:])
    return out, total[off]


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53


def dart_minhash(elements: np.ndarray, weights: np.ndarray, off: np.ndarray, k: int = K, darts: float = DARTS) -> np.ndarray:
    """Signatures (documents, k) of weighted sets; rows without elements are zero.

    The region of an element is cut into strips one unit wide, each with its own
    Poisson process along the ranks; a last strip takes the darts that land within
    the rest of the weight.
    """
    docs = len(off) - 1
    doc_of = np.repeat(np.arange(docs), np.diff(off))
    out = np.zeros((docs, k), U64)
    if not len(elements):
        return out
    strips = np.ceil(weights).astype(np.int64)
    strip = np.arange(strips.sum()) - np.repeat(np.cumsum(strips) - strips, strips)
    seed = mix(np.repeat(elements, strips) + strip.astype(U64) * U64(0x9E3779B97F4A7C15))
    width = np.minimum(np.repeat(weights, strips) - strip, 1.0)
    owner = np.repeat(doc_of, strips)
    norm = np.bincount(owner, width, docs)
    todo = norm > 0
    limit = np.where(todo, k * darts / np.maximum(norm, 1e-300), 0.0)
    while todo.any():
        mine = np.flatnonzero(todo[owner])
        best = np.full(docs * k, np.inf)
        value = np.zeros(docs * k, U64)
        rank, step = np.zeros(len(mine)), 0
        while len(mine):
            block = int(min(256, max(1, (1 << 16) // len(mine))))
            number = (np.arange(step, step + block, dtype=np.int64)).astype(U64) * U64(0xD1B54A32D192ED03)
            dart = mix(seed[mine][:, None] + number[None, :])
            ranks = rank[:, None] - np.cumsum(np.log(_uniform(dart)), axis=1)
            good = ranks <= limit[owner[mine]][:, None]
            dart2 = mix(dart + U64(0x2545F4914F6CDD1D))
            if (width[mine] < 1).any():
                good_w = _uniform(mix(dart2 + U64(77))) <= width[mine][:, None]
            else:
                good_w = True
            r, c = np.nonzero(good & good_w)
            key = owner[mine][r] * k + (dart2[r, c] % U64(k)).astype(np.int64)
            at = ranks[r, c]
            np.minimum.at(best, key, at)
            won = best[key] == at
            value[key[won]] = dart2[r, c][won]
            alive = good[:, -1]
            mine, rank = mine[alive], ranks[alive, -1]
            step += block
        full = todo & np.isfinite(best.reshape(docs, k)).all(axis=1)
        out[full] = value.reshape(docs, k)[full]
        todo &= ~full
        limit = np.where(todo, limit * 2, limit)
    return out


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    part = signature.reshape(len(signature), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.int64).astype(U64), part.shape[:2]).copy()
    for j in range(rows):
        key = mix(key * U64(0xA0761D6478BD642F) + part[:, :, j])
    return key


def _prints(e: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Two fingerprints of each set."""
    total = np.zeros((2, len(e) + 1), U64)
    for j, salt in enumerate((0x1234567, 0x89ABCDF)):
        np.cumsum(mix(e + U64(salt)), out=total[j, 1:])
    return (total[:, off[1:]] - total[:, off[:-1]]).astype(np.int64)


def text_digest(text: Column) -> Column:
    """16 bytes that tell texts of one doc_id apart."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256), 1, 32))


def _signature(batch: pa.RecordBatch, weighted: bool) -> list[pa.Array]:
    texts = texts_of(batch.column("text"))
    g, times, off = shingles(texts, weighted)
    e, e_off = elements(g, times, off)
    n = np.diff(e_off)
    prints = _prints(e, e_off)
    keys = band_keys(dart_minhash(g, times.astype(np.float64), off)).astype(np.int64)
    flat = pa.array(np.where((n > 0)[:, None], keys, 0)[n > 0].ravel())
    at = np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]).astype(np.int32)
    digest = pa.array([hashlib.sha256(t.encode()).digest()[:16] for t in texts], pa.binary())
    return [batch.column("doc_id"), digest, pa.array(prints[0]), pa.array(prints[1]), pa.array(n), pa.ListArray.from_arrays(pa.array(at), flat)]


def signatures(docs: DataFrame, weighted: bool = False) -> DataFrame:
    """(doc_id, digest, print1, print2, n_shingles, bands): of the text, of its weighted shingle set, and a key for each band."""
    return arrow_map(plain(docs, "doc_id", "text"), lambda: partial(_signature, weighted=weighted), "doc_id long, digest binary, print1 long, print2 long, n_shingles long, bands array<long>")


def sets_of(docs: DataFrame, nodes: DataFrame, weighted: bool = False) -> DataFrame:
    """(node, shingles) of the stored ``nodes`` (node, doc_id, print1, print2); other documents are passed over by a filter."""
    spark = docs.sparkSession
    slots = min(FILTER_MOST, 1 << max(15, math.ceil(math.log2(max(1, FILTER_EACH * nodes.count())))))
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(slots)) + 1
    parts = nodes.select(slot("doc_id").alias("s")).selectExpr("bitmap_bucket_number(s) as b", "bitmap_bit_position(s) as p").groupBy("b").agg(F.bitmap_construct_agg("p").alias("bits")).collect()
    bits = np.zeros(slots >> 3, np.uint8)
    for r in parts:
        block = np.frombuffer(bytes(r["bits"]), np.uint8)
        bits[(r["b"] - 1) * len(block) : r["b"] * len(block)] = block[: len(bits)]
    held = spark.sparkContext.broadcast(bits)

    def make():
        table = held.value

        def step(batch: pa.RecordBatch):
            s = np.asarray(batch.column("slot"), np.int64) - 1
            named = np.flatnonzero((table[s >> 3] >> (s & 7).astype(np.uint8)) & 1)
            column = batch.column("text").take(pa.array(named))
            e, off = elements(*shingles(texts_of(column), weighted))
            prints = _prints(e, off)
            values = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(e.astype(np.int64)))
            return [batch.column("doc_id").take(pa.array(named)), pa.array(prints[0]), pa.array(prints[1]), values]

        return step

    rows = plain(docs, "doc_id", "text").where("doc_id is not null").withColumn("slot", slot("doc_id"))
    found = arrow_map(rows, make, "doc_id long, print1 long, print2 long, shingles array<long>")
    on = ["doc_id", "print1", "print2"]
    return found.join(nodes.hint("shuffle_hash"), on).dropDuplicates(on).select("node", "shingles")


def compare(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Adds common, n_node and n_pivot to distinct pairs (node, pivot). A pivot of many pairs is met in parts of SALT."""
    per = cut(pairs.groupBy("pivot").agg(F.count(F.lit(1)).alias("per")))
    salted = join_sized(pairs, per, ["pivot"], "per").withColumn("part", F.pmod(F.xxhash64("node"), F.greatest(F.lit(1), F.ceil(F.col("per") / SALT))))
    centre = salted.select("pivot", "part").distinct().join(sets.select(F.col("node").alias("pivot"), F.col("shingles").alias("theirs")), "pivot")
    mine = salted.join(sets.select("node", "shingles"), "node")
    both = mine.join(centre, ["pivot", "part"])
    return both.select(*pairs.columns, F.size(F.array_intersect("shingles", "theirs")).alias("common"), F.size("shingles").alias("n_node"), F.size("theirs").alias("n_pivot"))


def _next_keys(found: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(key, size, node, outlier, n_pivot, d, m) of the buckets that pivots with unlinked members deal out.

    With t = similarity, |p| the pivot's size, M and D a member's missing and extra
    shingles, members u, v are similar only if x + y >= [t(|p| + |Du| + |Dv|) - |p|
    + |Mu| + |Mv|] / (1 + t), where they share x extra and y missing ones. As y is
    at most |Mu| and |Mv|, x >= [(t - 1)|p| + t|Dv| + |Mv| - tR] / (1 + t) =: least(v)
    where R is the greatest |M| - |D| of p's members, or 0. One of the two is an
    outlier, so x also reaches the least of p's outliers. Members that share that many
    extra shingles share one among the first |D| - least + 1 in any common order, and
    only those are dealt. If x may be 0, members and outliers for which
    t(|M| - |D|) / (1 + t) allows it are dealt by missing shingles as well.
    """
    t = similarity
    m = F.col("n_pivot") - F.col("common")
    d = F.col("n_node") - F.col("common")
    need = (F.lit(t - 1) * F.col("n_pivot") + t * d + m) / (1 + t)
    room = (t * m - t * d) / (1 + t)
    rows = found.select("node", "pivot", "outlier", "n_pivot", d.alias("d"), m.alias("m"), need.alias("need"), room.alias("room"))
    by_pivot = rows.groupBy("pivot").agg(F.min(F.when(F.col("outlier"), F.col("need"))).alias("least"), F.greatest(F.max("room"), F.lit(0.0)).alias("most"), F.count(F.lit(1)).alias("per")).where("least is not null")
    rows = join_sized(rows, cut(by_pivot), ["pivot"], "per")
    shared = F.ceil(F.greatest(F.col("need"), F.col("least")) - F.col("most") - 1e-6)
    shrunk = (F.col("room") >= F.col("least") - 1e-6) | (F.col("outlier") & (F.col("most") >= F.col("need") - 1e-6))
    part = F.pmod(F.xxhash64("node"), F.greatest(F.lit(1), F.ceil(F.col("per") / SALT)))
    rows = rows.select("node", "pivot", "outlier", "n_pivot", "d", "m", (F.col("d") - F.greatest(shared, F.lit(1)) + 1).cast("int").alias("first"), shrunk.alias("shrunk"), part.alias("part"))
    rows = rows.where("first > 0 or shrunk")
    centre = rows.select("pivot", "part").distinct().join(sets.select(F.col("node").alias("pivot"), F.col("shingles").alias("theirs")), "pivot")
    both = rows.join(sets, "node").join(centre, ["pivot", "part"])
    extra = F.transform(F.array_except("shingles", "theirs"), lambda s: F.xxhash64(F.col("pivot"), F.lit(1), s))
    extra = F.slice(F.sort_array(extra), F.lit(1), F.greatest(F.col("first"), F.lit(0)))
    lacking = F.when(F.col("shrunk"), F.transform(F.array_except("theirs", "shingles"), lambda s: F.xxhash64(F.col("pivot"), F.lit(2), s))).otherwise(F.array().cast("array<long>"))
    dealt = both.select(F.explode(F.concat(extra, lacking)).alias("key"), "node", "outlier", "n_pivot", "d", "m")
    live = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.max("outlier").alias("open")).where("size > 1 and open").drop("open")
    return dealt.join(live, "key")


def _closed(members: DataFrame, similarity: float) -> DataFrame:
    """The pairs of small buckets that can be similar, given what their members share with the bucket's pivot."""
    a, b = members.alias("a"), members.alias("b")
    x = F.least(F.col("a.d"), F.col("b.d")) + F.least(F.col("a.m"), F.col("b.m"))
    common = F.col("a.n_pivot") - F.col("a.m") - F.col("b.m") + x
    union = F.col("a.n_pivot") + F.col("a.d") + F.col("b.d") - x
    on = (F.col("a.key") == F.col("b.key")) & (F.col("a.node") < F.col("b.node")) & (F.col("a.outlier") | F.col("b.outlier")) & (common >= F.lit(similarity) * union)
    return a.join(b, on).select(F.col("b.node").alias("node"), F.col("a.node").alias("pivot")).distinct()


def links(docs: DataFrame, reps: DataFrame, similarity: float = SIMILARITY, weighted: bool = False) -> DataFrame:
    """(node, pivot) pairs of similar class representatives whose components are those of all similar pairs met in a band."""
    banded = reps.select("node", F.explode("bands").alias("key"))
    shared = cut(banded.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    members = cut(join_sized(banded, shared, ["key"], "size"))
    rank = cut(members.groupBy("node").agg(F.sum("size").alias("weight")))
    sets = cut(sets_of(docs, cut(reps.select("node", "doc_id", "print1", "print2").join(rank.select("node").hint("shuffle_hash"), "node", "left_semi")), weighted))
    members = members.select("key", "size", "node", F.lit(True).alias("outlier"))
    done, met, first = [], None, True

    def judged(pairs: DataFrame) -> DataFrame:
        union = F.col("n_node") + F.col("n_pivot") - F.col("common")
        found = cut(compare(pairs, sets).withColumn("outlier", F.col("common") < F.lit(similarity) * union))
        done.append(found.where("not outlier").select("node", "pivot"))
        return found

    while True:
        if not first:
            judged(cut(_closed(members.where(F.col("size") <= SMALL), similarity)))
            members = members.where(F.col("size") > SMALL)
            if members.isEmpty():
                break
        # The pivot: of the members that some link is open for, the one met most often.
        pivots = members.where("outlier").join(rank, "node").groupBy("key").agg(F.max_by("node", F.struct("weight", -F.col("node"))).alias("pivot"))
        pairs = members.join(pivots, "key").where("node <> pivot").groupBy("node", "pivot").agg(F.max("size").alias("size"))
        if met is not None:
            pairs = pairs.join(met.select("node", "pivot"), ["node", "pivot"], "left_anti")
        found = judged(cut(pairs))
        # A band's bucket of two is closed by its one comparison.
        found = (found.where("size > 2") if first else found).drop("size")
        # A pivot that meets more members deals out all it has met. Every round compares pairs not compared before, so rounds end.
        met = found if met is None else cut(met.unionByName(found))
        dealing = met.join(found.select("pivot").distinct(), "pivot", "left_semi")
        members, first = cut(_next_keys(dealing, sets, similarity)), False
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, class_id) of nodes that have an edge (node, pivot); the class is the smallest node.

    Alternates two steps until nothing changes: every node hands its smallest
    neighbour to its larger neighbours, then to its smaller ones. Minima are
    aggregated and joined back, so that no neighbourhood is held in one place.
    """
    cur = cut(edges.select(F.greatest("node", "pivot").alias("u"), F.least("node", "pivot").alias("v")).where("u <> v").distinct())
    state = None
    while True:
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = large.union(low.select("u", F.col("m").alias("v")).where("u <> v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        cur = cut(small.union(lower.select("u", F.col("m").alias("v"))).distinct())
        now = cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    member = cur.groupBy("u").agg(F.min("v").alias("class_id")).select(F.col("u").alias("node"), "class_id")
    return member.union(cur.select(F.col("v").alias("node"), F.col("v").alias("class_id")).distinct()).groupBy("node").agg(F.min("class_id").alias("class_id"))


def classes(docs: DataFrame, similarity: float = SIMILARITY, weighted: bool = False) -> DataFrame:
    """(doc_id, digest, head, class_id) of every row of ``docs``.

    A class is named by its smallest doc_id; heads tell classes apart, as different
    texts under one doc_id may lead two classes.
    """
    every = cut(signatures(docs, weighted))
    on = ["print1", "print2"]
    groups = every.groupBy(*on).agg(F.min("doc_id").alias("first_id"), F.max("n_shingles").alias("n"), F.count(F.lit(1)).alias("rows"))
    # Nodes are numbered, as one doc_id may stand on different texts; the numbers hold since they are stored.
    groups = cut(groups.withColumn("node", F.monotonically_increasing_id()))
    named = groups.where("first_id is not null and n > 0").select("node", F.col("first_id").alias("doc_id"), *on)
    reps = cut(every.select("doc_id", *on, "bands").join(named.hint("shuffle_hash"), ["doc_id", *on]).dropDuplicates(["doc_id", *on]))
    linked = cut(components(links(docs, reps, similarity, weighted)).withColumnRenamed("class_id", "head").join(groups.select("node", "first_id"), "node"))
    least = linked.groupBy("head").agg(F.min("first_id").alias("class_id"), F.count(F.lit(1)).alias("size"))
    found = join_sized(linked.select("node", "head"), cut(least), ["head"], "size").select("node", "head", "class_id")
    joined = cut(groups.join(found, "node", "left").select(*on, "rows", F.coalesce("head", "node").alias("head"), F.coalesce("class_id", "first_id").alias("class_id")))
    rows = join_sized(every.select("doc_id", "digest", *on), joined, on, "rows")
    return rows.select("doc_id", "digest", "head", F.when(F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id"))


def _counted(docs: DataFrame, similarity: float, weighted: bool) -> DataFrame:
    """(doc_id, digest, class_id, rows, class_size, first): what rows have in common, and whether they come first in their class."""
    rows = cut(classes(docs, similarity, weighted).groupBy("doc_id", "digest", "head", "class_id").agg(F.count(F.lit(1)).alias("rows")))
    known = rows.where("class_id is not null")
    size = known.groupBy("head").agg(F.sum("rows").alias("class_size"), F.min(F.struct("doc_id", "digest")).alias("least"))
    full = join_sized(known, cut(size), ["head"], "class_size")
    full = full.select("doc_id", "digest", "class_id", "rows", "class_size", (F.struct("doc_id", "digest") == F.col("least")).alias("first"))
    alone = rows.where("class_id is null").withColumns({"class_size": F.lit(1).cast("long"), "first": F.lit(True)})
    return full.unionByName(alone.select(*full.columns))


def dedup(docs: DataFrame, similarity: float = SIMILARITY, weighted: bool = False) -> DataFrame:
    """One row per document: doc_id, class_id (the smallest doc_id of its class), class_size, kept."""
    copy = _counted(docs, similarity, weighted).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    kept = F.col("class_id").isNull() | (F.col("first") & (F.col("copy") == 1))
    return copy.select("doc_id", "class_id", "class_size", kept.alias("kept"))


def keep(docs: DataFrame, similarity: float = SIMILARITY, weighted: bool = False) -> DataFrame:
    """One document of each class, with all its columns; rows with a null doc_id all stay."""
    stay = cut(_counted(docs, similarity, weighted).where("class_id is not null and first").select("doc_id", "digest", "rows"))
    return keep_one(docs.where("doc_id is not null"), stay, text_digest(F.col("text"))).unionByName(docs.where("doc_id is null"))
