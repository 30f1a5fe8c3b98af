"""Operators over the whole corpus: deduplication, packing, sharding, the pipeline."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lectern.llm import common, exact, near, packing, queries, rules, secrets, shards

SF = "/root/testdata/sf0.001"


def digest(t):
    return hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()


@pytest.mark.parametrize("which", ["odd", "docs", "empty"])
def test_exact(request, which):
    df = request.getfixturevalue(which)
    groups = {}
    for r in df.select("doc_id", "text").collect():
        groups.setdefault(digest(r.text), []).append(r.doc_id)
    got = exact.dedup(df).collect()
    assert len(got) == df.count()
    for r in got:
        ids = groups[r.text_sha256]
        known = [i for i in ids if i is not None]
        assert r.group_size == len(ids) and r.keep_id == (min(known) if known else None)
    assert sum(r.kept for r in got) == len(groups)
    kept = exact.keep(df)
    assert kept.columns == df.columns and sorted(digest(r.text) for r in kept.collect()) == sorted(groups)


def test_perfect_hash():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 2**63, (5000, 4)).astype(np.uint64)
    f = exact.PerfectHash.build(words)
    assert sorted(f.slots(words).tolist()) == list(range(5000))
    assert len(f.slots(rng.integers(0, 2**63, (100, 4)).astype(np.uint64))) == 100
    assert exact.PerfectHash.build(words[:0]).slots(words[:3]).tolist() == [-1, -1, -1]


def test_queries_with_sql(spark):
    c = duckdb.connect()
    c.execute("SET enable_progress_bar = false")
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    for name, sql in queries.ORACLES.items():
        df = queries.QUERIES[name](spark, SF)
        want = c.sql(sql)
        order = [want.columns.index(x) for x in df.columns]
        assert sorted(map(tuple, df.collect())) == sorted(tuple(r[i] for i in order) for r in want.fetchall())


def brute_classes(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    cls = list(range(len(sets)))

    def find(x):
        while cls[x] != x:
            x = cls[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or a and b and len(a & b) >= 0.8 * len(a | b):
                cls[find(i)] = find(j)
    return [find(i) for i in range(len(sets))]


def same_partition(a, b):
    return len(set(a)) == len(set(b)) == len(set(zip(a, b, strict=True)))


def copies(n, seed):
    """Copies of one text with 0 to 8 words changed, moved ends, and copies of copies."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    out = [base]
    for _ in range(n - 1):
        w = list(rng.choice(out) if rng.random() < 0.3 else base)
        for _ in range(rng.randrange(8)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        if rng.random() < 0.3:
            w = w[: len(w) - rng.randrange(40)]
        out.append(w)
    return [" ".join(w) for w in out]


@pytest.mark.parametrize("seed", [1, 2])
def test_near_matches_brute_force(spark, docs, seed):
    texts = [r.text for r in docs.orderBy("doc_id").limit(60).collect()] + copies(80, seed) + copies(20, seed + 10)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in near.dedup(df).collect()}
    assert same_partition([got[i].class_id for i in range(len(texts))], brute_classes(texts))
    for r in got.values():
        members = [x.doc_id for x in got.values() if x.class_id == r.class_id]
        assert r.class_id == min(members) and r.class_size == len(members) and r.kept == (r.doc_id == r.class_id)
    assert sorted(r.doc_id for r in near.keep(df).collect()) == sorted(i for i, r in got.items() if r.kept)


def test_near_odd(odd, empty):
    got = near.dedup(odd).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[2].class_id == 1 and by[10].class_id == 1 and by[4].class_id == by[3].class_id == by[5].class_id == 3 and by[7].class_id == 6
    assert sum(r.kept for r in got if r.doc_id == 2) == 0 and all(r.class_id is None and r.kept for r in got if r.doc_id is None)
    kept = near.keep(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r.kept for r in got)
    assert near.dedup(empty).count() == 0


def test_one_id_with_two_texts(spark):
    """Different texts under one doc_id are judged apart; of one class one row stays."""
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    df = spark.createDataFrame([(1, a), (1, b), (2, " ".join(f"c{i}" for i in range(40))), (3, b + " end"), (1, a)], "doc_id long, text string")
    assert sorted((r.doc_id, r.class_id, r.class_size, r.kept) for r in near.dedup(df).collect()) == [(1, 1, 2, False), (1, 1, 2, True), (1, 1, 2, True), (2, 2, 1, True), (3, 1, 2, False)]
    assert sorted((r.doc_id, r.text) for r in near.keep(df).collect()) == sorted([(1, a), (1, b), (2, " ".join(f"c{i}" for i in range(40)))])


def test_weights_count_repeats(spark):
    """With weights two texts that share a line many times are similar; as sets they are not."""
    line = " ".join(f"r{i}" for i in range(10)) + " "
    df = spark.createDataFrame([(i, " ".join(f"t{i}_{j}" for j in range(30)) + " " + line * 40) for i in range(2)], "doc_id long, text string")
    assert sorted(r.class_id for r in near.dedup(df).collect()) == [0, 1]
    assert sorted(r.class_id for r in near.dedup(df, weighted=True).collect()) == [0, 0]


def test_hot_keys(spark):
    """A key with most rows is joined without a shuffle, others as ever; each row once."""
    rows = spark.createDataFrame([(0 if i % 3 else i, i) for i in range(3000)], "k long, v long")
    table = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("name", F.col("k") + 1)
    got = common.join_sized(rows, common.cut(table), ["k"], "n").collect()
    assert sorted(r.v for r in got) == list(range(3000)) and all(r.name == r.k + 1 for r in got)


def test_dart_signatures():
    rng = np.random.default_rng(2)
    pool = near.mix(np.arange(1, 500, dtype=np.uint64))
    for share, weights in ((0.8, None), (0.5, None), (0.5, 2.5)):
        same = round(200 * share)
        a, b = pool[:200], np.concatenate([pool[:same], pool[200 : 400 - same]])
        w = np.ones(200) if weights is None else np.where(np.arange(200) % 2 == 0, weights, 0.5)
        s = near.dart_minhash(np.concatenate([a, b]), np.concatenate([w, w]), np.array([0, 200, 400]), 4096)
        wa, wb = dict(zip(a.tolist(), w, strict=True)), dict(zip(b.tolist(), w, strict=True))
        keys = set(wa) | set(wb)
        true = sum(min(wa.get(k, 0), wb.get(k, 0)) for k in keys) / sum(max(wa.get(k, 0), wb.get(k, 0)) for k in keys)
        assert abs((s[0] == s[1]).mean() - true) < 0.04
    order = rng.permutation(200)
    one = near.dart_minhash(pool[:200], np.ones(200), np.array([0, 200]))
    assert (one == near.dart_minhash(pool[:200][order], np.ones(200), np.array([0, 200]))).all()


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(100 + rng.randrange(30), 100 + rng.randrange(30)) for _ in range(25)]
    got = {r.node: r.class_id for r in near.components(spark.createDataFrame(edges, "node long, pivot long")).collect()}
    cls = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            cls[a] = cls[b] = min(cls[a], cls[b])
    assert all(got.get(x, x) == c for x, c in cls.items())


@pytest.mark.parametrize("which", ["odd", "docs", "empty"])
def test_packing(request, which):
    df = request.getfixturevalue(which)
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {}
    for r in df.collect():
        ids.setdefault(r.doc_id, []).append([*lib.encode(r.text or "", add_special_tokens=False).ids, 0])
    got = packing.pack(df).collect()
    assert sum(r.length for r in got) == sum(len(x) for v in ids.values() for x in v)
    held = {}
    for r in got:
        held.setdefault(r.sequence_id, []).append(r)
        own = [x for x in ids[r.doc_id] if len(x) == r.doc_tokens and zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32]
        assert own
    for parts in held.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert sorted(held) == list(range(len(held)))


def test_patterns():
    rng = random.Random(3)
    lengths = {}
    for _ in range(20000):
        n = rng.randint(1, 1024)
        lengths[n] = lengths.get(n, 0) + 1
    packs = packing.patterns(lengths)
    assert all(sum(p) <= 1024 for _, p in packs)
    back = {}
    for c, p in packs:
        for n in p:
            back[n] = back.get(n, 0) + c
    assert back == lengths
    assert sum(c * (1024 - sum(p)) for c, p in packs) < 0.02 * sum(n * c for n, c in lengths.items())


def test_shards(spark, odd, empty):
    number = lambda s, b: int(hashlib.md5(s.encode()).hexdigest()[b : b + 8], 16)
    n, size = 7, 211
    orders = [[(number(f"shard-{i}", 0) % size + j * (number(f"shard-{i}", 8) % (size - 1) + 1)) % size for j in range(size)] for i in range(n)]
    table, at, turn = {}, [0] * n, 0
    while len(table) < size:
        i = turn % n
        while orders[i][at[i]] in table:
            at[i] += 1
        table[orders[i][at[i]]] = i
        turn += 1
    assert {r.slot: r.shard for r in shards.lookup_table(spark, n, size).collect()} == table
    got = shards.place(odd, "doc_id", n, size).collect()
    assert len(got) == odd.count()
    for r in got:
        slot = number("" if r.doc_id is None else str(r.doc_id), 0) % size
        assert (r.slot, r.shard) == (slot, table[slot])
    assert shards.place(empty, "doc_id", n, size).count() == 0
    with pytest.raises(ValueError):
        shards.lookup_table(spark, 4, 210)


def test_pipeline_matches_brute_force(spark, docs, labels):
    out = [r.asDict() for r in corpus_pipeline.run(spark, SF).collect()]
    kept = {r.doc_id for r in rules.score(docs, labels).where("kept").collect()}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in kept}
    first = {}
    for i in sorted(texts):
        first.setdefault(digest(texts[i]), i)
    left = sorted(first.values())
    classes = brute_classes([texts[i] for i in left])
    least = {}
    for i, c in zip(left, classes, strict=True):
        least.setdefault(c, i)
    final = {i: secrets.redacted(texts[i]) for i in least.values()}
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: len(lib.encode(t, add_special_tokens=False).ids) + 1 for i, t in final.items()}
    assert {r["doc_id"]: r["doc_tokens"] for r in out} == want


def test_pipeline_stages_keep_columns(spark, odd, empty):
    for df in (odd, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, df, SF).columns == df.columns
