"""Quality rules: counts over whole texts, and an isolation forest over them.

The forest has a group of trees for each statistic and one for all together. Trees
are grown on labelled clean rows; a node's split is drawn from its rows' range and a
margin beyond, so that rows outside what clean ones span fall into empty leaves early.
A group's score comes from the mean path length; its threshold from the scores of
all labelled rows. A document goes if a group finds it anomalous.

Rows: a null text counts as empty and fails the base rules; a null doc_id is
carried along; repeated rows are judged alike; other columns are not read; an empty
table gives no rows. A very long text is walked in slices, its words' places are held
at once. Without usable labels every document that passes the base rules is kept.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, cut, plain, schema, ship, texts_of
from .vec import BLANK, SLICE, U64, batches, code_points, differ, identities, mix, offsets, paired, per_document, runs, slices, span_hashes, windows

SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Least words, and the share of repeated words in per cent, of the base rules.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Labelled rows that trees are grown on at most, taken in the order of a hash of doc_id; thresholds see all labelled rows.
LABELLED = 6000
#: Trees of a group, rows of a tree, levels of a tree.
TREES, TREE_ROWS, DEPTH = 32, 256, 12
#: How far beyond its rows' range a split may be drawn, as a share of the spread of all labelled rows.
MARGIN = 0.2
#: Share of labelled clean rows that all thresholds together may give up.
CLEAN_LOSS = 0.002
ROWS_AT_ONCE = 512
#: Steps from score 0 to 1 in which labelled rows' scores are counted.
STEPS = 2048

LOWER, UPPER, DIGIT, MARK = 1, 2, 4, 8


@lru_cache(1)
def _traits() -> np.ndarray:
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))
        out[c] = {"Lu": UPPER, "Lt": UPPER, "Nd": DIGIT}.get(kind, LOWER if kind[0] == "L" else MARK if kind[0] in "PS" else 0)
    return out


@lru_cache(1)
def _symbols() -> np.ndarray:
    out = np.zeros(0x110000, bool)
    out[[ord(c) for c in SYMBOLS]] = True
    return out


class Rules:
    """Counts of each text, by whole arrays; lines are compared as strings, words by hash and then by their characters."""

    def __call__(self, texts: list[str]) -> dict[str, np.ndarray]:
        n = len(texts)
        hashes, owners, letters, starts, ends, base = [], [], [], [], [], 0
        sums = {k: np.zeros(n, np.int64) for k in ("word_chars", "n_symbols", "letters", "upper", "digits", "marks")}
        traits, symbols = _traits(), _symbols()
        for docs, at, joined in slices(texts):
            codes = code_points(joined)
            solid = ~BLANK[codes]
            start, end = runs(solid, at)
            hashes.append(span_hashes(codes, start, end))
            owners.append(docs[np.searchsorted(at, start, "right") - 1])
            letters.append(codes)
            starts.append(base + start)
            ends.append(base + end)
            base += len(codes)
            kind = traits[codes]
            for name, flag in (("word_chars", solid), ("n_symbols", symbols[codes]), ("letters", (kind & (LOWER | UPPER)) > 0), ("upper", kind == UPPER), ("digits", kind == DIGIT), ("marks", kind == MARK)):
                np.add.at(sums[name], docs, per_document(flag, at))
        h = np.concatenate(hashes) if hashes else np.zeros(0, U64)
        doc = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        off = offsets(doc, n)
        spans = (np.concatenate(letters), np.concatenate(starts), np.concatenate(ends)) if hashes else None
        repeated = self.repeated(h, doc, off, spans)
        lines, dup = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for i, t in enumerate(texts):
            solid_lines = [x for x in t.split("\n") if x.strip(" \t\n\v\f\r")]
            lines[i], dup[i] = len(solid_lines), len(solid_lines) - len(set(solid_lines))
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        return {"n_words": np.diff(off), "n_dup_lines": dup, "n_repeat_words": per_document(repeated, off), "n_lines": lines, "n_same": per_document(same, off), **sums}

    @staticmethod
    def repeated(h: np.ndarray, doc: np.ndarray, off: np.ndarray, spans: tuple[np.ndarray, ...] | None) -> np.ndarray:
        """Whether each word lies in a window of three words that its text has twice or more."""
        out = np.zeros(len(h), bool)
        g, first = windows(h, off, 3)
        if not len(g):
            return out
        key = g ^ mix(doc[first].astype(U64))
        order = np.argsort(key, kind="stable")
        equal = np.flatnonzero(key[order[1:]] == key[order[:-1]])
        if not Rules._confirmed(first[order[equal]], first[order[equal + 1]], doc, spans):
            word = identities(*spans, h)
            key = paired(doc[first], paired(paired(word[first], word[first + 1]), word[first + 2]))
            order = np.argsort(key, kind="stable")
            equal = np.flatnonzero(key[order[1:]] == key[order[:-1]])
        hit = first[order[np.concatenate([equal, equal + 1])]]
        for j in range(3):
            out[hit + j] = True
        return out

    @staticmethod
    def _confirmed(a: np.ndarray, b: np.ndarray, doc: np.ndarray, spans: tuple[np.ndarray, ...]) -> bool:
        """Whether the windows that begin at words a and b are equal, pair by pair, in their characters and documents."""
        codes, start, end = spans
        if (doc[a] != doc[b]).any():
            return False
        for j in range(3):
            for low, high in batches((end[a + j] - start[a + j]).tolist(), SLICE):
                x, y = a[low:high] + j, b[low:high] + j
                if differ(codes, start[x], end[x], codes, start[y], end[y] - start[y]).any():
                    return False
        return True


FEATURES = ["symbols", "dup_lines", "repeats", "word_length", "upper", "marks", "digits", "same", "line_words"]


def features(c: dict[str, np.ndarray]) -> np.ndarray:
    """The forest's view of the counts: shares that do not depend on a text's length."""
    words, chars = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1)
    return np.stack(
        [
            c["n_symbols"] / chars,
            c["n_dup_lines"] / np.maximum(c["n_lines"], 1),
            c["n_repeat_words"] / words,
            np.log(chars / words),
            c["upper"] / np.maximum(c["letters"], 1),
            (c["marks"] - c["n_symbols"]) / words,
            c["digits"] / chars,
            c["n_same"] / words,
            np.log(words / np.maximum(c["n_lines"], 1)),
        ],
        axis=1,
    ).astype(np.float64)


def base_failed(words, repeated):
    return (words < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * words)


class IsolationForest:
    """Random splits over samples of rows; rows that few splits set apart are anomalous. Trees are flat arrays."""

    def __init__(self, views: list[list[int]], trees: int = TREES, rows: int = TREE_ROWS, seed: int = 7):
        self.views, self.trees, self.rows, self.seed = views, trees, rows, seed
        self.groups: list[list[tuple[np.ndarray, ...]]] = [[] for _ in views]
        self.norm = 1.0

    @staticmethod
    def _rest(n: float) -> float:
        """Mean path length of n rows that are not split further."""
        return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n

    def _tree(self, x: np.ndarray, view: list[int], margin: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        sample = x[rng.choice(len(x), min(self.rows, len(x)), replace=False)]
        feature, cut_at, left, right, length = [], [], [], [], []
        todo = [(np.arange(len(sample)), 0, -1, False)]
        while todo:
            rows, level, parent, is_right = todo.pop()
            me = len(feature)
            if parent >= 0:
                (right if is_right else left)[parent] = me
            feature.append(0)
            cut_at.append(np.inf)
            left.append(me)
            right.append(me)
            length.append(level + self._rest(len(rows)))
            if level == DEPTH or not len(rows):
                continue
            part = sample[rows]
            low, high = part.min(0) - margin, part.max(0) + margin
            open_ = [f for f in view if high[f] > low[f]]
            if open_:
                f = open_[int(rng.integers(len(open_)))]
                feature[me], cut_at[me] = f, rng.uniform(low[f], high[f])
                below = part[:, f] < cut_at[me]
                todo += [(rows[below], level + 1, me, False), (rows[~below], level + 1, me, True)]
        return np.array(feature, np.int8), np.array(cut_at), np.array(left, np.int16), np.array(right, np.int16), np.array(length, np.float32)

    def fit(self, x: np.ndarray, spread: np.ndarray) -> IsolationForest:
        """Grows every group on the rows of ``x``; ``spread`` is the width of each statistic among all rows seen."""
        if len(x):
            rng = np.random.default_rng(self.seed)
            self.norm = max(self._rest(min(self.rows, len(x))), 1e-9)
            self.groups = [[self._tree(x, view, MARGIN * spread, rng) for _ in range(self.trees)] for view in self.views]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """(rows, groups), 0 to 1; higher is more anomalous. All trees are walked together, ROWS_AT_ONCE rows at a time."""
        out = np.zeros((len(x), len(self.views)))
        trees = [t for g in self.groups for t in g]
        if not trees:
            return out
        first = np.concatenate([[0], np.cumsum([len(t[0]) for t in trees])]).astype(np.int32)
        feature, cut_at = (np.concatenate([t[i] for t in trees]) for i in (0, 1))
        after = np.concatenate([np.stack([t[2], t[3]], axis=1) + f for t, f in zip(trees, first[:-1], strict=True)]).astype(np.int32).ravel()
        length = np.concatenate([t[4] for t in trees]).astype(np.float64)
        for low in range(0, len(x), ROWS_AT_ONCE):
            part = x[low : low + ROWS_AT_ONCE]
            at = np.broadcast_to(first[:-1], (len(part), len(trees))).copy()
            for _ in range(DEPTH):
                value = np.take_along_axis(part, feature[at].astype(np.int64), axis=1)
                at = after[2 * at + (value >= cut_at[at])]
            mean = length[at].reshape(len(part), len(self.groups), -1).mean(axis=2)
            out[low : low + len(part)] = 2.0 ** (-mean / self.norm)
        return out


#: Each statistic by itself, and all of them.
VIEWS = [[f] for f in range(len(FEATURES))] + [list(range(len(FEATURES)))]


class Verdict:
    """A forest and the score of each of its groups from which documents are rejected."""

    def __init__(self, forest: IsolationForest, thresholds: np.ndarray):
        self.forest, self.thresholds = forest, thresholds

    def __call__(self, counts: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(score of the group nearest to its threshold or furthest beyond it, base_failed, kept)."""
        scores = self.forest.score(features(counts))
        beyond = scores - self.thresholds
        nearest = beyond.argmax(axis=1) if len(scores) else np.zeros(0, np.int64)
        failed = base_failed(counts["n_words"], counts["n_repeat_words"])
        return scores[np.arange(len(scores)), nearest], failed, ~failed & (beyond < 0).all(axis=1)


def thresholds(clean: np.ndarray, junk: np.ndarray, loss: float = CLEAN_LOSS) -> np.ndarray:
    """A threshold for each group, from counts (groups, STEPS) of labelled rows by score.

    It lies half-way between the highest score that clean rows may have (all but the
    group's share of ``loss``) and the next higher one of junk, so that clean
    documents a little beyond those seen stay; a group that tells no junk apart rejects nothing.
    """
    out = np.full(len(clean), np.inf)
    for g, (good, bad) in enumerate(zip(clean, junk, strict=True)):
        if good.sum() < 2:
            continue
        highest = int(np.searchsorted(np.cumsum(good), np.ceil((1 - loss / len(clean)) * good.sum())))
        above = np.flatnonzero(bad[highest + 1 :])
        if len(above):
            out[g] = (highest + 1 + (above[0] + 1) / 2) / STEPS
    return out


STATS = [*COUNTS, "n_lines", "n_same", "letters", "upper", "digits", "marks"]


def _arrays(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {k: np.asarray(batch.column(k), np.int64) for k in STATS}


def stats(docs: DataFrame) -> DataFrame:
    """(doc_id and the counts STATS) of every document, in one pass over the texts."""

    def make():
        rules = Rules()

        def step(batch: pa.RecordBatch):
            c = rules(texts_of(batch.column("text")))
            return [batch.column("doc_id"), *(pa.array(c[k]) for k in STATS)]

        return step

    return arrow_map(plain(docs, "doc_id", "text"), make, "doc_id long, " + ", ".join(f"{k} long" for k in STATS))


def fit(counted: DataFrame, labels: DataFrame, rows: int = LABELLED, loss: float = CLEAN_LOSS) -> Verdict:
    """A verdict from a stored table of ``stats`` and labels; it gives up at most ``loss`` of the labelled clean rows.

    Trees are grown on a bounded sample; thresholds come from how many of all
    labelled rows have each score, a table of bounded size.
    """
    named = plain(labels, "doc_id", "quality").where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    passed = counted.where(f"n_words >= {LEAST_WORDS} and 100 * n_repeat_words <= {MOST_REPEATED} * n_words")
    marked = cut(passed.join(named, "doc_id"))
    got = marked.orderBy(F.xxhash64("doc_id"), "doc_id", *STATS).limit(rows).collect()
    x = features({k: np.array([r[k] for r in got], np.int64) for k in STATS})
    clean = np.array([r["quality"] == 1 for r in got], bool)
    forest = IsolationForest(VIEWS)
    if clean.sum() < 2 or clean.all():
        return Verdict(forest, np.full(len(VIEWS), np.inf))
    forest.fit(x[clean], np.quantile(x, 0.999, axis=0) - np.quantile(x, 0.001, axis=0))

    def count(batches):
        for b in batches:
            at = np.minimum((forest.score(features(_arrays(b))) * STEPS).astype(np.int64), STEPS - 1)
            good = np.asarray(b.column("quality"), np.int64) == 1
            key, n = np.unique((np.arange(len(VIEWS)) * STEPS + at) * 2 + good[:, None], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["key", "n"])

    ship(marked.sparkSession)
    table = np.zeros(len(VIEWS) * STEPS * 2, np.int64)
    for r in marked.mapInArrow(count, schema("key long, n long")).groupBy("key").agg(F.sum("n").alias("n")).collect():
        table[r["key"]] = r["n"]
    table = table.reshape(len(VIEWS), STEPS, 2)
    return Verdict(forest, thresholds(table[:, :, 1], table[:, :, 0], loss))


def judge(counted: DataFrame, verdict: Verdict) -> DataFrame:
    """(doc_id, counts, base_failed, kept, anomaly) of every row of ``stats``, without a shuffle."""

    def run(batches):
        for b in batches:
            s, failed, kept = verdict(_arrays(b))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(b.column(k) for k in COUNTS), pa.array(failed), pa.array(kept), pa.array(s)], names=names)

    out = schema("doc_id long, " + ", ".join(f"{k} long" for k in COUNTS) + ", base_failed boolean, kept boolean, anomaly double")
    names = out.fieldNames()
    ship(counted.sparkSession)
    return counted.mapInArrow(run, out)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``judge`` of all documents by a verdict fitted to the labels; texts are read once."""
    counted = cut(stats(docs))
    return judge(counted, fit(counted, labels))


def keep(docs: DataFrame, verdict: Verdict) -> DataFrame:
    """The documents that the verdict keeps, with all their columns."""

    def make():
        rules = Rules()

        def step(batch: pa.RecordBatch):
            kept = verdict(rules(texts_of(batch.column("text"))))[2]
            return batch.filter(pa.array(kept)).columns

        return step

    return arrow_map(docs, make, docs.schema)
