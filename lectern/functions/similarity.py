"""Similarity scores: components as columns, edit-distance ratios as Arrow UDFs.

Token recall, entity overlap and the layout scores are built-ins. The ratios need
a longest common subsequence, which Spark lacks; they run on Arrow batches.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, entities, normalize_for_similarity, references, similarity_tokens


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit vectors over the shorter text."""
    if len(a) < len(b):
        a, b = b, a
    at: dict[str, int] = {}
    for i, c in enumerate(b):
        at[c] = at.get(c, 0) | 1 << i
    mask = (1 << len(b)) - 1
    row = mask
    for c in a:
        u = row & at.get(c, 0)
        row = (row + u | row - u) & mask
    return len(b) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """100 for equal texts, 0 for texts without a common character."""
    return 200.0 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_set_ratio(a: str, b: str) -> float:
    """The best ratio among the common words and the common words with either text's own."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    left, right = " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not left or not right):
        return 100.0
    one, two = f"{both} {left}".strip(), f"{both} {right}".strip()
    best = indel_ratio(one, two)
    if both:
        best = max(best, indel_ratio(both, one), indel_ratio(both, two))
    return best


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter text with a window of the longer."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0.0
    if a in b:
        return 100.0
    return max(indel_ratio(a, b[max(0, i) : i + len(a)]) for i in range(1 - len(a), len(b)))


def sequence_ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


def _pairwise(f):
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([f(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")

    return run


def ratio_udf():
    return _pairwise(indel_ratio)


def token_set_udf():
    return _pairwise(token_set_ratio)


def partial_udf():
    return _pairwise(partial_ratio)


def sequence_udf():
    return _pairwise(sequence_ratio)


def token_recall(left: Column | str, right: Column | str) -> Column:
    """The share of the left text's tokens, counted with repeats, that the right one has."""
    a, b = similarity_tokens(left), similarity_tokens(right)
    times = lambda tokens, t: F.size(F.filter(tokens, lambda x: x == t))
    common = F.aggregate(F.array_distinct(a), F.lit(0), lambda s, t: s + F.least(times(a, t), times(b, t)))
    return common / F.greatest(F.size(a), F.lit(1))


def token_bag(c: Column | str) -> Column:
    """The tokens of a text with a number for each repeat, so that bags meet as sets. Meant to be worked out once a text."""
    ordered = F.sort_array(similarity_tokens(c))
    return F.transform(F.array(ordered), lambda t: F.transform(t, lambda x, i: F.concat_ws("\u0001", x, (i + 1 - F.array_position(t, x)).cast("string"))))[0]


def bag_recall(left: Column, right: Column) -> Column:
    """``token_recall`` of bags."""
    return F.size(F.array_intersect(left, right)) / F.greatest(F.size(left), F.lit(1))


def entity_set(text: Column | str, translated: Column | str | None = None) -> Column:
    both = col(text) if translated is None else F.concat_ws(" ", col(text), col(translated))
    return F.array_union(entities(both), references(text))


def set_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity; one half where both sides are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.5).otherwise(F.size(F.array_intersect(a, b)) / union)


def semantic_of(norm_a: Column, norm_b: Column, recall: Column, token_set, sequence) -> Column:
    """Half token set, a quarter sequence, a quarter token recall of normalised texts; 0 where a side is empty. Takes the two UDFs."""
    score = 0.5 * token_set(norm_a, norm_b) / 100 + 0.25 * sequence(norm_a, norm_b) + 0.25 * recall
    return F.when((norm_a == "") | (norm_b == ""), 0.0).otherwise(F.least(F.lit(1.0), score))


def semantic_similarity(left: Column | str, right: Column | str, token_set, sequence) -> Column:
    """Half token set, a quarter sequence, a quarter token recall; 0 where a side is empty. Takes the two UDFs."""
    return semantic_of(normalize_for_similarity(left), normalize_for_similarity(right), token_recall(left, right), token_set, sequence)


def entity_score(source: Column | str, translated: Column | str, target: Column | str) -> Column:
    """Jaccard similarity of the entities of both sides; one half where there are none."""
    return set_similarity(entity_set(source, translated), entity_set(target))


def page_score(a: Column | str, b: Column | str) -> Column:
    gap = F.abs(col(a) - col(b))
    return F.when(gap == 0, 1.0).when(gap == 1, 0.65).when(gap == 2, 0.2).otherwise(0.0)


def section_score(a: Column | str, b: Column | str) -> Column:
    empty = lambda c: F.coalesce(col(c), F.lit("")) == ""
    return F.when(empty(a) | empty(b), 0.5).when(col(a) == col(b), 1.0).otherwise(0.0)


def length_score(a: Column | str, b: Column | str) -> Column:
    x, y = F.length(col(a)), F.length(col(b))
    return F.when((x == 0) | (y == 0), 0.0).otherwise(F.sqrt(F.least(x, y) / F.greatest(x, y)))


def layout_score(a: Column, b: Column) -> Column:
    """Nearness of two blocks (structs with page, ord, table_id, row_index, y0, y1)."""
    same_table = a["table_id"].isNotNull() & (a["table_id"] == b["table_id"])
    by_row = F.when(a["row_index"] == b["row_index"], 1.0).when(a["row_index"].isNotNull() & b["row_index"].isNotNull(), F.greatest(F.lit(0.0), 1 - F.abs(a["row_index"] - b["row_index"]) / 4))
    by_order = F.greatest(F.lit(0.0), 1 - F.abs(a["ord"] - b["ord"]) / 800)
    height = F.greatest(a["y1"], b["y1"], F.lit(1.0))
    by_height = F.greatest(F.lit(0.0), 1 - F.abs((a["y0"] + a["y1"]) / 2 - (b["y0"] + b["y1"]) / 2) / height)
    rest = F.when(a["page"] != b["page"], 0.2).when(a["y1"].isNull() | b["y1"].isNull(), by_order).otherwise(by_height)
    return F.coalesce(F.when(same_table, by_row), rest)


#: Weights of the pair score.
WEIGHTS = {"semantic": 0.55, "entities": 0.15, "page": 0.10, "section": 0.10, "length": 0.05, "layout": 0.05}


def weighted_score(parts: dict[str, Column]) -> Column:
    total = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        total = total + weight * parts[name]
    return F.least(total, F.lit(1.0))


def structural_score(a: Column, b: Column) -> Column:
    """Additive evidence from page, section, table and order that two blocks stand side by side, at most 1."""
    same_page = a["page"] == b["page"]
    gap = F.abs(a["ord"] - b["ord"])
    same_table = F.coalesce(a["table_id"] == b["table_id"], F.lit(False))
    part = lambda c, w: F.when(F.coalesce(c, F.lit(False)), w).otherwise(0.0)
    total = F.when(same_page, 0.25).when(F.abs(a["page"] - b["page"]) == 1, 0.08).otherwise(0.0)
    total = total + part((a["section"] != "") & (a["section"] == b["section"]), 0.20)
    total = total + part(same_table, 0.25) + part(same_table & (a["row_index"] == b["row_index"]), 0.20) + part(same_table & (F.abs(a["col_index"] - b["col_index"]) == 1), 0.10)
    total = total + F.when(same_page & (gap <= 2), 0.25).when(same_page & (gap <= 8), 0.15).otherwise(0.0)
    height = F.greatest(a["y1"], b["y1"], F.lit(1.0))
    total = total + part(same_page & (F.abs((a["y0"] + a["y1"]) - (b["y0"] + b["y1"])) / 2 / height <= 0.035), 0.15)
    return F.least(total, F.lit(1.0))


def structural_candidate(structural: Column, confirmed: float = 0.82, uncertain: float = 0.68) -> Column:
    """A score that stays below confirmation, whatever the layout; null below 0.70."""
    return F.when(structural >= 0.70, F.greatest(F.lit(uncertain), F.least(F.lit(confirmed - 0.01), 0.60 + 0.18 * structural)))
