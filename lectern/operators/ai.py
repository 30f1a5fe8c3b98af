"""External model calls behind one contract: cached, batched, validated, injectable.

The caller gives a function from a JSON payload to a JSON answer; without one, an
offline stub answers nothing. Requests are keyed by a digest of prompt and payload;
answers found in the cache are not asked again. The model's answers are advisory:
rows that do not fit the schema come out as violations.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import without_fence

BATCH, ATTEMPTS = 6, 3


def offline(_: str) -> str:
    return json.dumps({"items": []})


def batched(rows: DataFrame, size: int = BATCH, by: str = "doc_id", order: str = "ord") -> DataFrame:
    """Adds batch: rows of a document in order, ``size`` at a time."""
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1) / size).cast("int"))


def requests(rows: DataFrame, prompt: str, columns: list[str], by: str = "doc_id") -> DataFrame:
    """(by, batch, payload, key): a row a batch."""
    made = rows.groupBy(by, "batch").agg(F.to_json(F.struct(F.sort_array(F.collect_list(F.struct(*columns))).alias("items"))).alias("payload"))
    return made.withColumn("key", F.sha2(F.concat_ws("\u001f", F.lit(prompt), "payload"), 256))


def answers(asked: DataFrame, call: Callable[[str], str] = offline, cache: DataFrame | None = None, attempts: int = ATTEMPTS) -> DataFrame:
    """(key, answer, source): from the cache where it has the key, else from the call, tried again up to ``attempts`` times."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for payload in b["payload"]:
                answer = None
                for _ in range(attempts):
                    try:
                        answer = call(payload)
                        json.loads(answer)
                        break
                    except ValueError:
                        answer = None
                out.append(answer)
            yield pd.DataFrame({"key": b["key"], "answer": out, "source": "call"})

    wanted = asked.select("key", "payload").dropDuplicates(["key"])
    if cache is None:
        return wanted.mapInPandas(ask, "key string, answer string, source string")
    held = wanted.join(cache.select("key", "answer"), "key").select("key", "answer", F.lit("cache").alias("source"))
    return held.unionByName(wanted.join(cache, "key", "left_anti").mapInPandas(ask, "key string, answer string, source string"))


def parsed(rows: DataFrame, item_schema: str) -> DataFrame:
    """(key, item, violation): an answer's items, or why it was refused."""
    read = F.from_json(without_fence("answer"), f"struct<items:array<{item_schema}>>", {"mode": "PERMISSIVE"})
    out = rows.withColumn("items", read["items"])
    bad = F.when(F.col("answer").isNull(), "no answer").when(F.col("items").isNull(), "not the schema")
    return out.select("key", F.explode_outer("items").alias("item"), bad.alias("violation"))


def merged_verdicts(pairs: DataFrame, verdicts: DataFrame, least: float = 0.80) -> DataFrame:
    """Uncertain pairs with (pair_id, correct, confidence) verdicts: confirmed if correct and sure enough; unknown ids fall away."""
    joined = pairs.join(verdicts, "pair_id", "left")
    yes = F.coalesce(F.col("correct") & (F.col("confidence") >= least), F.lit(False))
    return joined.withColumns({"pair_status": F.when((F.col("pair_status") == "uncertain") & yes, "confirmed").otherwise(F.col("pair_status")), "ai_validated": F.col("correct").isNotNull()}).drop("correct", "confidence")
