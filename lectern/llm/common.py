"""What the operators share: reading, shipping code to workers, cutting lineage, Arrow mapping."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .vec import batches

#: Characters of text that an Arrow operator handles at a time; a longer text stands alone.
GROUP = 500_000
#: The blanks of the contracts, as a regular expression.
BLANKS = r"[\x20\x09-\x0D]+"

#: A key is hot when it holds more than this share of all rows; so there are fewer than HOT of them.
HOT = 1000

_shipped: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Makes this package importable in the workers, wherever the driver started."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp()) / f"{root.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of its own where none is named and all runs on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = os.path.join(tempfile.gettempdir(), f"lectern-{os.getpid()}")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Writes a table to the shared folder and reads it back, so that a lost executor costs no recomputation of what came before.

    The table goes when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lectern-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def schema(text: str) -> T.StructType:
    return T._parse_datatype_string(text)


def texts_of(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def arrow_map(df: DataFrame, make: Callable, out: str | T.StructType, text: str = "text") -> DataFrame:
    """Maps rows by groups of about GROUP characters. make() gives the function from a record batch to arrays; it runs once a task."""
    ship(df.sparkSession)
    kind = schema(out) if isinstance(out, str) else out
    names = kind.fieldNames()

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = None
        for batch in rows:
            if not batch.num_rows:
                continue
            step = step or make()
            sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_pylist()
            for a, b in batches(sizes, GROUP):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(list(step(part)), names=names)

    import pyarrow.compute  # noqa: F401

    return df.mapInArrow(run, kind)


def plain(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that others cannot clash with what an operator adds."""
    return df.select(*names)


def text_column(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def join_sized(rows: DataFrame, table: DataFrame, on: list[str], size: str) -> DataFrame:
    """``rows`` joined with a stored ``table`` whose column ``size`` says how many rows each of its keys meets.

    Hot keys, of which there are fewer than HOT whatever the corpus holds, are
    broadcast, so that their rows stay where they are; only the others are shuffled.
    """
    total = table.agg(F.sum(size)).first()[0] or 0
    is_hot = F.col(size) * HOT > F.lit(total)
    hot = F.broadcast(table.where(is_hot))
    rest = rows.join(F.broadcast(table.where(is_hot).select(*on)), on, "left_anti")
    return rows.join(hot, on).unionByName(rest.join(table.where(~is_hot), on))


def keep_one(docs: DataFrame, kept: DataFrame, digest: Column, key: str = "__lectern_digest") -> DataFrame:
    """The rows of ``docs`` named by (doc_id, digest, rows) in ``kept``; of rows repeated under one doc_id and digest, one.

    The named side is narrow and is the one that is hashed; texts move once.
    """
    wide = docs.withColumn(key, digest)
    columns = docs.columns
    on = lambda k: (F.col("__l.doc_id").eqNullSafe(F.col("__r.doc_id"))) & (F.col(f"__l.{key}") == F.col("__r.digest"))  # noqa: E731, ARG005
    single = kept.where("rows = 1").select("doc_id", "digest")
    repeated = kept.where("rows > 1").select("doc_id", "digest")
    one = wide.alias("__l").join(single.hint("shuffle_hash").alias("__r"), on(0), "left_semi")
    many = wide.alias("__l").join(repeated.hint("shuffle_hash").alias("__r"), on(0), "left_semi")
    return one.unionByName(many.dropDuplicates(["doc_id", key])).select(*columns)
