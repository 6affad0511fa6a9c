"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where that is unset, one of our own, in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='geoloom-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/geoloom/{name}-{uuid.uuid4().hex}"


CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors.

    The shuffle files of the write are dropped once it has ended, since nothing else reads them; the session's setting comes back.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    before = spark.conf.get(CLEAN)
    spark.conf.set(CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what ``materialise`` wrote, once nothing lazy reads it any more."""
    path = _paths.pop(df)
    jvm = df.sparkSession._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def short_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts can be long: fewer rows in an Arrow batch than Spark's 10,000, unless the session was set otherwise."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}


def per_text(rows: DataFrame, made: dict[str, str], f: Callable[[list[str]], tuple], size: int = 256) -> DataFrame:
    """rows with a column ``text`` -> the other columns and those that f makes of ``size`` texts at a time."""
    short_batches(rows.sparkSession)
    keep = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, size):
                part = b.slice(at, size)
                new = f(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *(pa.array(x, _ARROW[t]) for x, t in zip(new, made.values(), strict=True))], names=[*keep, *made])

    schema = rows.select(*keep).schema
    for name, kind in made.items():
        schema = schema.add(name, kind)
    return rows.mapInArrow(run, schema)


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def spare(columns: list[str], *names: str) -> list[str]:
    """The names, with underscores added until no column has them in any case."""
    taken = {c.lower() for c in columns}

    def free(name: str) -> str:
        return free(name + "_") if name.lower() in taken else name

    return [free(n) for n in names]


def only(docs: DataFrame, reps: DataFrame, id_col: str, hashed: Column) -> DataFrame:
    """The rows of ``docs`` whose id and hash are in reps (doc_id, h), with all their columns; of rows equal in both one stays.

    Both the join and the dropping of repeated rows go by the hashes of text and id, so rows move once.
    """
    h, i, its, other, other_i = spare(docs.columns, "__h", "__i", "__id", "__hash", "__hash_i")
    reps = reps.select(F.col("doc_id").alias(its), F.col("h").alias(other), F.xxhash64("doc_id").alias(other_i))
    rows = docs.withColumn(h, hashed).withColumn(i, F.xxhash64(id_col))
    same = (F.col(h) == F.col(other)) & (F.col(i) == F.col(other_i)) & F.col(id_col).eqNullSafe(F.col(its))
    return rows.join(reps.hint("merge"), same, "left_semi").dropDuplicates([h, i, id_col]).select(*docs.columns)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
