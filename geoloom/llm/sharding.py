"""Sharding by size-tiered compaction (DataFrame functions only).

``append`` writes arrivals as small immutable Parquet files, a task's rows each, without a shuffle. ``compact`` sorts
shards into tiers by size (a factor FAN apart), merges runs of at least FAN shards of one tier into files of about
``target`` bytes, and leaves shards of that size alone. Both end by committing a manifest: the next version is written
aside and renamed into place, and the rename fails if another writer has taken the version. Readers use the files of one
version; files are never changed, so older versions stay readable until ``vacuum``.

Defined cases: rows are carried along whole with all columns, nulls and repeats included; an empty arrival adds no
shard, and a store of such arrivals reads as no rows; compacting a store without shards commits nothing; a shard of one version may hold rows of several arrivals.
"""

from __future__ import annotations

import math
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FAN = 4
TARGET = 128 << 20
SMALLEST = 64 << 10
AT_ONCE = 100  # new files that one job writes
ENTRY = "shard string, n_rows long, n_bytes long, added int"


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def versions(spark: SparkSession, store: str) -> list[int]:
    fs, where = _fs(spark, f"{store}/manifests")
    return sorted(int(s.getPath().getName()[1:]) for s in fs.listStatus(where) if s.getPath().getName()[0] == "v") if fs.exists(where) else []


def manifest(spark: SparkSession, store: str, version: int | None = None) -> DataFrame:
    """Entries (shard, n_rows, n_bytes, added) of a version, the latest if none is given."""
    known = versions(spark, store)
    if not known:
        return spark.createDataFrame([], ENTRY)
    return spark.read.schema(ENTRY).parquet(f"{store}/manifests/v{known[-1] if version is None else version:08d}")


def commit(entries: DataFrame, store: str, version: int) -> None:
    """Make ``entries`` the version, if it is still free."""
    spark = entries.sparkSession
    aside, final = f"{store}/manifests/.{uuid.uuid4().hex}", f"{store}/manifests/v{version:08d}"
    entries.coalesce(1).write.parquet(aside)
    jvm = spark._jvm
    src, dst = jvm.org.apache.hadoop.fs.Path(aside), jvm.org.apache.hadoop.fs.Path(final)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(src.toUri(), spark._jsc.hadoopConfiguration())
    no_options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    context.rename(src, dst, no_options)  # fails if dst exists


def _described(written: DataFrame, version: int) -> DataFrame:
    return written.groupBy(F.col("_metadata.file_path").alias("shard"), F.col("_metadata.file_size").alias("n_bytes")).agg(F.count("*").alias("n_rows")).select(
        "shard", "n_rows", "n_bytes", F.lit(version).alias("added")
    )


def append(rows: DataFrame, store: str) -> int:
    """Write ``rows`` as new shards; the version that has them."""
    spark, path = rows.sparkSession, f"{store}/shards/{uuid.uuid4().hex}"
    version = (versions(spark, store) or [0])[-1] + 1
    rows.write.option("compression", "zstd").parquet(path)
    new = _described(spark.read.schema(rows.schema).parquet(path), version)
    commit(manifest(spark, store).unionByName(new), store, version)
    return version


def merges(sizes: dict[str, int], target: int = TARGET, fan: int = FAN) -> dict[str, int]:
    """Shard -> number of the file it is merged into; shards that stay are left out."""
    tiers: dict[int, list[str]] = {}
    for shard, size in sizes.items():
        if size < target * 3 // 4:
            tiers.setdefault(int(math.log(max(size, SMALLEST) / SMALLEST, fan)), []).append(shard)
    out: dict[str, int] = {}
    number = 0
    for _, shards in sorted(tiers.items()):
        if len(shards) < fan:
            continue
        total, held = sum(sizes[s] for s in shards), 0
        files = max(1, round(total / target))
        for s in sorted(shards, key=lambda s: (sizes[s], s)):
            out[s] = number + min(files - 1, held * files // max(1, total))
            held += sizes[s]
        number += files
    return out


def compact(spark: SparkSession, store: str, target: int = TARGET, fan: int = FAN) -> int | None:
    """Merge what is due; the new version, or None if nothing was due. Shard names and sizes pass the driver."""
    known = versions(spark, store)
    if not known:
        return None
    now = manifest(spark, store, known[-1])
    plan = merges({r["shard"]: r["n_bytes"] for r in now.select("shard", "n_bytes").collect()}, target, fan)
    if not plan:
        return None
    version, path = known[-1] + 1, f"{store}/shards/{uuid.uuid4().hex}"
    groups: dict[int, list[str]] = {}
    for shard, number in plan.items():
        groups.setdefault(number, []).append(shard)
    schema = spark.read.parquet(*plan).schema
    merged = list(groups.values())
    for at in range(0, len(merged), AT_ONCE):  # a task reads the shards of one new file one after another: no shuffle
        parts = [spark.read.schema(schema).parquet(*shards).coalesce(1) for shards in merged[at : at + AT_ONCE]]
        reduce(DataFrame.union, parts).write.mode("append").option("compression", "zstd").parquet(path)
    new = _described(spark.read.schema(schema).parquet(path), version)
    old = spark.createDataFrame([(shard,) for shard in plan], "shard string")
    commit(now.join(old, "shard", "left_anti").unionByName(new), store, version)
    return version


def read(spark: SparkSession, store: str, version: int | None = None) -> DataFrame:
    """The rows of a version, with ``_metadata`` of their files. A store without rows still knows its columns from its empty arrivals."""
    shards = [r["shard"] for r in manifest(spark, store, version).select("shard").collect()]
    return spark.read.parquet(*shards) if shards else spark.read.parquet(f"{store}/shards/*").where("false")


def vacuum(spark: SparkSession, store: str) -> int:
    """Delete shard files and manifests that the latest version doesn't use; how many shards went."""
    known = versions(spark, store)
    keep = {r["shard"] for r in manifest(spark, store).select("shard").collect()}
    gone = {r["shard"] for v in known[:-1] for r in manifest(spark, store, v).select("shard").collect()} - keep
    for path in [*gone, *(f"{store}/manifests/v{v:08d}" for v in known[:-1])]:
        fs, where = _fs(spark, path)
        fs.delete(where, True)
    return len(gone)
