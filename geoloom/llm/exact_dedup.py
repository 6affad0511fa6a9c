"""Exact dedup by an extendible-hash index on shared files (DataFrame functions only).

Every distinct text is one entry of the index: 64-bit key, digest, length, the largest doc_id and the number of rows.
``groupBy(key, text)`` inserts rows: map tasks combine their copies first, and texts whose keys collide are told apart by
their bytes (the grouping is on the text itself), so a text held by a third of all rows is one partial row per map task.
The directory has a slot for each value of the key's leading bits; their number grows until no slot holds more than
``capacity`` entries, and slots that fit together share a bucket, as they would if overfull buckets had been split one bit
at a time. The directory is a table, not a list on the driver. Owner tasks take whole buckets, number the entries of equal
keys as a chain and write them in order. A row finds its bucket through its slot, and its entry in the bucket's chain by
key, length and SHA-256.

Defined cases: a null text counts as empty; a null doc_id is smaller than any other; rows repeated with the same doc_id
and text are copies like any other and exactly one of them is kept; an empty table gives no rows; other columns are
carried along by ``drop_copies`` whatever their names and ignored by ``exact_copies``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.llm.common import materialise, only, text_or_empty

CAPACITY = 1 << 12
STEP = 4  # bits by which the directory grows at once
DEEPEST = 56  # one chain of equal keys cannot be split further


def key_of(text: Column) -> Column:
    return F.xxhash64(text)


def _prefix(depth: int) -> Column:
    return F.shiftrightunsigned("key", 64 - depth) if depth else F.lit(0).cast("long")


def directory(entries: DataFrame, capacity: int = CAPACITY) -> tuple[int, DataFrame]:
    """The number of leading bits of a key that name its slot, and a row per slot in use: slot, bucket (its depth and its bits)."""
    bits = 0
    while bits < DEEPEST and (entries.groupBy(_prefix(bits)).count().agg(F.max("count")).first()[0] or 0) > capacity:
        bits += STEP
    slots = materialise(entries.groupBy(_prefix(bits).alias("slot")).agg(F.count("*").alias("n")), "slots")
    depths = slots.withColumn("depth", F.explode(F.array(*map(F.lit, range(bits + 1))))).withColumn("prefix", F.expr(f"shiftrightunsigned(slot, {bits} - depth)"))
    fits = depths.groupBy("depth", "prefix").agg(F.sum("n").alias("entries")).where((F.col("entries") <= capacity) | (F.col("depth") == bits))
    first = depths.join(fits, ["depth", "prefix"]).groupBy("slot").agg(F.min(F.struct("depth", "prefix")).alias("b"))
    return bits, materialise(first.select("slot", F.concat_ws("-", "b.depth", F.hex("b.prefix")).alias("bucket")), "directory")


def build_index(rows: DataFrame, capacity: int = CAPACITY) -> tuple[int, DataFrame, DataFrame]:
    """rows (doc_id, text, key) -> bits and table of the directory; entries (bucket, key, chain, digest, n_bytes, keep_id, group_size)."""
    entries = rows.groupBy("key", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    entries = materialise(entries.select("key", F.sha2("text", 256).alias("digest"), F.octet_length("text").alias("n_bytes"), "keep_id", "group_size"), "entries")
    bits, slots = directory(entries, capacity)
    owned = entries.withColumn("slot", _prefix(bits)).join(slots, "slot").repartition("bucket")
    chain = F.row_number().over(Window.partitionBy("bucket", "key").orderBy("n_bytes", "digest"))  # within a bucket's owner: no further shuffle
    return bits, slots, materialise(owned.select("bucket", "key", chain.alias("chain"), "digest", "n_bytes", "keep_id", "group_size"), "hash-index")


def _keyed(docs: DataFrame, id_col: str, text_col: str, key: Callable[[Column], Column]) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("key", key(F.col("text")))


def _groups(docs: DataFrame, id_col: str, text_col: str, key: Callable[[Column], Column], capacity: int) -> DataFrame:
    """(doc_id, digest, n): rows repeated with one doc_id and text; with their entry's keep_id and group_size."""
    rows = _keyed(docs, id_col, text_col, key)
    bits, slots, index = build_index(rows, capacity)
    found = rows.select("doc_id", "key", F.sha2("text", 256).alias("digest"), F.octet_length("text").alias("n_bytes")).groupBy("doc_id", "key", "digest", "n_bytes").agg(F.count("*").alias("n"))
    return found.withColumn("slot", _prefix(bits)).join(slots, "slot").join(index, ["bucket", "key", "n_bytes", "digest"])


def exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: Callable[[Column], Column] = key_of, capacity: int = CAPACITY) -> DataFrame:
    """A row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    copy = F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy")
    return _groups(docs, id_col, text_col, key, capacity).select("doc_id", "keep_id", "group_size", "digest", copy).select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), F.col("digest").alias("text_sha256")
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: Callable[[Column], Column] = key_of, capacity: int = CAPACITY) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    index = build_index(_keyed(docs, id_col, text_col, key), capacity)[2]
    return only(docs, index.select(F.col("keep_id").alias("doc_id"), F.col("digest").alias("h")), id_col, F.sha2(text_or_empty(text_col), 256))
