"""Chains of pointers and graphs of pairs, in a number of rounds that is logarithmic in their length.

Every round joins the table with itself once and doubles the length that a pointer spans; finished rows take no further part.
Ids are of any type that has an order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.operators.shared import Written


def ends(links: DataFrame, made: Written) -> DataFrame:
    """links (id, nxt, size), each id once and nxt the id of another row or null -> id, last, total, low.

    ``last`` is the id at the chain's end, ``total`` the sizes from the row to the end, ``low`` the smallest id on that way. Rows of rings
    have no end: their ``last`` and ``total`` are null, and ``low`` is the smallest id of the ring.
    """
    kind = links.schema["id"].dataType
    rows = made(links.select("id", "nxt", F.col("size").cast("long").alias("total"), F.col("id").alias("low")), "chains")
    reached = rows.where("nxt is null").select("id", F.col("id").alias("last"), "total", "low")
    on, span = rows.where("nxt is not null"), 1
    left, fewer = on.count(), True
    while left and (fewer or span <= left):  # a round that ends no chain leaves rings alone, and these are no longer than all that is left
        to = on.select(F.col("id").alias("nxt"), F.col("nxt").alias("then"), F.col("total").alias("t2"), F.col("low").alias("w2"), F.lit(None).cast(kind).alias("last"))
        to = to.unionByName(reached.select(F.col("id").alias("nxt"), F.lit(None).cast(kind).alias("then"), F.col("total").alias("t2"), F.col("low").alias("w2"), "last"))
        step = made(on.join(to, "nxt").select("id", F.col("then").alias("nxt"), (F.col("total") + F.col("t2")).alias("total"), F.least("low", "w2").alias("low"), "last"), "chains")
        reached = reached.unionByName(step.where("nxt is null").select("id", "last", "total", "low"))
        on, span = step.where("nxt is not null").drop("last"), 2 * span
        now = on.count()
        left, fewer = now, now < left
    rings = on.select("id", F.lit(None).cast(kind).alias("last"), F.lit(None).cast("long").alias("total"), "low")
    return made(reached.unionByName(rings), "chain-ends")


def visits(links: DataFrame, starts: DataFrame, made: Written) -> DataFrame:
    """links (id, nxt, size) without rings and starts (start, id) -> start, id, before: all that a start's chain goes through, and the sizes before it.

    Pointers over 1, 2, 4, ... links are made first; taken from the longest to the shortest they reach every link of a chain once.
    """
    jumps = [made(links.where("nxt is not null").select("id", "nxt", F.col("size").cast("long").alias("size")), "jumps")]
    while jumps[-1].head(1):
        a, b = jumps[-1], jumps[-1].select(F.col("id").alias("nxt"), F.col("nxt").alias("then"), F.col("size").alias("more"))
        jumps.append(made(a.join(b, "nxt").select("id", F.col("then").alias("nxt"), (F.col("size") + F.col("more")).alias("size")), "jumps"))
    seen = starts.select("start", "id", F.lit(0).cast("long").alias("before"))
    for jump in reversed(jumps[:-1]):
        on = seen.join(jump, "id").select("start", F.col("nxt").alias("id"), (F.col("before") + F.col("size")).alias("before"))
        seen = made(seen.unionByName(on), "visits")
    return seen


def groups(pairs: DataFrame, made: Written) -> DataFrame:
    """pairs (a, b) of ids -> id, root: the smallest id that each can reach, for ids in pairs of different ids.

    Ids point to their smallest neighbour, pointers are followed to the end, and the graph shrinks to these ends.
    """
    edges = made(pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    roots = edges.select(F.col("a").alias("id"), F.col("b").alias("root")).limit(0)
    while edges.head(1):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"))
        found = ends(low.select(F.col("a").alias("id"), F.when(F.col("m") < F.col("a"), F.col("m")).alias("nxt"), F.lit(1).alias("size")), made).select("id", F.col("last").alias("to"))
        moved = roots.join(found.select(F.col("id").alias("root"), "to"), "root", "left").select("id", F.coalesce("to", "root").alias("root"))
        new = found.join(roots.select("id"), "id", "left_anti").select("id", F.col("to").alias("root"))
        roots = made(moved.unionByName(new), "roots")
        for side in ("a", "b"):
            edges = edges.join(found.select(F.col("id").alias(side), "to"), side).drop(side).withColumnRenamed("to", side)
        edges = made(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    return roots
