"""Filter interaction audit: what each filter removes at each step of every order of the filters.

A document's failures are a mask of one bit a filter. Spark counts documents, good and toxic ones in cells (part, mask), at
most 2 ** filters of them a part, whatever the number of rows; everything else follows from the cells. The orders are
visited by adjacent transpositions (Steinhaus, Johnson, Trotter): the next order swaps two neighbours, so only these two
steps are summed anew from the cells. A filter's Shapley sum (its removals over all orders) grows along the walk by the
value that it had times the number of visits for which it stood. All parts of a batch are walked at once, in numpy.

A text that stands under a smaller doc_id fails E. Rows with equal text and doc_id are counted together first; the smallest
doc_id of each text is found by a grouping with partial sums and comes back by a join on text hash and doc_id, so a text
held by a third of all rows is no hot key.

Defined cases: a null text counts as empty (no words: it fails A, and B and C not), a null source is part '', an empty one
too; a null doc_id is smaller than none and larger than none, and has no labels; rows that repeat a doc_id and its text
count each, none of them fails E for another of them; of several labels of one doc_id any that is 1 counts; an empty table gives
no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.llm.common import materialise, text_or_empty

LETTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, UPPER_PERCENT = 50, 65, 5
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def text_mask(text: Column) -> Column:
    """The bits of the filters A to D that a text fails."""
    words = F.array_remove(F.split(text, r"[ \t-\r]+"), "")
    n = F.size(words)
    upper = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = (n < LEAST_WORDS, F.size(F.array_distinct(words)) * 100 < n * DISTINCT_PERCENT, upper * 100 > F.length(text) * UPPER_PERCENT, text.rlike(r"[#$%&*|]"))
    return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))


def cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """A row per part: arrays over masks of the numbers of documents, good and toxic ones."""
    read = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"), text_or_empty(part_col).alias("part"))
    rows = read.select("doc_id", "part", F.sha2("text", 256).alias("h"), text_mask(F.col("text")).alias("mask"))
    rows = materialise(rows.groupBy("h", "doc_id", "part", "mask").agg(F.count("*").alias("n")), "audit-rows")
    first = rows.groupBy("h").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marked = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    # documents without an id have no label: their hash keeps them from meeting in one task
    where = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("-"), F.col("h"))))
    known = rows.join(first, ["h", "doc_id"], "left").withColumn("k", where)
    known = known.join(marked.withColumn("k", F.xxhash64(F.col("doc_id").cast("string"))), ["k", "doc_id"], "left")
    last = F.when(F.col("doc_id").isNotNull() & F.col("first").isNull(), 1 << 4).otherwise(0)
    sums = known.groupBy("part", (F.col("mask") + last).alias("mask")).agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic")
    )
    return sums.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))


def swaps(n: int) -> Iterator[int]:
    """The n! - 1 places k at which the next order swaps k and k + 1; each order of n things is met once."""
    if n < 2:
        return
    inner, down = [*swaps(n - 1), None], True
    for swap in inner:
        yield from range(n - 2, -1, -1) if down else range(n - 1)  # the last thing goes through all places
        if swap is not None:
            yield swap + down
        down = not down


def walk(n: np.ndarray, good: np.ndarray, toxic: np.ndarray, letters: str = LETTERS) -> tuple[list[str], np.ndarray]:
    """Cells (parts x masks) -> the orders met; counts (orders x steps x parts x COUNTS)."""
    size = len(letters)
    masks = np.arange(1 << size)
    total = n.sum(axis=1)
    order = list(range(size))
    fails = [n[:, masks >> f & 1 == 1].sum(axis=1) for f in range(size)]
    alone = [n[:, 1 << f] for f in range(size)]
    steps = np.zeros((size, len(n), len(COUNTS)), np.int64)  # of the order at hand
    shapley, since = np.zeros((size, len(n)), np.int64), np.zeros(size, np.int64)

    def redo(step: int) -> None:
        f, before = order[step], sum(1 << g for g in order[:step])
        here = (masks >> f & 1 == 1) & (masks & before == 0)
        gone = n[:, here].sum(axis=1)
        kept = (steps[step - 1, :, 0] if step else total) - gone
        for k, v in enumerate((kept, gone, fails[f] - gone, alone[f], good[:, here].sum(axis=1), toxic[:, here].sum(axis=1))):
            steps[step, :, k] = v

    for step in range(size):
        redo(step)
    names, out = ["".join(letters[f] for f in order)], [steps.copy()]
    for k in swaps(size):
        for step in (k, k + 1):  # what these two removed has stood since their last change
            shapley[order[step]] += steps[step, :, 1] * (len(names) - since[order[step]])
            since[order[step]] = len(names)
        order[k], order[k + 1] = order[k + 1], order[k]
        redo(k)
        redo(k + 1)
        names.append("".join(letters[f] for f in order))
        out.append(steps.copy())
    for step, f in enumerate(order):
        shapley[f] += steps[step, :, 1] * (len(names) - since[f])
    counts = np.stack(out)
    for i, name in enumerate(names):
        for step, letter in enumerate(name):
            counts[i, step, :, -1] = shapley[letters.index(letter)]
    return names, counts


PARTS = 64  # parts walked at once: 600 rows each


def audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """A row per part, filter_order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), PARTS):
                part = b.iloc[at : at + PARTS]
                sums = np.zeros((3, len(part), 1 << len(LETTERS)), np.int64)
                for i, held in enumerate(part["cells"]):
                    for c in held:
                        sums[:, i, c["mask"]] = c["n"], c["good"], c["toxic"]
                names, counts = walk(*sums)
                for i, name in enumerate(part["part"]):
                    of = counts[:, :, i].reshape(-1, len(COUNTS))
                    yield pd.DataFrame({"part": name, "filter_order": np.repeat(names, len(LETTERS)), "step": np.tile(np.arange(1, len(LETTERS) + 1, dtype=np.int32), len(names))} | dict(zip(COUNTS, of.T, strict=True)))

    return cells(docs, labels, **columns).mapInPandas(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))


ORACLE_SQL = """
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part,
        list_filter(string_split_regex(coalesce(text, ''), '[ \\t-\\r]+'), lambda x: x <> '') AS words,
        coalesce(doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, '')), false) AS again
    FROM documents
), l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
m AS (
    SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
        [len(words) < 50, 100 * len(list_distinct(words)) < 65 * len(words), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text), regexp_matches(text, '[#$%&*|]'), again] AS fails
    FROM d LEFT JOIN l USING (doc_id)
), c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY part, fails),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c_.x || d_.x || e.x AS filter_order FROM f a, f b, f c_, f d_, f e WHERE len(list_distinct([a.x, b.x, c_.x, d_.x, e.x])) = 5),
s AS (SELECT filter_order, step, filter_order[step] AS x FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (
    SELECT c.part, s.filter_order, s.step, s.x, n, good, toxic, fails[instr('ABCDE', s.x)] AS here,
        len(list_filter(range(1, s.step), lambda k: fails[instr('ABCDE', s.filter_order[k])])) > 0 AS gone, len(list_filter(fails, lambda y: y)) = 1 AS single
    FROM c, s
), t AS (
    SELECT part, filter_order, step, x, coalesce(sum(n) FILTER (NOT here AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (here AND NOT gone), 0)::BIGINT AS removed,
        coalesce(sum(n) FILTER (here AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (here AND single), 0)::BIGINT AS unique_fails,
        coalesce(sum(good) FILTER (here AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (here AND NOT gone), 0)::BIGINT AS toxic_lost
    FROM r GROUP BY part, filter_order, step, x
)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley FROM t"""
