"""SimHash near-dedup: 64-bit fingerprints of word shingles, linked by a self-join of binary tries.

Fingerprints that differ in at most two bits agree on two of four 16-bit blocks. For each of the six choices of two
blocks the fingerprint is permuted so that those blocks lead; equal leading blocks put fingerprints in one subtree,
which one task holds (8 bytes a fingerprint). Below it the trie is joined with itself: node pairs are walked together
bit by bit, differing bits add up, and a pair is dropped once it exceeds the budget. Only distinct fingerprints take
part; a task returns a star per local component, not all pairs, and stars are joined into components by Spark.

Defined cases: null text counts as empty; no words give fingerprint zero, which links like any other; repeated rows
share a fingerprint and a component; a component's id is its smallest doc_id that is not null (null if all are); an
empty table gives no rows; other columns are ignored (``keep_one`` carries them along).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.common import materialise, only, per_text, text_or_empty
from geoloom.llm.components import components

SHINGLE = 3
BITS = 2
WIDE = 8  # bits, where the texts themselves are checked afterwards
SEED = 42
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
BATCH = 1 << 16  # codes that are walked together, and the most node pairs held at a time are 16 times that


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The hashes of a text's shingles, repeats included; none without words."""
    words = (text or "").encode().translate(LOWER).split()  # bytes.split(): runs of 0x20 and 0x09-0x0D
    if not words:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)) if len(words) > size else [b" ".join(words)]
    return np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), shingles), np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that over half the hashes have; zero without hashes."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), BATCH):
        part = hashes[i : i + BATCH]
        counts += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    return majority(shingle_hashes(text, size))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash, fp (the fingerprint as a signed long)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    return per_text(rows, {"fp": "long"}, lambda texts: (np.array([fingerprint(t, size) for t in texts], np.uint64).view(np.int64),))


def trie_links(codes: np.ndarray, groups: np.ndarray, low: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs of one group whose codes differ in at most ``budget`` of the ``low`` lowest bits.

    ``codes`` (unsigned, distinct in a group) are sorted within ``groups`` (sorted); higher bits are equal in a group.
    A node is a range of codes; at each bit, ones in the range give the border between its children.
    """
    ones = {b: np.concatenate([[0], np.cumsum((codes >> np.uint64(b)) & np.uint64(1), dtype=np.int64)]) for b in range(low)}
    starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]]) if len(codes) else np.zeros(0, np.int64)
    ends = np.r_[starts[1:], len(codes)] if len(codes) else starts
    big = ends - starts > 1
    todo = [(low - 1, np.stack([starts[big], ends[big], starts[big], ends[big], np.zeros(big.sum(), np.int64)]))]
    left, right = [], []
    while todo:
        bit, pairs = todo.pop()
        if not pairs.shape[1]:
            continue
        if bit < 0:
            left.append(pairs[0])
            right.append(pairs[2])
            continue
        if pairs.shape[1] > 16 * BATCH:
            half = pairs.shape[1] // 2
            todo += [(bit, pairs[:, :half]), (bit, pairs[:, half:])]
            continue
        a0, a1, b0, b1, d = pairs
        am, bm = a1 - (ones[bit][a1] - ones[bit][a0]), b1 - (ones[bit][b1] - ones[bit][b0])
        own = a0 == b0
        new = np.concatenate(
            [np.stack([a0, am, b0, bm, d]), np.stack([am, a1, bm, b1, d]), np.stack([a0, am, bm, b1, d + 1]), np.stack([am, a1, b0, bm, d + 1])[:, ~own]], axis=1
        )
        some = (new[0] < new[1]) & (new[2] < new[3]) & (new[4] <= budget)
        some &= (new[0] != new[2]) | (new[1] - new[0] > 1)  # a leaf has no pair with itself
        todo.append((bit - 1, new[:, some]))
    empty = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (empty, empty)


def local_roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest position in each position's component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _permuted(codes: np.ndarray, lead: tuple[int, int]) -> np.ndarray:
    out = np.zeros(len(codes), np.uint64)
    for block in [*lead, *(b for b in range(4) if b not in lead)]:
        out = (out << np.uint64(16)) | ((codes >> np.uint64(48 - 16 * block)) & np.uint64(0xFFFF))
    return out


LEADS = list(combinations(range(4), 2))


def _subtrees(batches: Iterator[pd.DataFrame], budget: int = BITS) -> Iterator[pd.DataFrame]:
    """Rows (choice, head, fp) sorted by choice and head -> links between fingerprints; whole subtrees at a time."""

    def stars(rows: pd.DataFrame) -> pd.DataFrame:
        codes = rows["fp"].to_numpy(np.int64).view(np.uint64)
        choice, head = rows["choice"].to_numpy(), rows["head"].to_numpy()
        turned = np.zeros(len(codes), np.uint64)
        for c, lead in enumerate(LEADS):
            at = choice == c
            turned[at] = _permuted(codes[at], lead)
        order = np.lexsort((turned, head, choice))
        group = (choice[order].astype(np.int64) << 32) | head[order]
        root = local_roots(len(order), *trie_links(turned[order], group, 32, budget))
        at = np.flatnonzero(root != np.arange(len(root)))
        fps = rows["fp"].to_numpy(np.int64)[order]
        return pd.DataFrame({"u": fps[at], "v": fps[root[at]]})

    held: list[pd.DataFrame] = []
    size = 0
    for b in batches:
        held.append(b)
        size += len(b)
        if size >= BATCH:
            rows = pd.concat(held, ignore_index=True)
            last = (rows["choice"] == rows["choice"].iloc[-1]) & (rows["head"] == rows["head"].iloc[-1])
            yield stars(rows[~last])  # the last subtree may go on in the next batch
            held, size = [rows[last]], 0
    if held:
        yield stars(pd.concat(held, ignore_index=True))


def links(distinct: DataFrame, budget: int = BITS) -> DataFrame:
    """Links (u, v) that join all fingerprints ``fp`` that differ in at most two bits, directly or through others.

    With a larger budget they also join those that differ in more bits and agree on two of the four blocks.
    """
    block = [F.shiftrightunsigned("fp", 48 - 16 * b).bitwiseAND(0xFFFF) for b in range(4)]
    heads = F.array(*(F.struct(F.lit(c).alias("choice"), (block[a] * 65536 + block[b]).alias("head")) for c, (a, b) in enumerate(LEADS)))
    rows = distinct.select("fp", F.explode(heads).alias("s")).select("s.choice", "s.head", "fp")
    return rows.repartition("choice", "head").sortWithinPartitions("choice", "head").mapInPandas(partial(_subtrees, budget=budget), "u long, v long")


def text_pairs(fps: DataFrame, budget: int = WIDE) -> DataFrame:
    """fps (h, fp), written, h a text's hash -> pairs (u, v) of texts to check: a star for each set of fingerprints that the tries link."""
    first = materialise(fps.groupBy("fp").agg(F.min("h").alias("first")), "first-fps")
    same = fps.join(first, "fp").where("h <> first").select(F.col("first").alias("u"), F.col("h").alias("v"))
    roots = components(links(first.select("fp"), budget))
    near = roots.join(first.select(F.col("fp").alias("u"), F.col("first").alias("a")), "u").join(first.select(F.col("fp").alias("root"), F.col("first").alias("b")), "root")
    return same.union(near.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))).distinct()


def near_groups(fps: DataFrame) -> DataFrame:
    """fps (doc_id, text_hash, fp), materialised -> (fp, component_id, rep): rep is the document that stays."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_hash")).alias("first")
    distinct = materialise(fps.groupBy("fp").agg(first), "distinct-fps")
    roots = components(links(distinct))
    member = distinct.join(roots, distinct["fp"] == roots["u"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    return member.join(member.groupBy("root").agg(F.min("first").alias("rep")), "root").select("fp", F.col("rep.doc_id").alias("component_id"), "rep")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """A row per document: doc_id, fingerprint (16 hex digits), component_id."""
    fps = materialise(fingerprints(docs, id_col, text_col, size), "fps")
    return fps.join(near_groups(fps), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` that represent their group, with all their columns."""
    fps = materialise(fingerprints(docs, id_col, text_col, size), "fps")
    reps = near_groups(fps).select("rep.doc_id", F.col("rep.text_hash").alias("h")).distinct()
    return only(docs, reps, id_col, F.xxhash64(text_or_empty(text_col)))
