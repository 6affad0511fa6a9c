"""Removal of repeated substrings by longest-previous-factor arrays over suffix order.

A byte goes if a string of ``length`` bytes that covers it also starts elsewhere: anywhere earlier (``keep_first``, in
order of doc_id and position) or anywhere at all. Strings that start within one document stay together:

1. Every string of ``length`` bytes holds one minimal GRAM (by hash, leftmost on ties), whichever text it stands in.
   Starts that share a gram make a piece: text whose repeats can only lie in pieces of the same gram. Each document is
   read once and gives gram hash, piece hash, place and size of its pieces; no text is shuffled for this.
2. A gram seen once ends there. If all pieces of a gram are equal, all their starts are repeated. The other grams send
   one text for each different piece to the suffix step, so copies and common passages count once.
3. Suffix step: the texts of a gram, in one task, are put in suffix order by prefix doubling, cut off at ``length``
   bytes. Suffixes that tie are repeats of each other. For each the previous and the next suffix in that order with a
   smaller place in the corpus are searched; if one of them ties, the longest previous factor reaches ``length``, and the
   suffix has an earlier place.
4. Spans go back to the pieces' places, are merged for each document and cut out.

Defined cases: null text counts as empty; texts shorter than ``length`` are never touched; rows repeated with one doc_id
and text are one place (with ``keep_first`` treated alike; otherwise repeats of each other); a null doc_id comes last;
an empty table gives no rows; other columns are carried along by ``remove_repeats``. Documents are told apart by 128 bits
of text hash and doc_id, strings in step 2 by 128 bits of hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.llm.common import discard, materialise, short_batches, spare, text_or_empty

LENGTH = 200
GRAM = 48
CHUNK = 1 << 19  # bytes hashed together
ORDERED = 1 << 19  # bytes put in suffix order together, whole grams at a time
_LOW = 20  # bits for a place in a chunk
_BASE = 0x9E3779B97F4A7C15
LAST = (1 << 63) - 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_powers: list[np.ndarray] = []


def powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2 ** 64."""
    if not _powers:
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full((1 << _LOW) + 1, base, np.uint64)
            p[0] = 1
            _powers.append(np.cumprod(p, dtype=np.uint64))
    return _powers[0], _powers[1]


def pieces(data: np.ndarray, begins: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """data: texts one after another from ``begins``; -> (gram hash, piece hash, start, number of string starts)."""
    n = len(data)
    empty = np.zeros(0, np.int64)
    if n < length:
        return empty, empty, empty, empty
    up, down = powers()
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * up[:n], dtype=np.uint64)])
    grams = _mixed((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
    place = np.arange(len(grams), dtype=np.uint64)
    least = ((grams >> np.uint64(1)) & ~np.uint64((1 << _LOW) - 1)) | place
    least = least.view(np.int64)
    width, have = length - gram + 1, 1
    while 2 * have <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
    at = least & ((1 << _LOW) - 1)  # for each start of a string, the place of its gram
    ends = np.r_[begins[1:], n]
    live = np.zeros(n + 1, np.int32)
    long = ends - begins >= length
    np.add.at(live, begins[long], 1)
    np.add.at(live, ends[long] - length + 1, -1)
    live = np.cumsum(live[: len(at)]) > 0
    new = live.copy()
    new[1:] &= (at[1:] != at[:-1]) | ~live[:-1]
    first = np.flatnonzero(new)
    stop = np.flatnonzero(live & ~np.r_[live[1:] & ~new[1:], False]) + 1
    whole = _mixed((sums[stop + length - 1] - sums[first]) * down[first] + (stop - first).astype(np.uint64))
    return grams[at[first]].view(np.int64), whole.view(np.int64), first, stop - first


def chunks(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(data, begins, text number, offset in it); long texts are cut with ``length`` - 1 bytes in both parts."""
    held: list[tuple[bytes, int, int]] = []
    size = 0

    def out():
        lengths = np.array([len(b) for b, _, _ in held])
        return np.frombuffer(b"".join(b for b, _, _ in held), np.uint8), np.cumsum(lengths) - lengths, np.array([i for _, i, _ in held]), np.array([o for _, _, o in held])

    for i, t in enumerate(texts):
        for o in range(0, len(t) - length + 1, CHUNK):
            part = t[o : o + CHUNK + length - 1]
            if size + len(part) > CHUNK + length and held:
                yield out()
                held, size = [], 0
            held.append((part, i, o))
            size += len(part)
    if held:
        yield out()


def _identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_or_empty(text_col)
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(text).alias("t1"), F.xxhash64(text, F.lit(1)).alias("t2"), text.alias("text"))


def _scan(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """A row per piece (g, p, doc, row, at, n) and one per document (g null; p and at hold t1 and t2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33  # a number for each document; it holds once this scan is written
        names = ["g", "p", "doc", "row", "at", "n"]
        for b in batches:
            doc, t1, t2 = (b.column(c) for c in ("doc", "t1", "t2"))
            n_docs = b.num_rows
            own = np.arange(row, row + n_docs)
            row += n_docs
            if n_docs:
                yield pa.RecordBatch.from_arrays([pa.nulls(n_docs, pa.int64()), t1, doc, pa.array(own), t2, pa.nulls(n_docs, pa.int16())], names=names)
            doc = doc.to_numpy()
            for lo in range(0, n_docs, 512):
                texts = b.column("text").slice(lo, 512).cast(pa.binary()).to_pylist()
                for data, begins, number, offset in chunks(texts, length):
                    g, p, first, n = pieces(data, begins, length, gram)
                    k = np.searchsorted(begins, first, "right") - 1
                    i = number[k] + lo
                    yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(p), pa.array(doc[i]), pa.array(own[i]), pa.array(first - begins[k] + offset[k]), pa.array(n.astype(np.int16))], names=names)

    return rows.mapInArrow(run, "g long, p long, doc long, row long, at long, n short")


def suffix_ranks(data: np.ndarray, length: int) -> np.ndarray:
    """Ranks of all suffixes of ``data`` by their first ``length`` bytes; places past the end are lowest."""
    n = len(data)
    padded = np.concatenate([data.astype(np.uint64) + np.uint64(1), np.zeros(length + 8, np.uint64)])
    key = np.zeros(n, np.uint64)
    have = min(7, length)
    for i in range(have):
        key = key * np.uint64(257) + padded[i : i + n]

    def ranked(key: np.ndarray) -> np.ndarray:
        order = np.argsort(key)
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[True, ordered[1:] != ordered[:-1]])
        return rank

    rank = ranked(key)
    while have < length:
        step = min(have, length - have)
        rank = ranked(rank * (n + 2) + np.concatenate([rank[step:], np.zeros(min(step, n), np.int64)])[:n])
        have += step
    return rank


def smaller_positions(places: list[int], runs_of: list[int]) -> tuple[list[int], list[int]]:
    """For suffixes in suffix order the previous and the next one of the same run whose place is smaller, -1 if there is none.

    One pass with a stack of the suffixes that still wait for their next smaller one; places on it never fall.
    """
    before, after = [-1] * len(places), [-1] * len(places)
    waiting: list[int] = []
    run = None
    for i, (place, own) in enumerate(zip(places, runs_of, strict=True)):
        if own != run:
            waiting.clear()
            run = own
        while waiting and places[waiting[-1]] > place:
            after[waiting.pop()] = i
        if waiting:
            top = waiting[-1]
            before[i] = top if places[top] < place else before[top]
        waiting.append(i)
    return before, after


def previous_factors(texts: list[bytes], groups: np.ndarray, docs: np.ndarray, places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For all starts of strings of ``length`` bytes: (text, offset, repeated at all, has an earlier place).

    Only texts of one group are held against each other; docs and places give a text's order in the corpus. The longest
    previous factor of a suffix is what it shares with its previous or its next smaller place in suffix order. It comes to
    ``length`` within a run of ties alone, so only runs are searched.
    """
    sizes = np.array([len(t) for t in texts])
    begins = np.cumsum(sizes) - sizes
    rank = suffix_ranks(np.frombuffer(b"".join(texts), np.uint8), length)
    count = np.maximum(sizes - length + 1, 0)
    text = np.repeat(np.arange(len(texts)), count)
    offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    r = rank[begins[text] + offset]
    _, group = np.unique(groups, return_inverse=True)
    run = group[text] * (len(rank) + 1) + r  # ranks go to the number of bytes
    order = np.argsort(run, kind="stable")
    tie = run[order[1:]] == run[order[:-1]]
    repeated, earlier = np.zeros(len(r), bool), np.zeros(len(r), bool)
    tied = order[np.r_[tie, False] | np.r_[False, tie]] if len(order) else order
    repeated[tied] = True
    _, doc = np.unique(docs, return_inverse=True)
    place = (doc[text[tied]].astype(np.int64) << 40) + (places[text] + offset)[tied]
    before, after = smaller_positions(place.tolist(), run[tied].tolist())
    earlier[tied] = (np.array(before, np.int64) >= 0) | (np.array(after, np.int64) >= 0)
    return text, offset, repeated, earlier


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.r_[0, flags.astype(np.int8), 0]))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _suffix_step(texts: DataFrame, length: int) -> DataFrame:
    """texts (g, p, doc, at, piece), sorted by g in a partition -> spans of repeated starts of each piece."""

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["g", "p"]).reset_index(drop=True)
        found = previous_factors(list(rows["piece"]), rows["g"].to_numpy(), rows["doc"].to_numpy(), rows["at"].to_numpy(np.int64), length)
        text, _, repeated, earlier = found
        edges = np.searchsorted(text, np.arange(len(rows) + 1))
        part = lambda flags: [[{"a": a, "b": b} for a, b in runs(flags[lo:hi])] for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
        return pd.DataFrame({"g": rows["g"], "p": rows["p"], "spans": part(repeated), "earlier": part(earlier)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for b in batches:
            for lo in range(0, len(b), 1000):
                part = b.iloc[lo : lo + 1000]
                held.append(part)
                size += int(part["piece"].str.len().sum())
                if size > ORDERED:
                    rows = pd.concat(held)
                    last = rows["g"] == rows["g"].iloc[-1]  # may go on
                    if not last.all():
                        yield solve(rows[~last])
                    held = [rows[last]]
                    size = int(held[0]["piece"].str.len().sum())
        if held:
            yield solve(pd.concat(held))

    span = "array<struct<a:int,b:int>>"
    return texts.repartition("g").sortWithinPartitions("g", "p").mapInPandas(run, f"g long, p long, spans {span}, earlier {span}")


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, keep_first: bool = True) -> DataFrame:
    """(doc, t1, t2, starts): for documents with any, the spans of starts whose strings go."""
    short_batches(docs.sparkSession)
    rows = _identified(docs, id_col, text_col)
    scanned = materialise(_scan(rows, length, gram), "pieces")
    found = scanned.where("g is not null").select("g", "p", "doc", "row", F.col("at").cast("int").alias("at"), "n")
    owners = materialise(scanned.where("g is null").select("row", "doc", F.col("p").alias("t1"), F.col("at").alias("t2")), "owners")
    seen = found.groupBy("g").agg(F.count("*").alias("times"), F.min("p").alias("p0"), F.max("p").alias("p1")).where("times > 1")
    seen = materialise(seen.select("g", (F.col("p0") != F.col("p1")).alias("mixed")), "grams")  # written, so that the join's sides can be split
    shared = materialise(found.join(seen, "g"), "shared")
    discard(scanned)
    first = F.min(F.struct("doc", "at", "row", "n")).alias("first")
    kinds = materialise(shared.groupBy("g", "p", "mixed").agg(F.count("*").alias("times"), first), "kinds")

    at = kinds.where("mixed").select("first.row", F.struct("g", "p", "first.at", "first.n").alias("piece"))
    wanted = at.groupBy("row").agg(F.collect_list("piece").alias("pieces")).join(owners, "row").drop("row")  # at most a document's own pieces

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 128):
                rows = b.slice(at, 128)
                for text, doc, lists in zip(rows.column("text").cast(pa.binary()).to_pylist(), rows.column("doc").to_pylist(), rows.column("pieces").to_pylist(), strict=True):
                    for lo in range(0, len(lists), 2000):
                        part = lists[lo : lo + 2000]
                        yield pa.RecordBatch.from_pydict(
                            {"g": [x["g"] for x in part], "p": [x["p"] for x in part], "doc": [doc] * len(part), "at": pa.array([x["at"] for x in part], pa.int32()), "piece": pa.array([text[x["at"] : x["at"] + x["n"] + length - 1] for x in part], pa.binary())}
                        )

    texts = rows.join(wanted, ["doc", "t1", "t2"]).select("doc", "text", "pieces").mapInArrow(cut, "g long, p long, doc long, at int, piece binary")
    ordered = materialise(_suffix_step(texts, length), "suffixes")
    known = kinds.join(ordered, ["g", "p"], "left").select("g", "p", "times", "first", "spans", "earlier").where("times > 1 or size(spans) > 0")
    here = shared.join(materialise(known, "known"), ["g", "p"])
    whole = F.array(F.struct(F.lit(0).alias("a"), F.col("n").cast("int").alias("b")))
    if keep_first:
        is_first = (F.col("row") == F.col("first.row")) & (F.col("at") == F.col("first.at"))
        starts: Column = F.when(is_first, F.coalesce("earlier", F.array().cast("array<struct<a:int,b:int>>"))).otherwise(whole)
    else:
        starts = F.when(F.col("times") > 1, whole).otherwise(F.col("spans"))
    moved = F.transform(starts, lambda s: F.struct((s["a"] + F.col("at")).alias("a"), (s["b"] + F.col("at")).alias("b")))
    placed = here.select("row", moved.alias("s")).groupBy("row").agg(F.flatten(F.collect_list("s")).alias("starts"))
    return placed.join(owners, "row").groupBy("doc", "t1", "t2").agg(F.min_by("starts", "row").alias("starts")).where("size(starts) > 0")


def merged(starts: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """Spans of starts -> spans of bytes that they cover."""
    out: list[list[int]] = []
    for a, b in sorted((s["a"], s["b"] + length - 1) for s in starts or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def kept_bytes(data: bytes, gone: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in gone:
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]])


def kept_text(data: bytes, gone: list[tuple[int, int]]) -> str:
    """What is left as text: a character goes only with all its bytes."""
    whole = []
    for a, b in gone:
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        whole.append((a, b))
    return kept_bytes(data, whole).decode()


def _with_starts(docs: DataFrame, id_col: str, text_col: str, length: int, gram: int, keep_first: bool) -> DataFrame:
    text = text_or_empty(text_col)
    d, t1, t2, starts = spare(docs.columns, "__d", "__t1", "__t2", "__starts")
    gone = spans(docs, id_col, text_col, length, gram, keep_first).select(F.col("doc").alias(d), F.col("t1").alias(t1), F.col("t2").alias(t2), F.col("starts").alias(starts))
    same = (F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)) == F.col(d)) & (F.xxhash64(text) == F.col(t1)) & (F.xxhash64(text, F.lit(1)) == F.col(t2))
    return docs.join(gone, same, "left").drop(d, t1, t2)


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, keep_first: bool = True) -> DataFrame:
    """A row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    rows = _with_starts(docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")), "doc_id", "text", length, gram, keep_first)
    schema = rows.select("doc_id").schema.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part, out = b.slice(at, 256), []
                for t, starts in zip(part.column("text").cast(pa.binary()).to_pylist(), part.column("__starts").to_pylist(), strict=True):
                    gone = merged(starts, length)
                    out.append((len(t), sum(y - x for x, y in gone), len(gone), hashlib.sha256(kept_bytes(t, gone)).hexdigest()))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True))], names=schema.names)

    return rows.mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, keep_first: bool = True) -> DataFrame:
    """``docs`` with repeated strings cut out of the text column; other columns as they are. Characters stay whole."""
    rows, columns, (starts,) = _with_starts(docs, id_col, text_col, length, gram, keep_first), docs.columns, spare(docs.columns, "__starts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                both = zip(part.column(text_col).to_pylist(), part.column(starts).to_pylist(), strict=True)
                texts = [kept_text(t.encode(), merged(s, length)) if s else t for t, s in both]
                at = part.schema.get_field_index(text_col)
                yield part.set_column(at, pa.field(text_col, pa.string()), pa.array(texts, pa.string())).select(columns)

    return rows.mapInArrow(run, docs.schema)
