"""Document fingerprints by locally consistent parsing.

A text is parsed in levels. Runs of one symbol become one symbol; deterministic coin tossing (the lowest bit in which a
symbol differs from the one before, and that bit, done twice) gives small labels; a phrase begins wherever a label is
larger than both of its neighbours'. A phrase's name is a hash of its symbols and is a symbol of the next level. Whether
a phrase begins depends on a few symbols around it, so equal substrings have the same names inside, at any offset. The
fingerprint holds the SIZE smallest hashes of the phrase names from level LEAST on (all levels that a short text has),
and the likeness of two fingerprints estimates the share of names that their texts have in common.

Defined cases: null counts as empty; the empty text has the empty fingerprint, which is like itself (1) and like no
other (0); equal texts have equal fingerprints; a text's next document is the one with the next smaller doc_id, among
equal doc_ids the next larger text; a null doc_id is smaller than any other; after the last document comes the first
(one document is its own next); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.common import partitions, per_text, text_or_empty

SIZE = 64
LEAST = 2
LEVELS = 24
CHUNK = 1 << 20  # symbols parsed together; a longer text is parsed alone


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _tossed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Twice the place of the lowest bit in which a differs from b, plus that bit of a."""
    low = (a ^ b) & (~(a ^ b) + a.dtype.type(1))
    return 2 * np.bitwise_count(low - low.dtype.type(1)) + ((a & low) != 0)


def _next_level(names: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of one level, with the text they are in (sorted) -> those of the next."""
    n = len(names)
    head = np.r_[True, (names[1:] != names[:-1]) | (owner[1:] != owner[:-1])]
    at = np.flatnonzero(head)
    length = np.diff(np.r_[at, n])
    names, owner = names[at], owner[at]
    long = length > 1
    names[long] = _mixed(names[long] * np.uint64(3) + length[long].astype(np.uint64))
    n = len(names)
    start = np.r_[True, owner[1:] != owner[:-1]]
    label = np.empty(n, np.uint8)
    label[0] = 0
    label[1:] = _tossed(names[1:], names[:-1])
    label[start] = 255  # a text's first symbol differs from all
    second = np.empty(n, np.uint8)
    second[0] = 0
    second[1:] = _tossed(label[1:], label[:-1])
    second[start] = 0
    cut = start.copy()
    cut[1:] |= (second[1:] > second[:-1]) & (second[1:] > np.r_[second[2:], np.uint8(0)])  # zero follows the last symbol of any text
    cut[1:] &= start[1:] | ~start[:-1]  # no phrase of a first symbol alone
    at = np.flatnonzero(cut)
    phrase = np.cumsum(cut) - 1
    inside = np.arange(n) - at[phrase]
    weighted = _mixed(names + (inside.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    return _mixed(np.add.reduceat(weighted, at)), owner[at]


def _parsed(texts: list[str]) -> list[np.ndarray]:
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    names, held, whose = points + np.uint64(1), [], []
    for level in range(1, LEVELS + 1):
        if not len(names):
            break
        names, owner = _next_level(names, owner)
        single = np.r_[True, owner[1:] != owner[:-1]] & np.r_[owner[1:] != owner[:-1], True]  # the name of a whole text
        take = single if level < LEAST else np.ones(len(names), bool)
        held.append(_mixed(names[take] + np.uint64(level)) >> np.uint64(32))
        whose.append(owner[take])
        names, owner = names[~single], owner[~single]
    out = [np.zeros(0, np.uint32) for _ in texts]
    if held:
        h, w = np.concatenate(held), np.concatenate(whose).astype(np.uint64)
        both = np.unique((w << np.uint64(32)) | h)
        edges = np.searchsorted(both >> np.uint64(32), np.arange(len(texts) + 1))
        for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            out[i] = (both[a : min(b, a + SIZE)] & np.uint64(0xFFFFFFFF)).astype(">u4")
    return out


def fingerprint_many(texts: list[str]) -> list[bytes]:
    out: list[bytes] = []
    held: list[str] = []
    size = 0
    for t in texts:
        if held and size + len(t) > CHUNK:
            out += [x.tobytes() for x in _parsed(held)]
            held, size = [], 0
        held.append(t)
        size += len(t)
    return out + [x.tobytes() for x in _parsed(held)]


def likeness(a: bytes, b: bytes) -> float:
    if a == b:
        return 1.0
    x, y = np.frombuffer(a, ">u4").astype(np.int64), np.frombuffer(b, ">u4").astype(np.int64)
    if not len(x) or not len(y):
        return 0.0
    both = np.union1d(x, y)[: min(SIZE, max(len(x), len(y)))] if max(len(x), len(y)) == SIZE else np.union1d(x, y)
    return float(np.isin(both, x).__and__(np.isin(both, y)).mean())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, fingerprint (hex)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    return per_text(rows, {"fingerprint": "string"}, lambda texts: ([x.hex() for x in fingerprint_many(texts)],))


def _ranges(ids: DataFrame) -> list[int]:
    """The largest id of each range of about equal counts, descending: a number for each shuffle partition."""
    part = ids.where("id is not null").repartitionByRange(partitions(ids.sparkSession), F.col("id").desc())
    return sorted((r["top"] for r in part.groupBy(F.spark_partition_id()).agg(F.max("id").alias("top")).collect()), reverse=True)


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last half of the code points replaced by as many first ones of the next document. Texts move
    once: each is sent to its id range, and the first documents of a range to the range before it as well.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    tops = _ranges(rows.select("id"))
    up, last = [-t for t in tops], max(0, len(tops) - 1)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts, out = part.column("text").to_pylist(), []
                for i, text, fp in zip(part.column("id").to_pylist(), texts, fingerprint_many(texts), strict=True):
                    r = last if i is None else bisect.bisect_right(up, -i) - 1
                    out.append((r, False, i, text, fp))
                    if i is None and not tops or i is not None and i == tops[r]:
                        out.append((r - 1 if r > 0 else last, True, i, text, fp))  # who comes after that range's last
                kinds = (pa.int32(), pa.bool_(), pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["range", "after", "id", "text", "fp"])

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        held: list[tuple] = []  # the latest document
        got = False  # whether its range's last document has its next

        def add(row: tuple, nxt: tuple) -> None:
            _, i, text, fp = row
            half = len(text) // 2
            done.append((i, text, text[: len(text) - half] + nxt[2][:half], fp, nxt[3]))

        def flush() -> pa.RecordBatch:
            news = fingerprint_many([d[2] for d in done])
            out = [
                (i, len(text), hashlib.sha256(new.encode()).hexdigest(), fp.hex(), nfp.hex(), likeness(fp, nfp), likeness(fp, following))
                for (i, text, new, fp, following), nfp in zip(done, news, strict=True)
            ]
            done.clear()
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                for r, after, i, text, fp in zip(*(part.column(c).to_pylist() for c in ("range", "after", "id", "text", "fp")), strict=True):
                    row = (r, i, text, fp)
                    if held and held[0][0] == r and not got:
                        add(held[0], row)
                    if after:
                        got = True
                    else:
                        held, got = [row], False
                    if len(done) >= 256:
                        yield flush()
        if done:
            yield flush()

    sent = rows.mapInArrow(parse, "range int, after boolean, id long, text string, fp binary")
    return sent.repartitionById(max(1, len(tops)), "range").sortWithinPartitions("range", "after", F.col("id").desc_nulls_last(), "text").mapInArrow(
        edit, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
