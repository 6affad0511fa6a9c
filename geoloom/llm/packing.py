"""Packing along a space-filling curve.

A document's token ids are summed as hashed random signs into a vector of four numbers; the vector's cell on a Hilbert
curve is its key. Documents are range-sorted by that key, a prefix sum over their lengths (inside each range, then over
the ranges' totals) gives every document its place on one long tape, and the tape is cut every ``length`` tokens. So
neighbours on the curve share sequences, and no sequence needs padding but the end of the tape, which is cut into
powers of two. Token ids are computed once and written; the sort moves only keys and lengths.

Defined cases: a null or empty text is the end id alone; repeated rows are packed each on its own; an empty table gives
no rows; a document of any length is cut freely; other columns are ignored.
"""

from __future__ import annotations

import os
import string
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoloom.llm.common import materialise, per_text, text_or_empty

LENGTH = 2048
END = 1
DIMS, DEPTH = 4, 12  # numbers in a vector and bits of each on the curve
CACHE = 1_000_000  # words whose ids a worker remembers
MARKS = string.punctuation.replace("'", "")  # a run of these after letters is encoded on its own; "'" may begin a suffix
_known: dict[str, dict] = {}


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def kind_of(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def is_letters(word: str) -> bool:
    """Whether the tokenizer's own form of the word is letters only (a few letters come apart into letter and accent)."""
    return word.isalpha() and (word.isascii() or unicodedata.normalize("NFC", word).lower().isalpha())


class Encoder:
    """Token ids as bytes (of numpy type ``kind``, as short as the vocabulary lets it be), the same as of the whole text. The tokenizer drops white space,
    never joins across it, and ends each run of letters with a token of its own kind; so texts are cut at white space,
    new words are encoded many in a row, and words that were seen are not encoded again."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.kind = kind_of(max(vocabulary.values()) + 1)
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.signs = signs(np.arange(len(self.last)))
        self.ids: dict[str, bytes] = {}

    def one_by_one(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def in_a_row(self, words: list[str]) -> list[bytes]:
        """Ids of words that are letters only, each of which ends with one last token; if the count differs, one by one."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, self.kind)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(words) or ends[-1] != len(ids):
            return self.one_by_one(words)
        data, ends = ids.tobytes(), (ids.itemsize * ends).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def learn(self, words: set[str]) -> None:
        ids = self.ids
        plain, marked, rest = [], [], []
        for w in words:
            if w.isalpha():
                plain.append(w)
            elif is_letters(stem := w.rstrip(MARKS)):
                marked.append((w, stem, w[len(stem) :]))
            else:
                rest.append(w)
        plain = list(set(plain).union(stem for _, stem, _ in marked if stem not in ids))
        for i in range(0, len(plain), 500):
            ids.update(zip(plain[i : i + 500], self.in_a_row(plain[i : i + 500]), strict=True))
        rest += {m for _, _, m in marked if m not in ids and m not in words}
        ids.update(zip(rest, self.one_by_one(rest), strict=True))
        ids.update((w, ids[stem] + ids[m]) for w, stem, m in marked)

    def __call__(self, texts: list[str]) -> list[bytes]:
        cut = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        if len(self.ids) > CACHE:
            self.ids.clear()
        new = set().union(*cut).difference(self.ids)
        self.learn(new)
        out = [b"".join(map(self.ids.__getitem__, words)) for words in cut]
        for w in [w for w in self.ids.keys() & new if len(w) > 64]:
            del self.ids[w]
        return out


def encoder(path: str) -> Encoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share out the cores
    if path not in _known:
        _known[path] = Encoder(path)
    return _known[path]


def signs(ids: np.ndarray) -> np.ndarray:
    """A row of DIMS signs for each id: bits of a multiplicative hash."""
    h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return np.stack([((h >> np.uint64(60 - 7 * d)) & np.uint64(1)).astype(np.float32) * 2 - 1 for d in range(DIMS)], axis=1)


def hilbert(cells: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Positions on the Hilbert curve of rows of cell coordinates (Skilling, 2004)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    for b in range(depth - 1, 0, -1):
        q, p = 1 << b, (1 << b) - 1
        for i in range(n):
            on = (x[i] & q) != 0
            t = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] ^= t
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    for b in range(depth - 1, 0, -1):
        t = np.where(x[n - 1] & (1 << b), t ^ ((1 << b) - 1), t)
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(depth - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_key(sums: np.ndarray) -> np.ndarray:
    norm = np.maximum(np.sqrt((sums**2).sum(axis=1, keepdims=True)), 1e-9)
    cells = np.clip(((sums / norm + 1) / 2 * (1 << DEPTH)).astype(np.int64), 0, (1 << DEPTH) - 1)
    return hilbert(cells)


def tokens(docs: DataFrame, id_col: str, text_col: str, path: str) -> DataFrame:
    """doc_id, curve (key), n, ids (binary, the end id included)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))

    def run(texts: list[str]) -> tuple:
        encode = encoder(path)
        end = np.array([END], encode.kind).tobytes()
        ids = [np.frombuffer(x + end, encode.kind) for x in encode(texts)]
        return curve_key(np.array([encode.signs[x].sum(axis=0) for x in ids])), [len(x) for x in ids], [x.tobytes() for x in ids]

    return per_text(rows, {"curve": "long", "n": "long", "ids": "binary"}, run)


def tape(lengths: DataFrame) -> tuple[DataFrame, int]:
    """rows (row, doc_id, curve, n) -> (row, first: place on the tape), and the tape's length."""
    ranged = materialise(lengths.repartitionByRange("curve", "doc_id", "row").withColumn("range", F.spark_partition_id()), "ranges")
    totals = sorted((r["range"], r["n"]) for r in ranged.groupBy("range").agg(F.sum("n").alias("n")).collect())  # a row for each range
    before, total = [], 0
    for r, n in totals:
        before.append((r, total))
        total += n
    base = ranged.sparkSession.createDataFrame(before, "range int, base long")
    along = Window.partitionBy("range").orderBy("curve", "doc_id", "row").rowsBetween(Window.unboundedPreceding, 0)
    first = ranged.withColumn("upto", F.sum("n").over(along)).join(F.broadcast(base), "range")
    return first.select("row", (F.col("base") + F.col("upto") - F.col("n")).alias("first")), total


def cuts(first: int, n: int, total: int, length: int = LENGTH) -> list[tuple[int, int, int, int]]:
    """(start, size, sequence, offset) of the pieces of [first, first + n) on a tape of ``total``."""
    full = total // length
    out, at = [], first
    while at < first + n:
        if at < full * length:
            seq, begin, end = at // length, at // length * length, (at // length + 1) * length
        else:
            seq, begin, rest = full, full * length, total - full * length
            end = begin + (1 << rest.bit_length() - 1)
            while at >= end:
                rest -= end - begin
                seq, begin, end = seq + 1, end, end + (1 << rest.bit_length() - 1)
        upto = min(end, first + n)
        out.append((at - first, upto - at, seq, at - begin))
        at = upto
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, length: int = LENGTH) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (binary)."""
    made = materialise(tokens(docs, id_col, text_col, path or tokenizer_path()).withColumn("row", F.monotonically_increasing_id()), "tokens")
    places, total = tape(made.select("row", "doc_id", "curve", "n"))
    schema = made.select("doc_id").schema.add("start", "long").add("length", "long").add("ids_crc32", "long").add("doc_tokens", "long").add("sequence_id", "long").add("offset", "long").add("ids", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                out, whose = [], []
                for i, (n, raw, first) in enumerate(zip(*(part.column(c).to_pylist() for c in ("n", "ids", "first")), strict=True)):
                    ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4").tobytes()
                    for start, size, seq, offset in cuts(first, n, total, length):
                        piece = ids[4 * start : 4 * (start + size)]
                        out.append((start, size, zlib.crc32(piece), n, seq, offset, piece))
                        whose.append(i)
                kinds = [pa.int64()] * 6 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(whose)), *(pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True))], names=schema.names)

    return made.select("row", "doc_id", "n", "ids").join(places, "row").select("doc_id", "n", "ids", "first").mapInArrow(run, schema)
