"""Quality classifier: histogram gradient-boosted trees over document statistics.

Every whole text is read once for FEATURES (counts of byte classes, words, lines, repeats). Trees are grown on a bounded
sample: at most ``max_docs`` labelled documents in order of a hash of their id, of which only the statistics reach the
driver. Values fall into BINS quantile bins; each level of a tree picks its splits from histograms of gradients and
Hessians. Trees are complete, of DEPTH levels, and flattened into arrays: node k has children 2k + 1 and 2k + 2, so all
rows of a batch go down one level with one numpy step.

Defined cases: null counts as empty; an empty text has all statistics zero and is scored like any other; a null doc_id
is scored and is in no training fold; labels other than 0 and 1 are left out, and of several labels of one document the
largest counts; without a labelled document of both classes the score is the share of label 1 (0.5 without any); an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.llm.common import materialise, per_text, text_or_empty

MAX_DOCS = 12_000
TREES, DEPTH, BINS, RATE, LEAST = 80, 4, 64, 0.15, 8.0
GOOD = 0.7
FEATURES = (
    "log_chars", "log_words", "word_length", "words_a_line", "upper", "digit", "space", "sentence_end", "comma", "mark", "pipe", "bracket", "wide",
    "words_marked", "words_upper", "distinct_words", "top_word", "distinct_pairs", "distinct_lines", "top_line", "longest_word", "short_lines", "same_as_before",
)
_CLASS = np.zeros(256, np.int64)
for _i, _chars in enumerate([b"", bytes(range(65, 91)), b"0123456789", b" \t\n\r", b".!?", b",;:", b"#$%&*+=@^~_\\/", b"|", b"()[]{}<>", bytes(range(128, 256))]):
    _CLASS[list(_chars)] = _i


def statistics(text: str) -> list[float]:
    data = text.encode()
    kinds = np.bincount(_CLASS, weights=np.bincount(np.frombuffer(data, np.uint8), minlength=256), minlength=10) / max(1, len(data))
    words, lines = text.split(), text.split("\n")
    n = max(1, len(words))
    count, line_count = Counter(words), Counter(lines)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    before = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return [
        np.log1p(len(text)), np.log1p(len(words)), lengths.mean(), np.log1p(len(words) / len(lines)), *kinds[1:],
        sum(not w[-1].isalnum() and w[-1] not in ".,;:!?" for w in words) / n, sum(w.isupper() for w in words) / n, len(count) / n, max(count.values(), default=0) / n,
        len(set(zip(words, words[1:], strict=False))) / n, len(line_count) / len(lines), max(line_count.values()) / len(lines), np.log1p(lengths.max()),
        sum(len(x) < 30 for x in lines) / len(lines), before / n,
    ]


@dataclass(frozen=True)
class Model:
    feature: np.ndarray  # trees x inner nodes
    border: np.ndarray  # go right if the value is larger
    value: np.ndarray  # trees x leaves
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        margin = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, border, value in zip(self.feature, self.border, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > border[node])
            margin += value[node - len(feature)]
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    inner, none = (1 << DEPTH) - 1, Model(np.zeros((0, 1), np.int64), np.zeros((0, 1)), np.zeros((0, 1)), 0.0)
    share = y.mean() if len(y) else 0.5
    start = float(np.log(np.clip(share, 1e-6, 1 - 1e-6) / np.clip(1 - share, 1e-6, 1 - 1e-6)))
    if len(np.unique(y)) < 2:
        return Model(none.feature, none.border, none.value, start)
    borders = np.quantile(x, np.arange(1, BINS) / BINS, axis=0, method="lower")
    binned = np.stack([np.searchsorted(borders[:, f], x[:, f], "left") for f in range(x.shape[1])], axis=1)  # bin b: above b borders
    offsets = np.arange(x.shape[1]) * BINS
    margin, model = np.full(len(y), start), ([], [], [])
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, border = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, width = (1 << level) - 1, 1 << level
            cell = ((node - first)[:, None] * x.shape[1] * BINS + offsets + binned).ravel()
            hists = [np.bincount(cell, np.repeat(v, x.shape[1]), width * x.shape[1] * BINS).reshape(width, x.shape[1], BINS).cumsum(axis=2) for v in (g, h)]
            (gl, hl), (gs, hs) = hists, (hists[0][:, :, -1:], hists[1][:, :, -1:])
            gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
            gain[(hl < LEAST / 4) | (hs - hl < LEAST / 4)] = 0
            flat = gain[:, :, :-1].reshape(width, -1)
            best = flat.argmax(axis=1)
            use = flat[np.arange(width), best] > 1e-6
            f, b = best // (BINS - 1), best % (BINS - 1)
            feature[first : first + width] = f
            border[first : first + width] = np.where(use, borders[b, f], np.inf)
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > border[node])
        leaf = node - inner
        value = -RATE * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + 1)
        margin += value[leaf]
        for held, new in zip(model, (feature, border, value), strict=True):
            held.append(new)
    return Model(*map(np.array, model), start)


def train(docs: DataFrame, labels: DataFrame, fold: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_docs: int = MAX_DOCS) -> Model:
    """labels (id_col, label_col); rows where ``fold`` holds (a condition on labels) are learned from."""
    marked = labels.where(fold if fold is not None else F.lit(True)).where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    picked = marked.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col(label_col)).cast("int").alias("y")).orderBy(F.xxhash64("id"), "id").limit(max_docs).collect()
    if not picked:
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    few = docs.sparkSession.createDataFrame(picked, "id long, y int")  # at most max_docs rows
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")).join(F.broadcast(few), "id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "y": b["y"], "x": [statistics(t) for t in b["text"]]})

    seen = materialise(texts.mapInPandas(run, "id long, y int, x array<double>"), "quality-sample").groupBy("id").agg(F.max(F.struct("y", "x")).alias("s")).select("id", "s.y", "s.x").orderBy("id").toPandas()
    return fit(np.array(seen["x"].tolist(), float).reshape(-1, len(FEATURES)), seen["y"].to_numpy(float))


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, score."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    return per_text(rows, {"score": "double"}, lambda texts: (model.score(np.array([statistics(t) for t in texts], float)),))
