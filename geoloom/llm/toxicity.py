"""Toxicity: a support vector machine on a gap-weighted subsequence kernel with Nystroem landmarks.

A unit is a word's letters, or a run of single letters put together, in lower case, after a START sign. K(s, t) sums over common
subsequences of ORDER letters, each letter or gap that they span costing a factor DECAY (Lodhi et al., 2002), and is
normalised, so an insult with inserted or dropped letters stays close to the plain one. Landmarks are stems (starts of
words) that mark toxic training documents, picked greedily so that each adds documents the others miss; a unit is held
against a landmark in windows of as many letters as the landmark has and SPARE more, every SPARE letters from its start
to its end, and the largest value counts, so neither what stands before an insult nor endings matter. A sentence's
feature is its largest kernel value at each landmark (values under FLOOR count as zero), put through the inverse square
root of the landmarks' own kernel matrix; a linear machine with squared hinge loss is trained on labelled sentences. A
document's score is a logistic curve of its most toxic sentence's margin and of its units' margins over zero, to a word.

Training takes a bounded sample: at most ``max_docs`` labelled documents of each class in order of a hash of their id,
MAX_SENTENCES sentences of each class and MAX_UNITS units of them of at most LONGEST letters. Scoring reads every whole
text and every letter of its units.

Defined cases: null and empty texts score as a document without units; a null doc_id is scored and is in no training
fold; repeated rows score alike; without a labelled document of both classes every score is the share of toxic labels
(0 if there are none); of rows with one doc_id the largest text is learned from; an empty table gives no rows; other columns are ignored (``reject`` carries them along).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.llm.common import materialise, per_text, short_batches, text_or_empty

ORDER, DECAY, FLOOR = 3, 0.75, 0.35
LANDMARKS = 40
STEMS, SPARE = range(4, 10), 3  # letters of a stem; letters beyond them in a window, and from one window to the next
LONGEST = 24  # letters of a unit that is learned from
MAX_DOCS, MAX_SENTENCES, MAX_UNITS = 1000, 1500, 40_000
START = "^"  # stands before a unit's letters and a landmark's, so that a stem weighs more where a unit begins
CACHE = 150_000
TOXIC = 0.5
SENTENCE = re.compile(r"[.!?\n]+(?=\s|$)|\n+")


def windows(unit: str, width: int) -> list[str]:
    """Every place's next ``width - SPARE`` letters stand in one of the windows."""
    return [unit] if len(unit) <= width else [unit[i : i + width] for i in range(0, len(unit) - width + SPARE, SPARE)]


def as_rows(texts: list[str], width: int) -> np.ndarray:
    """Code points of the first ``width`` letters, padded with zeros."""
    return np.array(texts, f"<U{width}").view(np.int32).reshape(len(texts), width)


def subsequence_kernel(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """K for rows of s against the same rows of t (code points padded with zeros)."""
    n, width = t.shape
    below = [np.ones((width + 1, n), np.float32), *(np.zeros((width + 1, n), np.float32) for _ in range(ORDER - 1))]
    total = np.zeros(n, np.float32)
    square = np.float32(DECAY * DECAY)
    for x in s.T:
        if not x.any():
            break
        live = x != 0
        same = [(x == t[:, j]) & live for j in range(width)]
        for j in range(width):
            total += square * same[j] * below[ORDER - 1][j]
        for i in range(ORDER - 1, 0, -1):
            run = np.zeros(n, np.float32)
            for j in range(width):
                run = DECAY * run + square * same[j] * below[i - 1][j]
                below[i][j + 1] = np.where(live, DECAY * below[i][j + 1] + run, below[i][j + 1])
    return total


def self_kernel(rows: np.ndarray) -> np.ndarray:
    return np.concatenate([subsequence_kernel(r, r) for r in np.array_split(rows, len(rows) // 8192 + 1)])


@lru_cache(1024)
def reachable(landmark: str) -> tuple[str, np.ndarray]:
    """A landmark's different letters, and for each set of them (as bits) whether a text that has only these can come to FLOOR.

    K(s, t) is a product of vectors; what s lacks counts for nothing, so normalised K is at most the share of t's length that is left.
    """
    letters = "".join(sorted(set(landmark)))
    bits = np.array([letters.index(c) for c in landmark])
    has = (np.arange(1 << len(letters))[:, None] >> bits & 1).astype(bool)
    code = np.array([ord(c) for c in landmark], np.int32)
    left = subsequence_kernel(np.where(has, code, -1), np.where(has, code, -2))  # -1 and -2 match nothing
    return letters, left >= (FLOOR * 0.999) ** 2 * left[-1]


def letter_sets(words: list[str], letters: list[str]) -> np.ndarray:
    """For each word whether it holds each letter."""
    known = np.array([ord(c) for c in letters], np.int32)
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.int32)
    sizes = np.array([len(w) for w in words], np.int64)
    at = np.minimum(np.searchsorted(known, points), len(known) - 1)
    some = np.flatnonzero(known[at] == points)
    has = np.zeros((len(words), len(letters)), np.float32)
    has[np.repeat(np.arange(len(words)), sizes)[some], at[some]] = 1
    return has


def hopeful(has: np.ndarray, letters: list[str], landmarks: list[str]) -> np.ndarray:
    """For each row of letter_sets and each landmark whether the kernel can come to FLOOR."""
    near = []
    for mark in landmarks:
        own, can = reachable(mark)
        bits = np.array([1 << own.index(c) if c in own else 0 for c in letters], np.float32)
        near.append(can[(has @ bits).astype(np.int64)])
    return np.stack(near, axis=1)


def kernel_rows(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Normalised K of words at landmarks, the largest of a word's windows; pairs whose letters cannot come to FLOOR are zero at once."""
    out = np.zeros((len(words), len(landmarks)), np.float32)
    if not words or not landmarks:
        return out
    letters = sorted(set("".join(landmarks)))
    whole = hopeful(letter_sets(words, letters), letters, landmarks)  # a word's letters bound those of its windows
    for size in sorted(set(map(len, landmarks))):
        at = np.array([j for j, m in enumerate(landmarks) if len(m) == size])
        chosen = np.flatnonzero(whole[:, at].any(axis=1))
        if not len(chosen):
            continue
        heads: dict[str, int] = {}
        parts = [windows(words[i], size + SPARE) for i in chosen]
        back = np.array([heads.setdefault(p, len(heads)) for ps in parts for p in ps], np.int64)
        rows, marked = as_rows(list(heads), size + SPARE), as_rows([landmarks[j] for j in at], size)
        a, b = np.nonzero(hopeful(letter_sets(list(heads), letters), letters, [landmarks[j] for j in at]))
        if not len(a):
            continue
        used, place = np.unique(a, return_inverse=True)
        norms, mark_norms = self_kernel(rows[used]), self_kernel(marked)
        values = np.zeros((len(heads), len(at)), np.float32)
        for lo in range(0, len(a), 8192):
            k = slice(lo, lo + 8192)
            values[a[k], b[k]] = subsequence_kernel(rows[a[k]], marked[b[k]]) / np.sqrt(np.maximum(norms[place[k]] * mark_norms[b[k]], 1e-12))
        starts = np.cumsum([0, *map(len, parts)])[:-1]
        out[np.ix_(chosen, at)] = np.maximum.reduceat(values[back], starts, axis=0)
    out[out < FLOOR] = 0
    return out


def letters_of(word: str) -> str:
    return word if word.isalpha() else "".join(filter(str.isalpha, word))


def units_of(words: list[str]) -> list[str]:
    """Words as they are, and runs of three or more single letters put together."""
    if sum(map((1).__eq__, map(len, words))) < 3:
        return words
    out, run = list(words), []
    for w in [*words, "--"]:
        if len(w) == 1:
            if w.isalpha():
                run.append(w)
        else:
            if len(run) >= 3:
                out.append("".join(run))
            run = []
    return out


class Kernels:
    """Kernel rows of words, remembered; None for words that are far from all landmarks."""

    def __init__(self, landmarks: list[str]):
        self.landmarks, self.known = landmarks, {}

    def learn(self, words: set[str]) -> None:
        if len(self.known) + len(words) > CACHE:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        units = [(w, START + u) for w in new if len(u := letters_of(w)) >= STEMS[0]]
        texts = list(dict.fromkeys(u for _, u in units))
        rows = kernel_rows(texts, self.landmarks)
        near = {texts[i]: rows[i] for i in np.flatnonzero(rows.any(axis=1))}
        self.known.update(dict.fromkeys(new))
        self.known.update((w, near[u]) for w, u in units if u in near)


@dataclass(frozen=True)
class Model:
    landmarks: list[str]
    weights: np.ndarray  # at kernel values: the Nystroem map and the machine's weights in one
    bias: float
    curve: tuple[float, float, float]  # of a document's largest margin, of its rate, and the shift

    def probability(self, found: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(found @ np.array(self.curve[:2]) + self.curve[2], -30, 30)))


_scorers: dict[tuple[str, ...], Kernels] = {}


def evidence(texts: list[str], model: Model) -> np.ndarray:
    """For each text the largest margin of its sentences and the rate of its units' margins over zero to words."""
    kernels = _scorers.setdefault(tuple(model.landmarks), Kernels(model.landmarks))
    out = np.zeros((len(texts), 2))
    out[:, 0] = model.bias
    sentences = [[units_of(s.split()) for s in SENTENCE.split(t.lower())] for t in texts]
    for lo in range(0, len(texts), 256):
        kernels.learn({u for doc in sentences[lo : lo + 256] for s in doc for u in s})
        known = kernels.known
        for i, doc in enumerate(sentences[lo : lo + 256], lo):
            near = [k for k in ([k for k in map(known.__getitem__, s) if k is not None] for s in doc) if k]
            if near:
                rows = np.array([k for ks in near for k in ks])
                starts = np.cumsum([0, *map(len, near)])[:-1]
                margins = np.maximum.reduceat(rows, starts, axis=0) @ model.weights + model.bias
                mass = np.maximum(rows @ model.weights + model.bias, 0).sum()
                out[i] = margins.max(), np.log1p(100 * mass / sum(map(len, doc)))
    return out


def score(texts: list[str], model: Model) -> np.ndarray:
    return model.probability(evidence(texts, model))


def machine(landmarks: list[str], sentences: list[str], labels: np.ndarray, insults: list[str], units: list[str]) -> tuple[np.ndarray, float]:
    """sentences with labels; insults and units of clean documents are sentences of their own, with labels 1 and 0."""
    rng = np.random.default_rng(0)
    alphabet = sorted(set("".join(units))) or ["x"]
    gapped = []
    for m in landmarks:  # insults with a letter put in or doubled
        for _ in range(20):
            i = int(rng.integers(2, len(m)))  # START is not parted from the first letter
            gapped.append(m[:i] + (str(rng.choice(alphabet)) if rng.random() < 0.6 else m[i - 1]) + m[i:])
    kernels = Kernels(landmarks)
    rows = []
    every = [*(units_of(s.lower().split()) for s in sentences), *([u] for u in insults), *([u] for u in gapped), *([u] for u in units)]
    for at in range(0, len(every), 2000):
        kernels.learn({u for s in every[at : at + 2000] for u in s})
        for s in every[at : at + 2000]:
            near = [k for k in map(kernels.known.__getitem__, s) if k is not None]
            rows.append(np.max(near, axis=0) if near else np.zeros(len(landmarks), np.float32))
    y = np.r_[labels, np.ones(len(insults) + len(gapped)), np.zeros(len(units))].astype(float)
    own = kernel_rows(landmarks, landmarks).astype(float)
    value, vector = np.linalg.eigh((own + own.T) / 2)
    nystroem = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-2))) @ vector.T
    x = np.c_[np.array(rows, float) @ nystroem, np.ones(len(rows))]
    sign = 2 * y - 1
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    w = np.zeros(x.shape[1])
    ridge = np.diag(np.r_[np.full(len(landmarks), 1e-3), 1e-6]) * len(y)
    for _ in range(30):  # Newton steps for the squared hinge
        on = sign * (x @ w) < 1
        xo = x[on] * weight[on, None]
        new = np.linalg.solve(x[on].T @ xo + ridge, xo.T @ sign[on])
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return nystroem @ w[:-1], float(w[-1])


def logistic(found: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float, float]:
    """A logistic curve fitted by Newton steps, with classes weighted to the share of label 1."""
    x = np.c_[found, np.ones(len(y))]
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (weight * (p * (1 - p) + 1e-6))) @ x + np.eye(3) * 1e-1, x.T @ (weight * (y - p)) - 1e-1 * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), float(w[1]), float(w[2])


def stems(units: DataFrame, some: int) -> list[str]:
    """units (id, y, unit): the landmarks. At most 500 candidates with their at most ``max_docs`` documents are collected."""
    starts = F.array_distinct(F.transform(F.array(*map(F.lit, STEMS)), lambda n: F.when(F.length("unit") >= n, F.substring(F.col("unit"), 1, n))))
    pairs = units.select("id", "y", F.explode(starts).alias("stem")).where("stem is not null").groupBy("id", "y", "stem").agg(F.count("*").alias("n"))
    size = {r["y"]: r["count"] for r in units.groupBy("y").count().collect()}
    counts = pairs.groupBy("stem").agg(F.sum("y").alias("t"), F.sum(F.col("n") * F.col("y")).alias("tn"), F.sum(F.col("n") * (1 - F.col("y"))).alias("cn"))
    odds = F.log((F.col("tn") + 0.5) / (size.get(1, 0) + 1)) - F.log((F.col("cn") + 0.5) / (size.get(0, 0) + 1))
    counts = counts.withColumn("odds", odds).where((F.col("t") >= max(2, some // 200)) & (F.col("odds") > np.log(4)))
    best = counts.orderBy((F.col("t") * F.col("odds")).desc(), "stem").limit(500).collect()
    if not best:
        return []
    where = pairs.where(F.col("stem").isin([r["stem"] for r in best]) & (F.col("y") == 1)).groupBy("stem").agg(F.collect_list("id").alias("ids"))
    ids = {r["stem"]: set(r["ids"]) for r in where.collect()}
    gain = {r["stem"]: r["odds"] for r in best}  # from a document's units, so that a stem that clean texts hold now and then can still mark those that hold many
    left, out = dict(ids), []
    seen: dict[int, int] = {}
    while left and len(out) < LANDMARKS:  # a document is worth half as much each time it is met
        worth = {s: gain[s] * sum(0.5 ** seen.get(i, 0) for i in ids) for s, ids in left.items()}
        top = max(worth, key=lambda s: (worth[s], s))
        if worth[top] < 0.03 * some:
            break
        for i in left.pop(top):
            seen[i] = seen.get(i, 0) + 1
        left = {s: ids for s, ids in left.items() if not s.startswith(top) and not top.startswith(s)}
        out.append(top)
    return out


def train(docs: DataFrame, labels: DataFrame, fold: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_docs: int = MAX_DOCS) -> Model:
    """labels (id_col, label_col); rows where ``fold`` holds (a condition on labels) are learned from."""
    marked = labels.where(fold if fold is not None else F.lit(True)).where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    marked = marked.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col(label_col)).cast("int").alias("y"))
    count = {r["y"]: r["count"] for r in marked.groupBy("y").count().collect()}
    none, some = count.get(0, 0), count.get(1, 0)
    share = some / max(1, none + some)
    dull = Model([], np.zeros(0), 0.0, (0.0, 0.0, float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))))
    if not none or not some:
        return dull
    by_hash = F.xxhash64("id")
    picked = [r for y in (0, 1) for r in marked.where(F.col("y") == y).orderBy(by_hash, "id").limit(max_docs).collect()]  # at most 2 max_docs rows
    picked = docs.sparkSession.createDataFrame(picked, "id long, y int")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    sample = materialise(texts.join(F.broadcast(picked), "id").groupBy("id", "y").agg(F.max("text").alias("text")), "toxic-sample")
    count = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    none, some = count.get(0, 0), count.get(1, 0)
    if not none or not some:
        return dull
    low = sample.select("id", "y", F.lower("text").alias("text"))
    word = F.regexp_replace(F.col("w"), r"[^\p{L}]", "")
    units = low.select("id", "y", F.explode(F.array_distinct(F.split("text", r"\s+"))).alias("w")).select("id", "y", word.alias("unit")).where(F.length("unit").between(STEMS[0], LONGEST))
    landmarks = stems(units, some)
    if not landmarks:
        return dull
    stem = F.col("unit").rlike("^(" + "|".join(map(re.escape, landmarks)) + ")")
    words = units.groupBy("unit").agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("c"))
    first = lambda rows, c, n: [r[c] for r in rows.orderBy(F.xxhash64(c), c).limit(n).collect()]
    insults, clean = first(words.where((F.col("c") == 0) & stem), "unit", MAX_SENTENCES), first(words.where("c > 0"), "unit", MAX_UNITS)
    parts = low.select("y", F.explode(F.split("text", SENTENCE.pattern)).alias("s")).where(F.length("s").between(STEMS[0], 1000)).distinct()
    within = F.col("s").rlike("(?<!\\p{L})(" + "|".join(map(re.escape, landmarks)) + ")")
    toxic, calm = first(parts.where((F.col("y") == 1) & within), "s", MAX_SENTENCES), first(parts.where("y = 0"), "s", MAX_SENTENCES)
    landmarks = [START + m for m in landmarks]
    weights, bias = machine(landmarks, toxic + calm, np.r_[np.ones(len(toxic)), np.zeros(len(calm))], insults, clean)
    model = Model(landmarks, weights, bias, (1.0, 0.0, 0.0))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = evidence(list(b["text"]), model)
            yield pd.DataFrame({"y": b["y"], "margin": found[:, 0], "rate": found[:, 1]})

    seen = sample.repartition(max(1, min(32, (none + some) // 50)), "id").mapInPandas(run, "y int, margin double, rate double").toPandas()
    return Model(landmarks, weights, bias, logistic(seen[["margin", "rate"]].to_numpy(), seen["y"].to_numpy(float), share))


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, score."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    return per_text(rows, {"score": "double"}, lambda texts: (score(texts, model),))


def reject(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = TOXIC) -> DataFrame:
    """The rows of ``docs`` that score under the threshold, with all their columns."""
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = ["" if t is None else str(t) for t in part.column(text_col).to_pylist()]
                yield part.filter(pa.array(score(texts, model) < threshold))

    return docs.mapInArrow(run, docs.schema)
