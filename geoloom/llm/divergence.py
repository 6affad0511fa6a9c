"""Source divergence audit: how far each source's terms stand from those of its language and of the other sources.

Tasks count terms as bytes (what is no term byte becomes a space, A-Z become a-z), and Spark adds the counts up by lang,
source and term. All counts of a term meet in one chunk, a hash range of the terms of a language, of about CHUNK_ROWS
counts. There the terms are sorted as UTF-8 bytes, those in at least ``least`` documents are kept as a sorted array, and
a count's integer id is its term's place in that array by searchsorted: ids follow UTF-8 order. Bincounts over source and
id give dense vectors, a row a source and a column a kept term, never wider than DENSE cells at once. The second pass over the chunks,
now with the totals of each source and of the language, makes probabilities in whole billionths (long division in base
1000, exact up to 9e15 occurrences a language), adds up distances of pairs of sources by chunk, and takes each source's best
``top`` terms of the chunk (ties by id). Sums and ranks over the chunks are Spark's.

Defined cases: null text, lang and source count as ''; a document without terms makes its group known all the same;
repeated rows are documents like any other; a lang with one source has no pairs; without kept terms pairs have value 0 and there are
no terms; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoloom.llm.common import materialise, short_batches, text_or_empty

LEAST, TOP, ADDED, UNITS = 30, 50, 5, 1_000_000_000
HELD = 200_000  # different terms that a task counts before it hands them on
CHUNK_ROWS = 200_000
DENSE = 1 << 22
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: str) -> list[bytes]:
    return text.encode().translate(_TABLE).split()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and document counts by group and term; a row with an empty term says that the group occurs."""
    seen, docs, size = defaultdict(Counter), defaultdict(Counter), 0

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), n in seen.items():
            d, every = docs[lang, source], list(n)
            for at in range(0, len(every), 50_000):
                some = every[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * len(some), pa.string()), pa.array([source] * len(some), pa.string()), pa.array(some, pa.binary()),
                    pa.array([n[t] for t in some], pa.int64()), pa.array([d[t] for t in some], pa.int64()),
                ], names=["lang", "source", "term", "n", "docs"])
        seen.clear()
        docs.clear()

    for b in batches:
        for lang, source, text in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
            n, d, words = seen[lang, source], docs[lang, source], terms(text)
            size -= len(n)
            n.update(words)
            d.update(set(words))
            n[b""] += 1
            size += len(n)
            if size > HELD:
                yield from flush()
                size = 0
    yield from flush()


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, term (UTF-8 bytes; empty: the group occurs), n, docs."""
    short_batches(docs.sparkSession)
    rows = docs.select(text_or_empty(lang_col).alias("lang"), text_or_empty(source_col).alias("source"), text_or_empty(text_col).alias("text"))
    found = rows.mapInArrow(_counted, "lang string, source string, term binary, n long, docs long")
    return materialise(found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")


CHUNK = "lang string, chunk long, terms array<binary>, sources array<string>, sums array<long>, src array<int>, ids array<int>, n array<long>"


def _encode(least: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        """All counts of a chunk -> its kept terms in order; counts by source and id of the kept ones."""
        found = group["term"].to_numpy()
        order = np.argsort(found, kind="stable")  # as bytes
        ordered = found[order]
        new = np.ones(len(ordered), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        per_term = np.bincount(np.cumsum(new) - 1, weights=group["docs"].to_numpy()[order]).astype(np.int64)
        kept = ordered[new][per_term >= least]
        if not len(kept):
            return pd.DataFrame({c.split()[0]: pd.Series([], dtype=object) for c in CHUNK.split(", ")})
        at = np.searchsorted(kept, found)
        hit = (at < len(kept)) & (kept[np.minimum(at, len(kept) - 1)] == found)
        sources, src = np.unique(group["source"].to_numpy()[hit], return_inverse=True)
        n = group["n"].to_numpy()[hit]
        one = {"lang": group["lang"].iloc[0], "chunk": group["chunk"].iloc[0], "terms": kept.tolist(), "sources": sources.tolist(), "sums": np.bincount(src, n).astype(np.int64), "src": src.astype(np.int32), "ids": at[hit].astype(np.int32), "n": n}
        return pd.DataFrame([one])

    return run


def billionths(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(UNITS * (count + ADDED) / total), exactly; count + ADDED is at most total."""
    rest, out = count + ADDED, np.zeros(np.broadcast(count, total).shape, np.int64)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digit
    return out + 1


def _compared(top: int):
    """Chunks with their lang's totals -> shares of the distances of pairs, and the best terms of each source."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for c in b.itertuples(index=False):
                sources, groups = np.asarray(c.all_sources, object), len(c.all_sources)
                row = np.searchsorted(sources, np.asarray(c.sources, object))[c.src]
                terms, ids, n, added = np.asarray(c.terms, object), np.asarray(c.ids), np.asarray(c.n), ADDED * c.size
                width = max(1, DENSE // groups)  # columns and rows of a block: memory stays bounded for any number of sources
                for first in range(0, groups, width):
                    mine = range(first, min(first + width, groups))
                    far, best = np.zeros((len(mine), groups), np.int64), {a: [] for a in mine}
                    for lo in range(0, len(terms), width):
                        wide = min(width, len(terms) - lo)
                        here = (ids >= lo) & (ids < lo + wide)
                        counts = np.bincount(row[here] * wide + ids[here] - lo, n[here], groups * wide).astype(np.int64).reshape(groups, wide)
                        p = billionths(counts, (np.asarray(c.totals) + added)[:, None])
                        q = billionths(counts.sum(axis=0), np.int64(c.total + added))
                        for a in mine:
                            far[a - first] += np.abs(p - p[a]).sum(axis=1)
                            more = np.flatnonzero((counts[a] > 0) & (p[a] > q))
                            value = p[a, more] - q[more]
                            best[a] += [(-int(v), int(i) + lo) for v, i in zip(value, more, strict=True)]
                            best[a] = sorted(best[a])[:top]
                    for a in mine:
                        other = np.arange(groups) != a
                        yield pd.DataFrame({"lang": c.lang, "source": sources[a], "part": "pair", "item": sources[other], "value": far[a - first, other]})
                        if best[a]:
                            yield pd.DataFrame({"lang": c.lang, "source": sources[a], "part": "term", "item": [terms[i].decode() for _, i in best[a]], "value": [-v for v, _ in best[a]]})

    return run


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part (pair: distance to each other source of the lang; term: the ``top`` terms above the lang's level), item, value, rank."""
    counts = term_counts(docs, text_col, lang_col, source_col)
    groups, real = counts.where(F.octet_length("term") == 0).select("lang", "source"), counts.where(F.octet_length("term") > 0)
    chunks = real.count() // CHUNK_ROWS + 1
    coded = materialise(real.withColumn("chunk", F.pmod(F.xxhash64("term"), F.lit(chunks))).groupBy("lang", "chunk").applyInPandas(_encode(least), CHUNK), "term-chunks")

    by_source = coded.select("lang", F.explode(F.arrays_zip("sources", "sums")).alias("c")).groupBy("lang", F.col("c.sources").alias("source")).agg(F.sum("c.sums").alias("n"))
    known = groups.join(by_source, ["lang", "source"], "left").groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0)).alias("n")))).alias("g"), F.sum("n").alias("total"))
    known = materialise(known.select("lang", F.col("g.source").alias("all_sources"), F.col("g.n").alias("totals"), "total"), "source-totals")
    sizes = coded.groupBy("lang").agg(F.sum(F.size("terms")).alias("size"), F.collect_list("chunk").alias("chunk"))
    each = known.join(sizes, "lang").withColumn("chunk", F.explode("chunk"))
    found = materialise(coded.join(each, ["lang", "chunk"]).mapInPandas(_compared(top), "lang string, source string, part string, item string, value long"), "compared")

    bare = known.join(sizes.select("lang"), "lang", "left_anti").select("lang", F.explode("all_sources").alias("source"), "all_sources").select("lang", "source", F.explode("all_sources").alias("item")).where("source <> item")
    shares = found.where("part = 'pair'").select("lang", "source", "item", "value").unionByName(bare.withColumn("value", F.lit(0).cast("long")))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = shares.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))
    best = found.where("part = 'term'").select("lang", "source", "part", "item", "value", rank.alias("rank")).where(F.col("rank") <= top)
    return pairs.unionByName(best)


ORACLE_SQL = """
WITH d AS (
    SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms
    FROM documents
), g AS (SELECT DISTINCT lang, source FROM d), w AS (SELECT k, lang, source, unnest(terms) AS term FROM d),
v AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT k) >= 30), s AS (SELECT lang, count(*) AS size FROM v GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN v USING (lang, term) GROUP BY ALL),
t AS (
    SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS own,
        sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, v.term) AS m, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang) AS every
    FROM g JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term
), p AS (
    SELECT lang, source, term, n, (1 + 1000000000 * (n + 5) // (own + 5 * size))::BIGINT AS p, (1 + 1000000000 * (m + 5) // (every + 5 * size))::BIGINT AS q FROM t JOIN s USING (lang)
), x AS (
    SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), r AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
    UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q
)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM r QUALIFY part = 'pair' OR rank <= 50"""
