import itertools
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from geoloom.llm import divergence, filter_audit
from geoloom.llm.queries import op12_filter_audit, op13_source_divergence
from tests.oracle import same

SF = "/root/testdata/sf0.001"


def test_queries_equal_sql(spark):
    for sf in (SF, "/root/testdata/sf0.01"):
        assert same(op12_filter_audit(spark, sf), filter_audit.ORACLE_SQL, sf) == ""
        assert same(op13_source_divergence(spark, sf), divergence.ORACLE_SQL, sf) == ""


def test_swaps_meet_every_order_once():
    for n in range(6):
        order, seen = list(range(n)), [tuple(range(n))]
        for k in filter_audit.swaps(n):
            order[k], order[k + 1] = order[k + 1], order[k]
            seen.append(tuple(order))
        assert len(seen) == len(set(seen)) == len(list(itertools.permutations(range(n))))


def brute_audit(docs, labels):
    """Every document through every order."""
    good, toxic = ({d for d, *v in labels if v[k] == 1 and d is not None} for k in (0, 1))
    fails = []
    for doc_id, text, source, *_ in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        again = any(d is not None and doc_id is not None and d < doc_id and (t or "") == text for d, t, *_ in docs)
        f = dict(A=len(words) < 50, B=100 * len(set(words)) < 65 * len(words), C=100 * len(re.findall("[A-Z]", text)) > 5 * len(text), D=bool(re.search(r"[#$%&*|]", text)), E=again)
        fails.append((source or "", f, doc_id in good, doc_id in toxic))
    out, shapley = {}, Counter()
    for part in {s for s, *_ in fails}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [x for x in fails if x[0] == part]
            gone = []
            for step, letter in enumerate(order, 1):
                now = [x for x in left if x[1][letter]]
                redundant = sum(x[1][letter] for x in gone)
                left, gone = [x for x in left if not x[1][letter]], gone + now
                alone = sum(x[1][letter] and sum(x[1].values()) == 1 for x in fails if x[0] == part)
                shapley[part, letter] += len(now)
                out[part, order, step] = [len(left), len(now), redundant, alone, sum(x[2] for x in now), sum(x[3] for x in now)]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_by_brute_force(spark):
    rng = np.random.default_rng(5)
    texts = [None, "", "one two", "A" * 30, "w1 " * 60, " ".join(f"w{k}" for k in range(70)), "x | y " * 30, " ".join(f"W{k}#" for k in range(60)), "é ü " * 40]
    docs = [(int(rng.integers(0, 40)) if rng.random() > 0.1 else None, texts[rng.integers(len(texts))], [None, "", "a", "b", "hot"][rng.integers(5)]) for _ in range(120)]
    labels = [(k, int(k % 3 > 0), int(k % 4 == 0)) for k in range(0, 40, 2)] + [(2, 1, None), (4, None, 1), (None, 1, 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumns({"h": F.lit(1), "mask": F.lit(2), "part": F.lit("q"), "n": F.lit(3)})
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in filter_audit.audit(frame, marks).collect()}
    assert got == brute_audit(docs, labels)
    assert filter_audit.audit(frame.limit(0), marks).count() == 0


def brute_divergence(docs, least, top):
    docs = [tuple(x or "" for x in d[:3]) for d in docs]
    terms = [[t.translate({c: c + 32 for c in range(65, 91)}) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)] for text, _, _ in docs]
    out = set()
    for lang in {d[1] for d in docs}:
        df = Counter(t for d, ts in zip(docs, terms, strict=True) if d[1] == lang for t in set(ts))
        kept = sorted((t for t, n in df.items() if n >= least), key=str.encode)
        groups = sorted({d[2] for d in docs if d[1] == lang})
        count = {g: Counter(t for d, ts in zip(docs, terms, strict=True) if d[1:] == (lang, g) for t in ts if df[t] >= least) for g in groups}
        whole = sum(count.values(), Counter())
        p = lambda c: [1 + 1_000_000_000 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept]  # noqa: B023, E731
        q, shares = p(whole), {g: p(count[g]) for g in groups}
        for g in groups:
            pairs = sorted((-sum(abs(a - b) for a, b in zip(shares[g], shares[o], strict=True)), o.encode()) for o in groups if o != g)
            out |= {(lang, g, "pair", item.decode(), -v, k) for k, (v, item) in enumerate(pairs, 1)}
            best = sorted((-(a - b), t.encode()) for t, a, b in zip(kept, shares[g], q, strict=True) if count[g][t] and a > b)
            out |= {(lang, g, "term", item.decode(), -v, k) for k, (v, item) in enumerate(best[:top], 1)}
    return out


def test_divergence_by_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(9)
    words = ["the", "The", "über", "ÜBER", "naïve", "zebra", "日本", "x1y", "a_b", "don't", *(f"w{chr(97 + k)}" for k in range(26))]
    docs = [(None if rng.random() < 0.05 else " ".join(rng.choice(words, rng.integers(0, 30))), [None, "", "en", "de"][rng.integers(4)], [None, "", "a", "b", "hot", "é"][rng.integers(6)]) for _ in range(300)]
    docs += [("once", "fr", s) for s in "abc"] + [(None, "fr", "d"), ("alone", "it", "x")]
    frame = spark.createDataFrame(docs, "text string, lang string, source string").withColumns({"term": F.lit(1), "n": F.lit(2), "chunk": F.lit(3), "docs": F.lit(4)})
    want = brute_divergence(docs, 12, 7)
    for rows, dense in ((200_000, 1 << 22), (20, 6)):  # many small chunks and narrow blocks give the same
        monkeypatch.setattr(divergence, "CHUNK_ROWS", rows)
        monkeypatch.setattr(divergence, "DENSE", dense)
        got = [tuple(r) for r in divergence.audit(frame, least=12, top=7).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert divergence.audit(frame.limit(0)).count() == 0


def test_billionths_are_exact():
    rng = np.random.default_rng(3)
    total = rng.integers(10, 9_000_000_000_000_000, 1000)
    count = (total * rng.random(1000)).astype(np.int64) - 5
    count = np.maximum(count, 0)
    assert divergence.billionths(count, total).tolist() == [1 + 1_000_000_000 * (int(c) + 5) // int(t) for c, t in zip(count, total, strict=True)]
