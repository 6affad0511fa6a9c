import random
import re

import corpus_pipeline
import numpy as np
import pandas as pd

from geoloom.llm import similar, toxicity


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.materialise(stage(spark, docs, sf), name)
        assert after.columns == columns and 0 < after.count() <= docs.count()
        docs = after
    assert docs.groupBy("text").count().where("count > 1 and text <> ''").count() == 0
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_toxic_documents_go(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    kept = toxicity.reject(docs, toxicity.train(docs, labels)).join(labels, "doc_id")
    clean = labels.where("toxic = 0").count()
    assert kept.where("toxic = 0").count() > 0.98 * clean
    assert kept.where("toxic = 1").count() < 0.1 * labels.where("toxic = 1").count()


def test_edge_rows_through_all_stages(spark, tmp_path):
    """Nulls in any column, empty and very long texts, ties, repeated rows, columns that operators use inside."""
    words = [f"w{k}" for k in range(400)]
    rng = random.Random(1)
    text = lambda n: " ".join(rng.choices(words, k=n))
    long, shared, near = text(30_000), text(80), text(100)
    rows = [
        (1, None, None, None, 1), (2, "", "en", "a", 2), (3, long, "en", None, 3), (4, long, None, "b", 3), (5, "one two", "fr", "c", 4), (5, "one two", "fr", "c", 4), (None, "no id " + text(9), None, None, None),
        (6, f"{text(60)} {shared} {text(50)}", "en", "a", 1), (7, f"{text(60)} {shared} {text(70)}", "en", "a", 1), (8, near, "de", "a", 1), (9, near + " more", "de", "a", 1), (10, "漢字 \U0001f600", "zh", "a", 1),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, h long").selectExpr("*", "1 AS score", "2 AS keep_id", "'x' AS word")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(6, 1, 0), (8, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialise(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == frame.columns
        kept.append(sorted((r["doc_id"] or 0) for r in docs.collect()))
    assert len(kept[0]) == len(rows)  # no toxic label: nothing is toxic
    assert kept[1] == [0, 2, 4, 5, 6, 7, 8, 9, 10] and kept[2] == kept[3] == [0, 2, 4, 5, 6, 7, 8, 10]
    cut = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert cut[6] == rows[7][1] and shared not in cut[7] and cut[4] == long and (cut[2] or "") == ""
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in pieces} == {None, *kept[3]} - {0}
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0


def _plain_kept(rows):
    """Brute force: of components of texts with a five-word Jaccard of at least 0.8 the smallest doc_id."""
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))})
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted(least.values())


def test_near_copies_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = rng.choices(vocabulary, k=60)
    bases = [rng.choices(vocabulary, k=rng.randint(3, 150)) for _ in range(25)]
    texts = ["", " ", None, "one two", "One  two"]
    for k in range(250):
        words = list(rng.choice(bases))
        for _ in range(rng.randint(0, max(1, len(words) // 30))):  # similarities on both sides of 0.8
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        texts.append(" ".join([*words, *(passage if k % 5 == 0 else [])]))
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    kept = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    want = _plain_kept(rows)
    assert len(want) < 200 and sorted(r["doc_id"] for r in kept.collect()) == want


def test_near_copies_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == _plain_kept([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert similar.keep_one(docs.where("false")).count() == 0


def test_sketches_spare_texts_and_lose_no_pair():
    rng = np.random.default_rng(5)
    for n in (1, 3, 40, 400, 3000):
        base = rng.integers(0, 1 << 63, 2 * n).astype(np.uint64)
        sets = [np.unique(base[:n])] + [np.unique(np.r_[base[: n - k], base[n : n + extra]]) for k in {0, n // 20, n // 9, n // 5, n} for extra in {0, n // 20, n // 9, n}]
        sets = [x for x in sets if len(x)]
        rows = np.stack([np.frombuffer(similar.sketch(x), np.uint8) for x in sets])
        size = np.array([len(x) for x in sets])
        for x, own in zip(sets, rows, strict=True):
            may = similar.may_be_alike(np.repeat(own[None], len(sets), axis=0), rows, np.full(len(sets), len(x)), size)
            assert all(m or not similar.alike(x, y) for m, y in zip(may, sets, strict=True))
        other = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        assert n == 1 or not similar.may_be_alike(rows[:1], np.frombuffer(similar.sketch(other), np.uint8)[None], size[:1], np.array([len(other)]))[0]


def test_differences_from_a_centre_lose_no_pair():
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    pool = rng.integers(0, 1 << 63, 60).astype(np.uint64)
    centre = np.unique(base[:140])
    made = [np.unique(np.r_[rng.choice(centre, 140 - int(k), False), rng.choice(pool, int(e), False)]) for k, e in rng.integers(0, 60, (250, 2))]
    sets = [x for x in made if not similar.alike(x, centre)] + [x for x in made if similar.alike(x, centre)][:20]
    count = sum(similar.lacks(x, centre) for x in sets)
    frequent = np.sort(pool[:30])
    found = [similar.differing(x, centre, count, frequent, np.arange(30)) for x in sets]
    pairs = 0
    for x, (d, keys, _) in zip(sets, found, strict=True):
        for y, (e, others, low) in zip(sets, found, strict=True):
            if x is not y and d >= e and similar.alike(x, y) and not (similar.alike(x, centre) and similar.alike(y, centre)):
                pairs += 1
                assert len(np.intersect1d(keys, others[:low]))
    assert pairs > 50


def test_a_large_family_makes_few_pairs(spark, monkeypatch):
    rng = random.Random(6)
    base = [f"w{i}" for i in range(150)]
    texts = [" ".join(base)]
    for i in range(240):
        words = list(base)
        for at in rng.sample(range(150), rng.choice((3, 4, 5, 5))):
            words[at] = f"x{i}y{at}" if rng.random() < 0.8 else f"z{at}"
        texts.append(" ".join(words))
    rows = list(enumerate(texts))
    checked, sizes = similar._checked, []
    monkeypatch.setattr(similar, "_checked", lambda pairs, *more: sizes.append(pairs.count()) or checked(pairs, *more))
    kept = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == _plain_kept(rows)
    assert sum(sizes) < 8 * len(texts), sizes


def test_keys_of_the_same_texts_count_once(spark):
    """Keys of two texts are decided at once, keys that the same texts have are one: neither is held against components again."""
    sizes = {10: 100, 11: 100, 12: 100, 13: 40}
    groups = [(k, h, 100 - k) for k in range(1, 16) for h in (10, 11, 12)] + [(k, h, 30) for k in (20, 21) for h in (10, 13)] + [(30, 11, 95), (30, 12, 95), (40, 13, 9)]
    rows = pd.DataFrame(groups, columns=["key", "h", "rest"]).assign(n=lambda x: x["h"].map(sizes))[["key", "h", "n", "rest"]]
    shared = pd.concat(similar._shared(iter([rows])))
    assert set(shared.loc[shared["size"] == 2, ["key", "first", "h"]].itertuples(index=False, name=None)) == {(30, 11, 12)}
    assert sorted(r["h"] for r in similar._once(spark.createDataFrame(shared, similar.SHARED)).where("key = 1").collect()) == [10, 11, 12]
    assert similar._once(spark.createDataFrame(shared, similar.SHARED)).count() == 3


def test_a_large_table_shows_more_frequent_shingles(spark, monkeypatch):
    """A passage that one text in twenty has comes last in the order, however many texts there are."""
    monkeypatch.setattr(similar, "SAMPLE", 20)
    passage = " ".join(f"p{i}" for i in range(9))
    texts = [f"{k} a{k} b{k} c{k} d{k} e{k} f{k} " + (passage if k % 20 == 0 else "") for k in range(2000)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").selectExpr("xxhash64(text) AS h", "text")
    frequent, rank = similar.frequent_shingles(rows)
    assert set(similar.shingles(passage)) == set(frequent) and (np.diff(frequent.astype(object)) > 0).all() and (rank >= 30).all()
