"""Each operator against brute force, and on nulls, empty tables, repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from geoloom.llm import exact_dedup, fingerprints, line_dedup, packing, quality, queries, sentencepiece_codec, sharding, simhash, similar, suffix_dedup, toxicity
from geoloom.llm.common import scratch
from geoloom.llm.components import components
from tests.oracle import same

SF = "/root/testdata/sf0.001"
BIG = (1 << 60) + 1  # does not fit a double
LONG = "word " * 30_000
ROWS = [
    (1, "the same text", "en", 1), (2, "the same text", None, None), (2, "the same text", "x", 2), (3, None, None, None), (4, "", "fr", 0), (None, "no id", "en", 5), (None, "no id", "en", 5),
    (BIG, LONG, "en", 1), (6, "Éàü 漢字 \U0001f600 tab\tand\nline", "fr", 3), (7, "a", "en", 1), (8, "the same text but longer " * 30, "en", 1), (9, "and more the same text but longer " * 30, "en", 1),
]
SCHEMA = "doc_id long, text string, key string, row long"  # names that operators use inside


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# --- exact dedup


def test_exact_same_as_sql(spark):
    assert same(queries.op3_exact_dedup(spark, SF), queries.ORACLE["op3_exact_dedup"], SF) == ""


@pytest.mark.parametrize("weak", [False, True])
def test_exact_cases(docs, none, weak):
    key = (lambda c: F.pmod(F.xxhash64(c), F.lit(2))) if weak else exact_dedup.key_of
    rows = exact_dedup.exact_copies(docs, key=key, capacity=3).collect()
    assert len(rows) == len(ROWS)
    want = defaultdict(list)
    for i, t, *_ in ROWS:
        want[hashlib.sha256((t or "").encode()).hexdigest()].append(i)
    for r in rows:
        ids = want[r["text_sha256"]]
        assert r["group_size"] == len(ids) and r["keep_id"] == max((i for i in ids if i is not None), default=None)
    assert sum(r["kept"] for r in rows) == len(want)
    kept = exact_dedup.drop_copies(docs, key=key, capacity=3)
    assert kept.columns == docs.columns and kept.count() == len(want)
    assert exact_dedup.exact_copies(none).count() == 0 == exact_dedup.drop_copies(none).count()


def test_directory_doubles(spark):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"), F.xxhash64("id").alias("key"))
    bits, slots, index = exact_dedup.build_index(rows, 100)
    assert bits == 8 and slots.count() == 256
    depths = [int(r["bucket"].split("-")[0]) for r in slots.select("bucket").distinct().collect()]
    assert sum(2.0 ** -d for d in depths) == 1  # the buckets share out all keys
    assert index.groupBy("bucket").count().agg(F.max("count")).first()[0] <= 100 and index.count() == 5000
    by_slot = rows.withColumn("slot", exact_dedup._prefix(bits)).join(slots, "slot").select("doc_id", "bucket")
    assert by_slot.exceptAll(index.select(F.col("keep_id").alias("doc_id"), "bucket")).count() == 0  # a row's slot names the bucket of its entry


def test_registered_index_has_many_buckets(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    assert exact_dedup.build_index(rows.withColumn("key", exact_dedup.key_of("text")))[2].select("bucket").distinct().count() >= 4


def test_clashing_names(spark):
    names = ["__k", "__d", "__key", "__digest", "__id", "__h", "__hash", "__starts", "__t1", "__t2"]
    rows = spark.createDataFrame([(i, "a text that repeats " * 20, *(f"{n}{i}" for n in names)) for i in range(3)], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    for made in (exact_dedup.drop_copies(rows), simhash.keep_one(rows), similar.keep_one(rows), suffix_dedup.remove_repeats(rows)):
        assert made.columns == rows.columns and all(r[n] == f"{n}{r['doc_id']}" for r in made.collect() for n in names)


# --- SimHash


def _plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def _plain_components(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_simhash_brute_force(spark, table):
    got = {r["doc_id"]: r for r in queries.op9_simhash(spark, SF).collect()}
    rows = table.collect()
    fps = [_plain_fingerprint(r["text"]) for r in rows]
    least = {}
    roots = _plain_components(fps)
    for c, r in zip(roots, rows, strict=True):
        least[c] = min(least.get(c, r["doc_id"]), r["doc_id"])
    assert {r["doc_id"]: (f"{f:016x}", least[c]) for r, f, c in zip(rows, fps, roots, strict=True)} == {i: (r["fingerprint"], r["component_id"]) for i, r in got.items()}


def test_simhash_links_lose_nothing(spark):
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(50)]
    for _ in range(400):
        fps.append(rng.choice(fps) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    fps = sorted(set(fps))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    found = components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"))).collect()
    got = {r["u"]: r["root"] for r in found}
    want = _plain_components(fps)
    groups = defaultdict(set)
    for c, x in zip(want, signed, strict=True):
        groups[c].add(x)
    assert all(len({got.get(x, x) for x in g}) == 1 for g in groups.values())
    assert len({got.get(x, x) for x in signed}) == len(groups)


def test_simhash_cases(docs, none):
    rows = simhash.near_copies(docs).collect()
    assert len(rows) == len(ROWS)
    assert {r["component_id"] for r in rows if r["doc_id"] in (1, 2)} == {1}
    assert {r["fingerprint"] for r in rows if r["doc_id"] in (3, 4)} == {"0" * 16}
    assert BIG in {r["doc_id"] for r in rows}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len({r["fingerprint"] for r in rows})
    assert simhash.near_copies(none).count() == 0 == simhash.keep_one(none).count()


# --- suffix dedup


def _plain_repeats(rows, length, first):
    places = defaultdict(list)
    for i, t in sorted(rows):
        for s in range(len(t) - length + 1):
            places[t[s : s + length]].append((i, s))
    out = {}
    for i, t in rows:
        gone = np.zeros(len(t), bool)
        for s in range(len(t) - length + 1):
            p = places[t[s : s + length]]
            if p[0] != (i, s) if first else len(p) > 1:
                gone[s : s + length] = True
        out[i] = (len(t), int(gone.sum()), len(suffix_dedup.runs(gone)), hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest())
    return out


@pytest.mark.parametrize("first", [False, True])
def test_suffix_brute_force(spark, table, first):
    got = {r[0]: tuple(r[1:]) for r in suffix_dedup.repeated_bytes(table, keep_first=first).collect()}
    assert got == _plain_repeats([(r["doc_id"], (r["text"] or "").encode()) for r in table.collect()], 200, first)


@pytest.mark.parametrize("first", [False, True])
def test_suffix_small_alphabet(spark, first):
    rng, texts = random.Random(1), ["a" * 80, "ab" * 40, "", "é" * 30]
    for _ in range(60):
        texts.append("".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) + rng.choice(texts)[3:40])
    rows = list(enumerate(texts))
    made = suffix_dedup.repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string"), length=12, gram=5, keep_first=first)
    assert {r[0]: tuple(r[1:]) for r in made.collect()} == _plain_repeats([(i, t.encode()) for i, t in rows], 12, first)


def test_smaller_positions():
    rng = random.Random(3)
    for n in (0, 1, 2, 7, 60):
        places = [rng.randint(0, 9) for _ in range(n)]
        runs = sorted(rng.randint(0, 3) for _ in range(n))
        before, after = suffix_dedup.smaller_positions(places, runs)
        for i in range(n):
            fits = [j for j in range(n) if runs[j] == runs[i] and places[j] < places[i]]
            assert before[i] == max((j for j in fits if j < i), default=-1) and after[i] == min((j for j in fits if j > i), default=-1)


def test_previous_factors_of_places_that_are_not_in_order():
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 30))).encode() for _ in range(40)]
    groups, docs, at = np.array([rng.randint(0, 2) for _ in texts]), np.array([rng.randint(-5, 5) for _ in texts]), np.array([rng.randint(0, 9) * 40 for _ in texts])
    seen = defaultdict(list)
    for t, g, d, a in zip(texts, groups, docs, at, strict=True):
        for s in range(len(t) - 5):
            seen[g, t[s : s + 6]].append((d, a + s))
    text, offset, repeated, earlier = suffix_dedup.previous_factors(texts, groups, docs, at, 6)
    for i, s, r, e in zip(text, offset, repeated, earlier, strict=True):
        places = seen[groups[i], texts[i][s : s + 6]]
        assert r == (len(places) > 1) and e == (min(places) < (docs[i], at[i] + s))


def test_suffix_long_texts_are_cut_in_chunks(monkeypatch):
    text = bytes(random.Random(2).choices(b"abcd", k=5000))
    whole = [x for x in suffix_dedup.chunks([text], 20)]
    monkeypatch.setattr(suffix_dedup, "CHUNK", 300)
    starts = [range(o, o + len(d) - 19) for d, _, _, (o,) in suffix_dedup.chunks([text], 20)]
    assert len(whole) == 1 and sorted(s for r in starts for s in r) == list(range(5000 - 19))


def test_suffix_cases(docs, none):
    rows = suffix_dedup.remove_repeats(docs, length=20, gram=8)
    assert rows.columns == docs.columns and rows.count() == len(ROWS)
    assert suffix_dedup.repeated_bytes(docs, keep_first=False).count() == len(ROWS)
    assert suffix_dedup.remove_repeats(none).count() == 0 == suffix_dedup.repeated_bytes(none).count()
    data = "aéb".encode()
    assert suffix_dedup.kept_text(data, [(0, 2)]) == "éb" and suffix_dedup.kept_text(data, [(0, 3)]) == "b"


# --- packing


def _check_packing(pieces, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    want = sorted(np.array([*e.ids, 1], "<u4").tobytes() for e in t.encode_batch(texts, add_special_tokens=False))
    seqs = defaultdict(list)
    for p in pieces:
        assert p["length"] > 0 and p["ids_crc32"] == zlib.crc32(p["ids"]) and len(p["ids"]) == 4 * p["length"]
        seqs[p["sequence_id"]].append(p)
    for s in seqs.values():
        at = 0
        for p in sorted(s, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 2048 and (at == 2048 or at & (at - 1) == 0)
    assert sum(p["length"] for p in pieces) == sum(len(x) // 4 for x in want)
    return want


def test_packing_round_trip(table):
    pieces = packing.pack(table).collect()
    rows = {r["doc_id"]: r["text"] or "" for r in table.collect()}
    want = _check_packing(pieces, list(rows.values()))
    got = defaultdict(bytes)
    for p in sorted(pieces, key=lambda p: (p["doc_id"], p["start"])):
        assert p["start"] == len(got[p["doc_id"]]) // 4
        got[p["doc_id"]] += p["ids"]
    assert sorted(got.values()) == want


def test_packing_cases(docs, none):
    _check_packing(packing.pack(docs).collect(), [t or "" for _, t, *_ in ROWS])
    assert packing.pack(none).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abÉİΣ'’.,!*1 ٣\n\t́\x1c_", max_size=40), max_size=5))
def test_words_encode_like_whole_texts(texts):
    e = packing.encoder(packing.tokenizer_path())
    want = [np.array(x.ids, e.kind).tobytes() for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert e(texts) == want


def test_hilbert_is_a_curve():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3), -1).reshape(-1, 3)
    keys = packing.hilbert(cells, 3)
    assert sorted(keys) == list(range(512)) and (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


# --- fingerprints


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aab é", max_size=60), max_size=8))
def test_fingerprints_stand_alone(texts):
    assert fingerprints.fingerprint_many(texts) == [fingerprints.fingerprint_many([t])[0] for t in texts]


def test_fingerprints_likeness(table):
    texts = [r["text"] for r in table.collect() if 2000 < len(r["text"] or "") < 9000][:20]
    like = lambda a, b: fingerprints.likeness(*fingerprints.fingerprint_many([a, b]))
    for a, b in zip(texts, texts[1:], strict=False):
        assert like(a, a) == 1 and like(a, "x" + a) > 0.9 and 0.25 < like(a, a[len(a) // 2 :]) < 0.75
        assert like(a, b) < 0.2 or a[:50] == b[:50]


def test_edited_texts(table, docs, none):
    for frame in (table, docs):
        rows = sorted(((r["doc_id"], r["text"] or "") for r in frame.collect()), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
        want = []
        for k, (i, t) in enumerate(rows):
            n = rows[(k + 1) % len(rows)][1]
            half = len(t) // 2
            want.append((str(i), len(t), hashlib.sha256((t[: len(t) - half] + n[:half]).encode()).hexdigest()))
        got = fingerprints.edited_fingerprints(frame).collect()
        assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in got) == sorted(want)
        assert all(0 <= r[c] <= 1 for r in got for c in ("near_edited", "near_next"))
    assert fingerprints.edited_fingerprints(none).count() == 0


# --- classifiers


def _held_out(spark, query, label, threshold):
    rows = query(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert ((rows["score"] >= threshold) == (rows["predicted"] == 1)).all() and rows["score"].between(0, 1).all()
    hit = (rows["predicted"] == 1) & (rows[label] == 1)
    return (rows["predicted"] == rows[label]).mean(), hit.sum() / (rows[label] == 1).sum(), hit.sum() / (rows["predicted"] == 1).sum()


def test_quality_held_out(spark):
    assert _held_out(spark, queries.op2_quality, "quality", 0.7)[0] > 0.98


def test_toxicity_held_out(spark):
    accuracy, recall, precision = _held_out(spark, queries.op7_toxicity, "toxic", 0.5)
    assert accuracy > 0.97 and recall >= 0.9 and precision >= 0.9


def test_subsequence_kernel_brute_force():
    from itertools import combinations

    def plain(s, t):
        total = 0.0
        for a in combinations(range(len(s)), toxicity.ORDER):
            for b in combinations(range(len(t)), toxicity.ORDER):
                if [s[i] for i in a] == [t[j] for j in b]:
                    total += toxicity.DECAY ** (a[-1] - a[0] + 1 + b[-1] - b[0] + 1)
        return total

    pairs = [("idiot", "idi.ot"), ("banana", "bandana"), ("abc", "cba"), ("ab", "abc")]
    rows = [toxicity.as_rows([p[k] for p in pairs], 8) for k in (0, 1)]
    assert np.allclose(toxicity.subsequence_kernel(*rows), [plain(*p) for p in pairs], rtol=1e-4)


def test_insults_inside_units():
    marks = ["idiot", "aaab", "moronic"]
    plain = toxicity.kernel_rows(["idiot", "moronic"], marks)
    for before in range(12):
        for after in (0, 3, 30):
            unit = "xzqwvkxzqwvk"[:before] + "idiot" + "puhlbcsnymgfjerzwqkxvpuhlbcsny"[:after]
            assert toxicity.kernel_rows([unit], marks)[0, 0] >= toxicity.FLOOR, unit
    spelled = toxicity.units_of("you a r e a n i d i o t".split())[-1]
    assert spelled == "areanidiot" and toxicity.kernel_rows([spelled, "x" * 200 + "moronic"], marks).max(axis=0)[[0, 2]].min() >= toxicity.FLOOR
    assert plain[0, 0] == pytest.approx(1) and toxicity.kernel_rows(["aaab"], marks)[0, 1] == pytest.approx(1)  # two different letters


def test_letter_filter_is_a_bound():
    rng = random.Random(6)
    marks = [*("".join(rng.choices("abcdefg", k=rng.randint(4, 9))) for _ in range(20)), *("".join(map(chr, range(300 + 9 * k, 309 + 9 * k))) for k in range(8))]
    words = [*("".join(rng.choices("abcdefgh", k=rng.randint(4, 7))) for _ in range(300)), *marks]
    found = toxicity.kernel_rows(words, marks)
    for j, m in enumerate(marks):
        for i, w in enumerate(words):
            if len(w) <= len(m) + toxicity.SPARE:
                s, t = (toxicity.as_rows([x], 12) for x in (w, m))
                k = toxicity.subsequence_kernel(s, t) / np.sqrt(np.maximum(toxicity.self_kernel(s) * toxicity.self_kernel(t), 1e-12))
                assert found[i, j] == pytest.approx(k[0] if k[0] >= toxicity.FLOOR else 0, abs=1e-4) or abs(k[0] - toxicity.FLOOR) < 1e-4


def test_classifier_cases(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (6, 1, 0), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    empty = labels.where("false")
    for module, column in ((quality, "quality"), (toxicity, "toxic")):
        for marks in (labels, empty):
            model = module.train(docs, marks, label_col=column)
            scored = module.score_documents(docs, model).collect()
            assert len(scored) == len(ROWS) and all(0 <= r["score"] <= 1 for r in scored)
            assert module.score_documents(none, model).count() == 0
        assert module.train(none, labels, label_col=column) is not None
    kept = toxicity.reject(docs, toxicity.train(docs, empty))
    assert kept.columns == docs.columns and kept.count() == len(ROWS)


# --- SentencePiece


def _best_score(codec, text):
    pieces = {p.decode(): i for i, p in enumerate(codec.data) if p and i not in codec.byte.values()}
    scores = {piece: score for piece, (_, score, _) in ((k, codec.automaton.get(k)) for k in codec.automaton.keys())}
    best = [0.0] + [-1e18] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - 24), end):
            p = text[start:end]
            s = scores.get(p, codec.unknown_score if end - start == 1 else None)
            if p in pieces or end - start == 1:
                best[end] = max(best[end], best[start] + s)
    return best[-1], scores


def test_viterbi_is_best():
    codec = sentencepiece_codec.codec(sentencepiece_codec.model_path())
    for text in ("the nation of things", "Éàü 漢字 x", "aaaa  bbbb\n\tc", "ing"):
        marked = sentencepiece_codec.SPACE + text.replace(" ", sentencepiece_codec.SPACE)
        want, scores = _best_score(codec, marked)
        got = 0.0
        for i in codec.best(marked):
            got += 0 if i in codec.byte.values() else scores[codec.data[i].decode()]
        unknown = sum(c not in scores for c in marked)
        assert got + unknown * codec.unknown_score == pytest.approx(want)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=st.characters(blacklist_categories=["Cs"], blacklist_characters="▁"), max_size=60))
def test_pieces_round_trip(text):
    codec = sentencepiece_codec.codec(sentencepiece_codec.model_path())
    assert codec.decode(codec.encode(text)) == text


def test_sentencepiece_cases(docs, none):
    rows = sentencepiece_codec.encode(docs).collect()
    assert sorted(r["decoded"] for r in rows) == sorted(t or "" for _, t, *_ in ROWS)
    again = sentencepiece_codec.decode(sentencepiece_codec.encode(docs).withColumnRenamed("decoded", "text")).where("decoded <> text")
    assert again.count() == 0 and sentencepiece_codec.encode(none).count() == 0


# --- lines


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab", max_size=9), st.text(alphabet="ab", max_size=9), st.integers(0, 3))
def test_within(a, b, threshold):
    assert line_dedup.within(a, b, threshold) == (_distance(a, b) <= threshold)
    reach = max(y for y in range(len(b) + 1) if any(_distance(a[:x], b[:y]) <= threshold for x in range(len(a) + 1)))
    assert line_dedup.follow(a, b, threshold) == (len(b) + 1 if _distance(a, b) <= threshold else reach)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab", min_size=1, max_size=9), st.text(alphabet="ab", max_size=9), st.integers(1, 3))
def test_split_until_done(a, b, threshold):
    """Two texts come to a common finished key of splits exactly if they are within the threshold: a is looked for, b looks."""

    def keys(text, own):
        found, rows = set(), []
        begun = line_dedup._windows([(threshold, len(a), text)])
        if begun:
            rows.append((0, own, begun[0]))
        while rows:
            g, mine, windows = rows.pop()
            for to, by_own, done, left in line_dedup.split(g, mine, windows):
                if done:
                    found.add((to, by_own))
                else:
                    rows.append((to, by_own, left))
        return found

    own = {g for g, mine in keys(a, True) if mine}
    assert bool(own & {g for g, _ in keys(b, False)}) == (_distance(a, b) <= threshold)


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_line_links_brute_force(spark, threshold):
    rng, texts = random.Random(3), []
    for _ in range(120):
        s = list(rng.choice(texts)) if texts and rng.random() < 0.6 else [rng.choice("abé d") for _ in range(rng.randint(18, 40))]
        for _ in range(rng.randint(0, 3)):
            k, kind = rng.randrange(len(s)), rng.random()
            if kind < 0.4:
                s[k] = rng.choice("xyz")
            elif kind < 0.7:
                s.insert(k, rng.choice("xyz"))
            else:
                del s[k]
        texts.append("".join(s))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    every = line_dedup.lines(line_dedup.documents(frame))
    used = sorted({t for t in texts if len(t) >= line_dedup.LEAST})
    near = {frozenset((a, b)) for i, a in enumerate(used) for b in used[:i] if _distance(a, b) <= threshold}
    named = {r["id"]: r["line"] for r in every.select(line_dedup._id("h1", "h2").alias("id"), "line").collect()}
    found = {frozenset((named[r["u"]], named[r["v"]])) for r in line_dedup.links(every, threshold).collect()}
    assert found <= near and _joined(found) == _joined(near)


def _joined(pairs):
    """The sets of lines that the pairs join."""
    groups = []
    for pair in map(set, pairs):
        apart = [g for g in groups if not g & pair]
        groups = [*apart, pair.union(*(g for g in groups if g & pair))]
    return {frozenset(g) for g in groups}


def test_line_groups_are_not_paired_out(spark):
    """Many lines that share segments: each cluster's lines are joined, lines four edits apart are not."""
    rng = random.Random(2)
    bases = ["".join(rng.choices("abcdefgh ", k=240)) for _ in range(2)]
    texts = []
    for base in bases:
        for k in range(60):
            at = rng.randrange(230)
            texts.append(base[:at] + "".join(rng.choices("XYZ", k=rng.choice((1, 4, 5)))) + base[at + rng.choice((0, 1)) :])
    every = line_dedup.lines(line_dedup.documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    used = sorted(set(texts))
    near = {frozenset((a, b)) for i, a in enumerate(used) for b in used[:i] if abs(len(a) - len(b)) < 4 and line_dedup.within(a, b, 3)}
    named = {r["id"]: r["line"] for r in every.select(line_dedup._id("h1", "h2").alias("id"), "line").collect()}
    found = [frozenset((named[r["u"]], named[r["v"]])) for r in line_dedup.links(every).collect()]
    assert set(found) <= near and _joined(found) == _joined(near)


def test_candidates_grow_with_the_lines(spark):
    """Lines of one template with a number at random, with one, two and three edits allowed, and a family of near copies."""
    rng = random.Random(4)
    made = {
        "short": lambda: f"Order number {rng.randrange(10**6):06d} was received and will be sent soon.",
        "long": lambda: f"Order number {rng.randrange(10**6):06d} was received on day {rng.randrange(365)} of the year and will be sent to the address that you gave us " + "as soon as it can be sent. " * 4,
        "family": lambda: (lambda s, k: s[:k] + rng.choice("XYZ") + s[k + 1 :])("A line that many documents share but for a letter that someone has typed in another way.", rng.randrange(80)),
    }
    for name, line in made.items():
        for n in (150, 600):
            texts = sorted({line() for _ in range(n)})
            every = line_dedup.lines(line_dedup.documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
            found, _ = line_dedup.candidates(every.where(F.col("n") >= line_dedup.LEAST), None)
            count = sum(f.count() for f in found)
            assert count < line_dedup.LARGE * len(texts), (name, n, count)  # cells of at most LARGE lines are paired


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcdefgh ", min_size=20, max_size=60), st.lists(st.tuples(st.integers(0, 2), st.integers(0, 59), st.sampled_from("xya")), max_size=3), st.integers(1, 3))
def test_near_lines_have_a_rare_gram_in_common(line, edits, threshold):
    other = list(line)
    for kind, at, letter in edits[:threshold]:
        at = min(at, len(other))
        other[at : at + (kind < 2)] = letter * (kind > 0)
    lines = [line, "".join(other)]
    if len(lines[1]) >= line_dedup.LEAST:
        bands = line_dedup._bands(threshold)
        for shown in (lines, [], ["abcdefgh abcdefgh abcdefgh"]):
            number, key = line_dedup.rare(lines, bands, line_dedup._ranks(shown, bands))
            assert set(key[number == 0]) & set(key[number == 1])


def test_rows_of_a_family_with_larger_edits(spark, monkeypatch):
    """Lines that differ from one line by more than the threshold at any place: no table grows with the square of their number, or by splits."""
    rng, sizes, write = random.Random(6), [], line_dedup.materialise
    base = "".join(rng.choices("abcdefgh ", k=360))
    texts = []
    for _ in range(400):
        at = rng.randrange(360)
        texts.append(base[:at] + "".join(rng.choices("ijklmnopq", k=5)) + base[at:])
    texts.append(texts[0][:50] + "!" + texts[0][50:])
    monkeypatch.setattr(line_dedup, "materialise", lambda df, name: (lambda out: sizes.append((out.count(), name)) or out)(write(df, name)))
    every = line_dedup.lines(line_dedup.documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    found = line_dedup.links(every)
    near = {frozenset((a, b)) for i, a in enumerate(texts) for b in texts[:i] if line_dedup.within(a, b, 3)}
    named = {r["id"]: r["line"] for r in every.select(line_dedup._id("h1", "h2").alias("id"), "line").collect()}
    got = {frozenset((named[r["u"]], named[r["v"]])) for r in found.collect()}
    assert got <= near and _joined(got) == _joined(near) and near
    assert max(sizes)[0] < 25 * len(texts), max(sizes)


def test_long_lines_are_hashed_in_parts():
    """A batch of 1,000 long lines would take gigabytes of sums at once; whole lines, in order, and a line over the bound is alone."""
    for sizes in ([300_000] * 40, [20] * 1000, [3_000_000, 20, 20, 3_000_000], [line_dedup.HASHED] * 3, [20], []):
        lines = ["é" * n for n in sizes]
        parts = [p.column("line").to_pylist() for p in line_dedup._parts(pa.RecordBatch.from_pydict({"line": pa.array(lines, pa.string())}))]
        assert [x for p in parts for x in p] == lines
        assert all(sum(map(len, p)) - len(p[0]) <= line_dedup.HASHED for p in parts)
    points = np.array([0, 65, 0x10FFFF], np.uint64)
    assert (line_dedup._letters()[points] == line_dedup._mixed(points + np.uint64(1))).all()


def test_a_group_is_one_cell_of_few_rows(spark):
    """Lines that leave the pivot soon and could follow it for long are in many cells; a group that can be paired as it is needs none."""
    rows = [(1, h, h, 0, 0, [], False, 0, 900, 0, 900, True, 1000, h % 2 == 0) for h in range(1, 41)] + [(1, 50, 50, 0, 0, [], True, 0, 0, 0, 0, True, 1000, False)]
    probed = spark.createDataFrame(rows, "g long, h1 long, h2 long, p1 long, p2 long, before array<long>, near boolean, a int, b int, c int, d int, own boolean, n int, ring boolean")
    assert line_dedup._cells(probed, 41).count() == 41 and line_dedup._cells(probed, 40).count() > 1000
    pairs = {(r["h1_x"], r["h1_y"]) for r in line_dedup._pairs(line_dedup._cells(probed, 41), 41).collect()}
    split = {(r["h1_x"], r["h1_y"]) for r in line_dedup._pairs(line_dedup._cells(probed, 8), 41).collect()}
    assert pairs == split and len(pairs) >= 40 * 39 // 2


def test_edits_of_very_long_lines():
    a = "abcdefghij" * 20_000
    assert line_dedup.within("x" + a, a[:-1] + "y", 3) and not line_dedup.within("xyzw" + a, a, 3) and line_dedup.within(a[1:], a[:-1], 2)


def test_line_cases(spark, docs, none):
    assert line_dedup.line_report(docs).count() == len(ROWS) == line_dedup.drop_lines(docs).count()
    assert line_dedup.line_report(none).count() == 0
    line = "a line that stands in two documents"
    two = spark.createDataFrame([(2, f"x\n{line}!\n\n"), (1, f"{line}\ny")], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in line_dedup.drop_lines(two).collect()} == {1: f"{line}\ny", 2: "x\n\n"}


def _plain_lines(rows):
    """Brute force: doc_id -> (lines that stay, dropped, near, places); exact classes of all lines, edit links by the shorter line's length."""
    rows = sorted(rows)
    places = [(i, pos, line) for i, t in rows for pos, line in enumerate(t.split("\n"))]
    root = {line: line for _, _, line in places if line}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    used, linked = [x for x in root if len(x) >= 20], set()
    for k, a in enumerate(used):
        for b in used[:k]:
            short = min(len(a), len(b))
            edits = 1 if short < 100 else 2 if short < 200 else 3
            if abs(len(a) - len(b)) <= edits and _distance(a, b) <= edits:
                linked |= {a, b}
                root[find(a)] = find(b)
    seen, out = set(), {i: [[], 0, 0, []] for i, _ in rows}
    for i, pos, line in places:
        one = out[i]
        gone = bool(line) and find(line) in seen
        one[2] += line in linked
        if line:
            seen.add(find(line))
            one[3].append((pos, find(line), gone))
        if gone:
            one[1] += 1
        else:
            one[0].append(line)
    return out


def test_line_report_brute_force(spark):
    rng, pool = random.Random(8), ["ok", "page 1", "", "x"]
    for n in (19, 20, 21, 60, 98, 99, 100, 101, 150, 199, 200, 203, 204, 260, 300):
        base = "".join(rng.choices("abcd e", k=n))
        for edits in (0, 1, 2, 3, 4):
            s = list(base)
            for _ in range(edits):
                k, kind = rng.randrange(len(s)), rng.random()
                s[k : k + 1] = [] if kind < 0.3 else ["X", s[k]] if kind < 0.6 else ["Y"]
            pool.append("".join(s))
    rows = [(i, "\n".join(rng.choices(pool, k=rng.randint(1, 5)))) for i in range(60)]
    want = _plain_lines(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    classes = {}
    for r in line_dedup.line_report(frame).collect():
        kept, gone, near, places = want[r["doc_id"]]
        text = "\n".join(kept)
        assert (r["n_dropped"], r["n_near"], r["kept_chars"], r["kept_sha256"]) == (gone, near, len(text), hashlib.sha256(text.encode()).hexdigest())
        assert [(x["pos"], x["dropped"]) for x in r["lines"]] == [(p, g) for p, _, g in places]
        for x, (_, c, _) in zip(r["lines"], places, strict=True):
            assert classes.setdefault(c, x["class_id"]) == x["class_id"]
    assert len(set(classes.values())) == len(classes)
    assert {r["doc_id"]: r["text"] for r in line_dedup.drop_lines(frame).collect()} == {i: "\n".join(w[0]) for i, w in want.items()}


# --- sharding


def test_sharding(spark, docs, none):
    store = scratch(spark, "test-store")
    for _ in range(3):
        sharding.append(docs, store)
    sharding.append(none, store)
    before = sharding.manifest(spark, store).count()
    version = sharding.compact(spark, store)
    now = sharding.manifest(spark, store)
    assert version == 5 and now.count() < before
    assert sharding.read(spark, store).exceptAll(docs.union(docs).union(docs)).count() == 0
    assert sharding.read(spark, store).count() == 3 * len(ROWS) == sharding.read(spark, store, 3).count()
    with pytest.raises(Exception, match="exist"):  # the version is taken
        sharding.commit(now, store, version)
    assert sharding.vacuum(spark, store) > 0 and sharding.read(spark, store).count() == 3 * len(ROWS)
    assert sharding.compact(spark, scratch(spark, "no-store")) is None
    empty = scratch(spark, "empty-store")
    sharding.append(none, empty)
    assert sharding.compact(spark, empty) is None and sharding.read(spark, empty).count() == 0 and sharding.read(spark, empty).columns == none.columns


def test_merges_fill_targets():
    plan = sharding.merges({f"s{i}": 1 << 20 for i in range(400)} | {"big": 120 << 20}, target=100 << 20)
    assert "big" not in plan and len(set(plan.values())) == 4 and len(plan) == 400
