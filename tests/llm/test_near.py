"""The pipeline's near-dedup stage against brute force."""

import random

import corpus_pipeline
import numpy as np
import pytest
from crawlens import scale
from crawlens.llm import chunk_dedup, decontaminate, minhash, toxicity
from pyspark.sql import functions as F
from test_dedup import frame


def plain_shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_kept(rows):
    """Ids that stay, and the number of similar pairs."""
    sets = {i: plain_shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    n = 0
    for i in sets:
        for j in sets:
            if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                n += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {find(i) for i in sets}, n


def near_rows():
    r = random.Random(11)
    words = [f"w{i}" for i in range(500)]
    rows = []
    for i in range(120):
        own = [r.choice(words) for _ in range(r.choice([12, 60, 200, 700]))]
        rows.append((10 * i, " ".join(own)))
        for k in range(1, 4):  # edits that leave it on either side of 0.8
            own = list(own)
            for at in r.sample(range(len(own)), max(1, int(len(own) * r.choice([0.005, 0.01, 0.02, 0.03])))):
                own[at] = r.choice(words)
            rows.append((10 * i + k, " ".join(own)))
    base = [r.choice(words) for _ in range(300)]
    for k in range(60):  # a large group, not all of whose pairs are similar
        own = list(base)
        for at in r.sample(range(300), r.choice([2, 3, 4])):
            own[at] = r.choice(words)
        rows.append((5000 + k, " ".join(own)))
    return rows


def test_near_copies_as_by_brute_force(spark):
    rows = near_rows()
    kept, n = plain_kept(rows)
    assert n > 300 and len(kept) < len(rows) - 150
    out = corpus_pipeline.distinct(spark, frame(spark, rows), "")
    found = [x.doc_id for x in out.collect()]
    assert len(found) == len(set(found)) and set(found) == kept


def test_near_dedup_of_odd_rows(spark):
    r = random.Random(2)
    long = lambda: " ".join(f"v{r.randrange(10**6)}" for _ in range(100))
    a, b, c, d = (long() for _ in range(4))
    rows = [(None, a + " x"), (None, b), (5, c), (5, d + " y"), (4, d), (3, a), (7, None), (8, ""), (9, " \n"), (5, c)]
    kept = minhash.keep_one(frame(spark, rows))
    assert sorted((str(x.doc_id), x.text) for x in kept.collect()) == sorted([("None", b), ("5", c), ("4", d), ("3", a), ("7", None)], key=lambda x: (x[0], str(x[1])))
    assert minhash.keep_one(frame(spark, rows).limit(0)).count() == 0
    assert minhash.keep_one(frame(spark, [(1, a), (2, b)])).count() == 2


def test_clean_rows_with_the_id_of_a_contaminated_one_stay(spark):
    item = " ".join(f"i{n}" for n in range(30))
    rows = [(None, f"before {item} after"), (None, "clean words of its own"), (None, None), (2, f"{item} then"), (2, "also clean"), (3, "")]
    clean = decontaminate.keep_clean(frame(spark, rows), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted((str(x.doc_id), str(x.text)) for x in clean.collect()) == [("2", "also clean"), ("3", ""), ("None", "None"), ("None", "clean words of its own")]


@pytest.mark.parametrize("most", [16 << 20, 0])
def test_columns_of_any_name_come_back(spark, monkeypatch, most):
    monkeypatch.setattr(scale, "BROADCAST_BYTES", most)
    names = ["_sha", "_id", "_n", "_kept", "_gone", "key", "kept", "whole", "sha", "_salt", "_salts", "n", "a.b"]
    item = " ".join(f"i{n}" for n in range(30))
    long = " ".join(f"v{n}" for n in range(60_000))
    rows = [(1, "some text"), (1, "some text"), (2, "some text"), (3, item), (None, None), (None, None), (4, "of its own"), (5, long), (6, long + " more")]
    given = frame(spark, rows).withColumns({c: F.lit(f"own {c}") for c in names})
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    model = toxicity.ToxicityModel({}, None, None, 0.0)
    own = [(None, None), (2, "some text"), (3, item), (4, "of its own"), (5, long), (6, long + " more")]
    clean = sorted((r for r in rows if r[1] != item), key=str)
    for kept, expected in [
        (chunk_dedup.keep_unique(given), own),
        (minhash.keep_one(given), [(None, None), (1, "some text"), (3, item), (4, "of its own"), (5, long)]),
        (decontaminate.keep_clean(given, bench), clean),
        (toxicity.keep_harmless(given, model), rows),
    ]:
        assert kept.schema.simpleString() == given.schema.simpleString()
        found = kept.collect()
        assert sorted(((r.doc_id, r.text) for r in found), key=str) == sorted(expected, key=str)
        assert all(r[c] == f"own {c}" for r in found for c in names)


def test_fingerprints_within_two_bits_meet(spark):
    r = random.Random(5)
    prints = [r.getrandbits(63) for _ in range(50)]
    rows = [(n, p) for n, p in enumerate(prints)] + [(50 + n, p ^ 5) for n, p in enumerate(prints[:20])] + [(70, prints[0]), (71, prints[0] ^ 15)]
    nodes = spark.createDataFrame(rows, "node long, fp long")
    pairs = {(x.a, x.b) for x in minhash.close_prints(nodes).collect()}
    assert {(n, 50 + n) for n in range(20)} | {(0, 70)} <= pairs and all(a < b for a, b in pairs)
    fps = dict(rows)
    assert all((fps[a] ^ fps[b]).bit_count() <= 2 for a, b in pairs)


def test_sketches_never_part_similar_sets(spark):
    r = np.random.default_rng(6)
    rows, true = [], []
    for size in (1, 4, 30, 200, 1023, 1025, 3000, 20_000):
        for part in (0.0, 0.05, 0.1, 0.11, 0.112, 0.12, 0.3, 0.5):
            for grown in (1.0, 1.1, 1.25, 1.3):
                one = r.integers(0, 1 << 63, size, np.uint64)
                fresh = r.integers(0, 1 << 63, round(size * grown), np.uint64)
                other = np.unique(np.concatenate([one[: size - int(part * size)], fresh[: len(fresh) - size + int(part * size)]]))
                one = np.unique(one)
                shared = len(np.intersect1d(one, other))
                true.append(shared / (len(one) + len(other) - shared))
                rows.append((len(rows), len(one), minhash.sketch(one).tolist(), len(other), minhash.sketch(other).tolist()))
    frame_ = spark.createDataFrame(rows, "i long, s long, w array<long>, os long, ow array<long>")
    found = [x[0] for x in frame_.orderBy("i").select(minhash.can_be_similar(*map(F.col, ("s", "w", "os", "ow")))).collect()]
    assert sum(s >= 0.8 for s in true) > 60 and all(f for f, s in zip(found, true) if s >= 0.8)
    assert sum(s < 0.6 for s in true) > 40 and not any(f for f, s, row in zip(found, true, rows) if s < 0.6 and row[1] >= 30)
    assert {len(x[2]) for x in rows} >= {16, 32, 64, 512}


def test_texts_of_a_value_that_can_not_be_similar_are_not_held_against_each_other(spark, monkeypatch):
    r = random.Random(12)
    words = [f"w{i}" for i in range(500)]
    base = [r.choice(words) for _ in range(200)]
    rows = []
    for i in range(300):  # edited apart: two thirds are similar to no other
        own = list(base)
        for at in r.sample(range(200), r.choice([1, 2, 8, 10, 12, 12])):
            own[at] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    kept, n = plain_kept(rows)
    assert n > 4000 and 200 < len(kept) < 300
    held, before = [], minhash._similar
    monkeypatch.setattr(minhash, "_similar", lambda pairs, *rest: (held.append(pairs.count()), before(pairs, *rest))[1])
    assert {x.doc_id for x in minhash.keep_one(frame(spark, rows)).collect()} == kept
    assert sum(held[1:]) < 2 * n  # over 30 000 pairs share a value
