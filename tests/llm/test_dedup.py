"""Exact dedup, SimHash near-dedup and decontamination against plain Python."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from crawlens.llm import chunk_dedup, decontaminate, simhash
from crawlens.llm.common import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    words = ["alpha", "beta", "Gamma", "delta", "éclair", "zeta.", "eta", "theta\n", "iota", "kappa"]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.choice([0, 1, 2, 3, 40, 900])))) for i in range(120)]
    rows += [(200 + i, rows[i][1].upper() if i % 2 else rows[i][1]) for i in range(0, 120, 3)]
    for i in range(40):  # one word changed in a long text
        own = [r.choice(words) for _ in range(1500)]
        rows.append((400 + 2 * i, " ".join(own)))
        own[700] = "changed"
        rows.append((401 + 2 * i, " ".join(own)))
    return rows + [(900, None), (901, ""), (902, " \n\t "), (903, "x" * 300_000), (904, "X" * 300_000), (905, "🙂 " * 9000)]


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_chunks_are_the_text_and_follow_content(spark):
    rng = random.Random(1)
    text = " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 9))) for _ in range(20_000))
    shifted = "new words in front of it " + text
    a, b = (r[0] for r in spark.createDataFrame([(text,), (shifted,)], "t string").select(chunk_dedup.chunks(F.col("t"))).collect())
    assert "".join(a) == text and "".join(b) == shifted
    assert all(chunk_dedup.MIN_CHARS <= len(c) <= chunk_dedup.MAX_CHARS for c in a[:-1])
    assert len(set(a) & set(b)) > 0.9 * len(a)
    none = spark.createDataFrame([("",)], "t string").select(chunk_dedup.chunks(F.col("t"))).first()[0]
    assert none == []


@pytest.mark.parametrize("weak", [False, True])
def test_exact_duplicates(spark, texts, weak):
    identify = (lambda c: F.pmod(F.length(c), F.lit(7)).cast("long")) if weak else F.xxhash64  # a weak one makes chunks collide
    found = chunk_dedup.exact_duplicates(frame(spark, texts), identify=identify).collect()
    groups = {}
    for i, t in texts:
        groups.setdefault(lowered(t), []).append(i)
    text_of = dict(texts)
    assert len(found) == len(texts)
    for r in found:
        norm = lowered(text_of[r.doc_id])
        assert (r.keep_id, r.group_size, r.kept) == (max(groups[norm]), len(groups[norm]), r.doc_id == max(groups[norm]))
        assert r.text_sha256 == hashlib.sha256(norm.encode()).hexdigest()


def test_exact_duplicates_of_odd_rows(spark):
    rows = frame(spark, [(None, "A"), (3, "a"), (3, "a"), (None, "lone"), (5, None), (6, "")]).withColumns({"row": F.lit(1), "key": F.lit("k"), "kept": F.lit(0)})
    found = chunk_dedup.exact_duplicates(rows).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in found) == Counter(
        [(None, 3, 3, False), (3, 3, 3, True), (3, 3, 3, False), (None, None, 1, True), (5, 6, 2, False), (6, 6, 2, True)]
    )
    kept = chunk_dedup.keep_unique(rows)
    assert kept.columns == rows.columns
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == [("3", "a"), ("6", ""), ("None", "lone")]
    assert chunk_dedup.exact_duplicates(rows.limit(0)).count() == chunk_dedup.keep_unique(rows.limit(0)).count() == 0


def plain_fingerprint(text):
    words = lowered(text).encode().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))] if words else []
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64)) if hashes else 0


def plain_components(prints):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_near_duplicates(spark, texts):
    prints = {i: plain_fingerprint(t) for i, t in texts}
    whole = plain_components(prints)
    assert len(set(whole.values())) < len(set(prints.values()))  # different fingerprints are linked
    found = simhash.near_duplicates(frame(spark, texts).withColumns({"fp": F.lit("x"), "root": F.lit(1)})).collect()
    assert {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in found} == {i: (prints[i], whole[i]) for i in prints}
    kept = simhash.keep_one(frame(spark, texts))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(whole.values())) and kept.columns == SCHEMA.replace(",", "").split()[::2]
    assert simhash.near_duplicates(frame(spark, texts).limit(0)).count() == 0


def test_links_find_every_close_pair(spark):
    r = random.Random(2)
    prints = [r.getrandbits(64) for _ in range(40)]
    prints += [p ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for p in prints[:30]]
    signed = sorted({p - (1 << 64) if p >> 63 else p for p in prints})
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    links = {(r.a, r.b) for r in simhash.linked_fingerprints(df).collect()}
    close = {(a, b) for n, b in enumerate(signed) for a in signed[:n] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    assert links and links <= close
    linked = {r.node: r.root for r in components(df.sparkSession.createDataFrame(sorted(links), "a long, b long")).collect()}
    assert all(linked[a] == linked[b] for a, b in close)
    with_null = simhash.near_duplicates(frame(spark, [(None, "a b c"), (None, "lone words here"), (4, "A b\tc")])).collect()
    assert Counter((r.doc_id, r.component_id, r.component_size) for r in with_null) == Counter([(None, 4, 2), (4, 4, 2), (None, None, 1)])


def test_components_of_long_chains(spark):
    n = 70
    edges = [(i, i + 1) for i in range(n)] + [(1000, 1001), (1001, 1000), (5, 5)]
    random.Random(1).shuffle(edges)
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(n + 1), 0), 1000: 1000, 1001: 1000}
    star = components(spark.createDataFrame([(500, i) for i in range(300)], "a long, b long"))
    assert star.select("root").distinct().count() == 1


def plain_similarity(a, b):
    return sum((a & b).values()) / sum((a | b).values())


def plain_shingles(text):
    words = decontaminate.words_only(text or "").split()
    return [tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))] if words else []


def test_decontamination_against_brute_force(spark):
    r = random.Random(8)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(400)]
    passage = lambda n: [r.choice(words) for _ in range(n)]
    items = [(k, passage(r.choice([6, 20, 31, 44, 59, 320]))) for k in range(30)] + [(90, ["three", "short", "words"])]
    docs = []
    for i in range(150):
        own = passage(r.randint(0, 200))
        if i % 2:
            leak = list(r.choice(items)[1])
            for _ in range(len(leak) * (i % 3) // 90):
                leak[r.randrange(len(leak))] = "edited"
            at = r.randint(0, len(own))
            own[at:at] = leak
        docs.append((i, " ".join(w.upper() if i % 5 == 0 else w for w in own).replace(" ", ", " if i % 7 == 0 else " ")))
    docs += [(900, None), (901, ""), (902, "Three short words."), (903, " ".join(passage(30_000) + items[3][1])), (904, " ".join(items[4][1][:-2])), (None, " ".join(items[5][1]))]
    given = frame(spark, docs).withColumns({"item_id": F.lit("x"), "similarity": F.lit(1)})
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items] * 2 + [(91, None), (92, ""), (None, "a b c")], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contaminated(given, bench, block_chars=3000).collect()}
    true = {}
    for i, t in docs:
        own = plain_shingles(t)
        for k, w in items:
            item = Counter(plain_shingles(" ".join(w)))
            size = sum(item.values())
            if len(own) < 2000 or k in (3, 4, 5):
                best = max((plain_similarity(Counter(own[a : a + size]), item) for a in range(max(1, len(own) - size + 1))), default=0) if own else 0
                if best >= 0.8:
                    true[i, k] = best
    certain = {p for p, s in true.items() if s >= 0.85}
    assert set(found) <= set(true) and certain <= set(found)
    assert len(set(found) & set(true)) >= 0.9 * len(true)
    assert all(abs(found[p] - true[p]) < 1e-9 for p in certain)
    clean = decontaminate.keep_clean(given, bench)
    assert clean.columns == given.columns and {r.doc_id for r in clean.collect()} == {i for i, _ in docs} - {i for i, _ in found}
    assert decontaminate.contaminated(given, bench.limit(0)).count() == decontaminate.contaminated(given.limit(0), bench).count() == 0


def test_fingerprints_within_the_radius_share_a_block():
    index = decontaminate.ItemIndex([(1, " ".join(map(str, range(60))))])
    size, members, own, tables = index.classes[0]
    r = np.random.default_rng(4)
    near = own[0] ^ np.array([np.bitwise_or.reduce(np.uint64(1) << r.choice(64, n, replace=False).astype(np.uint64)) if n else 0 for n in range(16) for _ in range(50)], np.uint64)
    hits = [h for _, h in index.candidates(near, members, own, tables)]
    assert len(hits[0]) == len(near)
