"""Runs of repeated word sequences against a plain search."""

import random
import zlib
from fractions import Fraction
from hashlib import sha256

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from crawlens.llm import periodic


def plain_runs(words, least=6, exponent=4):
    found = {}
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, exponent * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_words(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def plain_collapsed(words, runs):
    return b" ".join(w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs))


def of_sequences(sequences):
    owner, *columns = periodic.find_runs([np.array(s, np.int64) for s in sequences])
    return [[tuple(int(v) for v in row) for k, *row in zip(owner, *columns) if k == i] for i in range(len(sequences))]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), max_size=14), st.integers(1, 9), st.lists(st.integers(0, 2), max_size=9)), max_size=4))
def test_runs_of_short_alphabets(parts):
    sequences = [head + (head[-3:] or [1]) * times + tail for head, times, tail in parts]
    assert of_sequences(sequences) == [plain_runs(s) for s in sequences]


def test_runs_of_many_shapes():
    rng = random.Random(5)
    sequences = []
    for _ in range(300):
        n, kinds = rng.randint(0, 90), rng.choice([1, 2, 4, 30])
        words = [rng.randrange(kinds) for _ in range(n)]
        for _ in range(rng.randint(0, 3) if n else 0):
            a = rng.randrange(n)
            p = rng.randint(1, max(1, (n - a) // 3))
            for i in range(a, rng.randint(a, n)):
                words[i] = words[a + (i - a) % p]
        sequences.append(words)
    assert of_sequences(sequences) == [plain_runs(s) for s in sequences]


def test_grammar_agrees_with_comparing_symbol_by_symbol():
    rng = random.Random(3)
    words = [0] + [rng.choice([1, 1, 1, 2]) for _ in range(400)] + [3] + ([1, 2, 2] * 60) + [4]
    words[100:180] = words[200:280]
    grammar = periodic.Grammar(np.array(words))
    assert len(grammar.levels) < 60
    pairs = [(a, b) for a in range(1, len(words) - 1, 7) for b in range(a + 1, len(words) - 1, 11)]
    a, b = (np.array(v) for v in zip(*pairs))
    for forward in (True, False):
        expected = []
        for i, j in pairs:
            k = 0
            while words[i + k if forward else i - 1 - k] == words[j + k if forward else j - 1 - k]:
                k += 1
            expected.append(k)
        assert grammar.extend(a, b, forward).tolist() == expected


def test_long_texts_take_few_candidates_at_a_time():
    words = np.random.default_rng(1).integers(0, 5000, 60_000)
    words[10_000:50_000] = np.tile(words[10_000:14_000], 10)
    words[55_000:55_500] = 7
    owner, start, length, period = periodic.find_runs([words])
    assert (10_000, 4_000) in set(zip(start.tolist(), period.tolist())) and (7 == words[start[period == 1]]).any()
    sizes = np.array([len(words)])
    parts = list(periodic.candidates(np.append(0, np.append(words, 1)) + 0, np.array([1]), sizes, most=1000))
    assert len(parts) > 100


TEXTS = [
    (1, "a b a b a b a b tail"), (2, ""), (3, None), (4, " \t\x0b "), (5, "x " * 40), (6, "one two three four"), (None, "n n n n n n n"), (5, "x " * 40),
    (7, "é é " * 9 + "z\x1cz"), (18, "p q r s t u v w " * 30), (10, "w1 w2 w3 w4 w5 w6 w7 w8 w9 " * 25), (11, "k l m " * 5 + "x y " * 6 + "A a A a A a A a"),
]


def test_query_against_plain_python(spark, tmp_path):
    rng = random.Random(8)
    rows = TEXTS + [(i, " ".join(rng.choice("a b c dd eee".split()) for _ in range(rng.randint(0, 120)))) for i in range(100, 160)]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = periodic.op11_periodic_runs(spark, str(tmp_path)).collect()
    expected = []
    for doc_id, text in rows:
        words = plain_words(doc_id, text)
        runs = plain_runs(words)
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        expected.append(
            (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha256(listed.encode()).hexdigest(), sha256(plain_collapsed(words, runs)).hexdigest())
        )
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, t in rows if t)


def test_operator_keeps_other_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(i, t, "r", "old", "g", "w") for i, t in TEXTS], "doc_id long, body string, row string, runs string, _g string, `a.b` string")
    got = periodic.collapse_runs(docs, "body")
    assert got.columns == ["doc_id", "row", "_g", "a.b", "runs", "collapsed"]
    found = {(r["doc_id"], r["row"], r["_g"], r["a.b"]): r["collapsed"] for r in got.collect()}
    assert found[1, "r", "g", "w"] == "a b tail" and found[2, "r", "g", "w"] == "" and found[5, "r", "g", "w"] == "x" and found[None, "r", "g", "w"] == "n"
    assert periodic.collapse_runs(docs.limit(0), "body").collect() == []
    assert [r["collapsed"] for r in periodic.collapse_runs(docs.where("doc_id = 1").select("body"), "body").collect()] == ["a b tail"]


def test_strongest_is_exact(spark):
    runs = [(0, 1_000_000_007, 3), (5, 2_000_000_014, 6), (9, 1_000_000_010, 3), (12, 2_000_000_020, 6)]
    rows = spark.createDataFrame([(runs,), ([],)], f"runs {periodic.RUNS}")
    assert [r[0] and tuple(r[0]) for r in rows.select(periodic.strongest(F.col("runs"))).collect()] == [runs[2], None]
