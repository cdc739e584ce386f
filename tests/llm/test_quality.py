"""The quality model: features and gradient against plain loops, accuracy on held-out rows, cases."""

import random

import numpy as np
import pytest

from crawlens.llm import quality as q
from crawlens.llm.toxicity import fold

SPACE = " \t\n\r\x0b\x0c"


def kind(byte):
    c = chr(byte)
    if byte > 127:
        return 7
    if c in " \t":
        return 3
    if c in SPACE:
        return 4
    return 0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 5 if c in ".,;:'\"()-" else 6


def plain_passages(text):
    """Passages of one stretch, feature by feature."""
    data = text.encode()
    starts = [i for i, b in enumerate(data) if kind(b) not in (3, 4) and (i == 0 or kind(data[i - 1]) in (3, 4))]
    words = data.split()
    assert len(words) == len(starts)
    rows, seen = [], set()
    for low in range(0, max(1, len(words)), q.WORDS):
        own = words[low : low + q.WORDS]
        pairs, n = np.zeros(64), max(1, len(own))
        end = starts[low + q.WORDS] if low + q.WORDS < len(starts) else len(data)
        for i in range(starts[low], end) if own else ():
            pairs[kind(data[i]) * 8 + (kind(data[i + 1]) if i + 1 < len(data) else 4)] += 1
        lengths = [len(w) for w in own] or [0]
        repeated = 0
        for i in range(low, low + len(own)):
            if i + 2 < len(words):
                repeated += tuple(words[i : i + 3]) in seen
                seen.add(tuple(words[i : i + 3]))
        same = sum(i > 0 and words[i] == words[i - 1] for i in range(low, low + len(own)))
        rest = [np.log1p(len(own)), min(np.mean(lengths), 100) / 10, min(np.std(lengths), 100) / 10, len(set(own)) / n, repeated / n, same / n]
        rows.append([*np.sqrt(pairs / max(1, pairs.sum())), *rest])
    return np.array(rows)


TEXTS = ["", " \n ", "one", "A b! c2 é", "w " * 200, "tail words without end", "\t x y x y x y  z\n" * 30, "x" * 70_000, "Ünï -- (x)\r\n\x0b\x0c q " * 40]


def test_features_against_plain_loops():
    found, counts = q.bags(TEXTS)
    at = np.cumsum(counts) - counts
    for text, low, n in zip(TEXTS, at, counts):
        np.testing.assert_allclose(found[low : low + n], plain_passages(text), atol=2e-4, err_msg=text[:20])
    for text, low, n in zip(TEXTS, at, counts):  # a text's passages do not depend on its neighbours
        np.testing.assert_array_equal(q.bags([text])[0], found[low : low + n])


def test_long_texts_go_by_stretches():
    rng = random.Random(4)
    text = " ".join(rng.choice("ab cde fghi JK l.".split()) for _ in range(40_000))
    parts = q.stretches(text.encode())
    assert b"".join(parts) == text.encode() and [len(p.split()) for p in parts] == [16384, 16384, 7232]
    whole, counts = q.bags(["a b", text, ""], most=1000)
    np.testing.assert_allclose(whole[1:-1], np.concatenate([plain_passages(p.decode()) for p in parts]), atol=2e-4)
    assert counts.tolist() == [1, 256 + 256 + 113, 1]


def test_attention_and_gradient_against_differences():
    rng = np.random.default_rng(0)
    model = q.AttentionModel.fresh(0.3, np.zeros(q.FEATURES), np.ones(q.FEATURES))
    counts, labels, passages = np.array([3, 1, 5]), np.array([1.0, 0, 1]), rng.normal(size=(9, q.FEATURES))
    weight = model.forward(passages, counts)["weight"]
    assert np.allclose(np.add.reduceat(weight, [0, 3, 4]), 1) and (weight > 0).all()

    def loss(weights):
        s = 1 / (1 + np.exp(-q.AttentionModel(weights, model.mean, model.scale).forward(passages, counts)["logit"]))
        return -(labels * np.log(s) + (1 - labels) * np.log(1 - s)).mean()

    slope = model.gradient(passages, counts, labels)
    for i in [*range(0, len(slope), 97), *range(len(slope) - 40, len(slope))]:
        step = np.zeros_like(slope)
        step[i] = 1e-6
        assert abs((loss(model.weights + step) - loss(model.weights - step)) / 2e-6 - slope[i]) < 1e-7


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = q.op12_quality(spark, sf).join(labels, "doc_id").where("held_out").select("score", "predicted", "quality").collect()
    score, label = np.array([r["score"] for r in rows]), np.array([r["quality"] for r in rows])
    above = (score[label == 1][:, None] > score[label == 0]).mean()
    assert len(rows) > 500 and above > 0.97 and np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.97


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["calm", "words", "here"]) if i % 2 else rng.choice(["###", "!!!", "7$7"]) for _ in range(rng.randint(5, 300)))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "\n"), (None, "calm words"), (5, "here calm"), (5, "here calm"), (1003, "calm " * 60_000)]
    return spark.createDataFrame([(i, t, "l", "x", "y") for i, t in rows], "doc_id long, text string, label string, score string, passages string").repartition(5)


def test_cases(spark, docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(280)] + [(5, 0), (None, 1), (7, None)], "doc_id long, quality int")
    model = q.fit(docs, labels)
    rows = q.score_documents(docs, model).collect()
    assert len(rows) == 307 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 300]
    assert held and all(r["predicted"] == r["doc_id"] % 2 for r in held if r["doc_id"] != 5)
    empty = {r["score"] for r in rows if r["doc_id"] in (1000, 1001, 1002)}
    assert len(empty) == 1
    assert np.array_equal(q.fit(docs.repartition(2), labels.repartition(3)).attention.weights, model.attention.weights)
    kept = dict(docs.limit(0).select("doc_id", "label", "text").dtypes)
    assert model.score(docs.select("doc_id", "label", "text")).columns == ["doc_id", "label", "score"] and kept["label"] == "string"


def test_labels_of_one_kind_and_empty_tables(spark, docs):
    labels = "doc_id long, quality int"
    assert {r["score"] for r in q.score_documents(docs, q.fit(docs, spark.createDataFrame([(i, 1) for i in range(40)], labels))).collect()} == {1.0}
    none = q.fit(docs, spark.createDataFrame([], labels))
    assert none.rate == 0.5 and q.score_documents(docs.limit(0), none).collect() == []
    teaching = [r["doc_id"] for r in docs.where(fold(docs["doc_id"]) != 0).select("doc_id").where("doc_id < 100").collect()]
    bounded = q.fit(docs, spark.createDataFrame([(i, i % 2) for i in teaching], labels), max_rows=20)
    assert bounded.attention is not None
