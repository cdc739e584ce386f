"""Quality of documents by attention-based multiple-instance learning.

A document is a bag of passages of 64 words. Every passage is described by how its characters follow each other and its
words repeat, and encoded by a learned layer; gated attention, learned from the labels of whole documents, weighs the
passages, and the weighted encoding is scored.

The model learns in rounds: each shard of the labelled passages takes some steps of its own from the common weights,
in its task; the driver averages the shards' weights. Texts are described once, in NumPy over the bytes of many texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlens.llm.common import query, table, text_batches
from crawlens.llm.toxicity import HELD_OUT, bounded, fold
from crawlens.scale import cut

#: Words a passage; passages a stretch, within which repetitions are sought.
WORDS, STRETCH = 64, 256
#: Bound on the labelled rows that are learned from.
MAX_ROWS = 20_000
SHARDS, ROUNDS, EPOCHS, BAGS, RATE, DECAY = 8, 6, 4, 64, 0.01, 1e-4
UNITS, GATES = 24, 12
_KINDS = 8


def _kinds() -> np.ndarray:
    """The kind of each byte: other signs 6, space 3, line end 4, lower case 0, capital 1, digit 2, marks of sentences 5, beyond ASCII 7."""
    kinds = np.full(256, 6, np.uint8)
    kinds[[9, 32]], kinds[[10, 11, 12, 13]], kinds[128:] = 3, 4, 7
    for kind, signs in ((0, "abcdefghijklmnopqrstuvwxyz"), (1, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (2, "0123456789"), (5, ".,;:'\"()-")):
        kinds[list(signs.encode())] = kind
    return kinds


KIND = _kinds()
FEATURES = _KINDS * _KINDS + 6


def stretches(text: bytes) -> list[bytes]:
    """The text cut before every 16 384th word; most texts are one stretch."""
    size = WORDS * STRETCH
    if len(text) < 2 * size:
        return [text]
    space = np.isin(KIND[np.frombuffer(text, np.uint8)], (3, 4))
    first = np.flatnonzero(~space & np.append(True, space[:-1]))
    borders = [0, *first[size::size].tolist(), len(text)]
    return [text[a:b] for a, b in zip(borders[:-1], borders[1:])]


def describe(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(features of all passages, passages of each part). A part without words is one passage of zeros.

    Features: the rates of the pairs of kinds of neighbouring bytes (roots, so that rare pairs show), the logarithm of the
    number of words, mean and deviation of their lengths, the share of different words, of words that begin three words
    seen before in the part, and of words that are the same as the one before.
    """
    data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    ends = np.cumsum([len(p) + 1 for p in parts])
    kinds = KIND[data]
    space = (kinds == 3) | (kinds == 4)
    first = ~space & np.append(True, space[:-1])
    starts = np.flatnonzero(first)
    part_of = np.searchsorted(ends, starts, side="right")
    words = np.bincount(part_of, minlength=len(parts))
    before = np.cumsum(words) - words
    passages = np.maximum(1, -(-words // WORDS))
    base = np.cumsum(passages) - passages
    total = int(passages.sum())
    out = np.zeros((total, FEATURES), np.float32)
    if not len(starts):
        return out, passages
    of_word = base[part_of] + (np.arange(len(starts)) - before[part_of]) // WORDS
    # A byte belongs to the passage of the word begun last; bytes in front of a part's first word do not count.
    latest = np.cumsum(first) - 1
    inside = (latest >= 0) & (part_of[latest] == np.repeat(np.arange(len(parts)), np.diff(ends, prepend=0)))
    inside[ends - 1] = False
    at = np.flatnonzero(inside)
    of_byte = of_word[latest[at]]
    pairs = of_byte * (_KINDS * _KINDS) + kinds[at].astype(np.int64) * _KINDS + kinds[at + 1]
    counts = np.bincount(pairs, minlength=total * _KINDS * _KINDS).reshape(total, -1)
    out[:, : _KINDS * _KINDS] = np.sqrt(counts / np.maximum(1, counts.sum(axis=1, keepdims=True)))
    lengths = np.add.reduceat(~space, starts).astype(np.float64)
    n = np.bincount(of_word, minlength=total)
    some = np.maximum(1, n)
    mean = np.bincount(of_word, lengths, total) / some
    spread = np.sqrt(np.maximum(0, np.bincount(of_word, lengths**2, total) / some - mean**2))
    # Words by a polynomial of their bytes, modulo 2 ** 64.
    place = np.arange(len(data)) - starts[np.maximum(latest, 0)]
    powers = np.cumprod(np.full(int(lengths.max()) + 1, 0x9E3779B97F4A7C15, np.uint64))
    terms = np.where(space, np.uint64(0), (data.astype(np.uint64) + np.uint64(1)) * powers[np.minimum(np.maximum(place, 0), len(powers) - 1)])
    names = np.add.reduceat(terms, starts)
    names ^= names >> np.uint64(29)
    _, seen = np.unique(names * np.uint64(0xD6E8FEB86659FD93) + of_word.astype(np.uint64) * np.uint64(0xA0761D6478BD642F), return_index=True)
    different = np.bincount(of_word[seen], minlength=total) / some
    repeated, same = np.zeros(total), np.zeros(total)
    if len(names) > 1:
        next_same = (names[1:] == names[:-1]) & (part_of[1:] == part_of[:-1])
        same = np.bincount(of_word[1:][next_same], minlength=total) / some
    if len(names) > 2:
        threes = (names[:-2] * np.uint64(3) + names[1:-1]) * np.uint64(0xE7037ED1A0B428DB) ^ names[2:]
        threes = threes * np.uint64(0x8EBC6AF09C88C6E3) + part_of[2:].astype(np.uint64) * np.uint64(0x589965CC75374CC3)
        whole = part_of[:-2] == part_of[2:]
        owner, threes = of_word[:-2][whole], threes[whole]
        _, seen = np.unique(threes, return_index=True)
        repeated = (np.bincount(owner, minlength=total) - np.bincount(owner[seen], minlength=total)) / some
    out[:, _KINDS * _KINDS :] = np.stack([np.log1p(n), np.minimum(mean, 100) / 10, np.minimum(spread, 100) / 10, different, repeated, same], axis=1)
    return out, passages


def bags(texts: list[str], most: int = 2_000_000) -> tuple[np.ndarray, np.ndarray]:
    """The passages of all texts and how many each text has; described some megabytes at a time."""
    parts = [(i, part) for i, text in enumerate(texts) for part in stretches(text.encode())]
    rows, counts, start, size = [np.zeros((0, FEATURES), np.float32)], np.zeros(len(texts), np.int64), 0, 0
    for end, (_, part) in enumerate(parts, 1):
        size += len(part)
        if size >= most or end == len(parts):
            found, n = describe([p for _, p in parts[start:end]])
            rows.append(found)
            np.add.at(counts, [i for i, _ in parts[start:end]], n)
            start, size = end, 0
    return np.concatenate(rows), counts


class AttentionModel:
    """Weights of the encoder, the gated attention and the score, with the mean and scale of the features."""

    SHAPES = {"encode": (FEATURES, UNITS), "shift": (UNITS,), "value": (UNITS, GATES), "gate": (UNITS, GATES), "attend": (GATES,), "judge": (UNITS,), "bias": (1,)}

    def __init__(self, weights: np.ndarray, mean: np.ndarray, scale: np.ndarray):
        self.weights, self.mean, self.scale = weights, mean, scale

    @classmethod
    def fresh(cls, rate: float, mean: np.ndarray, scale: np.ndarray, seed: int = 7) -> AttentionModel:
        rng = np.random.default_rng(seed)
        drawn = [rng.normal(0, 1 / np.sqrt(s[0]), s).ravel() if len(s) > 1 or k == "attend" else np.zeros(s) for k, s in cls.SHAPES.items()]
        drawn[-1][:] = np.log(rate / (1 - rate))
        drawn[-2][:] = rng.normal(0, 0.1, UNITS)
        return cls(np.concatenate(drawn), mean, scale)

    def parts(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, shape in self.SHAPES.items():
            size = int(np.prod(shape))
            out[name] = flat[at : at + size].reshape(shape)
            at += size
        return out

    def forward(self, passages: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        """All that a step needs; ``logit`` a bag, ``weight`` (attention) a passage. Every bag has a passage."""
        w = self.parts(self.weights)
        x = ((passages - self.mean) / self.scale).clip(-8, 8)
        code = np.tanh(x @ w["encode"] + w["shift"])
        value, gate = np.tanh(code @ w["value"]), 1 / (1 + np.exp(-(code @ w["gate"])))
        energy = (value * gate) @ w["attend"]
        first = np.cumsum(counts) - counts
        energy = np.exp(energy - np.repeat(np.maximum.reduceat(energy, first), counts))
        weight = energy / np.repeat(np.add.reduceat(energy, first), counts)
        whole = np.add.reduceat(code * weight[:, None], first, axis=0)
        return {"x": x, "code": code, "value": value, "gate": gate, "weight": weight, "whole": whole, "logit": whole @ w["judge"] + w["bias"], "first": first}

    def score(self, passages: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Of each bag; rounded, as the last digits of sums depend on what else is in a batch."""
        return np.round(1 / (1 + np.exp(-self.forward(passages, counts)["logit"].clip(-30, 30))), 12)

    def gradient(self, passages: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """Of the mean logistic loss of the bags."""
        w, f = self.parts(self.weights), self.forward(passages, counts)
        error = (1 / (1 + np.exp(-f["logit"].clip(-30, 30))) - labels) / len(labels)
        each = np.repeat(error[:, None] * w["judge"], counts, axis=0)
        pull = (each * f["code"]).sum(axis=1)
        mean = np.repeat(np.add.reduceat(f["weight"] * pull, f["first"]), counts)
        energy = f["weight"] * (pull - mean)
        both = energy[:, None] * w["attend"]
        value = both * f["gate"] * (1 - f["value"] ** 2)
        gate = both * f["value"] * f["gate"] * (1 - f["gate"])
        code = (f["weight"][:, None] * each + value @ w["value"].T + gate @ w["gate"].T) * (1 - f["code"] ** 2)
        parts = [f["x"].T @ code, code.sum(axis=0), f["code"].T @ value, f["code"].T @ gate, (f["value"] * f["gate"]).T @ energy, f["whole"].T @ error, [error.sum()]]
        return np.concatenate([np.ravel(p) for p in parts])

    def learn(self, passages: np.ndarray, counts: np.ndarray, labels: np.ndarray, epochs: int, rate: float, seed: int) -> None:
        """Steps over mixed batches of bags, with Adam's running moments."""
        rng, starts = np.random.default_rng(seed), np.cumsum(counts) - counts
        mean, square, step = np.zeros_like(self.weights), np.zeros_like(self.weights), 0
        for _ in range(epochs):
            order = rng.permutation(len(counts))
            for low in range(0, len(order), BAGS):
                chosen = order[low : low + BAGS]
                n = counts[chosen]
                rows = np.repeat(starts[chosen] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                slope = self.gradient(passages[rows], n, labels[chosen]) + DECAY * self.weights
                step += 1
                mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
                self.weights = self.weights - rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)


def _described(rows: DataFrame) -> DataFrame:
    """shard, place, label and the passages of rows (doc_id, text, label)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_batches(batches, "text", 1_000_000):
            rows, counts = bags(texts)
            borders = np.append(0, np.cumsum(counts) * FEATURES)
            passages = pa.ListArray.from_arrays(pa.array(borders, pa.int32()), pa.array(rows.ravel(), pa.float32()))
            yield pa.RecordBatch.from_arrays([part.column(c) for c in ("shard", "place", "label")] + [passages], ["shard", "place", "label", "passages"])

    placed = rows.select(F.pmod(F.xxhash64("doc_id"), F.lit(SHARDS)).cast("int").alias("shard"), F.xxhash64("doc_id", "text").alias("place"), "label", "text")
    return placed.mapInArrow(run, "shard int, place long, label int, passages array<float>")


def _each_shard(described: DataFrame, schema: str, work) -> list:
    """What ``work(shard, passages, counts, labels)`` gives for each shard that a task holds (a small row), by shard."""
    plain = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
    names, types = zip(*[(name, plain[kind]) for name, kind in map(str.split, schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        whole = pa.Table.from_batches(held).sort_by([("shard", "ascending"), ("place", "ascending")])
        shards = np.array(whole.column("shard").to_pylist())
        for shard in np.unique(shards):
            low, high = np.searchsorted(shards, (shard, shard + 1))
            own = whole.slice(low, high - low)
            lists = pa.concat_arrays(own.column("passages").chunks)
            passages = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)
            counts = lists.value_lengths().to_numpy() // FEATURES
            row = work(int(shard), passages, counts.astype(np.int64), np.array(own.column("label").to_pylist(), np.float64))
            yield pa.RecordBatch.from_pylist([dict(zip(names, row))], pa.schema(list(zip(names, types))))

    return sorted(described.mapInArrow(run, schema).collect())


class QualityModel:
    """A fitted attention model, or (without two kinds of labels) the rate of the label 1."""

    def __init__(self, attention: AttentionModel | None, rate: float):
        self.attention, self.rate = attention, rate

    def score(self, rows: DataFrame) -> DataFrame:
        """``rows`` (any columns and text) without text, with ``score`` between 0 and 1. Only the texts go to Python."""
        model = self.attention
        if model is None:
            return rows.drop("text").withColumn("score", F.lit(self.rate))

        @F.arrow_udf("double")
        def scored(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for column in columns:
                made = [model.score(*bags([t.as_py() or "" for t in column[at : at + 256]])) for at in range(0, len(column), 256)]
                yield pa.array(np.concatenate(made) if made else [], pa.float64())

        return rows.withColumn("score", scored.asNondeterministic()("text")).drop("text")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS) -> QualityModel:
    """A model from ``labels`` (doc_id and ``label_col``), but for rows of the fold HELD_OUT.

    It learns from at most ``max_rows`` labelled rows, chosen by a hash of the id. Rows with a null label or id teach
    nothing; of repeated labels of an id the largest counts, documents of one id each are a bag of their own. With
    labels of one kind only the score is the rate of the label 1; without any, one half. Shards and their order follow
    from the ids, so the weights do not depend on partitions.
    """
    known = labels.select("doc_id", F.col(label_col).cast("int").alias("label")).dropna().groupBy("doc_id").agg(F.max("label").alias("label"))
    folded = cut(known.where(fold(F.col("doc_id")) != HELD_OUT), "folds")
    chosen = bounded(folded, max_rows, folded.count())
    # At most max_rows ids: small whatever the input, so they go to the documents.
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    taught = cut(texts.join(F.broadcast(chosen), "doc_id"), "labelled")
    described = cut(_described(taught).repartition(SHARDS, "shard"), "passages")
    sums = _each_shard(
        described, "shard int, bags long, ones double, n long, sums array<double>, squares array<double>",
        lambda shard, passages, counts, labels: (shard, len(counts), float(labels.sum()), len(passages), passages.sum(axis=0, dtype=np.float64).tolist(), (passages.astype(np.float64) ** 2).sum(axis=0).tolist()),
    )
    seen = sum(r["bags"] for r in sums)
    rate = sum(r["ones"] for r in sums) / seen if seen else 0.5
    if not seen or not 0 < rate < 1:
        return QualityModel(None, rate)
    n = sum(r["n"] for r in sums)
    mean = np.sum([r["sums"] for r in sums], axis=0) / n
    scale = np.sqrt(np.maximum(np.sum([r["squares"] for r in sums], axis=0) / n - mean**2, 0)) + 1e-3
    model = AttentionModel.fresh(rate, mean, scale)
    for turn in range(ROUNDS):
        weights, pace = model.weights, RATE * (1 - turn / ROUNDS)

        def work(shard, passages, counts, labels, weights=weights, pace=pace, turn=turn):
            own = AttentionModel(weights, mean, scale)
            own.learn(passages, counts, labels, EPOCHS, pace, 1000 * turn + shard)
            return shard, len(counts), own.weights.tolist()

        learned = _each_shard(described, "shard int, bags long, weights array<double>", work)
        model = AttentionModel(np.average([r["weights"] for r in learned], axis=0, weights=[r["bags"] for r in learned]), mean, scale)
    return QualityModel(model, rate)


def score_documents(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 from a score of 0.3).

    Null texts are scored like empty ones, which are a bag of one empty passage; null ids and repeated rows are rows like
    any other; an empty table gives an empty result. Other columns are ignored.
    """
    scored = model.score(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    return scored.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op12_quality")
def op12_quality(spark, sf_dir):
    """The quality of every document, by a model learned from the labels outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
