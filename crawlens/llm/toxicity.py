"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Labelled documents are divided by a hash of their id: some teach the lexicon (words and parts of words that toxic
texts use), others the trees, others the calibration, so that none is judged by what it taught itself. A document's
features are densities of lexicon hits, how close they stand to the second person, capitals, punctuation and
obfuscation rates; every whole text is read once, in one Arrow stage.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import compress

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlens.llm.common import kept, query, table, text_batches
from crawlens.scale import cut

FOLDS, HELD_OUT = 5, 0
LEXICON_FOLDS, TREE_FOLDS, CALIBRATION_FOLDS = (1, 2), (3,), (4,)
#: Bound on the labelled rows that each of the three steps learns from, and on the lexicon.
MAX_ROWS, MAX_TERMS = 20_000, 4_000
GRAM = 5
TIES = 1e-6
# Words that address the reader, in the languages of the corpus.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine deinen deiner ihr euch euer eure sie tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros tus os".split()
)
# Characters that stand for letters in disguised words.
LEET = str.maketrans("013457@$!|", "oieastasil")
_EDGE = re.compile(r"^\W+|[\W_]+$")
_INNER = re.compile(r"[\W_]")
_REPEATS = re.compile(r"(.)\1{2,}")
_ENDS = ".,;:!?\"'()[]{}<>*#&%-_"
NEAR = 5
FEATURES = (
    "log_words", "strong_density", "strong_share", "weak_density", "weight_density", "top_weight", "part_density", "part_weight", "top_part", "hidden_density",
    "near_person", "person_density", "capital_rate", "shouting_rate", "mark_rate", "bang_rate", "edge_mark_rate", "obfuscation_rate", "stretch_rate", "digit_rate",
)


def plain(token: str) -> str:
    """The word in a token: without marks around it, in lower case."""
    return _EDGE.sub("", token).lower()


def uncovered(token: str) -> str:
    """The word behind a disguised token: letters for look-alike signs, no marks inside, no stretched letters."""
    return _REPEATS.sub(r"\1", _INNER.sub("", token.lower().strip(_ENDS).translate(LEET)))


def grams(word: str, size: int = GRAM) -> set[str]:
    """Parts of a word with its two ends marked, of ``size`` characters; a shorter word is one part."""
    marked = f"^{word}$"
    return {marked[i : i + size] for i in range(max(1, len(marked) - size + 1))}


class Features:
    """Feature rows of texts under a lexicon: (kind, term) -> weight, kind "word" or "part"."""

    def __init__(self, lexicon: dict[tuple[str, str], float], most: int = 200_000):
        self.words = {t: w for (k, t), w in lexicon.items() if k == "word"}
        self.parts = {t: w for (k, t), w in lexicon.items() if k == "part"}
        self.found = ahocorasick.Automaton()
        for t, w in self.parts.items():
            # A part shorter than GRAM is a whole word with its ends.
            self.found.add_word(t if len(t) == GRAM else f"\n{t}\n", w)
        self.found.make_automaton()
        ranked = sorted(self.words.values(), reverse=True)
        self.strong = ranked[min(len(ranked) - 1, 100)] if ranked else 0.0
        self.most = most
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.rows = np.zeros((1024, 16), np.float32)

    def _row(self, token: str) -> tuple[float, ...]:
        word = plain(token)
        weight = self.words.get(word, 0.0)
        part_weights = [self.parts[g] for g in grams(word) if g in self.parts] if word else []
        hidden = 0.0
        bare = uncovered(token)
        if bare != word and weight == 0.0:
            hidden = self.words.get(bare, 0.0)
        marks = sum(not c.isalnum() for c in token)
        letters = sum(c.isalpha() for c in token)
        digits = sum(c.isdigit() for c in token)
        upper = sum(c.isupper() for c in token)
        inner = len(_INNER.sub("", word)) != len(word) or (0 < digits < len(word) and letters > 0)
        edge = marks > 0 and len(word) > 0 and not inner
        return (
            float(weight >= self.strong > 0), float(weight > 0), weight, float(bool(part_weights)), max(part_weights, default=0.0), hidden,
            float(word in SECOND_PERSON), letters, upper, float(upper > 2 and upper == letters), marks, token.count("!") + token.count("?"),
            float(edge), float(inner), float(bool(_REPEATS.search(token))), digits,
        )

    def _part_weights(self, words: list[str]) -> dict[int, float]:
        """The largest weight among the parts of a word, by its place, for words that have any. They hold no line break."""
        best: dict[int, float] = {}
        if not self.parts:
            return best
        joined = "\n\n".join([f"^{w}$" for w in words])
        hits = list(self.found.iter(f"\n{joined}\n"))
        if hits:
            # A word's lengths with its marks and the line breaks around it, added up, are where it ends.
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 4)
            for at, weight in zip(np.searchsorted(ends, [e for e, _ in hits], side="right").tolist(), (w for _, w in hits)):
                best[at] = max(best.get(at, 0.0), weight)
        return best

    def _add(self, new: list[str]) -> None:
        """Rows of new tokens; those that are a bare word, or one between marks, are described together."""
        cores = [t.strip(_ENDS) for t in new]
        simple = [c.isalpha() and (c == t or c.isascii() or c.lower().isalpha()) and "_" not in t for t, c in zip(new, cores)]
        base = len(self.known)
        own = list(compress(new, simple))
        if own:
            bare = list(compress(cores, simple))
            words = [c.lower() for c in bare]
            weight = np.array([self.words.get(w, 0.0) for w in words])
            rows = np.zeros((len(own), self.rows.shape[1]))
            rows[:, 0], rows[:, 1], rows[:, 2] = (weight >= self.strong) & (self.strong > 0), weight > 0, weight
            for at, part in self._part_weights(words).items():
                rows[at, 3], rows[at, 4] = 1.0, part
            rows[:, 6] = [w in SECOND_PERSON for w in words]
            rows[:, 7] = letters = np.fromiter(map(len, bare), np.int64, len(bare))
            rows[:, 8] = upper = np.array([0 if c.islower() else sum(x.isupper() for x in c) for c in bare])
            rows[:, 9] = (upper > 2) & (upper == letters)
            rows[:, 10] = marks = np.fromiter(map(len, own), np.int64, len(own)) - letters
            rows[:, 12] = marks > 0
            for at in np.flatnonzero(marks).tolist():
                rows[at, 11] = own[at].count("!") + own[at].count("?")
            for at, token in enumerate(own):
                if _REPEATS.search(token):
                    rows[at, 14] = 1.0
                    rows[at, 5] = self.words.get(uncovered(token), 0.0) if weight[at] == 0.0 else 0.0
            self.rows[base : base + len(own)] = rows
            self.known.update(zip(own, range(base, base + len(own))))
        for token in compress(new, (not x for x in simple)):
            self.rows[len(self.known)] = self._row(token)
            self.known[token] = len(self.known)

    def _ids(self, tokens: list[str]) -> np.ndarray:
        known = self.known
        new = set(tokens).difference(known)
        if len(known) + len(new) > self.most and known:
            self._clear()
            known, new = self.known, set(tokens)
        if len(known) + len(new) > len(self.rows):
            grown = np.zeros((2 * (len(known) + len(new)), self.rows.shape[1]), np.float32)
            grown[: len(known)] = self.rows[: len(known)]
            self.rows = grown
        self._add(list(new))
        return np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))

    def of(self, text: str) -> list[float]:
        tokens = text.split()
        if not tokens:
            return [0.0] * len(FEATURES)
        sums, tops, near, n = np.zeros(16), np.zeros(16, np.float32), 0.0, len(tokens)
        for start in range(0, n, 100_000):  # a very long text goes in parts; only words near a border may miss a pronoun
            rows = self.rows_of(tokens[start : start + 100_000])
            sums += rows.sum(axis=0, dtype=np.float64)
            tops = np.maximum(tops, rows.max(axis=0))
            hits, persons = np.flatnonzero(rows[:, 1] + rows[:, 3]), np.flatnonzero(rows[:, 6])
            if len(hits) and len(persons):
                at = np.searchsorted(persons, hits)
                left = np.abs(hits - persons[np.maximum(at - 1, 0)])
                right = np.abs(hits - persons[np.minimum(at, len(persons) - 1)])
                near += float((np.minimum(left, right) <= NEAR).sum())
        letters, chars = max(1.0, sums[7]), max(1, len(text))
        return [
            float(np.log1p(n)), 100 * sums[0] / n, sums[0] / max(1.0, sums[1]), 100 * sums[1] / n, 100 * sums[2] / n, float(tops[2]), 100 * sums[3] / n, 100 * sums[4] / n, float(tops[4]),
            100 * sums[5] / n, near / n * 100, 100 * sums[6] / n, sums[8] / letters, 100 * sums[9] / n, sums[10] / chars, 100 * sums[11] / n, sums[12] / n, sums[13] / n, 100 * sums[14] / n,
            sums[15] / chars,
        ]

    def rows_of(self, tokens: list[str]) -> np.ndarray:
        ids = self._ids(tokens)
        return self.rows[ids]


def shared_features(lexicon: dict[tuple[str, str], float]) -> Features:
    """The features of a lexicon, with the tokens that a worker's earlier tasks have seen."""
    return kept(("features", *sorted(lexicon.items())), lambda: Features(lexicon))


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def bounded(rows: DataFrame, most: int, total: int) -> DataFrame:
    """At most ``most`` of ``total`` rows, the ones whose ids hash smallest: the same ones whatever the partitions.

    Rows whose hash is too large to be among them go first, so the sort sees little more than ``most`` rows.
    """
    place = F.xxhash64("doc_id")
    if total > 2 * most:
        share = (most + 10 * most**0.5) / total
        rows = rows.where(place < int(share * 2.0**64 - 2.0**63))
    return rows.orderBy(place, "doc_id").limit(most)


def learn_lexicon(labelled: DataFrame, max_terms: int = MAX_TERMS, least: int = 3) -> dict[tuple[str, str], float]:
    """Weights of the terms most telling for toxic texts, from rows of text and toxic (0 or 1).

    Words are counted once for each document and, by the words they occur in, parts of words. A weight is the log odds
    of the term's rate among toxic against other texts. Only the ``max_terms`` terms come to the driver.
    """
    schema = "doc boolean, word string, toxic int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_batches(batches, "text", 1_000_000):
            docs, words, marks = [], [], []
            for text, toxic in zip(texts, part.column("toxic").to_pylist()):
                own = {plain(t) for t in text.split()} - {""}
                docs += [True, *[False] * len(own)]
                words += ["", *sorted(own)]
                marks += [toxic] * (len(own) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(docs), pa.array(words, pa.string()), pa.array(marks, pa.int32())], ["doc", "word", "toxic"])

    counts = cut(labelled.select("text", "toxic").mapInArrow(run, schema).groupBy("doc", "word").agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("n")), "words")
    whole = counts.where("doc").first()
    if whole is None or not 0 < whole["bad"] < whole["n"]:
        return {}
    bad, good = whole["bad"], whole["n"] - whole["bad"]
    marked = F.concat(F.lit("^"), F.col("word"), F.lit("$"))
    parts = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(marked) - GRAM + 1)), lambda i: F.substr(marked, i, F.lit(GRAM))))
    words = counts.where("not doc")
    terms = words.select(F.lit("word").alias("kind"), F.col("word").alias("term"), "bad", "n").unionByName(
        words.where(F.length("word") <= 64).select(F.lit("part").alias("kind"), F.explode(parts).alias("term"), "bad", "n")
        .groupBy("kind", "term").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    )
    weight = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("n") - F.col("bad") + 0.5) / (good + 1))
    best = terms.where(F.col("bad") >= least).withColumn("weight", weight).where("weight > 1.5").orderBy(F.desc(F.col("weight") * F.sqrt("bad")), "kind", "term").limit(max_terms)
    return {(r["kind"], r["term"]): r["weight"] for r in best.collect()}


class ToxicityModel:
    """A fitted lexicon, tree ensemble and calibration; scores any documents."""

    def __init__(self, lexicon: dict[tuple[str, str], float], trees: GBTClassificationModel | None, calibration: IsotonicRegressionModel | None, rate: float):
        self.lexicon, self.trees, self.calibration, self.rate = lexicon, trees, calibration, rate

    def features(self, rows: DataFrame) -> DataFrame:
        """``rows`` without text, with the array ``features``. Only the texts go to Python, the rest stays where it is."""
        lexicon = self.lexicon

        @F.arrow_udf("array<double>")
        def dense(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
            features = shared_features(lexicon)
            for column in columns:
                made = [features.of(t.as_py() or "") for t in column]
                yield pa.array(made, pa.list_(pa.float64()))

        return rows.withColumn("features", dense.asNondeterministic()("text")).drop("text")

    def raw(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``raw``: the trees' probability, before calibration."""
        vectors = self.features(rows).withColumn("features", array_to_vector("features"))
        if self.trees is None:
            return vectors.drop("features").withColumn("raw", F.lit(self.rate))
        return self.trees.transform(vectors).withColumn("raw", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")

    def score(self, rows: DataFrame) -> DataFrame:
        """``rows`` (any columns and text) without text, with ``score`` between 0 and 1."""
        scored = self.raw(rows)
        if self.calibration is not None:
            # The trees' own probability only orders what the calibration scores alike: it adds less than TIES, less than the
            # steps of a calibration by max_rows rows, and never takes away, so a score is cut at one half as calibrated.
            scored = self.calibration.transform(scored).withColumn("raw", F.col("prediction") + TIES * F.col("raw") * (1 - F.col("prediction"))).drop("prediction")
        return scored.withColumnRenamed("raw", "score").withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score")))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS) -> ToxicityModel:
    """A model from ``labels`` (doc_id, toxic), but for rows of the fold HELD_OUT.

    Each of the three steps learns from at most ``max_rows`` rows of its folds, chosen by a hash of the id. Rows with
    a null label or id teach nothing; of repeated labels of an id the largest counts. With labels of one kind only (or
    none), the score is the rate of toxic labels (or 0).
    """
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    folded = known.withColumn("fold", fold(F.col("doc_id"))).where(F.col("fold") != HELD_OUT)
    folded = cut(folded, "folds")
    counts = {r["fold"]: r["count"] for r in folded.groupBy("fold").count().collect()}
    chosen = None
    for folds in (LEXICON_FOLDS, TREE_FOLDS, CALIBRATION_FOLDS):
        rows = bounded(folded.where(F.col("fold").isin(*folds)), max_rows, sum(counts.get(f, 0) for f in folds))
        chosen = rows if chosen is None else chosen.unionByName(rows)
    # Three times max_rows ids at most: small whatever the input, so they go to the documents.
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    taught = cut(texts.join(F.broadcast(chosen), "doc_id"), "labelled")
    seen = taught.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("bad")).first()
    rate = seen["bad"] / seen["n"] if seen["n"] else 0.0
    lexicon = learn_lexicon(taught.where(F.col("fold").isin(*LEXICON_FOLDS)))
    model = ToxicityModel(lexicon, None, None, rate)
    tree_rows = taught.where(F.col("fold").isin(*TREE_FOLDS))
    mix = [r[0] for r in tree_rows.select("toxic").distinct().collect()]
    if len(mix) < 2:
        return model
    rows = cut(model.features(tree_rows.select("doc_id", "toxic", "text")), "features").orderBy("doc_id").coalesce(4)
    rows = rows.withColumn("features", array_to_vector("features")).cache()
    trees = GBTClassifier(labelCol="toxic", featuresCol="features", maxIter=25, maxDepth=4, stepSize=0.2, minInstancesPerNode=5, seed=7).fit(rows)
    rows.unpersist()
    model = ToxicityModel(lexicon, trees, None, rate)
    raw = cut(model.raw(taught.where(F.col("fold").isin(*CALIBRATION_FOLDS)).select("toxic", "text")), "raw")
    if raw.isEmpty():
        return model
    return ToxicityModel(lexicon, trees, IsotonicRegression(labelCol="toxic", featuresCol="raw").fit(raw), rate)


def score_documents(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 from a score of one half).

    Null texts are scored like empty ones; null ids and repeated rows are rows like any other; an empty table gives an
    empty result. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    scored = model.score(rows)
    return scored.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_harmless(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores below one half, with all their columns; cases as in ``score_documents``."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_whole"), F.col(text_col).alias("text"))
    return model.score(whole).where("score < 0.5").select("_whole.*")


@query("op1_toxicity")
def op1_toxicity(spark, sf_dir):
    """The toxicity of every document, by a model learned from the labels outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
