"""Mixture-controlled packing: deficit round-robin over one queue of tokens per source.

Every window (training sequence) serves each queue its share of tokens; what rounding withholds from a queue is its
deficit and is served in a later window. For queues that don't run dry, the tokens a queue has been served before any
point of the stream have a closed form, floor(u * C) - floor(u * c), with c and C the summed shares of the queues up
to it. So deficits carry across windows and partitions without one task seeing the whole stream: a document needs to
know only its queue and the number of tokens before it there. When explicit targets make a queue run dry, the rest
goes on as a new phase among the other queues.
"""

from __future__ import annotations

import os
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from crawlens.llm.common import kept, query, running_total, table, text_batches
from crawlens.scale import cut

WINDOW, END_ID = 4096, 2
#: A source without a target and with fewer tokens a window shares a queue with others like it; so there are at most WINDOW / LEAST queues.
LEAST = 2
# White space as the tokenizer knows it; Python's own split() knows four separators more.
_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_MORE_SPACE = re.compile("[\x1c-\x1f]")
_LATIN = re.compile("[\x00-\xff]*")
_ALPHABETS = re.compile("[\x00-\u024f]*")
# Fixed value: the pattern by which the tokenizer splits words.
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_ASCII_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")


class _Kept(dict):
    """Ids by word or piece, found where they are missing; up to ``most`` of at most 64 characters are kept."""

    def __init__(self, find: Callable[[str], bytes], most: int):
        super().__init__()
        self.find, self.most = find, most

    def __missing__(self, key: str) -> bytes:
        ids = self.find(key)
        if len(key) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[key] = ids
        return ids


class WordEncoder:
    """Token ids of texts, two bytes an id, by the tokenizer of words and signs at ``path``.

    The tokenizer never joins across white space, and within a word it splits off signs and digits first, so words and
    their pieces are encoded once and kept, up to ``most`` of each. A piece goes to the tokenizer's model as the
    tokenizer hands it there, by its bytes; words beyond the Latin alphabets go through the whole tokenizer.
    """

    def __init__(self, path: str, most: int = 150_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        size = self.tokenizer.get_vocab_size()
        if size > 1 << 16:
            raise ValueError("ids beyond 65535 don't fit two bytes")
        self.packed = [i.to_bytes(2, "little") for i in range(size)]
        self.model, self.level = self.tokenizer.model, ByteLevel(add_prefix_space=False, use_regex=False)
        self.words, self.pieces = _Kept(self._word, most), _Kept(self._piece, most)

    @staticmethod
    def _split(text: str) -> list[str]:
        if _MORE_SPACE.search(text):
            return [w for w in _SPACE.split(text) if w]
        if text.isascii() or _LATIN.fullmatch(text):
            text = text.lower()  # as the tokenizer does; elsewhere its rules may differ
        return text.split()

    def _piece(self, piece: str) -> bytes:
        if not (piece.isascii() and piece.isprintable()):  # printable ASCII stands for itself
            piece = self.level.pre_tokenize_str(piece)[0][0]
        return b"".join([self.packed[t.id] for t in self.model.tokenize(piece)])

    def _word(self, word: str) -> bytes:
        if word.isascii():
            word = word.lower()
            return self._piece(word) if word.isalpha() else b"".join([self.pieces[p] for p in _ASCII_PIECE.findall(word)])
        if not _ALPHABETS.fullmatch(word):
            # The tables of letters that Python, the pattern and the tokenizer know agree on the Latin alphabets only.
            return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u2").tobytes()
        if word != word.lower() or not _LATIN.fullmatch(word):
            word = self.tokenizer.normalizer.normalize_str(word)
        return b"".join([self.pieces[p] for p in _PIECE.findall(word)])

    def encode(self, texts: list[str]) -> list[bytes]:
        ids = self.words.__getitem__
        return [b"".join(map(ids, self._split(t))) for t in texts]


def tokenized(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, n, ids (two bytes an id, little-endian) of every row; ids end with END_ID."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), F.col(text_col).alias("text"))
    schema = rows.select("doc_id", "source", F.lit(0).cast("long").alias("n"), F.lit(b"").alias("ids")).schema
    end = np.array([END_ID], "<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(("encoder", tokenizer), lambda: WordEncoder(tokenizer))
        for part, texts in text_batches(batches, "text"):
            ids = [x + end for x in encoder.encode(texts)]
            counts = pa.array([len(x) // 2 for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("source"), counts, pa.array(ids, pa.binary())], ["doc_id", "source", "n", "ids"])

    return rows.mapInArrow(run, schema)


class Mixture:
    """Where each queue's tokens go: phases of the stream, each serving every queue a fixed number of tokens.

    A queue of weight zero waits until the others have run dry.
    """

    def __init__(self, totals: list[int], weights: list[int], window: int = WINDOW):
        self.window = window
        left, begun, base = list(totals), [0] * len(totals), 0
        self.phases: list[list[tuple[int, int, int, int, int]]] = [[] for _ in totals]
        while any(left):
            active = [q for q, n in enumerate(left) if n and weights[q]] or [q for q, n in enumerate(left) if n]
            share = {q: weights[q] or 1 for q in active}
            first = min(active, key=lambda q: left[q] / share[q])
            served = {q: min(left[q], share[q] * left[first] // share[first]) for q in active}
            size, before = sum(served.values()), 0
            for q in active:
                if served[q]:
                    # Queue positions from, phase's place in the stream, its size, summed shares before and with q.
                    self.phases[q].append((begun[q], base, size, before, before + served[q]))
                before += served[q]
                begun[q] += served[q]
                left[q] -= served[q]
            base += size

    def pieces(self, queue: int, start: int, end: int) -> Iterator[tuple[int, int, int, int]]:
        """(queue position, length, window, offset there) of the tokens [start, end) of a queue, in order."""
        phases = self.phases[queue]
        at = start
        k = bisect_right(phases, at, key=lambda p: p[0]) - 1
        while at < end:
            begun, base, size, low, high = phases[k]
            stop = min(end, begun + high - low)
            w = (base + (at - begun) * size // (high - low)) // self.window
            while at < stop:
                x = at - begun
                while True:
                    u, v = max(0, w * self.window - base), min(size, (w + 1) * self.window - base)
                    left_u, left_v = u * low // size, v * low // size
                    served, until = u * high // size - left_u, v * high // size - left_v
                    if x < served:
                        w -= 1
                    elif x >= until:
                        w += 1
                    else:
                        break
                length = min(stop - begun, until) - x
                yield at, length, w, base + u - w * self.window + left_v - left_u + x - served
                at += length
                w += 1
            k += 1


def pack(
    docs: DataFrame,
    tokenizer: str,
    targets: Mapping[str, float] | None = None,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Pieces of documents laid into windows: doc_id, source, start, length, ids (four bytes each, little-endian),
    doc_tokens, sequence_id, offset.

    ``targets`` gives the wanted proportion of tokens of some sources, small ones too; a source that has none is served
    when those have run dry. Without targets each source has its share of all tokens, so that every window holds the
    mixture of the corpus; sources with less than LEAST tokens a window share a queue. Every id lies in exactly one piece; all windows but the last are full. Null and empty texts
    are END_ID alone; a null source counts as the source ''. Each row is a document of its own, whatever its id, so
    repeated rows and null ids are packed too. An empty table gives no pieces. Other columns are ignored.
    """
    spark = docs.sparkSession
    stored = cut(tokenized(docs, tokenizer, id_col, text_col, source_col).withColumn("row", F.monotonically_increasing_id()), "tokens")
    totals = cut(stored.groupBy("source").agg(F.sum("n").alias("n")), "totals")
    total = totals.agg(F.sum("n")).first()[0] or 0
    # At most window / LEAST sources are this large; those with a target have a queue of their own, however small.
    wanted = {k: w for k, w in (targets or {}).items() if w > 0}
    alone = F.col("n") * window >= LEAST * F.lit(total)
    large = [(r["source"], r["n"]) for r in totals.where(alone | F.col("source").isin(list(wanted))).orderBy(F.desc("n"), "source").collect()]
    rest = total - sum(n for _, n in large)
    sizes = [n for _, n in large]
    shared = len(sizes)
    if rest and large and targets is None and rest * window < LEAST * total:
        shared -= 1
        sizes[-1] += rest
    elif rest or not sizes:
        sizes.append(rest)
    if targets is None:
        weights = sizes
    else:
        whole = sum(wanted.values())
        weights = [max(1, round(1e9 * wanted[s] / whole)) if s in wanted else 0 for s, _ in large] + [0] * (len(sizes) - len(large))
    mixture = Mixture(sizes, weights, window)
    names = spark.createDataFrame([(s, q) for q, (s, _) in enumerate(large)], "source string, queue int")
    places = running_total(
        stored.select("row", "source", "n").join(F.broadcast(names), "source", "left").select("row", "n", F.coalesce("queue", F.lit(shared)).alias("queue")),
        ["queue"], "row", "n", "before",
    )
    placed = stored.join(places.select("row", "queue", "before"), "row").select("doc_id", "source", "n", "ids", "queue", "before")
    long = F.lit(0).cast("long")
    schema = placed.select(
        "doc_id", "source", long.alias("start"), long.alias("length"), "ids", long.alias("doc_tokens"), long.alias("sequence_id"), long.alias("offset")
    ).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(part, of, rows, ids):
            starts, lengths, windows, offsets, whole = zip(*rows)
            named = part.select(["doc_id", "source"]).take(pa.array(of, pa.int64()))
            return pa.RecordBatch.from_arrays(
                [named.column(0), named.column(1), *(pa.array(x, pa.int64()) for x in (starts, lengths)), pa.array(ids, pa.binary()),
                 *(pa.array(x, pa.int64()) for x in (whole, windows, offsets))],
                ["doc_id", "source", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

        for part in batches:
            of, rows, out, held = [], [], [], 0
            for i, (n, packed, q, before) in enumerate(zip(*(part.column(c).to_pylist() for c in ("n", "ids", "queue", "before")))):
                ids = np.frombuffer(packed, "<u2").astype("<u4").tobytes()
                for at, length, w, offset in mixture.pieces(q, before, before + n):
                    start = at - before
                    of.append(i)
                    rows.append((start, length, w, offset, n))
                    out.append(ids[4 * start : 4 * (start + length)])
                held += len(ids)
                if held > 16_000_000:
                    yield batch(part, of, rows, out)
                    of, rows, out, held = [], [], [], 0
            if rows:
                yield batch(part, of, rows, out)

    return placed.mapInArrow(run, schema)


@query("op7_packing")
def op7_packing(spark, sf_dir):
    """All documents packed with the corpus's own mixture in every sequence."""
    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
