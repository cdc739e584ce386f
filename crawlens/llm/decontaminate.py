"""Benchmark decontamination by SimHash over item-sized windows.

Every position of every document opens a window of as many word shingles as a benchmark item has; the window's
64-bit SimHash is taken from running sums over the document. A multi-index of the items' fingerprints (four blocks of
16 bits, each matched within three bits) finds every window within RADIUS bits: fifteen differing bits leave one block
with three at most. What it finds is verified by the exact similarity of weighted shingle sets.

The items are the query set: they go to the tasks in blocks of bounded size, and each block meets all documents in one
pass without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlens.llm.common import kept, query, running_total, table, text_batches, without
from crawlens.scale import cut

SIZE, SIMILARITY, RADIUS = 5, 0.8, 15
#: Items whose sizes are within this factor share windows of the smallest one's size; each is verified at its own size.
ALIKE = 1.05
#: Characters of items that one pass over the documents takes.
BLOCK_CHARS = 4_000_000
_CHUNK, _PIECE = 32_768, 1 << 20
_WORDS = bytes(b if chr(b).isalnum() or b > 127 else 32 for b in range(256))
_MARKS = re.compile("[\x80-\xa9\xab-\xb4\xb6-\xb9\xbb-\xbf -⁯　-〿︰-﹏]")
_STEPS = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)
_PLACES = np.cumprod(np.full(SIZE, 0xD6E8FEB86659FD93, np.uint64), dtype=np.uint64)
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()
_NEAR = np.array([sum(1 << b for b in bits) for n in range(RADIUS // 4 + 1) for bits in combinations(range(16), n)], np.uint16)


def words_only(text: str) -> bytes:
    """Lower-case words in UTF-8; ASCII signs and the common marks of other scripts become spaces."""
    lower = text.lower()
    if not lower.isascii():
        lower = _MARKS.sub(" ", lower)
    return lower.encode().translate(_WORDS)


def _mixed(x: np.ndarray) -> np.ndarray:
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(factor)
    return x ^ (x >> np.uint64(33))


def _word_hashes(piece: bytes) -> np.ndarray:
    """A 64-bit hash of every word; the piece has a space at both ends."""
    octets = np.frombuffer(piece, np.uint8)
    space = octets == 32
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edges[0::2], edges[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    lengths = ends - starts
    letters = octets[~space].astype(np.uint64)
    firsts = np.cumsum(lengths) - lengths
    within = np.arange(len(letters)) - np.repeat(firsts, lengths)
    return _mixed(np.add.reduceat((letters + np.uint64(1)) * _STEPS[within & 4095], firsts) + lengths.astype(np.uint64))


class Shingles:
    """Hashes of the word shingles of several texts, one after the other.

    ``starts`` has where each text's shingles begin, and the end. A text of fewer words than a shingle is one shingle.
    """

    def __init__(self, texts: list[str]):
        found, counts = [], []
        for start in range(0, len(texts), 256):
            joined = [words_only(t) for t in texts[start : start + 256]]
            buffer = b" " + b" ".join(joined) + b" "
            # Long buffers are hashed piece by piece, cut at spaces.
            at = 0
            while at < len(buffer) - 1:
                end = buffer.find(b" ", min(at + _PIECE, len(buffer) - 1))
                found.append(_word_hashes(buffer[at : end + 1]))
                at = end
            counts += [len(j.split()) for j in joined]
        words = np.concatenate([*found, np.zeros(SIZE, np.uint64)])
        n = np.array(counts, np.int64)
        size = np.where(n >= SIZE, n - SIZE + 1, np.minimum(n, 1))
        self.starts = np.concatenate([[0], np.cumsum(size)])
        ends = np.cumsum(n)
        at = np.arange(self.starts[-1]) + np.repeat(ends - n - self.starts[:-1], size)
        limit = np.repeat(ends, size)
        total = np.zeros(len(at), np.uint64)
        for j in range(SIZE):
            total += np.where(at + j < limit, words[np.minimum(at + j, len(words) - 1)], np.uint64(0)) * _PLACES[j]
        self.hashes = _mixed(total)


def _lanes(hashes: np.ndarray, width: int) -> np.ndarray:
    """The 64 bits of each hash as counters of ``width`` bytes, in 64-bit words."""
    octets = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    if width == 1:
        return _LANES[octets]
    return np.unpackbits(octets, axis=1).astype(f"u{width}").view(np.uint64)


def _running(hashes: np.ndarray, width: int) -> np.ndarray:
    lanes = _lanes(hashes, width)
    return np.concatenate([np.zeros((1, lanes.shape[1]), np.uint64), np.cumsum(lanes, axis=0, dtype=np.uint64)])


def _prints(counts: np.ndarray, sizes, width: int) -> np.ndarray:
    """Fingerprints from differences of running sums; a bit is set if it is in over half of the hashes."""
    each = np.ascontiguousarray(counts).view(f"u{width}").reshape(len(counts), 64)
    return np.packbits((each > np.asarray(sizes, f"u{width}") // 2).ravel()).view(np.uint64)


def _width(size: int) -> int:
    return 1 if size < 256 else 2 if size < 65_536 else 4


class ItemIndex:
    """Multi-index over the fingerprints of a block of items (id, text), by item size."""

    def __init__(self, items: list[tuple[int, str]]):
        kept = [(i, t) for i, t in items if words_only(t).split()]
        shingles = Shingles([t for _, t in kept]) if kept else None
        self.ids = [i for i, _ in kept]
        self.counts, self.sizes, by_size = [], [], {}
        for k in range(len(kept)):
            own = shingles.hashes[shingles.starts[k] : shingles.starts[k + 1]]
            width = _width(len(own))
            sums = _running(own, width)
            self.counts.append(Counter(own.tolist()))
            self.sizes.append(len(own))
            by_size.setdefault(len(own), []).append((k, _prints(sums[-1:] - sums[:1], len(own), width)[0]))
        self.classes = []
        groups: list[tuple[int, list]] = []
        for size, members in sorted(by_size.items()):
            if not groups or size > ALIKE * groups[-1][0] or _width(size) != _width(groups[-1][0]):
                groups.append((size, []))
            groups[-1][1].extend(members)
        for size, members in groups:
            prints = np.array([p for _, p in members], np.uint64)
            blocks = prints.view(np.uint16).reshape(-1, 4)
            tables = np.zeros((4, 1 << 16), bool)
            for b in range(4):
                tables[b, (blocks[:, b, None] ^ _NEAR).ravel()] = True
            self.classes.append((size, [k for k, _ in members], prints, tables))

    def candidates(self, prints: np.ndarray, members: list[int], own: np.ndarray, tables: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(item, positions) of all fingerprints within RADIUS bits of an item."""
        blocks = prints.view(np.uint16).reshape(-1, 4)
        maybe = tables[0].take(blocks[:, 0])
        for b in (1, 2, 3):
            maybe |= tables[b].take(blocks[:, b])
        at = np.flatnonzero(maybe)
        near = prints[at]
        for k, p in zip(members, own):
            hit = at[np.bitwise_count(near ^ p) <= RADIUS]
            if len(hit):
                yield k, hit

    def windows(self, shingles: Shingles) -> Iterator[tuple[int, np.ndarray, int]]:
        """(item, window starts, window size) of all windows within RADIUS bits."""
        hashes, starts = shingles.hashes, shingles.starts
        sizes = np.diff(starts)
        text_end = np.repeat(starts[1:], sizes)
        for width in (1, 2, 4):
            classes = [c for c in self.classes if _width(c[0]) == width]
            if not classes:
                continue
            longest = classes[-1][0]
            for low in range(0, len(hashes), _CHUNK):
                sums = _running(hashes[low : low + _CHUNK + longest], width)
                for size, members, own, tables in classes:
                    n = min(_CHUNK, len(sums) - size)
                    if n > 0:
                        prints = _prints(sums[size : size + n] - sums[:n], size, width)
                        for k, hit in self.candidates(prints, members, own, tables):
                            hit = hit + low
                            hit = hit[text_end[hit] >= hit + size]
                            if len(hit):
                                yield k, hit, size
        # Texts shorter than an item are windows as a whole, if they can be similar enough.
        for size, members, own, tables in self.classes:
            short = np.flatnonzero((sizes < size) & (sizes >= SIMILARITY * size) & (sizes > 0))
            if len(short):
                width = _width(size)
                sums = np.array([_lanes(hashes[starts[t] : starts[t + 1]], width).sum(axis=0, dtype=np.uint64) for t in short])
                prints = _prints(sums, sizes[short][:, None], width)
                for k, hit in self.candidates(prints, members, own, tables):
                    for t in short[hit]:
                        yield k, starts[t : t + 1], int(sizes[t])

    def matches(self, texts: list[str]) -> list[tuple[int, int, float, int, int]]:
        """(text, item, similarity, first word, words) of the best window of each text and item that are similar."""
        shingles = Shingles(texts)
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        for k, hits, size in self.windows(shingles):
            item, whole = self.counts[k], self.sizes[k]
            texts_of = np.searchsorted(shingles.starts, hits, side="right") - 1
            for hit, text in zip(hits.tolist(), texts_of.tolist()):
                low, high = int(shingles.starts[text]), int(shingles.starts[text + 1])
                # At the item's own size, the window may start a little earlier.
                n = min(max(size, whole), high - low) if size >= SIMILARITY * whole and high - low >= size else size
                for at in range(max(low, min(hit, high - n) - max(0, whole - size)), min(hit, high - n) + 1):
                    shared = sum((Counter(shingles.hashes[at : at + n].tolist()) & item).values())
                    similarity = shared / (n + whole - shared)
                    if similarity >= SIMILARITY:
                        best[text, k] = max(best.get((text, k), (0.0, 0, 0)), (similarity, low - at, n))
        return [(text, k, s, -at, n + SIZE - 1) for (text, k), (s, at, n) in sorted(best.items())]


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_chars: int) -> Iterator[tuple[tuple[int, str], ...]]:
    """The items with an id and a text, in blocks of about so many characters (one longer item is a block)."""
    rows = items.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).dropna().distinct()
    sized = running_total(rows.withColumn("n", F.char_length("text")).withColumn("one", F.lit(1)), ["one"], "id", "n", "before", ties=("text",))
    placed = cut(sized.select("id", "text", F.floor(F.col("before") / block_chars).alias("block")), "items")
    for (block,) in placed.select("block").distinct().orderBy("block").collect():
        yield tuple((r["id"], r["text"]) for r in placed.where(F.col("block") == block).orderBy("id", "text").collect())


def contaminated(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """Pairs of documents and items: doc_id, item_id, similarity, first_word, n_words (of the best window).

    A pair is a document with a window of the item's size whose five-word shingles, as a weighted set, are at least
    0.8 similar (Jaccard) to the item's. A document of fewer shingles than the item is a window as a whole. Items
    without words or an id match nothing, nor do null and empty texts. Repeated documents match each for themselves,
    null ids included; repeated items with the same id are one. Without documents or items there are no pairs.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    types = {"item_id": "long", "similarity": "double", "first_word": "long", "n_words": "long"}
    schema = rows.select("doc_id", *(F.lit(None).cast(t).alias(c) for c, t in types.items())).schema

    def pass_over(block: tuple[tuple[int, str], ...]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = kept(("items", *block), lambda: ItemIndex(list(block)))
            for part, texts in text_batches(batches, "text", 2_000_000):
                found = index.matches(texts)
                if found:
                    text, item, similarity, first, n = zip(*found)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id").take(pa.array(text)), pa.array([index.ids[k] for k in item], pa.int64()), pa.array(similarity, pa.float64()), pa.array(first, pa.int64()), pa.array(n, pa.int64())],
                        schema.names,
                    )

        return rows.mapInArrow(run, schema)

    out = None
    for block in item_blocks(items, item_col, item_text, block_chars):
        found = pass_over(block)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def keep_clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns; cases as in ``contaminated``.

    Rows go by their text, so a clean row stays whatever else has its id or none. Other columns come back as they are,
    whatever their names.
    """
    sha = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    keyed = docs.select(sha.alias("sha"), F.col(text_col).alias("text"))
    dirty = contaminated(keyed, items, "sha", "text").select(F.col("doc_id").alias("key"), F.lit(False).alias("kept"))
    return without(docs, sha, dirty)


@query("op6_decontamination")
def op6_decontamination(spark, sf_dir):
    """Every document that holds a benchmark item, with the item and their similarity."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
