"""Runs of repeated word sequences, found by recompression.

The words of a slice of texts become one sequence of numbers. Rounds of block compression (a stretch of one symbol
becomes a symbol) and pair compression (symbols are divided in two classes; a left one before a right one becomes a
symbol) turn it into a run-length grammar of logarithmic height: equal stretches become equal symbols but for a few at
their ends. A grammar answers how far two places agree by climbing while they do and descending where they differ,
forwards and backwards, for many pairs of places at a time.

A run of period q and at least four periods holds three grid places 2kq, 2kq + q and 2kq + 2q with one and the same
word. Grid places of that kind are the candidates; their exact extensions by the grammar are the runs.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlens.llm.common import query, table, text_batches

LEAST, EXPONENT = 6, 4
WORD = r"[^\x20\x09-\x0D]+"
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


class _Level:
    """A sequence of symbols and how the next level groups them: where its symbols start, and which one holds a place."""

    def __init__(self, symbols: np.ndarray):
        self.symbols = symbols
        self.starts = self.holder = np.zeros(0, np.int64)
        self.pairs = False

    def group(self, first: np.ndarray, pairs: bool) -> None:
        self.starts = np.append(np.flatnonzero(first), len(self.symbols))
        self.holder = np.cumsum(first) - 1
        self.pairs = pairs


class Grammar:
    """The run-length grammar of a sequence whose first and last symbols occur nowhere else in it."""

    def __init__(self, symbols: np.ndarray):
        self.levels = [_Level(symbols.astype(np.int64))]
        self.names = int(symbols.max()) + 1 if len(symbols) else 1
        salt = 0
        while len(self.levels[-1].symbols) > 1:
            self._compress_blocks()
            if len(self.levels[-1].symbols) > 1:
                self._compress_pairs(salt)
            salt += 1

    def _named(self, keys: np.ndarray) -> np.ndarray:
        known, place = np.unique(keys, return_inverse=True)
        names = self.names + place
        self.names += len(known)
        return names

    def _compress_blocks(self) -> None:
        level = self.levels[-1]
        symbols = level.symbols
        first = np.append(True, symbols[1:] != symbols[:-1])
        if first.all():
            return
        level.group(first, False)
        sizes, above = np.diff(level.starts), symbols[level.starts[:-1]]
        long = sizes > 1
        above[long] = self._named(above[long] * (len(symbols) + 1) + sizes[long])
        self.levels.append(_Level(above))

    def _compress_pairs(self, salt: int) -> None:
        level = self.levels[-1]
        symbols = level.symbols
        mixed = (symbols.astype(np.uint64) + np.uint64(salt + 1)) * np.uint64(0x9E3779B97F4A7C15)
        side = ((mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)) & np.uint64(1)
        left_first, right_first = (side[:-1] < side[1:]), (side[:-1] > side[1:])
        joined = left_first if left_first.sum() >= right_first.sum() else right_first
        if not joined.any():
            return
        level.group(np.append(True, ~joined), True)
        above, at = symbols[level.starts[:-1]], np.flatnonzero(joined)
        above[level.holder[at]] = self._named(symbols[at] * self.names + symbols[at + 1])
        self.levels.append(_Level(above))

    def extend(self, a: np.ndarray, b: np.ndarray, forward: bool) -> np.ndarray:
        """How many symbols agree from places ``a`` and ``b`` on (forward) or before them (backward); a and b differ pairwise."""
        x, y = a.astype(np.int64), b.astype(np.int64)
        back = 0 if forward else 1
        turned: list[np.ndarray] = []
        active = np.arange(len(x))
        for level in self.levels:  # up: while the symbols agree, step to the next border and climb
            same = level.symbols[x[active] - back] == level.symbols[y[active] - back]
            stop, active = active[~same], active[same]
            if len(active):
                p, q = x[active], y[active]
                hp, hq = level.holder[p - back], level.holder[q - back]
                if forward:
                    border = (level.starts[hp] == p) & (level.starts[hq] == q)
                    rest_p, rest_q = level.starts[hp + 1] - p, level.starts[hq + 1] - q
                else:
                    border = (level.starts[hp + 1] == p) & (level.starts[hq + 1] == q)
                    rest_p, rest_q = p - level.starts[hp], q - level.starts[hq]
                step = np.where(border, 0, np.minimum(rest_p, rest_q)) * (1 - 2 * back)
                x[active], y[active] = p + step, q + step
                apart = ~border & (rest_p != rest_q)
                stop, active = np.concatenate([stop, active[apart]]), active[~apart]
                x[active], y[active] = level.holder[x[active]], level.holder[y[active]]
            turned.append(stop)
            if not len(active):
                break
        down = np.zeros(0, np.int64)
        for h in range(len(turned) - 1, 0, -1):  # down: the parts of two differing symbols agree in one symbol or stretch at most
            down = np.concatenate([down, turned[h]])
            lower = self.levels[h - 1]
            hp, hq = x[down], y[down]
            p, q = lower.starts[hp], lower.starts[hq]
            same = lower.symbols[p - back] == lower.symbols[q - back]
            if lower.pairs:
                step = same.astype(np.int64)
            elif forward:
                step = same * np.minimum(lower.starts[hp + 1] - p, lower.starts[hq + 1] - q)
            else:
                step = same * np.minimum(p - lower.starts[hp - 1], q - lower.starts[hq - 1])
            x[down], y[down] = p + step * (1 - 2 * back), q + step * (1 - 2 * back)
        return x - a if forward else a - x


def candidates(symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray, exponent: int = EXPONENT, most: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Grid places and periods at which a text has one word three times in a row, in parts of about ``most`` places.

    A run of at least four periods q holds two steps of a grid of 2q: none is missed, whatever its place.
    """
    periods = sizes // exponent
    text = np.repeat(np.arange(len(sizes)), periods)
    period = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    places = (sizes[text] - 1) // (2 * period)
    parts = np.searchsorted(np.cumsum(places), np.arange(0, places.sum() + most, most))
    for low, high in zip(parts[:-1], np.append(parts[1:-1], len(text))):
        n = places[low:high]
        owner = np.repeat(np.arange(low, high), n)
        q = period[owner]
        grid = starts[text[owner]] + 2 * q * (np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n))
        same = symbols[grid] == symbols[grid + q]
        grid, q = grid[same], q[same]
        same = symbols[grid] == symbols[grid + 2 * q]
        yield grid[same], q[same]


def _smallest(runs: np.ndarray) -> np.ndarray:
    """Of rows start, length, period, each stretch once with the smallest of its periods."""
    runs = runs[:, np.lexsort((runs[2], runs[1], runs[0]))]
    first = np.ones(runs.shape[1], bool)
    first[1:] = (runs[:2, 1:] != runs[:2, :-1]).any(axis=0)
    return runs[:, first]


def find_runs(sequences: list[np.ndarray], least: int = LEAST, exponent: int = EXPONENT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, start, length, period) of all runs in ``sequences`` of numbers from 0, by sequence, start and period.

    A run cannot be lengthened without breaking its smallest period q, and is at least ``least`` and ``exponent`` * q
    long (``exponent`` from 4).
    """
    sizes = np.array([len(s) for s in sequences], np.int64)
    names = max((int(s.max()) + 1 for s in sequences if len(s)), default=0)
    # Symbols of their own stand before, between and after the sequences.
    parts = [np.array([names], np.int64)]
    for k, s in enumerate(sequences):
        parts += [s, np.array([names + 1 + k], np.int64)]
    symbols = np.concatenate(parts)
    starts = np.cumsum(sizes + 1) - sizes
    grammar, found = None, []
    for grid, q in candidates(symbols, starts, sizes, exponent):
        if len(grid):
            grammar = grammar or Grammar(symbols)
            before = grammar.extend(grid, grid + q, forward=False)
            length = before + grammar.extend(grid, grid + q, forward=True) + q
            kept = length >= np.maximum(least, exponent * q)
            found.append(_smallest(np.stack([(grid - before)[kept], length[kept], q[kept]])))
    if not found:
        return (np.zeros(0, np.int64),) * 4
    start, length, period = _smallest(np.concatenate(found, axis=1))
    order = np.lexsort((period, start))
    start, length, period = start[order], length[order], period[order]
    owner = np.searchsorted(starts, start, side="right") - 1
    return owner, start - starts[owner], length, period


def collapsed(words: list[bytes], runs: Iterator[tuple[int, int, int]]) -> bytes:
    """The words joined by spaces, without those that a run holds after its first period."""
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    dropped = np.cumsum(change[:-1]) > 0
    return b" ".join(w for w, d in zip(words, dropped.tolist()) if not d)


def collapse_runs(docs: DataFrame, text_col: str = "text", least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """``docs`` without its texts, with ``runs`` (start, length and period in words) and ``collapsed``, the text without repetitions.

    Words end at ASCII white space. Whole texts are read, some megabytes at a time; a longer text is taken alone. Null
    texts are like empty ones: no runs, an empty collapsed text. Repeated rows and null ids are rows like any other, an
    empty table gives an empty result. Columns named ``runs`` or ``collapsed`` are replaced; others are kept.
    """
    others = [c for c in docs.columns if c not in (text_col, "runs", "collapsed")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row") if others else F.lit(None).cast("string").alias("row"), F.col(f"`{text_col}`").alias("text"))
    schema = rows.select("row", F.lit(None).cast(RUNS).alias("runs"), F.lit("").alias("collapsed")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_batches(batches, "text", 2_000_000):
            names: dict[bytes, int] = defaultdict(count().__next__)
            words = [t.encode().split() for t in texts]  # bytes split at ASCII white space only
            ids = [np.fromiter(map(names.__getitem__, w), np.int64, len(w)) for w in words]
            owner, start, length, period = find_runs(ids, least, exponent)
            bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
            plain = [
                collapsed(w, zip(start[lo:hi], length[lo:hi], period[lo:hi])) if lo < hi else b" ".join(w)
                for w, lo, hi in zip(words, bounds[:-1], bounds[1:])
            ]
            runs = pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], ["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), runs), pa.array(plain, pa.binary()).cast(pa.string())], schema.names
            )

    found = rows.mapInArrow(run, schema)
    return found.select(*(["row.*"] if others else []), "runs", "collapsed")


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; of equal ones the first. Null where there is none."""
    first = F.get(runs, F.lit(0))
    return F.reduce(runs, first, lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))


def with_periods(docs: DataFrame) -> DataFrame:
    """``docs`` with a repetition written into one text of ten, by the checksum h of its id: h % 10 = 0.

    With n words, g = h // 10, a = g % n and p = 1 + (n - a) // (3 + g % 8), words from a on repeat the p words there.
    Other texts stay as they are; a null id has no checksum.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0))
    shaped = docs.withColumn("_g", F.floor(h / 10)).withColumn("_w", F.when(h % 10 == 0, words)).withColumn("_n", F.size("_w").cast("long"))
    shaped = shaped.withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")))
    shaped = shaped.withColumn("_p", 1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8)))
    at = lambda w, i: F.when(i < F.col("_a"), w).otherwise(F.get(F.col("_w"), (F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int")))
    rewritten = F.array_join(F.transform("_w", at), " ")
    return shaped.withColumn("text", F.when(F.col("_p").isNotNull(), rewritten).otherwise(F.col("text"))).drop("_g", "_w", "_n", "_a", "_p")


_CRC = "list_reduce(list_transform(string_split({}, ''), lambda c: ord(c)::bigint), lambda c, b: list_reduce(range(8), lambda r, i: if(r % 2 = 1, xor(r // 2, 3988292384), r // 2), xor(c, b)), 4294967295)"
ORACLE = f"""
with crc as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as words,
    xor({_CRC.format("doc_id::varchar")}, 4294967295) as h from documents),
shaped as (select r, doc_id, words, h, len(words)::bigint as n, case when h % 10 = 0 and len(words) > 0 then (h // 10) % len(words) end as a from crc),
d as (select r, doc_id, n, case when a is null then words
    else list_transform(range(n), lambda i: words[1 + if(i < a, i, a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)))]) end as words from shaped),
w as materialized (select r, i, t, t || ' ' || lead(t) over (partition by r order by i) as u from (select r, unnest(range(n)) as i, unnest(words) as t from d)),
periods as (select r, n, unnest(range(1, n // 4 + 1)) as q from d),
grid as (select r, q, unnest(range(0, (n - 1) // (2 * q))) * 2 * q as g from periods),
one as materialized (select grid.r, q, g, t, u from grid join w on w.r = grid.r and w.i = g),
two as materialized (select one.r, q, g, one.t from one join w on w.r = one.r and w.i = g + q and w.u = one.u),
maybe as materialized (select distinct two.r, q from two join w on w.r = two.r and w.i = g + 2 * q and w.t = two.t),
equal as (select maybe.r, q, x.i, x.i - row_number() over (partition by maybe.r, q order by x.i) as island from maybe join w x on x.r = maybe.r join w y on y.r = maybe.r and y.i = x.i + q and y.t = x.t),
stretches as (select r, q, min(i) as s, count(*) + q as l from equal group by r, q, island),
runs as materialized (select r, s, l, min(q) as p from stretches where l >= greatest(6, 4 * q) group by r, s, l),
lists as (select r, count(*) as n_runs, sha256(string_agg(s || ',' || l || ',' || p || chr(10), '' order by s, p)) as runs_sha256 from runs group by r),
best as (select r, s, l, p from runs qualify row_number() over (partition by r order by l::double / p desc, s, p) = 1),
gone as (select distinct r, i from (select r, unnest(range(s + p, s + l)) as i from runs)),
kept as (select w.r, string_agg(t, ' ' order by w.i) as text from w anti join gone on w.r = gone.r and w.i = gone.i group by w.r)
select doc_id, coalesce(n_runs, 0)::bigint as n_runs, s::bigint as start, l::bigint as length, p::bigint as period, (1000 * l // p)::bigint as exponent_milli,
    coalesce(runs_sha256, sha256('')) as runs_sha256, sha256(coalesce(kept.text, '')) as collapsed_sha256
from d left join lists using (r) left join best using (r) left join kept using (r)
"""


@query("op11_periodic_runs", ORACLE)
def op11_periodic_runs(spark, sf_dir):
    """Runs of every document, after a repetition was written into a tenth of them, and digests of what is left."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = collapse_runs(with_periods(docs)).withColumn("best", strongest(F.col("runs")))
    listed = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
