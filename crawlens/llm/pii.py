"""Personal data with offset-preserving deobfuscation.

The plain identifiers are found in the text as it stands. Texts that hold traces of a disguise are then rewritten by
a chain of transducers, each of which maps every output character to the source characters it came from: look-alike
letters and digits of other scripts and invisible characters, spelled digits, and written-out "at" and "dot". What the
same patterns find in the rewritten text goes back through the chain as a span of the source.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlens.llm.common import query, table, text_batches

KINDS = ("email", "ip", "card", "phone")

# The patterns of the four kinds. Possessive forms and the look-behind only spare retries that can't succeed.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

# Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "А": "A", "в": "b", "В": "B", "с": "c", "С": "C", "ԁ": "d", "е": "e", "Е": "E", "һ": "h", "Н": "H", "і": "i", "І": "I", "ј": "j", "Ј": "J",
    "к": "k", "К": "K", "ӏ": "l", "м": "m", "М": "M", "о": "o", "О": "O", "р": "p", "Р": "P", "ԛ": "q", "ѕ": "s", "Ѕ": "S", "т": "t", "Т": "T", "у": "y", "У": "Y",
    "х": "x", "Х": "X", "α": "a", "Α": "A", "Β": "B", "ε": "e", "Ε": "E", "Η": "H", "ι": "i", "Ι": "I", "κ": "k", "Κ": "K", "Μ": "M", "ν": "v", "Ν": "N",
    "ο": "o", "Ο": "O", "ρ": "p", "Ρ": "P", "τ": "t", "Τ": "T", "υ": "u", "Υ": "Y", "χ": "x", "Χ": "X", "Ζ": "Z", "ı": "i", "ⅼ": "l", "ⅰ": "i",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "․": ".", "。": ".", "·": ".", "٫": ".",
    " ": " ", " ": " ", " ": " ", " ": " ", " ": " ",
}
# Characters without a width.
INVISIBLE = "­᠎​‌‍⁠﻿"
# Digits as words, in the languages of the corpus.
SPELLED = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_FULL_WIDTH = {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
_FOREIGN_DIGITS = {base + n: str(n) for base in (0x0660, 0x06F0, 0x0966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6) for n in range(10)}
_CHARACTERS = {**{ord(a): b for a, b in HOMOGLYPHS.items()}, **_FULL_WIDTH, **_FOREIGN_DIGITS, **{ord(c): "" for c in INVISIBLE}}
_ODD = re.compile("[" + "".join(map(re.escape, map(chr, _CHARACTERS))) + "]")

_AT_WORDS, _DOT_WORDS = "at|arroba|arobase|chez|ät", "dot|punkt|point|punto"
_AT_BRACKETED = re.compile(rf"\s{{0,3}}[\[({{<]\s{{0,3}}(?:{_AT_WORDS}|@)\s{{0,3}}[\])}}>]\s{{0,3}}", re.I)
_DOT_BRACKETED = re.compile(rf"\s{{0,3}}[\[({{<]\s{{0,3}}(?:{_DOT_WORDS}|\.)\s{{0,3}}[\])}}>]\s{{0,3}}", re.I)
# Bare words: only a whole address spelled with both counts, as either word alone is ordinary prose.
_BARE = re.compile(
    rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}(?: (?:{_DOT_WORDS}) [A-Za-z0-9_%+-]{{1,64}}){{0,4}} (?:{_AT_WORDS}) [A-Za-z0-9-]{{1,63}}(?: (?:{_DOT_WORDS}) [A-Za-z0-9-]{{1,63}}){{1,5}}(?![A-Za-z0-9])(?![A-Za-z0-9._%+-]{{0,64}}@)", re.I
)
# A real "@" with spelled dots around it. Next to a plain address these words are often prose, so "dot" alone counts
# in front of one, and after one only what ends domains.
_NAME = "[A-Za-z0-9_%+-]"
_HALF_BARE = re.compile(
    rf"(?<={_NAME})@[A-Za-z0-9-]{{1,63}}+(?: (?:{_DOT_WORDS}) [A-Za-z0-9-]{{1,63}}+){{1,5}}(?![A-Za-z0-9])"
    rf"|(?<={_NAME})@[A-Za-z0-9-]{{1,63}}+(?:\.[A-Za-z0-9-]{{1,63}}+){{1,5}}(?: (?:{_DOT_WORDS}) (?:com|org|net|edu|gov|info|biz)| dot [A-Za-z]{{2}}){{1,3}}(?![A-Za-z0-9])"
    rf"|(?<![A-Za-z0-9._%+-]){_NAME}{{1,64}}+(?: dot {_NAME}{{1,64}}+){{1,4}}(?=@[A-Za-z0-9-])",
    re.I,
)
_BARE_AT, _BARE_DOT = re.compile(rf" (?:{_AT_WORDS}) ", re.I), re.compile(rf" (?:{_DOT_WORDS}) ", re.I)
_DIGIT_WORD = "|".join(sorted(map(re.escape, SPELLED), key=lambda w: (-len(w), w)))
# Spelled digits count in runs of three or more digits, spelled or not, as one alone is prose.
_SPELLED_RUN = re.compile(rf"(?<!\w)(?:plus[ ,-]{{1,2}})?(?:{_DIGIT_WORD}|[0-9]++)(?:[ ,-]{{1,2}}(?:{_DIGIT_WORD}|(?:dot|punkt|point|punto)|[0-9]+)){{2,}}(?!\w)", re.I)
# Numbers around spelled dots are an address only where all four are there.
_SPELLED_IP = re.compile(rf"(?<!\w)[0-9]{{1,3}}(?:(?: {{1,2}}(?:{_DOT_WORDS}) {{1,2}}|\.)[0-9]{{1,3}}){{3}}(?!\w)", re.I)
_IP_DOT = re.compile(rf" {{1,2}}(?:{_DOT_WORDS}) {{1,2}}", re.I)
_SPELLED_PART = re.compile(rf"(?P<digit>{_DIGIT_WORD})|(?P<plus>plus)|(?P<dot>{_DOT_WORDS})|(?P<gap>[ ,-]+)", re.I)
# What a disguise can't do without, to be sought in lower case.
_TRACES = (
    re.compile(rf"[\[({{<]\s{{0,3}}(?:{_AT_WORDS}|@|{_DOT_WORDS}|\.)\s{{0,3}}[\])}}>]"),
    re.compile(rf"(?:{_DIGIT_WORD})[ ,-]{{1,2}}(?:{_DIGIT_WORD}|[0-9])"),
)
_BARE_TRACES = tuple(f" {w} " for w in _DOT_WORDS.split("|"))


def disguised(text: str) -> bool:
    """Whether the text may hold a disguise; what says no has none."""
    if not text.isascii() and _ODD.search(text):
        return True
    lower = text.lower()
    return any(w in lower for w in _BARE_TRACES) or any(t.search(lower) for t in _TRACES)


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = 2 * n - 9 * (n > 4)
        total += n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the plain identifiers, leftmost and non-overlapping per kind; in time linear in the text."""
    found = []
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            found.append(("email", start, end))
        elif start < at:
            pass
        # The run before a failed "@" is not searched again: the next local part starts after it.
        end = max(end, at + 1)
        at = text.find("@", end)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m.group().split(".")):
            found.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _NOT_DIGIT.sub("", m.group())
            if 14 <= len(digits) <= 19 and _luhn(digits):
                found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                found.append(("phone", m.start(), m.end()))
    return sorted(found, key=_order)


def _order(span: tuple[str, int, int]) -> tuple[int, int]:
    return span[1], KINDS.index(span[0])


class Rewritten:
    """A text and, for each of its characters, the source span it stands for (``ends`` holds one more for the end)."""

    def __init__(self, text: str, starts=None, ends=None):
        self.text = text
        self.starts = range(len(text)) if starts is None else starts
        self.ends = range(1, len(text) + 1) if ends is None else ends

    def replaced(self, pieces: Iterator[tuple[int, int, str]]) -> Rewritten:
        """With each (start, end, replacement), in order, put in: every new character stands for the whole piece."""
        text, starts, ends, at = [], [], [], 0
        for start, end, new in pieces:
            text += (self.text[at:start], new)
            starts += self.starts[at:start]
            ends += self.ends[at:start]
            if new:
                starts += [self.starts[start]] * len(new)
                ends += [self.ends[end - 1]] * len(new)
            at = end
        text.append(self.text[at:])
        starts += self.starts[at:]
        ends += self.ends[at:]
        return Rewritten("".join(text), starts, ends)


def _characters(r: Rewritten) -> Rewritten:
    return r.replaced((m.start(), m.end(), _CHARACTERS[ord(m.group())]) for m in _ODD.finditer(r.text))


def _digits(r: Rewritten) -> Rewritten:
    r = r.replaced((x.start(), x.end(), ".") for m in _SPELLED_IP.finditer(r.text) for x in _IP_DOT.finditer(r.text, m.start(), m.end()))

    def pieces():
        for run in _SPELLED_RUN.finditer(r.text):
            if not _SPELLED_PART.search(run.group()) or not any(w for w in re.split(r"[ ,-]+", run.group().lower()) if w in SPELLED):
                continue
            for m in _SPELLED_PART.finditer(r.text, run.start(), run.end()):
                new = SPELLED[m.group().lower()] if m.lastgroup == "digit" else {"plus": "+", "dot": ".", "gap": ""}[m.lastgroup]
                yield m.start(), m.end(), new

    return r.replaced(pieces())


def _addresses(r: Rewritten) -> Rewritten:
    def pieces():
        for m in _BARE.finditer(r.text):
            yield from sorted([(x.start(), x.end(), "@") for x in _BARE_AT.finditer(r.text, m.start(), m.end())] + [(x.start(), x.end(), ".") for x in _BARE_DOT.finditer(r.text, m.start(), m.end())])

    r = r.replaced(pieces())
    # The part before an "@" and the part after it are matches of their own.
    r = r.replaced((x.start(), x.end(), ".") for m in _HALF_BARE.finditer(r.text) for x in _BARE_DOT.finditer(r.text, m.start(), m.end()))
    bracketed = sorted([(m.start(), m.end(), "@") for m in _AT_BRACKETED.finditer(r.text)] + [(m.start(), m.end(), ".") for m in _DOT_BRACKETED.finditer(r.text)])
    return r.replaced(iter(bracketed))


def added_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans of disguised identifiers: found in the rewritten text, as spans of the source text.

    One that a base span of its kind covers wholly adds nothing; others may overlap base spans, which are then a part
    of the disguised identifier.
    """
    if not disguised(text):
        return []
    r = _addresses(_digits(_characters(Rewritten(text))))
    if r.text == text:
        return []
    out, at = [], {kind: 0 for kind in KINDS}
    taken = {kind: sorted((s, e) for k, s, e in base if k == kind) for kind in KINDS}
    for kind, start, end in base_spans(r.text):
        s, e = r.starts[start], r.ends[end - 1]
        if e - s == end - start and text[s:e] == r.text[start:end]:
            continue  # nothing in it was disguised
        own = taken[kind]  # without overlaps, as are the spans of the rewritten text: both are passed once
        while at[kind] < len(own) and own[at[kind]][1] < e:
            at[kind] += 1
        if at[kind] == len(own) or s < own[at[kind]][0]:
            out.append((kind, s, e))
    return out


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and added: arrays of (kind, start, end), code points, end exclusive, by start and then kind.

    ``base`` has the plain identifiers, ``added`` the disguised ones, which may hold base spans. Null and empty texts have none;
    repeated rows and null ids are rows like any other; an empty table gives an empty result; other columns are ignored.
    """
    spans = "array<struct<kind:string,start:int,end:int>>"
    schema = docs.select(F.col(id_col).alias("doc_id"), F.lit(None).cast(spans).alias("base"), F.lit(None).cast(spans).alias("added")).schema
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = lambda spans: [{"kind": k, "start": s, "end": e} for k, s, e in spans]
        for part, texts in text_batches(batches, "text"):
            base = [base_spans(t) for t in texts]
            added = [sorted(added_spans(t, b), key=_order) for t, b in zip(texts, base)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(map(named, base), kind), pa.array(map(named, added), kind)], ["doc_id", "base", "added"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping spans are one, of the first one's kind."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=_order):
        if start >= at:
            out += (text[at:start], f"<{kind}>")
        at = max(at, end)
    return "".join(out) + text[at:]


@query("op8_pii")
def op8_pii(spark, sf_dir):
    """Counts and digest of the plain identifiers, and all spans, of every document."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    rank = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    both = F.transform(
        F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))),
        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")),
    )
    found = find_personal_data(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *map(count, KINDS), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(both).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )
